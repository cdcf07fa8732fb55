"""The engine's data model over the driver's star-schema tables, as DataFrames and as SQL.

An order is a transaction: its customer and the wallets of returned lines fund it, the wallets of the other
lines are paid. Web events that aren't purchases are network records, purchases their transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import array_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; times without a zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def rnd(c: Column, digits: int = 6) -> Column:
    """Rounding that any engine with IEEE doubles does alike."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid, timestamp, inputs, outputs, input_amounts, output_amounts, fee, script_type."""
    line = F.struct("l_linenumber", F.concat(F.lit("W"), "l_partkey").alias("wallet"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").alias("back"), cents(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    tx = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    back, paid = F.filter("lines", lambda x: x["back"]), F.filter("lines", lambda x: ~x["back"])
    tx = tx.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("timestamp"), "o_orderpriority",
        F.transform(back, lambda x: x["wallet"]).alias("back"), F.transform(back, lambda x: x["amount"]).alias("back_amounts"),
        F.transform(paid, lambda x: x["wallet"]).alias("outputs"), F.transform(paid, lambda x: x["amount"]).alias("output_amounts"), F.transform("lines", lambda x: x["tax"]).alias("taxes"),
    ).where(F.size("outputs") > 0)
    own = cents(F.greatest(array_sum(F.col("output_amounts")) + array_sum(F.col("taxes")) - array_sum(F.col("back_amounts")), F.lit(0.01)))
    script = F.substring("o_orderpriority", 1, 1)
    return tx.withColumn("own", own).select(
        F.concat(F.lit("T"), "o_orderkey").alias("txid"), "timestamp", F.concat(F.array(F.concat(F.lit("W"), "o_custkey")), "back").alias("inputs"), "outputs",
        F.concat(F.array("own"), "back_amounts").alias("input_amounts"), "output_amounts",
        rnd(F.col("own") + array_sum(F.col("back_amounts")) - array_sum(F.col("output_amounts")), 8).alias("fee"),
        F.when(script == "1", "P2PKH").when(script == "2", "P2SH").when(script == "3", "P2WPKH").when(script == "4", "P2TR").otherwise("OP_RETURN").alias("script_type"),
    )


def flows(tx: DataFrame) -> DataFrame:
    """One row for each touch of a wallet by a transaction: txid, timestamp, wallet, side (in: spends), amount."""
    side = lambda name, kind: F.transform(F.arrays_zip(F.col(f"{name}s").alias("wallet"), F.col(f"{name}_amounts").alias("amount")), lambda x: F.struct(F.lit(kind).alias("side"), x["wallet"].alias("wallet"), x["amount"].alias("amount")))
    return tx.select("txid", "timestamp", F.explode(F.concat(side("input", "in"), side("output", "out"))).alias("x")).select("txid", "timestamp", "x.*")


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, timestamp, src_ip, dst_ip, txid, protocol."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").where("event_type <> 'purchase'").withColumn("k", k)
    ip = lambda a, *p: F.concat(F.lit(a), *(x for q in p for x in (F.lit("."), q)))
    user = (F.col("user_id") % 256).cast("string")
    return e.select(F.col("event_id").alias("rec"), F.col("ts").alias("timestamp"), ip("185.220", user, F.col("k").cast("string")).alias("src_ip"), ip("91.198", F.col("k").cast("string"), user).alias("dst_ip"), F.col("k").cast("string").alias("txid"), F.upper("event_type").alias("protocol"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("txid"), F.col("ts").alias("timestamp"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 97 = 0").select(F.concat(F.lit("W"), "c_custkey").alias("wallet"))


#: The same model in SQL; every oracle starts with it.
SQL = """
WITH li AS (SELECT l_orderkey k, l_linenumber n, 'W' || l_partkey w, l_extendedprice a, l_returnflag = 'R' r, floor(l_extendedprice * l_tax * 100 + 0.5) / 100 tax FROM lineitem),
ag AS (SELECT k, coalesce(list(w ORDER BY n) FILTER (r), []) ri, coalesce(list(a ORDER BY n) FILTER (r), []) ra, list(w ORDER BY n) FILTER (NOT r) ow, list(a ORDER BY n) FILTER (NOT r) oa, list(tax ORDER BY n) taxes FROM li GROUP BY k),
t0 AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, ri, ra, ow, oa,
  floor(greatest(list_sum(oa) + list_sum(taxes) - coalesce(list_sum(ra), 0), 0.01) * 100 + 0.5) / 100 own FROM orders JOIN ag ON o_orderkey = k WHERE ow IS NOT NULL),
tx AS (SELECT 'T' || o_orderkey txid, o_orderdate AS "timestamp", epoch_us(o_orderdate) us, ['W' || o_custkey] || ri inputs, ow outputs, [own] || ra input_amounts, oa output_amounts,
  floor((own + coalesce(list_sum(ra), 0) - list_sum(oa)) * 1e8 + 0.5) / 1e8 fee,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P2PKH' WHEN '2' THEN 'P2SH' WHEN '3' THEN 'P2WPKH' WHEN '4' THEN 'P2TR' ELSE 'OP_RETURN' END script_type FROM t0),
flows AS (SELECT txid, us, 'in' side, unnest(inputs) wallet, unnest(input_amounts) amount FROM tx UNION ALL SELECT txid, us, 'out', unnest(outputs), unnest(output_amounts) FROM tx),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) k FROM events),
net AS (SELECT event_id rec, epoch_us(ts) us, '185.220.' || (user_id % 256) || '.' || k src_ip, '91.198.' || k || '.' || (user_id % 256) dst_ip, CAST(k AS VARCHAR) txid, upper(event_type) protocol FROM ev WHERE event_type <> 'purchase'),
pur AS (SELECT CAST(event_id AS VARCHAR) txid, epoch_us(ts) us FROM events WHERE event_type = 'purchase'),
seeds AS (SELECT 'W' || c_custkey wallet FROM customer WHERE c_custkey % 97 = 0)
"""


class Registry:
    """Queries and their SQL, added where they are defined."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, model: bool = True):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                start = SQL.replace("WITH", "WITH RECURSIVE", 1) if "USING KEY" in sql else SQL  # recursion types unions by their first part
                self.sql[name] = (start + ", " * (not sql.lstrip().upper().startswith("SELECT")) if model else "") + sql
            return f

        return add
