"""Reading record files of several formats into the two typed tables.

All cells are read as text; column names are folded and mapped by alias; a file's kind follows from its columns.
Kept rows of repeated keys are the first by file name and place in the file.
"""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import array_sum, blank_to_null, is_missing, parse_timestamp, split_amounts, split_list, to_float, to_int

log = logging.getLogger(__name__)

#: Accepted column names for each field; of several, the last in this order that is there wins.
TX_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime"],
    "txid": ["txid", "tx_id", "hash", "transaction_id"],
    "inputs": ["input_addresses", "inputs", "from_addresses"],
    "outputs": ["output_addresses", "outputs", "to_addresses"],
    "input_amounts": ["input_amounts", "input_values"],
    "output_amounts": ["output_amounts", "output_values"],
    "fee": ["fee", "tx_fee"],
    "script_type": ["script_type", "script", "type"],
    "src_ip": ["src_ip", "source_ip", "srcip"],
    "dst_ip": ["dst_ip", "destination_ip", "dstip"],
    "src_port": ["src_port", "source_port"],
    "dst_port": ["dst_port", "destination_port"],
    "geo_country": ["geo_country", "country", "country_code", "src_geo_country"],
    "geo_asn": ["geo_asn", "asn", "src_geo_asn"],
}
NETWORK_ALIASES = {k: TX_ALIASES[k] for k in ("timestamp", "txid", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "geo_asn")} | {"protocol": ["protocol", "proto"]}
TX_SIGNALS = ["inputs", "outputs", "input_amounts", "output_amounts", "fee", "script_type"]
NETWORK_SIGNALS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
RECORD_KEYS = ["records", "data", "transactions", "network", "network_metadata", "items"]
ARTEFACTS = {"graph.json", "alerts.json", "pipeline_summary.json", "explainer_meta.json", "planted_patterns.json"}
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xml": "xml"}


def canonical_key(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _as_text(df: DataFrame) -> DataFrame:
    """Every column as text; arrays joined by |; names folded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        elif isinstance(f.dataType, T.StructType):
            inner = [F.array_join(c[g.name], "|") if isinstance(g.dataType, T.ArrayType) else c[g.name].cast("string") for g in f.dataType.fields]
            c = F.concat_ws("|", *inner)
        else:
            c = c.cast("string")
        out.append(c.alias(canonical_key(f.name)))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _as_text(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill(""))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _as_text(spark.read.option("primitivesAsString", True).json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records; an object with the first list under one of RECORD_KEYS; else one record."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    for key in RECORD_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) and isinstance(df.schema[key].dataType.elementType, T.StructType):
            return _as_text(df.select(F.explode(key).alias("r")).select("r.*"))
    return _as_text(df)


def read_xml(spark: SparkSession, path: str, row_tag: str = "transaction") -> DataFrame:
    """Rows of row_tag; nested lists become |-joined text, a txid attribute stands in for the element."""
    df = _as_text(spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path))
    if "_txid" in df.columns:
        df = df.withColumn("txid", F.coalesce("txid", "_txid") if "txid" in df.columns else F.col("_txid")).drop("_txid")
    return df


def read_records(spark: SparkSession, path: str, row_tag: str = "transaction") -> DataFrame:
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    return read_xml(spark, path, row_tag) if kind == "xml" else {"csv": read_csv, "json": read_json, "jsonl": read_jsonl}[kind](spark, path)


def present(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Field: the column that gives it."""
    return {f: hit[-1] for f, names in aliases.items() if (hit := [n for n in names if n in columns])}


def guess_kind(columns: list[str]) -> str:
    """transactions, network, mixed or unknown, from the columns."""
    tx = len(set(present(columns, TX_ALIASES)) & set(TX_SIGNALS))
    net = len(set(present(columns, NETWORK_ALIASES)) & set(NETWORK_SIGNALS))
    if tx >= 2 and net >= 2:
        return "mixed"
    return "unknown" if tx == net else "transactions" if tx > net else "network"


def _any_present(df: DataFrame, aliases: dict[str, list[str]], signals: list[str]) -> Column:
    cols = [c for f, c in present(df.columns, aliases).items() if f in signals]
    out = F.lit(False)
    for c in cols:
        out = out | ~is_missing(F.col(c))
    return out


def split_mixed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transaction rows, network rows) of a file with both; a row may be in both."""
    return df.where(_any_present(df, TX_ALIASES, TX_SIGNALS)), df.where(_any_present(df, NETWORK_ALIASES, NETWORK_SIGNALS))


def _field(df: DataFrame, aliases: dict[str, list[str]], name: str) -> Column:
    c = present(df.columns, aliases).get(name)
    return F.col(c) if c else F.lit(None).cast("string")


def normalise_transactions(df: DataFrame) -> DataFrame:
    """The 14 columns of transactions; rows without time, id or any wallet go; a missing fee is what inputs exceed outputs by."""
    f = lambda n: _field(df, TX_ALIASES, n)
    out = df.select(
        parse_timestamp(f("timestamp")).alias("timestamp"), F.coalesce(blank_to_null(f("txid")), F.lit("")).alias("txid"), split_list(f("inputs")).alias("inputs"), split_list(f("outputs")).alias("outputs"),
        f("input_amounts").alias("ia"), f("output_amounts").alias("oa"), to_float(f("fee")).alias("fee"), F.coalesce(F.upper(blank_to_null(f("script_type"))), F.lit("UNKNOWN")).alias("script_type"),
        *(blank_to_null(f(c)).alias(c) for c in ("src_ip", "dst_ip", "geo_country", "geo_asn")), *(to_int(f(c)).alias(c) for c in ("src_port", "dst_port")),
    )
    out = out.withColumn("input_amounts", split_amounts(F.col("ia"), F.size("inputs"))).withColumn("output_amounts", split_amounts(F.col("oa"), F.size("outputs"))).drop("ia", "oa")
    spent = array_sum(F.col("input_amounts"))
    fee = F.when((F.col("fee") <= 0) & (spent > 0), F.round(F.greatest(spent - array_sum(F.col("output_amounts")), F.lit(0.0)), 8)).otherwise(F.col("fee"))
    out = out.withColumn("fee", fee).where("timestamp is not null and txid <> '' and (size(inputs) > 0 or size(outputs) > 0)")
    return out.select("timestamp", "txid", "inputs", "outputs", "input_amounts", "output_amounts", "fee", "script_type", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "geo_asn")


def normalise_network(df: DataFrame) -> DataFrame:
    """The 9 columns of network records; rows without time, or without both addresses, go."""
    f = lambda n: _field(df, NETWORK_ALIASES, n)
    out = df.select(
        parse_timestamp(f("timestamp")).alias("timestamp"), blank_to_null(f("src_ip")).alias("src_ip"), blank_to_null(f("dst_ip")).alias("dst_ip"), to_int(f("src_port")).alias("src_port"), to_int(f("dst_port")).alias("dst_port"),
        F.coalesce(blank_to_null(f("txid")), F.lit("")).alias("txid"), F.coalesce(F.upper(blank_to_null(f("protocol"))), F.lit("TCP")).alias("protocol"), blank_to_null(f("geo_country")).alias("geo_country"), blank_to_null(f("geo_asn")).alias("geo_asn"),
    )
    return out.where("timestamp is not null and (src_ip is not null or dst_ip is not null)")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """All files below a folder of any file system that Spark reads, sorted; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    if fs.exists(path):
        files = fs.listFiles(path, True)
        while files.hasNext():
            out.append(files.next().getPath().toString())
    return sorted(out)


def latest_folder(spark: SparkSession, parent: str) -> str | None:
    """The folder below parent that was changed last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    best = max(folders, key=lambda s: (s.getModificationTime(), s.getPath().getName()), default=None)
    return best.getPath().toString() if best is not None else None


def load_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """(transactions, network, seeds) of all readable files below folder; unreadable ones are reported and skipped."""
    tx, net, seeds = [], [], []
    for place, path in enumerate(file_names(spark, folder)):
        name = path.rpartition("/")[2]
        if name.startswith((".", "_")) or name in ARTEFACTS or os.path.splitext(name)[1].lower() not in FORMATS:
            continue
        try:
            if (found := seed_file(spark, path)) is not None:
                seeds += found
                continue
            df = read_records(spark, path)
            kind = guess_kind(df.columns)
        except Exception as error:  # noqa: BLE001  one bad file must not stop the others
            log.warning("skipped %s: %s", path, error)
            continue
        parts = split_mixed(df) if kind == "mixed" else (df if kind == "transactions" else None, df if kind == "network" else None)
        for rows, normalise, out in ((parts[0], normalise_transactions, tx), (parts[1], normalise_network, net)):
            if rows is not None:
                out.append(normalise(rows).withColumn("_file", F.lit(place)).withColumn("_row", F.monotonically_increasing_id()))

    def union(parts: list[DataFrame], keys: list[str]) -> DataFrame | None:
        if not parts:
            return None
        all_rows = parts[0]
        for p in parts[1:]:
            all_rows = all_rows.unionByName(p)
        return keep_first(all_rows, keys, ["_file", "_row"]).drop("_file", "_row")

    return union(tx, ["txid"]), union(net, ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid"]), seeds


#: A seed list has a few wallets; larger JSON files are records and aren't parsed to find out.
SEED_BYTES = 4 << 20


def seed_file(spark: SparkSession, path: str) -> list[str] | None:
    """Wallets of a seed list: an object with wallets and seed, and without counts."""
    if not path.endswith(".json"):
        return None
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= SEED_BYTES).select(F.decode("content", "UTF-8").alias("value")).first()
    if found is None:
        return None
    try:
        data = json.loads(found.value)
    except ValueError:
        return None
    if isinstance(data, dict) and "wallets" in data and "seed" in data and "counts" not in data:
        return [str(w) for w in data["wallets"]]
    return None


def seeds_table(spark: SparkSession, wallets: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in wallets], "wallet string").distinct()


def write_unified(df: DataFrame, path: str) -> None:
    """One CSV folder; lists joined with |, times as ISO text."""
    lists = {f.name: F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), "|") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    times = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    df.withColumns(lists | times).write.mode("overwrite").option("header", True).csv(path)

