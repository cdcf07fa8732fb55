"""URL filters: fixed rules first, then rules mined from labelled urls.

A url's tokens are its host's labels, its registered name, its path segments with their places (numbers as one
token), its file suffix, the names of its query's parameters and whether it has a fragment. Spark's FP-growth finds
the combinations of tokens that at least ``MIN_ROWS`` bad urls have; the good urls that have them too are counted by
an inverted index. A rule "tokens -> block" is kept if its confidence and the lower end of that confidence's interval
are high enough, and if none of its parts has a rule at least as confident. All this is decided on the executors, and
there is no limit on rules. Kept rules match by an inverted index: each is filed under its rarest token, so a url only
meets rules of tokens that it has.

Before FP-growth, tokens that lie in exactly the same urls become one item, and a token that is a rule of confidence 1
by itself is taken out, as all that contain it are redundant: so tokens that always come together don't give all their
combinations.

Labels: a url is bad if its label has quality 0 or toxic 1. All labelled urls are mined, and all urls judged.

Edge cases: a null url or one without "://" has an empty host and path, fits no rule and has no tokens, so it is
allowed; repeated rows are judged each; without labelled urls, or without bad ones, nothing is mined; other
columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_ROWS, MIN_CONFIDENCE, MIN_LOWER = 12, 0.6, 0.5
_END = re.compile(r"[/?#]")
_QUERY_OR_FRAGMENT = re.compile(r"[?#]")


def parse(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; the host's A-Z in lower case."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _END.search(rest)) else len(rest)
    host = rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    tail = rest[end:]
    return host, tail[: m.start()] if (m := _QUERY_OR_FRAGMENT.search(tail)) else tail


def fitting(host: str, path: str, rules=RULES) -> tuple[str, str] | tuple[None, None]:
    """(rule, verdict) of the longest rule that fits, if any."""
    best = max(((len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (best[1], best[2]) if best else (None, None)


def tokens(url: str | None) -> list[str]:
    """Sorted distinct tokens."""
    host, path = parse(url)
    if not host and not path:
        return []
    labels = host.split(".")
    out = {f"host:{x}" for x in labels if x} | {"name:" + ".".join(labels[-2:])}
    segments = [x for x in path.split("/") if x]
    out |= {f"path{i}:{'#' if x.split('.')[0].isdigit() else x}" for i, x in enumerate(segments)}
    if segments and "." in segments[-1]:
        out.add("suffix:" + segments[-1].rpartition(".")[2])
    tail = url[url.find("://") + 3 :]
    query = tail.partition("?")[2].partition("#")[0]
    out |= {"query:" + x.partition("=")[0] for x in query.split("&") if x}
    if "#" in tail:
        out.add("fragment")
    return sorted(out)


def tokenized(pages: DataFrame) -> DataFrame:
    """(page_id, tokens)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(u) for u in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["page_id", "tokens"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, tokens array<string>")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the kept rules for the class "block", from (tokens, bad)."""
    rows = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "urls-rows")
    total, bad = rows.agg(F.sum("n"), F.sum("bad")).first()
    if not total or bad < MIN_ROWS:
        return []
    # Wilson's lower end for the confidence, at two standard errors.
    c, n = F.col("bad") / F.col("n"), F.col("n")
    lower = (c + 2 / n - 2 * F.sqrt(c * (1 - c) / n + 1 / n**2)) / (1 + 4 / n)
    own = F.when((c >= min_confidence) & (lower >= MIN_LOWER), c).otherwise(0.0).alias("own")

    # Tokens by their urls: the sum of the rows' hashes tells sets of rows apart.
    each = rows.select("row", "n", "bad", F.explode("tokens").alias("t"))
    place = F.sum(F.xxhash64("row").cast("decimal(38,0)"))
    tokens_ = each.groupBy("t").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), place.alias("place")).where(F.col("bad") >= MIN_ROWS)
    items = stage(tokens_.groupBy("n", "bad", "place").agg(F.min("t").alias("item"), F.collect_list("t").alias("same")).select("item", "same", "n", "bad", own), "urls-items")
    kept = [([r.item], r.own, r.bad / total) for r in items.where("own = 1").select("item", "own", "bad").collect()]

    def spelled(kept: list) -> list[tuple[list[str], float, float]]:
        """The rules with each token that an item stands for: on other urls they may come apart."""
        used = sorted({x for parts, _, _ in kept for x in parts})
        same = {r.item: sorted(r.same) for r in items.where(F.col("item").isin(used)).select("item", "same").collect()} if used else {}
        return sorted(((sorted(x), c, s) for parts, c, s in kept for x in product(*(same[i] for i in parts))), key=lambda k: (len(k[0]), k[0]))

    open_ = items.where("own < 1")
    held = each.join(open_.select("item", F.explode("same").alias("t")), "t").groupBy("row").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.sort_array(F.collect_set("item")).alias("items"))
    held = stage(held, "urls-held")
    baskets = held.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1), "bad")).alias("_")).select("items")
    many = baskets.count()
    if not many:
        return spelled(kept)
    model = FPGrowth(itemsCol="items", minSupport=(MIN_ROWS - 0.5) / many).fit(baskets)
    sets = stage(model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("bad")), "urls-sets")
    # Each set's rows, good ones too: it is filed under the item with the fewest urls.
    rarest = F.struct("item_n", "item")
    filed = sets.withColumn("item", F.explode("items")).join(open_.select("item", F.col("n").alias("item_n")), "item").groupBy("items", "bad").agg(F.min(rarest).alias("r")).select("items", "bad", F.col("r.item").alias("item"))
    met = held.select("n", F.col("items").alias("own_items"), F.explode("items").alias("item")).join(filed, "item").where(F.size(F.array_except("items", "own_items")) == 0)
    sets = stage(met.groupBy("items", "bad").agg(F.sum("n").alias("n")).select("items", "bad", "n", own), "urls-sets")
    # upto: the highest confidence of a rule among a set's parts, from its parts of one item less.
    known = None
    for size in range(1, sets.agg(F.max(F.size("items"))).first()[0] + 1):
        level = sets.where(F.size("items") == size)
        if known is None:
            level = level.withColumn("upto", F.lit(0.0))
        else:
            parts = level.select("items", F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("part"))
            best = known.select(F.col("items").alias("part"), F.greatest("own", "upto").alias("best"))
            level = level.join(parts.join(best, "part").groupBy("items").agg(F.max("best").alias("upto")), "items")
        known = stage(level, "urls-level")
        kept += [(list(r["items"]), r.own, r.bad / total) for r in known.where("own > upto").select("items", "own", "bad").collect()]
    return spelled(kept)


def inverted(rules: list[tuple[list[str], float, float]], pages_with: dict[str, int]) -> dict[str, list[frozenset]]:
    """Rules by their rarest token."""
    index: dict[str, list[frozenset]] = {}
    for parts, _, _ in rules:
        index.setdefault(min(parts, key=lambda t: (pages_with.get(t, 0), t)), []).append(frozenset(parts))
    return index


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of pages; mined: the tokens of a mined rule that fits."""
    truth = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad is not null")
    labelled = tokenized(pages).join(truth, F.col("page_id") == F.col("doc_id")).where("size(tokens) > 0").select("tokens", "bad")
    mined = mine(labelled)
    used = sorted({t for parts, _, _ in mined for t in parts})
    counts = labelled.select(F.explode("tokens").alias("t")).where(F.col("t").isin(used)).groupBy("t").count().collect() if used else []
    index = inverted(mined, {r.t: r["count"] for r in counts})

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, path = parse(url)
                rule, verdict = fitting(host, path, rules)
                hit = None
                if rule is None:
                    own = set(tokens(url))
                    hit = min((sorted(r) for t in own for r in index.get(t, ()) if r <= own), default=None)
                    verdict = "block" if hit else "allow"
                out.append((page_id, host, path, rule, verdict, " ".join(hit) if hit else None))
            kinds = [pa.int64()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict", "mined"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_urls": op5_urls}
SQL: dict[str, str] = {}
