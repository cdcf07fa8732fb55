"""Toxicity: a factorization machine over hashed terms.

``train`` fits the machine on a bounded sample of labelled documents; ``score`` applies it to whole texts.
A text is the set of its lower-cased words and of their beginnings of ``STEMS`` bytes (insults are inflected),
each hashed into one of 2**20 buckets. Besides a weight per
bucket the machine has a vector per bucket whose inner products weigh pairs of terms, so an insult beside a
group's mention can count for more than the sum of both.

Bounded sample (a documented parameter): at most ``SAMPLE_ROWS`` labelled documents, those with the smallest
hash of doc_id; equal texts count once. All counts for the choice of buckets run over that sample as
DataFrame aggregates; only the chosen buckets of each sampled row reach the driver.

Edge cases: a null or empty text has no terms and gets the score of the bias alone; a label that is null is
no label; a doc_id labelled more than once counts as toxic if any label says so; repeated rows are scored
each; with no labelled rows, or only one class, every score is the smoothed base rate. Columns of ``docs``
named like an output are replaced by the output.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage, table, text_batches

BUCKETS = 1 << 20
SAMPLE_ROWS = 20_000
TERMS = 512
FACTORS = 6
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7)
WORD_CACHE = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> set[bytes]:
    return set(_WORD.findall(text.encode("utf-8", "surrogatepass").lower())) if text else set()


def buckets(word: bytes) -> list[int]:
    """Of the word and of its beginnings."""
    return [zlib.crc32(t) & (BUCKETS - 1) for t in (word, *(b"^" + word[:k] for k in STEMS if k <= len(word)))]


@dataclass
class FactorizationMachine:
    """index: bucket -> row of weights and vectors."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities for rows of distinct term indices."""
        out = np.full(len(rows), self.bias)
        for i, r in enumerate(rows):
            if r:
                v = self.vectors[r]
                s = v.sum(0)
                out[i] += self.weights[r].sum() + 0.5 * float(s @ s - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 30, l2: float = 2e-3, rate: float = 0.05, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by Adam on the logistic loss; x: rows of 0 and 1."""
    n, m = x.shape
    rng = np.random.default_rng(seed)
    base = (y.sum() + 1.0) / (n + 2.0)
    p = [np.array(np.log(base / (1 - base))), np.zeros(m), rng.normal(0, 0.01, (m, factors))]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if n and 0 < y.sum() < n else 0):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            b = order[at : at + 512]
            xb = x[b].astype(np.float64)
            s = xb @ p[2]
            z = p[0] + xb @ p[1] + 0.5 * ((s * s).sum(1) - xb @ (p[2] * p[2]).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            grads = [g.sum(), xb.T @ g + l2 * p[1] / 10, xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * p[2] + l2 * p[2]]
            t += 1
            for a, q, k, d in zip(first, second, range(3), grads, strict=True):
                a *= 0.9
                a += 0.1 * d
                q *= 0.999
                q += 0.001 * d * d
                p[k] = p[k] - rate * (a / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    return float(p[0]), p[1], p[2]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(y, buckets) of the sampled labelled documents; rows whose crc32(doc_id) mod 3 is 1 are held out."""
    spark = docs.sparkSession
    text_batches(spark)
    chosen = (
        labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy("doc_id").agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")

    def hashed(batches):
        for batch in batches:
            found = [sorted({b for w in terms(t) for b in buckets(w)}) for t in batch.column(0).to_pylist()]
            digest = [hash(tuple(f)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(digest, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["y", "digest", "buckets"])

    return stage(texts.mapInArrow(hashed, "y int, digest long, buckets array<int>").groupBy("digest").agg(F.max("y").alias("y"), F.first("buckets").alias("buckets")).select("y", "buckets"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, n_terms: int = TERMS) -> FactorizationMachine:
    """Fit on the sample; buckets are the n_terms with the largest chi-square against the label."""
    sample = labelled_sample(docs, labels, label, rows)
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    per = sample.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").cast("double").alias("df"), F.sum("y").cast("double").alias("a")).where("df >= 4")
    n_, p_ = F.lit(float(n)), F.lit(float(pos))
    expected = F.col("df") * p_ / n_
    chi = (F.col("a") - expected) ** 2 * n_ * n_ / (F.col("df") * p_ * (n_ - F.col("df") + 1) * (n_ - p_ + 1) / n_ + 1e-9)
    top = [r.b for r in per.orderBy(chi.desc(), "b").limit(n_terms).collect()] if 0 < pos < n else []
    index = {b: i for i, b in enumerate(top)}
    # A bounded answer: sampled rows times at most n_terms small numbers.
    kept = sample.select("y", F.array_intersect("buckets", F.lit(top) if top else F.array().cast("array<int>")).alias("b")).collect() if top else []
    x = np.zeros((len(kept), len(top)), dtype=np.int8)
    for i, r in enumerate(kept):
        x[i, [index[b] for b in r.b]] = 1
    if not top:
        rate = (pos + 1.0) / (n + 2.0)
        return FactorizationMachine({}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS)))
    order = np.lexsort(x.T)  # the same order of rows however they came
    bias, w, v = fit(x[order], np.array([r.y for r in kept], dtype=np.float64)[order])
    return FactorizationMachine(index, bias, w, v)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold)."""
    text_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        cache: dict[bytes, tuple[int, ...]] = {}
        get = model.index.get
        for batch in batches:
            rows = []
            for t in batch.column(keep.index("text")).to_pylist():
                found = set()
                for w in terms(t):
                    i = cache.get(w)
                    if i is None:
                        if len(cache) > WORD_CACHE:
                            cache.clear()
                        i = cache[w] = tuple(get(b) for b in buckets(w) if b in model.index)
                    if i:
                        found.update(i)
                rows.append(sorted(found))
            p = model.scores(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, f"{fields}, score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
