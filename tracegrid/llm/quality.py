"""Quality rules with risk-controlled cutoffs. DataFrame and SQL functions only.

``measure`` computes the counts of whole texts inside each row (no shuffle). ``calibrate`` chooses for each stratum
one vector of cutoffs, for all rules together, from labelled rows that pass the base rules:

1. On one third of them (selection) each rule gets the rung of its fixed ladder with the best margin of rejected bad
   rows over PENALTY times rejected good rows; a rule without a positive margin isn't used. The rules' rungs are
   tightened together, from none to that one, in STEPS steps: a fixed sequence of joint vectors.
2. On the others (certification) a step with k of n good rows rejected by any rule is certified if the exact binomial
   tail P(X <= k | n, alpha) is at most delta / strata. Steps are tested from the most lenient on and the first
   failure ends the sequence, which needs no correction; Bonferroni is over the strata alone. With probability
   1 - delta no stratum loses more than alpha of its good rows to the rules together.
3. Among certified steps the selection rows pick the one with the best margin, the most lenient of equal ones.

A stratum needs about ln(delta / strata) / ln(1 - alpha) good certification rows (some 220 with four strata) before
anything can be certified; rows of smaller strata are judged by the base rules alone. Any number of strata is
handled alike.

Edge cases: a null or empty text has no words, so all counts are 0 and the base rule rejects it; a null
stratum is a stratum of its own; repeated rows are judged each; a doc_id labelled more than once counts as
bad if any label says so; without labels no cutoff is certified. Input columns named like an output are
replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_broadcast, documents, stage, table

ALPHA = 0.02
DELTA = 0.05
PENALTY = 10.0
STEPS = 10
MIN_WORDS = 50

#: Rule: (value of the counts, larger is worse; its ladder from lenient to strict).
LADDERS: dict[str, list[float]] = {
    "symbols": [1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05],
    "repeats": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "lines": [0.2, 0.15, 0.1, 0.07, 0.05, 0.035, 0.025, 0.015, 0.01],
    "shouting": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "long_words": [40.0, 30.0, 20.0, 15.0, 12.0, 11.0, 10.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts"]

_WORDS = r"regexp_extract_all(coalesce(text, ''), r'[^\x20\x09-\x0D]+', 0)"
#: Windows of three words as sorted longs: a hash above, the place in the b low bits.
_KEYS = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), length(bin(size(w)))) | i))"
#: Places whose window is also that of a neighbour in that order; equal hashes are verified word by word.
_SAME = "shiftright({a}, b) = shiftright({b}, b) and w[int({a} & m)] = w[int({b} & m)] and w[int({a} & m) + 1] = w[int({b} & m) + 1] and w[int({a} & m) + 2] = w[int({b} & m) + 2]"
_REPEATED = f"filter(s, (x, j) -> (j > 0 and {_SAME.format(a='x', b='s[j - 1]')}) or (j < size(s) - 1 and {_SAME.format(a='x', b='s[j + 1]')}))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and body with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


_COVERED = _let(f"sort_array(transform({_REPEATED}, x -> x & m))", "p", "aggregate(transform(p, (x, j) -> if(j = 0, 3L, least(3L, x - p[j - 1]))), 0L, (a, x) -> a + x)")
_N_REPEAT = "if(size(w) < 4, 0L, " + _let("length(bin(size(w)))", "b", _let("shiftleft(1L, b) - 1", "m", _let(_KEYS, "s", _COVERED))) + ")"
_LINES = r"filter(split(coalesce(text, ''), r'\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')"
_MEASURES = _let(
    _WORDS,
    "w",
    "named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))), 'n_symbols', bigint(regexp_count(coalesce(text, ''), r'[#*$%&|<>]')), "
    f"'n_dup_lines', {_let(_LINES, 'l', 'bigint(size(l) - size(array_distinct(l)))')}, 'n_repeat_words', {_N_REPEAT}, "
    r"'n_shouts', bigint(regexp_count(coalesce(text, ''), r'[\p{Lu}!]')))",
)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the counts of COUNTS and base_failed."""
    keep = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "kept", "_measures")]
    return (
        docs.select(*keep, F.expr(_MEASURES).alias("_measures"))
        .select(*keep, *(F.col(f"_measures.{c}").alias(c) for c in COUNTS))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _values() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.col("word_chars").cast("double")
    return {
        "symbols": F.col("n_symbols") / n,
        "repeats": F.col("n_repeat_words") / n,
        "lines": F.col("n_dup_lines") / n,
        "shouting": F.col("n_shouts") / F.greatest(chars, F.lit(1.0)),
        "long_words": chars / n,
        "short_words": -chars / n,
    }


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of chance p, exactly, term by term in logarithms; 1 where k > n * p."""
    step = f"ln(double({n}) - i + 1) - ln(double(i)) + ln({p!r}D) - ln(1 - {p!r}D)"
    first = f"named_struct('t', double({n}) * ln(1 - {p!r}D), 's', double({n}) * ln(1 - {p!r}D))"
    merge = _let(f"a.t + {step}", "t", "named_struct('t', t, 's', greatest(a.s, t) + ln(1 + exp(-abs(a.s - t))))")
    return F.expr(f"if({k} > {n} * {p!r}D, 1D, if({k} = 0, exp({n} * ln(1 - {p!r}D)), exp(aggregate(sequence(1L, greatest({k}, 1L)), {first}, (a, i) -> {merge}).s)))")


def _stratum(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>, step, n, k, tail, margin): one row per stratum with a certified step."""
    truth = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min((F.col(label) == 1).cast("int")).alias("good"))
    # The first rung that rejects a row is the number of cutoffs that its value doesn't exceed.
    rung_of = lambda ladder, v: F.size(F.filter(F.array(*map(F.lit, ladder)), lambda c: c >= v))
    first = [rung_of(LADDERS[r], v).alias(r) for r, v in _values().items()]
    rows = measured.where(~F.col("base_failed")).select("doc_id", _stratum(stratum).alias("stratum"), *first).join(truth, "doc_id")
    rows = stage(rows.withColumn("certify", F.crc32(F.col("doc_id").cast("string")) % 3 != 0).drop("doc_id"), "quality-rows")

    # The rungs up to which each rule goes: one pass of partial sums, then a few rows per stratum.
    over = [F.sum((F.col(r) <= i).cast("long")).alias(f"{r}_{i}") for r, ladder in LADDERS.items() for i in range(len(ladder))]
    sums = rows.where("not certify").groupBy("stratum", "good").agg(*over)
    rungs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("rung"), F.col(f"{r}_{i}").alias("k")) for r, ladder in LADDERS.items() for i in range(len(ladder)))))
    gain = F.sum(F.when(F.col("good") == 0, F.col("k")).otherwise(-PENALTY * F.col("k")))
    margins = sums.withColumn("x", rungs).select("stratum", "good", "x.*").groupBy("stratum", "rule", "rung").agg(gain.alias("margin"))
    best = margins.groupBy("stratum", "rule").agg(F.max(F.struct("margin", (-F.col("rung")).alias("lenient"))).alias("b")).where("b.margin > 0")
    ends = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", (1 - F.col("b.lenient")).alias("rungs")))).alias("ends"))

    # The first step at which any rule rejects a row; STEPS + 1 for none.
    step = F.least(*(F.coalesce(F.ceil(STEPS * (F.col(r) + 1) / F.col("ends")[r]), F.lit(STEPS + 1)) for r in LADDERS))
    counts = rows.join(ends, "stratum").withColumn("first", step).groupBy("stratum", "good", "certify", "first").agg(F.count("*").alias("m"))
    of = lambda good, certify: F.coalesce(F.sum(F.when((F.col("good") == good) & (F.col("certify") == certify) & (F.col("first") <= F.col("step")), F.col("m"))), F.lit(0))
    tests = (
        counts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).groupBy("stratum", "step")
        .agg(F.coalesce(F.sum(F.when((F.col("good") == 1) & F.col("certify"), F.col("m"))), F.lit(0)).alias("n"), of(1, True).alias("k"), (of(0, False) - PENALTY * of(1, False)).alias("margin"))
    )
    n_strata = max(1, rows.select("stratum").distinct().count())
    so_far = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    certified = tests.withColumn("tail", binomial_tail("k", "n", alpha)).withColumn("certified", F.min(F.col("tail") <= F.lit(delta / n_strata)).over(so_far)).where("certified")
    chosen = certified.groupBy("stratum").agg(F.max(F.struct("margin", (-F.col("step")).alias("lenient"), "step", "n", "k", "tail")).alias("b")).where("b.margin > 0")
    rung = lambda r: F.floor(F.col("b.step") * F.col("ends")[r] / STEPS)
    cutoff = [F.when(rung(r) > 0, F.struct(F.lit(r).alias("rule"), F.element_at(F.array(*map(F.lit, ladder)), rung(r).cast("int")).alias("cutoff"))) for r, ladder in LADDERS.items()]
    return chosen.join(ends, "stratum").select("stratum", F.map_from_entries(F.array_compact(F.array(*cutoff))).alias("cutoffs"), "b.step", "b.n", "b.k", "b.tail", "b.margin")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``carry``) with the counts, base_failed, kept and the failed rules; measured once, staged for both uses."""
    measured = measure(docs)
    measured = stage(measured if carry is None else measured.select(*carry, *COUNTS, "base_failed"), "quality")
    cutoffs = stage(calibrate(measured, labels, stratum, "quality", alpha, delta).select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs")), "quality-cutoffs")
    judged = measured.drop("failed_rules", "_stratum", "_cutoffs").join(bounded_broadcast(cutoffs), _stratum(stratum) == F.col("_stratum"), "left")
    failed = F.array_compact(F.array(*(F.when(v > F.col("_cutoffs")[r], F.lit(r)) for r, v in _values().items())))
    return judged.withColumn("failed_rules", failed).drop("_stratum", "_cutoffs").withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    judged = apply_rules(docs, table(spark, sf_dir, "labels"), carry=["doc_id", "lang"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
