"""Mined url rules against counts of all subsets, rare hosts, noisy families and later path segments."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tracegrid.llm import urls


def kept_rules(rows: list[tuple[list[str], int]]) -> dict[frozenset, float]:
    """All sets of tokens that are rules and have no part that is one at least as confident."""
    n, bad = Counter(), Counter()
    for tokens, b in rows:
        for k in range(1, len(tokens) + 1):
            for x in combinations(tokens, k):
                n[frozenset(x)] += 1
                bad[frozenset(x)] += b
    rules = {}
    for x, m in n.items():
        c = bad[x] / m
        if bad[x] >= 12 and c >= 0.6 and (c + 2 / m - 2 * math.sqrt(c * (1 - c) / m + 1 / m**2)) / (1 + 4 / m) >= 0.5:
            rules[x] = c
    return {x: c for x, c in rules.items() if not any(y < x and rules[y] >= c for y in rules)}


def test_mined_url_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        tokens = sorted({f"{kind}{rng.randrange(4)}" for kind in "abcde"} | ({"a0x", "a0y"} if rng.random() < 0.2 else set()))
        odds = 0.95 if {"a1", "b2"} <= set(tokens) else 0.75 if "c0" in tokens else 1.0 if {"d1", "e1"} <= set(tokens) else 0.1
        rows.append((tokens, int(rng.random() < odds)))
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad int"))
    want = kept_rules(rows)
    assert len(want) > 3 and {frozenset(t): c for t, c, _ in got} == pytest.approx(want)


def test_rare_bad_hosts_and_noisy_families_are_blocked(spark):
    """Twenty bad hosts with ten tokens that only come together, a noisy family, and a host below 0.2 % of the urls."""
    page = lambda i: f"http://a{i % 20}.b{i % 20}.c{i % 20}.d{i % 20}.e{i % 20}.org/x{i % 20}/y{i % 20}/f.s{i % 20}?q{i % 20}=1" if i < 400 else f"http://noisy.org/n/{i}" if i < 800 else f"http://rare.org/r/{i}" if i < 815 else f"http://fine{i % 7}.org/p/{i}"
    bad = lambda i: i < 400 or i < 800 and i % 5 > 0 or 800 <= i < 815
    pages = [(i, page(i)) for i in range(9000)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(i, int(not bad(i)), 0) for i in range(9000)], "doc_id long, quality int, toxic int"))
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == set(range(815))


def test_later_path_segments_give_rules(spark):
    pages = [(i, f"http://a.org/en/2020/{'casino' if i % 2 else 'news'}/x{i}/y") for i in range(400)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == {i for i in range(400) if i % 2}
