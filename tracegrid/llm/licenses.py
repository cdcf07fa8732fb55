"""License scans: matching statistics against a generalised suffix automaton of licence texts.

All templates, as sequences of words, are inserted into one suffix automaton. A document streams through it:
after each word the automaton's state and length tell the longest run of words ending there that occurs in any
template. Where such a run ends and is long enough, each of its places in a template is a fragment; fragments
of a template that follow each other in both texts, with few words between, are chained into a span. A span
that covers enough of its template gives the template's label; the score is the best coverage.

Base phrases are templates too. A phrase ends at a word exactly if its state is above the current one in the
automaton's suffix links (or is it, with enough length), so all places of base phrases come from the same pass.

Edge cases: a null or empty text has no words, empty labels, score 0 and null places; repeated rows are scanned
each; a document may be any length, as fragments are chained in one pass; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_batches

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose every place counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices and openings of public licences, with their labels.
TEMPLATES = (
    ("mit", "mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words of a match to count as a fragment, words between chained fragments, share of a template that a span must cover.
MIN_MATCH, MAX_GAP, MIN_COVERAGE = 3, 6, 0.7


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


@dataclass
class Automaton:
    """A generalised suffix automaton of sequences of small numbers."""

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Where a state's strings end: pairs (sequence, words up to the end).
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _new(self, length: int, link: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.go) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = clone
        while p >= 0 and self.go[p].get(symbol) == q:
            self.go[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for at, symbol in enumerate(sequence, 1):
            q = self.go[last].get(symbol)
            if q is not None:  # another sequence has been here
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
            else:
                new = self._new(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in self.go[p]:
                    self.go[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.go[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                last = new
            self.ends[last].append((number, at))

    def finish(self) -> None:
        """Give every state the places of the states below it."""
        for s in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]}) if self.link[s] > 0 else []

    def state_of(self, sequence: list[int]) -> int:
        s = 0
        for symbol in sequence:
            s = self.go[s][symbol]
        return s


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, words(text)) for label, text in [*templates, *((label, text) for text, label in base)]]
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in self.templates:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.automaton = Automaton()
        for i, (_, ws) in enumerate(self.templates):
            self.automaton.add(i, [self.vocabulary[w] for w in ws])
        self.automaton.finish()
        a = self.automaton
        own: dict[int, list[tuple[int, str]]] = {}
        for text, label in base:
            ws = words(text)
            own.setdefault(a.state_of([self.vocabulary[w] for w in ws]), []).append((len(ws), label))
        #: For each state, the base phrases (words, label) at it and above it.
        self.phrases: list[list[tuple[int, str]]] = []
        for s in range(len(a.go)):
            found, at = [], s
            while at > 0:
                found += own.get(at, [])
                at = a.link[at]
            self.phrases.append(found)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words; base places (first word, label); spans (label, first word, last word, coverage), best first."""
        found = words(text)
        if not found:
            return 0, [], []
        known = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), dtype=np.int32, count=len(found))
        # Only runs of two and more known words can hold a phrase.
        hit = known >= 0
        pair = hit.copy()
        pair[1:] &= hit[:-1]
        pair[0] = False
        if not pair.any():
            return len(found), [], []
        inside = pair.copy()
        inside[:-1] |= pair[1:]
        at = np.flatnonzero(inside)
        go, link, length = self.automaton.go, self.automaton.link, self.automaton.length
        base, fragments = [], []
        state = size = 0
        before = -2
        for i, symbol in zip(at.tolist(), known[at].tolist(), strict=True):
            if i != before + 1:
                if size >= 2:
                    fragments.append((before, size, state))
                state = size = 0
            before = i
            old_state, old_size = state, size
            while state and symbol not in go[state]:
                state = link[state]
                size = length[state]
            nxt = go[state].get(symbol)
            state, size = (nxt, size + 1) if nxt is not None else (0, 0)
            if size <= old_size and old_size >= 2:
                fragments.append((i - 1, old_size, old_state))
            for n, label in self.phrases[state]:
                if size >= n:
                    base.append((i - n + 1, label))
        if size >= 2:
            fragments.append((before, size, state))
        return len(found), base, self._chain(fragments)

    def _chain(self, fragments: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """fragments: (last word, words, state) in the order of the document."""
        chains: dict[int, list[int]] = {}  # template: first and last word, place in the template, covered words
        done: dict[tuple[str, int, int], float] = {}

        def close(t: int) -> None:
            first, last, _, covered = chains.pop(t)
            label, ws = self.templates[t]
            share = min(1.0, covered / len(ws))
            if share >= MIN_COVERAGE:
                done[label, first, last] = max(share, done.get((label, first, last), 0.0))

        for last, size, state in fragments:
            places: dict[int, list[int]] = {}
            for t, end in self.automaton.ends[state]:
                if size >= min(MIN_MATCH, len(self.templates[t][1])):
                    places.setdefault(t, []).append(end)
            for t, ends in places.items():
                chain = chains.get(t)
                if chain:
                    # The nearest place behind the chain; words that both runs share count once.
                    new = last - max(last - size, chain[1])
                    fit = [e for e in ends if e - new >= chain[2]] if 0 < new and last - size - chain[1] <= MAX_GAP else []
                    if fit:
                        chain[1], chain[2], chain[3] = last, fit[0], chain[3] + new
                        continue
                    close(t)
                chains[t] = [last - size + 1, last, ends[0], size]
        for t in list(chains):
            close(t)
        return sorted(((label, a, b, share) for (label, a, b), share in done.items()), key=lambda x: (-x[3], x[1], x[0]))


_scanners: dict[tuple, Scanner] = {}


def scanner(templates=TEMPLATES, base=BASE) -> Scanner:
    """One for each worker process and set of templates."""
    if (templates, base) not in _scanners:
        _scanners[templates, base] = Scanner(templates, base)
    return _scanners[templates, base]


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, base places, spans) of whole texts."""
    text_batches(docs.sparkSession)
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches):
        for batch in batches:
            n, places, spans = [], [], []
            for text in batch.column(1).to_pylist():
                k, b, s = scanner(templates, base).scan(text)
                n.append(k)
                places.append([{"word": w, "label": x} for w, x in b])
                spans.append([{"label": x, "first_word": f, "last_word": t, "coverage": c} for x, f, t, c in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "base", "spans"])

    schema = "doc_id long, n_words long, base array<struct<word: long, label: string>>, spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


QUERIES = {"op1_licenses": op1_licenses}
SQL: dict[str, str] = {}
