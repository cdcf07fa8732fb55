"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

A text's BPE encoding has a last token, and so has each of its prefixes; the encoding of a prefix is that
last token behind the encoding of what precedes it. Distinct words are inserted into a trie (here: sorted, so
that a walk in order is the depth-first traversal and the stack holds the path). Going down, each node's last
token is found from its ancestors' states: among the vocabulary's tokens that end there, the longest whose
pair with the last token before it is one that the merges would leave alone. States of shared prefixes are so
computed once. A word's ids are read off the path backwards.

Texts are cut into words exactly as the vocabulary's pattern does; pieces between safe single spaces are
looked up in a bounded cache first. The end-of-text string in a text is its own token.

Edge cases: a null or empty text has no ids; bytes that don't decode become U+FFFD; repeated rows are encoded
each; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_batches

VOCABULARY = "byte_bpe_50k.json"
PIECE_CACHE, WORD_CACHE = 400_000, 400_000
#: The pattern that cuts a text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UNSAFE = re.compile(r" \s|\s ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.size = [len(b) for b in self.bytes_of]
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.id_of = {self.bytes_of[i]: i for i in vocabulary.values()}
        #: Ids by merge: (left, right) -> rank, and each token's rank and two parts; single bytes rank below all merges.
        self.rank = [-1] * len(self.bytes_of)
        self.parts = [(i, i) for i in range(len(self.bytes_of))]
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[x, y] = r
            if self.rank[z] < 0:
                self.rank[z], self.parts[z] = r, (x, y)
        #: Tokens by their bytes from the last to the first.
        self.suffixes: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for b, i in self.id_of.items():
            at = 0
            for c in reversed(b):
                at = self.suffixes[at].setdefault(c, len(self.suffixes))
                if at == len(self.suffixes):
                    self.suffixes.append({})
                    self.ends.append(-1)
            self.ends[at] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.cut = regex.compile(PATTERN).findall

    def stable(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a, b side by side: no merge across their border comes before those inside."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, rank, ok = a, b, self.rank, None
        limit = 1 << 60
        while ok is None:
            r = self.merged.get((x, y))
            if r is not None and r < limit:
                ok = False
            # Undo the later of the two merges: what then faces the border was there until that merge. Of equal
            # merges, the left one came first.
            elif rank[x] > rank[y]:
                limit, x = rank[x], self.parts[x][1]
            elif rank[y] >= 0:
                limit, y = rank[y] + 1, self.parts[y][0]
            else:
                ok = True
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def learn(self, words: list[bytes]) -> None:
        """Encode distinct words: one traversal of their trie."""
        size, suffixes, ends, stable = self.size, self.suffixes, self.ends, self.stable
        last, path = [-1], b""
        for word in sorted(words):
            depth, top = 0, min(len(word), len(path))
            while depth < top and word[depth] == path[depth]:
                depth += 1
            del last[depth + 1 :]
            for d in range(depth + 1, len(word) + 1):
                node, k, found = 0, d, []
                while k:
                    node = suffixes[node].get(word[k - 1], -1)
                    if node < 0:
                        break
                    k -= 1
                    if ends[node] >= 0:
                        found.append((ends[node], k))
                for token, k in reversed(found):
                    if not k or stable(last[k], token):
                        last.append(token)
                        break
            path = word
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= size[last[d]]
            self.words[word] = np.array(ids[::-1], dtype="<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        """Pieces whose words don't depend on each other."""
        if _UNSAFE.search(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > PIECE_CACHE:
            self.pieces = {"": b""}
        if len(self.words) > WORD_CACHE:
            self.words = {}
        split = [[self._split(s) if i % 2 == 0 else [s] for i, s in enumerate(re.split(f"({'|'.join(map(re.escape, self.special))})", t))] if t else [] for t in texts]
        new = {p: None for parts in split for k, s in enumerate(parts) if k % 2 == 0 for p in s if p not in self.pieces}
        for p in new:
            new[p] = [w.encode("utf-8", "replace") for w in self.cut(p)]
        self.learn([w for w in {w for ws in new.values() for w in ws} if w not in self.words])
        for p, ws in new.items():
            self.pieces[p] = b"".join([self.words[w] for w in ws])
        special = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        get = self.pieces.__getitem__
        return [b"".join([b"".join(map(get, s)) if k % 2 == 0 else special[s[0]] for k, s in enumerate(parts)]) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One for each worker process; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    text_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(vocabulary).encode_all(batch.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        for batch in batches:
            text = [encoder(vocabulary).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(documents(spark, sf_dir)))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
