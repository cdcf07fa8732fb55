"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

The word tokenizer never joins characters across white space, so a text's ids are those of its parts between
ASCII white space, one after the other. A part of plain Latin letters with plain marks behind it is two
tokens' worth of text, case folded; each piece met for the first time is encoded by the library and kept in a
bounded cache as bytes (little-endian unsigned 32-bit ids).
"""

from __future__ import annotations

import os
import re

import numpy as np

PART_CACHE, WORD_CACHE = 300_000, 600_000
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Precomposed letters that fold case by themselves, then marks that form one run of their own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#*$%&()\[\]{}=/+-]*)")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        #: The tokenizer's letter for each byte, as its byte-level step has it: printable bytes stand for themselves.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return found

    def _plain(self, word: str) -> bytes:
        """A run of letters goes straight to the library's model, without the steps that only long texts need."""
        found = self.words.get(word)
        if found is None:
            s = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.words[word] = np.array([t.id for t in self.model.tokenize(s)], dtype="<u4").tobytes()
        return found

    def _part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        found = self._plain(plain[1].lower()) + self._word(plain[2]) if plain else self._word(text)
        if len(part) < 64:
            self.parts[part] = found
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text."""
        if len(self.parts) > PART_CACHE:
            self.parts.clear()
        if len(self.words) > WORD_CACHE:
            self.words = {"": b""}
        get, part, out = self.parts.get, self._part, []
        for text in texts:
            parts = text.encode("utf-8", "replace").split() if text else []
            found = list(map(get, parts))
            if None in found:
                found = [part(p) if x is None else x for p, x in zip(parts, found, strict=True)]
            out.append(b"".join(found))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process; it outlives tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
