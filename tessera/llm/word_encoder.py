"""Encoding with the tokenizers library, each word of a byte-level pre-tokenizer once a worker.

A byte-level tokenizer without a normalizer encodes every word of its pre-tokenizer by itself, so the ids of a text are
those of its words in turn. Words that a worker has met are looked up; new ones go to the model of the library's tokenizer. Any
other kind of tokenizer gets the whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

from tessera.llm.pretoken import byte_letters, word_finder

#: Words that a worker remembers in each of two generations, some 200 bytes each; longer ones are asked for each time.
MOST_WORDS, LONGEST = 250_000, 64
#: Texts whose new words are found together: so many, or fewer if they have so many characters; a longer text goes by itself.
TOGETHER, CHARACTERS = 128, 1 << 20
#: What a byte-level model takes for each byte.
LETTERS = dict(enumerate(byte_letters()))


class WordEncoder:
    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        before = spec.get("pre_tokenizer") or {}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.words = word_finder(pattern) if by_words and pattern else None
        self.strings = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.strings)) + ")")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if not any(s in text for s in self.strings):
            return self.words(text)
        parts = self.special.split(text)  # special strings stand at the odd places
        return [w for n, part in enumerate(parts) for w in ([part] if n % 2 else self.words(part))]

    def _learn(self, words: list[str]) -> None:
        """Asks the library for words; when the table is full, those not met for a generation are forgotten."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known, self.older = {}, self.known
        known, older, merged = self.known, self.older.get, self.library.model.tokenize
        for w in words:
            if (ids := older(w)) is None:
                if w in self.strings:
                    ids = array("I", self.library.encode(w, add_special_tokens=False).ids).tobytes()
                else:  # a word of the pre-tokenizer goes to the library's model as it stands, a letter for each byte
                    ids = array("I", [t.id for t in merged(w.encode().decode("latin-1").translate(LETTERS))]).tobytes()
            known[w] = ids

    def _together(self, texts: list[str | None]) -> Iterator[bytes]:
        get = self.known.get
        words = [self._words(t) if t else [] for t in texts]
        found = [list(map(get, w)) for w in words]
        holes = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        new = {w[i] for w, h in zip(words, holes) for i in h}
        if new:
            self._learn(list(new))
        for w, f, h in zip(words, found, holes):
            for i in h:
                f[i] = self.known[w[i]]
            yield b"".join(f)
        if new and max(map(len, new)) > LONGEST:
            for w in [w for w in new if len(w) > LONGEST]:
                del self.known[w]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        for part in _parts(texts):
            if self.words is None:
                for e in self.library.encode_batch_fast([t or "" for t in part], add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()
            else:
                yield from self._together(part)


def _parts(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of a bounded size, since a text's words take some ten times its characters."""
    part, chars = [], 0
    for text in texts:
        n = len(text or "")
        if part and (len(part) == TOGETHER or chars + n > CHARACTERS):
            yield part
            part, chars = [], 0
        part.append(text)
        chars += n
    if part:
        yield part


@lru_cache(maxsize=2)
def word_encoder(path: str, pattern: str | None) -> WordEncoder:
    return WordEncoder(path, pattern)
