"""Terms and names found in texts in one pass, by an automaton (J13, J21, T17, W6, W7 of the survey).

A dictionary becomes a trie with failure links, built once and broadcast. Its size is checked first: above ``MOST_TERMS`` terms or
``MOST_CHARACTERS`` characters there is no automaton, and ``gaps`` and ``windows`` join on tokens and names instead, with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.session import written

#: The largest dictionary that is broadcast: some 150 MB as an automaton.
MOST_TERMS, MOST_CHARACTERS = 100_000, 2_000_000
_TOKEN = regex.compile(r"[\w+#]")


def small(dictionary: DataFrame, size: Column) -> list[Row] | None:
    """The rows of a dictionary, or None if it is too large to be broadcast. ``size``: the characters of a row."""
    kept = written(dictionary, "dictionary")
    n, characters = kept.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return kept.collect() if n <= MOST_TERMS and characters <= MOST_CHARACTERS else None


def automaton(entries: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    """A trie with failure links over keys that tell entries apart; None without a key."""
    trie = ahocorasick.Automaton()
    for key, value in entries:
        if key:
            trie.add_word(key, (len(key), value))
    trie.make_automaton()
    return trie if len(trie) else None


def named_in(trie: ahocorasick.Automaton, text: str | None) -> list:
    """The terms that stand in a text as whole tokens, each once, by place in the dictionary; none in a null text. Values are (place, term)."""
    found, text = set(), text or ""
    for end, (length, value) in trie.iter(text):
        before, after = end - length, end + 1
        if value not in found and (before < 0 or not _TOKEN.match(text[before])) and (after == len(text) or not _TOKEN.match(text[after])):
            found.add(value)
    return [term for _, term in sorted(found)]


def chosen_in(trie: ahocorasick.Automaton, parts: Iterable[str | None] | None) -> list:
    """The values of the names in parts of a location: from the left, the longest, none overlapping. Keys start and end with a space."""
    out = []
    for part in () if parts is None else parts:
        words = [w for w in (part or "").split(" ") if w]
        hits = sorted(((end + 1 - length, -length, value) for end, (length, value) in trie.iter(f" {' '.join(words)} ")), key=lambda h: h[:2])
        free = 0
        for start, less, value in hits:
            if start >= free:
                out.append(value)
                free = start - less - 1  # the space that ends a name may begin the next
    return out


def lookup(texts: Column, trie: ahocorasick.Automaton | None, find: Callable, kind: str, spark) -> Column:
    """``find(trie, text)`` for each row, an array of ``kind``."""
    if trie is None:
        return F.array().cast(f"array<{kind}>")
    shared = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(f"array<{kind}>")
    def found(given: pd.Series) -> pd.Series:
        ready = shared.value
        return pd.Series([find(ready, x) for x in given], index=given.index, dtype=object)

    return found(texts)


def whole_terms(haystack: Column, vocab: list[Row], spark) -> Column:
    """The terms that a text names as whole tokens, the longest first, then by position. ``vocab``: term, position; terms without a token match nothing."""
    terms = [r.term for r in sorted(vocab, key=lambda r: (-len(r.term), r.position, r.term)) if _TOKEN.search(r.term)]
    return lookup(haystack, automaton((x, (n, x)) for n, x in enumerate(terms)), named_in, "string", spark)


def whole_names(location: Column, gazetteer: list[Row], most: int, spark) -> Column:
    """The names of at most ``most`` words in a location's parts, ``(name, provinces)`` in order. ``gazetteer``: one row a name."""
    fit = [r for r in gazetteer if r.name and "" not in r.name.split(" ") and r.name.count(" ") < most]
    trie = automaton((f" {r.name} ", {"name": r.name, "provinces": list(r.provinces or [])}) for r in fit)
    return lookup(location, trie, chosen_in, "struct<name:string,provinces:array<string>>", spark)
