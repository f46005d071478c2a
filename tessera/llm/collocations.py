"""Phrases of two or three words that stand together more often than their parts suggest, level by level.

Level k counts phrases of k words. A bitmap of the frequent phrases of each level before is broadcast, and a task sends a phrase only if
both of its overlapping shorter parts are in it. A bitmap never lacks a frequent phrase, so counts are exact; where it holds others by
chance, some phrases too many are counted and fall to the threshold. Its size follows the number of frequent phrases up
to ``MOST_BITS``, a bound that holds for any corpus; past it, pruning gets weaker and nothing else changes.

Each level's frequent phrases are written; every cut of a candidate is scored by joining these tables.

Defined cases: a null text counts as empty, a null language as ``und``; phrases do not cross the characters that end a piece; repeated rows
count as often as they stand; equal scores go by frequency, then by the phrase's bytes; an empty table gives an empty
result; other columns are ignored. Numbers are exact for counts up to 10**15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.session import ranked

#: Bits of a bitmap for each frequent phrase, and the fewest and most bits of one (128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 30
#: Words that a task gathers, and different words that it tells apart, before it sends counts on.
MOST_GATHERED, MOST_WORDS, MOST_WORD_BYTES = 1_500_000, 400_000, 32 << 20
_ID_BITS = 20  # MOST_WORDS and the words of one more text have to fit; longer texts are taken in parts
_PART = 1 << 19

_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK, _SKIP = -1, -2


def pieces_and_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text in order, with ``\\n`` where a piece ends; empty strings mean nothing."""
    return text.translate(_CLEAN).replace(b"\n", b" \n ").split(b" ")


def _has(bitmap: np.ndarray, place):
    """Whether the bits at hashes are set; a bitmap's size is a power of two."""
    place = place & (len(bitmap) * 8 - 1)
    return (bitmap[place >> 3] >> (place & 7)) & 1 != 0


class Vocabulary(dict):
    """Numbers for the words of one language as they come; a word that the bitmap lacks ends a run like the end of a piece."""

    def __init__(self, lang: str, frequent: np.ndarray | None):
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.words, self.hashes, self.size = [], [], 0
        self.frequent, self.mask = (None, 0) if frequent is None else (frequent.tobytes(), len(frequent) * 8 - 1)
        self.seed, self.runs = xxhash.xxh64_intdigest(lang.encode(), 42), []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        self.size += len(word)
        if self.frequent is not None and not self.frequent[(h & self.mask) >> 3] >> (h & 7) & 1:
            number = _BREAK
        else:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = number
        return number

    def gather(self, words: list[bytes]) -> int:
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        ids = ids[ids != _SKIP]
        self.runs += [ids, np.array([_BREAK], np.int32)]
        return len(ids)

    def counts(self, k: int, bitmaps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """The phrases of k words among what was gathered, and how often each stands there. The words stay known, the texts are forgotten."""
        ids = np.concatenate(self.runs).astype(np.int64) if self.runs else np.zeros(0, np.int64)
        self.runs = []
        hashes = np.array(self.hashes, np.uint64)[ids] if self.hashes else np.zeros(len(ids), np.uint64)  # of no use at a break
        good, mixed = ids >= 0, hashes
        for length in range(2, k + 1):  # good[i]: the phrase of ``length`` words at i may be frequent
            good = good[:-1] & good[1:]
            mixed = _mix(mixed[:-1], hashes[length - 1 :])
            if length < k:
                good &= _has(bitmaps[length - 1], mixed)
        at, key = np.nonzero(good)[0], np.int64(0)
        for i in range(k):
            key = key << _ID_BITS | ids[at + i]
        keys, seen = np.unique(key, return_counts=True) if len(at) else (at, at)
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        parts = [words.take(pa.array(keys >> _ID_BITS * (k - 1 - i) & (1 << _ID_BITS) - 1)) for i in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], seen


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(5) | a >> np.uint64(59)) ^ b


def _place(lang: Column, phrase: Column, k: int) -> Column:
    """The hash of a phrase as ``Vocabulary`` and ``_mix`` make it."""
    words = F.split(phrase, " ")
    out = F.xxhash64(lang, words[0])
    for i in range(1, k):
        out = F.shiftleft(out, 5).bitwiseOR(F.shiftrightunsigned(out, 59)).bitwiseXOR(F.xxhash64(lang, words[i]))
    return out


def bitmap(phrases: DataFrame, k: int) -> np.ndarray:
    """One bit for each of a level's phrases, gathered as segments of 4 kB: at most ``MOST_BITS`` bits reach the driver."""
    bits = LEAST_BITS
    n = phrases.count()
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    place = _place(F.col("lang"), F.col("phrase"), k).bitwiseAND(F.lit(bits - 1))
    segments = phrases.select(F.shiftright(place, 15).alias("segment"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in segments.groupBy("segment").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["segment"] * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, k: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """``lang, phrase, f`` for phrases of k words that the bitmaps of shorter ones allow; of level 1 also a null phrase with all words' number."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, words in known.items():
                phrases, seen = words.counts(k, sent.value)
                phrases = pa.concat_arrays([phrases, pa.nulls(1, pa.string())]) if k == 1 else phrases
                seen = np.append(seen, seen.sum()) if k == 1 else seen
                for at in range(0, len(seen), 100_000):
                    some = phrases[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), some, pa.array(seen[at : at + 100_000], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                words, lang = pieces_and_words(text.as_py()), lang.as_py()
                for at in range(0, len(words), _PART):  # parts overlap by k - 1 words, so that no phrase is lost or counted twice
                    if lang not in known:
                        known[lang] = Vocabulary(lang, sent.value[0] if k > 1 else None)
                    mine = known[lang]
                    held += mine.gather(_part(words, at, _PART, k))
                    many = len(known) > 1000 or sum(map(len, known.values())) > MOST_WORDS or sum(v.size for v in known.values()) > MOST_WORD_BYTES
                    if held > MOST_GATHERED or many:
                        yield from send()
                        held = 0
                    if many:
                        known.clear()
        yield from send()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _part(words: list[bytes], at: int, size: int, k: int) -> list[bytes]:
    """The words of one part of a text, and so many of the next that its last phrases are whole."""
    to, more = at + size, 0
    while to < len(words) and more < k - 1:
        more += words[to] != b""
        to += 1
    return words[at:to]


def collocations(docs: DataFrame, *, max_words: int = 3, least: int = 10, part_of: int = 50, top: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases (all if null).

    A phrase found inside a longer candidate with at least ``part_of`` per cent of its occurrences is dropped.
    """
    if max_words not in (2, 3):
        raise ValueError("max_words has to be 2 or 3")
    levels, bitmaps = [], []
    for k in range(1, max_words + 1):
        counted = phrase_counts(docs, k, bitmaps)
        levels.append(written(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases{k}"))
        if k < max_words:
            bitmaps.append(bitmap(levels[-1].filter("phrase IS NOT NULL"), k))
    totals = levels[0].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    levels[0] = levels[0].filter("phrase IS NOT NULL")

    cuts, longer = None, None
    for k in range(2, max_words + 1):
        words = F.split("phrase", " ")
        for at in range(1, k):
            first, rest = (F.concat_ws(" ", *[words[i] for i in r]) for r in (range(at), range(at, k)))
            cut = levels[k - 1].select("lang", "phrase", F.col("f").alias("a"), F.lit(at).alias("cut"), first.alias("first"), rest.alias("rest"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
        if k > 2:
            for r in (range(k - 1), range(1, k)):
                inner = levels[k - 1].select("lang", F.concat_ws(" ", *[words[i] for i in r]).alias("phrase"), F.col("f").alias("longest"))
                longer = inner if longer is None else longer.unionByName(inner)

    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, left, right = (F.col(c).cast("decimal(16,0)") for c in "alr")
    cuts = cuts.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)"), "under": left * right})
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best"))
    if longer is not None:
        scored = scored.join(longer.groupBy("lang", "phrase").agg(F.max("longest").alias("longest")), ["lang", "phrase"], "left")
        scored = scored.filter(F.col("longest").isNull() | (100 * F.col("longest") < part_of * F.col("a")))
    found = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    placed = ranked(found, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")])
    if top is not None:
        placed = placed.filter(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.*, t.cut, array_to_string(w[1:t.cut], ' ') AS head, array_to_string(w[t.cut + 1:], ' ') AS tail
  FROM c, (VALUES (1), (2)) t(cut) WHERE t.cut < c.k),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cuts.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.head AND x.k = cuts.cut
  JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.tail AND y.k = cuts.k - cuts.cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
longest AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE b.k = 3 OR x.a IS NULL OR 100 * x.a < 50 * b.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""
