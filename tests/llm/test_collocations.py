import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations
from tessera.llm.collocations import Vocabulary, _mix, _place

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=None, longest=3):
    out = set()
    for lang in {r[2] or "und" for r in rows}:
        f = Counter()
        for r in rows:
            if (r[2] or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        good = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in good.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and g in [h[i : i + len(g)] for i in range(len(h) - len(g) + 1)] for h, b in good.items()):
                continue
            score, cut = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return out


def mined(spark, rows, **settings):
    return {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA), **settings).collect()}


def texts(rng, n):
    words = ["New", "york", "city", "the", "of", "été", "\xa0x", "a\x00b", *"abcdefgh"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", new york city "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), "p", 1) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(spark, monkeypatch, small):
    """Also with bitmaps so small that they prune little, texts in many parts, and counts sent on all the time."""
    if small:
        for name, value in (("_PART", 3), ("MOST_GATHERED", 40), ("MOST_WORDS", 30)):
            monkeypatch.setattr(collocations, name, value)
    rows = texts(random.Random(5), 150)
    assert mined(spark, rows, least=4) == brute(rows, 4)
    if not small:
        assert mined(spark, rows, least=4, top=5) == brute(rows, 4, 5)
        assert mined(spark, rows, least=6, max_words=2) == brute(rows, 6, longest=2)


def test_awkward_rows(spark):
    rows = [(1, None, None, "x", 1), (None, "", "en", None, None), (2, "Yes no. " * 30_000, "en", "x", 2), (3, "a a a a a a a", "en", "y", 3), (3, "a a a a a a a", "en", "y", 3)]
    rows += [(4, "q " + "w" * 2_000_000 + " r", "en", "z", 1)] * 2
    assert mined(spark, rows) == brute(rows, 10)
    assert mined(spark, rows, least=2) == brute(rows, 2)
    assert mined(spark, [], least=2) == set()


def test_hashes_and_pruning(spark):
    """Spark and the tasks place a phrase alike; a level sends only phrases whose shorter parts are in the bitmaps."""
    row = spark.range(1).select(F.lit("fr").alias("lang"), F.lit("été a b").alias("phrase")).select(_place(F.col("lang"), F.col("phrase"), 3).alias("h")).first()
    words = Vocabulary("fr", None)
    words.gather([w.encode() for w in "été a b".split()])
    h = np.array(words.hashes, np.uint64)
    assert _mix(_mix(h[:1], h[1:2]), h[2:])[0] == row.h % 2**64
    docs = spark.createDataFrame([("en", "a b c a b d x y")], "lang string, text string")
    level = spark.createDataFrame([("en", w) for w in "abc"], "lang string, phrase string")
    bits = collocations.bitmap(level, 1)
    assert np.unpackbits(bits).sum() == 3
    assert {tuple(r) for r in collocations.phrase_counts(docs, 2, [bits]).collect()} == {("en", "a b", 2), ("en", "b c", 1), ("en", "c a", 1)}
