import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import source_audit
from tessera.llm.source_audit import pair_sums, shares, terms_of

SCHEMA = "doc_id bigint, text string, lang string, source string, value string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """The contract in plain Python, with integers of any size."""
    docs = [tuple(x or "" for x in (r[2], r[3], r[1])) for r in rows]
    term_re = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        terms = term_re.findall(text.translate(LOWER))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        whole = p(sum((count[lang, s] for s in sources), Counter()))
        mine = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            far = sorted((-sum(abs(mine[s][t] - mine[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((whole[t] - mine[s][t], t.encode()) for t in kept if count[lang, s][t] and mine[s][t] > whole[t])[:top]
            for part, found in (("pair", far), ("term", own)):
                out |= {(lang, s, part, item.decode(), -f, i + 1) for i, (f, item) in enumerate(found)}
    return out


def audited(spark, rows, least=3, top=4):
    docs = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in source_audit.source_audit(docs, least_docs=least, top=top).collect()}


@pytest.mark.parametrize(("cells", "terms", "counted"), [(1 << 18, 4096, 200_000), (8, 3, 10)])
def test_like_brute_force(spark, monkeypatch, cells, terms, counted):
    """One block, and many small ones with counts sent on again and again."""
    for name, value in (("CELLS", cells), ("MOST_TERMS", terms), ("LEAST_TERMS", 1), ("MOST_COUNTED", counted), ("MOST_LANGS", 0 if cells == 8 else 100)):
        monkeypatch.setattr(source_audit, name, value)
    rng, words = random.Random(3), ["The", "été", "x", "\U0001f389", "zebra", "a1b", "don't", "日本", "É", "é", *"abcdefgh"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de"]), rng.choice(["hot"] * 3 + ["s1", "s2", "S3", "ü"]), "v") for i in range(120)]
    rows += [(500 + i, "rare words only here", "fr", f"f{i}", None) for i in range(3)] + [(600, "alone", "it", "one", None)]
    assert audited(spark, rows) == brute(rows, 3, 4)


def test_awkward_rows(spark):
    rows = [(1, None, None, None, "a"), (1, None, None, None, "a"), (None, "", "", "s", None), (2, "b b\x00b\x7fb " * 5000, None, "s", "c"), (3, "b", "", "S", "c"), (4, "B", None, "t", "c")]
    rows += [(9, "tie TIE", "en", s, None) for s in ("b", "a", "c") for _ in range(3)]
    assert audited(spark, rows) == brute(rows, 3, 4)
    assert audited(spark, rows, least=100) == brute(rows, 100, 4)  # no term kept: all pairs, value 0
    assert audited(spark, []) == set()


def test_shares_are_exact():
    for count, n, v in ((0, 0, 1), (7, 7, 1), (8_999_999_999_999_990, 8_999_999_999_999_999, 3), (12_345_678_901, 99_999_999_999_999, 1_000_003)):
        assert int(shares(np.array([count]), np.int64(n + 5 * v))[0]) == 1 + 1_000_000_000 * (count + 5) // (n + 5 * v)


def test_pair_sums_in_pieces():
    p = np.random.default_rng(1).integers(0, 10**9, (11, 23))
    assert np.triu(pair_sums(p, rows=4, terms=5), 1).tolist() == np.triu(np.abs(p[:, None] - p[None]).sum(axis=2), 1).tolist()


def test_terms():
    assert terms_of("Ab1cÉ\x00é_Z\x7f".encode()) == ["ab".encode(), "cÉ".encode(), "é".encode(), b"z"]
