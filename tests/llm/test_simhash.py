import collections
import itertools
import math
import random

import duckdb
import numpy as np
import xxhash

from tessera.llm import simhash as s

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, most):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    v = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= most)[0]:
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {(ids[i], least.get(root(i))) for i in range(len(ids))}


def test_documents(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = s.op10_simhash_groups(spark, FOLDER).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{plain(t):016x}" for i, t in rows}
    assert {(r.doc_id, r.component_id) for r in got} == groups([i for i, _ in rows], [plain(t) for _, t in rows], 2)


def test_awkward(spark, awkward):
    fps = s.fingerprints(awkward)
    got = s.group_documents(fps, s.link_fingerprints(fps, s.disjoint_blocks(64, 3), 2)).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == by[3] == by[4] == 2 and by[6] == 6
    none = s.fingerprints(awkward.limit(0))
    assert s.group_documents(none, s.link_fingerprints(none, s.disjoint_blocks(64, 3), 2)).count() == 0


def test_hot_blocks_are_split_without_loss(spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(900)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(i, [int(np.uint64(f).view(np.int64))]) for i, f in enumerate(fps)], "doc_id bigint, fp array<bigint>")
    for limit in (20, 4096):
        links = s.link_fingerprints(frame, s.disjoint_blocks(64, 3), 2, run_limit=limit)
        got = {(r.doc_id, r.component_id) for r in s.group_documents(frame, links).collect()}
        assert got == groups(list(range(len(fps))), fps, 2)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)], "a bigint, b bigint")
    got = {r.node: r.root for r in s.components(s.stars(links)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies(spark):
    rng = random.Random(9)
    rows, base = [], {}
    for d in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        base[d] = [len(rows), len(rows) + 1, len(rows) + 2]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, edited(rng, words, 1)), (len(rows) + 2, edited(rng, words, 3))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in s.near_duplicates(frame).collect()}
    assert all(got[i] % 3 == 0 and got[i] == i - i % 3 for i in got)
    kept = s.keep_one(frame.withColumn("fp", frame.doc_id))
    assert sorted(r.doc_id for r in kept.collect()) == [v[0] for v in base.values()] and "fp" in kept.columns


def test_a_pair_between_failing_pairs_is_found(spark, monkeypatch):
    block = s.overlapping_blocks(256, 16, 1)[0]
    free = [b for b in range(256) if b not in block]
    bits = lambda on, rest: np.packbits([b in on for b in range(256)]).view(">u8").astype(np.uint64).view(np.int64).tolist() + [rest] * 28
    one, two, three = set(), set(free[:29]), set(free[14:45])  # 29, 30 and 31 bits apart; the second differs everywhere else
    made = spark.createDataFrame([(0, bits(one, 0)), (1, bits(two, -1)), (2, bits(three, 0))], "doc_id bigint, fp array<bigint>")
    monkeypatch.setattr(s, "fingerprints", lambda docs, **settings: made)
    got = {r.doc_id: r.component_id for r in s.near_duplicates(made, blocks=(16, 1)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_runs_stay_below_the_limit(spark):
    rng = random.Random(7)
    for lanes, most, flips, blocks in ((1, 2, 3, s.disjoint_blocks(64, 3)), (4, 50, 40, s.overlapping_blocks(256, 16, 3))):
        fps = [set(rng.sample(range(64 * lanes), rng.randrange(flips))) for _ in range(700)]
        longs = sorted({tuple(np.packbits([b in on for b in range(64 * lanes)]).view(">u8").astype(np.uint64).view(np.int64).tolist()) for on in fps})
        frame = spark.createDataFrame([(list(x),) for x in longs], "fp array<bigint>")
        got = {}
        for r in s.runs_of(frame, blocks, most, lanes=lanes, run_limit=60).collect():
            got.setdefault(r.key, []).append(tuple(np.frombuffer(r.fp, np.int64).tolist()))
        assert max(map(len, got.values())) <= 60 < len(longs)
        together = {p for run in got.values() for p in itertools.combinations(sorted(run), 2)}
        for a, b in itertools.combinations(longs, 2):
            bits = sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(a, b))
            share = any(all((a[i // 64] ^ b[i // 64]) >> (63 - i % 64) & 1 == 0 for i in block) for block in blocks)
            assert bits > most or not share or (a, b) in together


def test_keep_one_with_null_and_shared_ids(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (5, texts[3]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[6]), (9, texts[6]), (None, None), (None, "")]
    got = s.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[6]), (None, "")]
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), t) for d, t in want)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(sets, least):
    """All pairs of Jaccard similarity ``least`` and more, by what they share among their rarest shingles; equal sets but once."""
    count = collections.Counter(x for s_ in sets for x in s_)
    by, out, first = collections.defaultdict(list), {}, {}
    for n, found in enumerate(sets):
        if not found or first.setdefault(frozenset(found), n) != n:
            continue
        rare = sorted(found, key=lambda x: (count[x], x))
        rare = rare[: len(found) - math.ceil(least * len(found)) + 1]
        for m in {m for x in rare for m in by[x]}:
            alike = len(found & sets[m]) / len(found | sets[m])
            if alike >= least:
                out[m, n] = alike
        for x in rare:
            by[x].append(n)
    return out


def recall(spark, folder, bands=((0.8, 0.85), (0.85, 1.0), (0.7, 0.78))):
    """Pairs of different texts in each band of similarity, and how many of them are in one group."""
    rows = duckdb.connect().execute(f"select doc_id, text from '{folder}/documents.parquet' order by doc_id").fetchall()
    pairs = similar_pairs([shingles(t) for _, t in rows], min(low for low, _ in bands))
    group = {r.doc_id: r.component_id for r in s.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    together = {p: group[rows[p[0]][0]] == group[rows[p[1]][0]] for p in pairs}
    return [(sum(low <= a < high for a in pairs.values()), sum(together[p] for p, a in pairs.items() if low <= a < high)) for low, high in bands]


def test_recall_of_the_shipped_settings(spark, tmp_path):
    rng, rows = random.Random(5), []
    for n in range(500):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 400))]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, edited(rng, words, max(1, int(len(words) * rng.uniform(0.005, 0.04)))))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (edge, edge_found), (close, close_found), (below, below_found) = recall(spark, str(tmp_path))
    assert edge > 90 and edge_found >= 0.9 * edge and close > 100 and close_found >= 0.99 * close
    assert below > 20 and below_found <= 0.1 * below


def test_a_family_over_the_run_limit(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    family = [" ".join(words)] + [edited(rng, words, rng.randrange(1, 6)) for _ in range(300)]
    others = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(family + others)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in s.near_duplicates(frame, run_limit=50).collect()}
    assert got == {i: 0 if i < len(family) else i for i in got}
