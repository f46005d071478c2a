import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe_codec, packing, token_counts, token_store, word_encoder
from tessera.llm.common import new_path
from tessera.llm.pretoken import word_finder
from tessera.llm.word_encoder import WordEncoder

PATH, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LETTERS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​'sdab19٣Ⅷ²é中한!$́🎉\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["a<|endoftext|>b<|endoftext|>", "x" * 5000, None]


def wanted(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_encoder(library, odd_texts, monkeypatch):
    monkeypatch.setattr("tessera.llm.word_encoder.MOST_WORDS", 200)
    got = [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(PATH, PATTERN).encode(odd_texts)]
    assert got == wanted(library, odd_texts)


def test_long_words_are_not_remembered(library):
    encoder, counter = WordEncoder(PATH, PATTERN), token_counts.MergeCounter(PATH, PATTERN)
    texts = ["short " + "abcxyz" * 500, "short " + "漢字" * 400, "abcxyz" * 500]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == wanted(library, texts)
        assert [counter.count(t) for t in texts] == [len(x) for x in wanted(library, texts)]
    assert max(map(len, [*encoder.known, *counter.known])) <= 64 and "short" in encoder.known and "short" in counter.known


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello big World", "", None]
    got = [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(path, PATTERN).encode(texts)]
    assert got == wanted(Tokenizer.from_file(path), texts)


def test_counts(library, odd_texts):
    counter = token_counts.MergeCounter(PATH, PATTERN)
    assert [counter.count(t) for t in odd_texts] == [len(x) for x in wanted(library, odd_texts)]


def test_count_rows(spark, awkward, library):
    got = token_counts.token_counts(awkward, PATH, PATTERN).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(wanted(library, [r.text])[0]))
        assert r.over_limit == (r.n_tokens > 1024)


def test_codec_pieces(odd_texts):
    codec = bpe_codec.encoding(RANKS, PATTERN)
    find = word_finder(PATTERN)
    for t in filter(None, odd_texts):
        assert sum((codec.encode_ordinary(p) for p in bpe_codec.safe_pieces(t, 5)), []) == codec.encode_ordinary(t)
        assert "".join(find(t)) == t


def test_codec_rows(spark, awkward):
    codec = bpe_codec.encoding(RANKS, PATTERN)
    out = bpe_codec.encoded(awkward, RANKS, PATTERN)
    rows = out.withColumn("raw", bpe_codec.decoded(F.col("ids"), RANKS, PATTERN)).collect()
    assert len(rows) == awkward.count()
    assert all(r.ids == codec.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode() for r in rows)


def test_codec_query(spark, awkward, tmp_path):
    """All rows: nulls, blanks, an emoji, special strings, repeated rows and long texts."""
    awkward.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    codec = bpe_codec.encoding(RANKS, PATTERN)

    def row(doc_id, text):
        ids = codec.encode_ordinary(text)
        return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

    want = [row(r.doc_id, r.text or "") for r in awkward.collect()]
    assert sorted(map(tuple, bpe_codec.op6_bpe_codec(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("run", [" ", "\n", " \t", "a", "\u6f22", "7", "!", "\U0001f389"])
def test_codec_on_long_runs(run):
    """Two million characters without a safe place: ids as the library gives them match by match; of less, as it gives them whole."""
    codec = bpe_codec.encoding(RANKS, PATTERN)
    text = "x" + run * (2_000_000 // len(run)) + "y 1"
    ids = bpe_codec.encode(text, codec)
    assert codec.decode_bytes(ids) == text.encode()
    if run != "\U0001f389":
        assert ids == [i for word in word_finder(PATTERN)(text) for i in codec._encode_single_piece(word)]
    some = "x" + run * 300 + "y 1" + run * 300
    assert bpe_codec.encode(some, codec, 50) == codec.encode_ordinary(some)


@pytest.mark.parametrize("bounds", [{}, {"part_ids": 3000}, {"part_docs": 2}])
def test_store(spark, awkward, library, bounds):
    folder = new_path(spark, "test-tokens")
    parts = token_store.write_tokens(awkward, folder, PATH, PATTERN, 0, **bounds)
    assert all(p["n_docs"] <= bounds.get("part_docs", 99) and (p["n_docs"] == 1 or p["n_tokens"] <= bounds.get("part_ids", 10**9)) for p in parts)
    assert [p["base"] for p in parts] == [sum(q["n_tokens"] for q in parts[:i]) for i in range(len(parts))]
    rows = sorted(token_store.read_tokens(spark, folder, together=100).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in awkward.collect()), key=lambda x: (x is not None, x))
    texts = {r.doc_id: r.text for r in awkward.collect()}
    start = 0
    for r in rows:
        ids = wanted(library, [texts[r.doc_id]])[0] + [0]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    empty = new_path(spark, "test-tokens")
    assert token_store.write_tokens(awkward.limit(0), empty, PATH, PATTERN, 0) == [] and token_store.read_tokens(spark, empty).count() == 0


def test_store_query(spark, awkward, library, tmp_path):
    awkward.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    texts = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = [], 0
    for doc, text in texts:
        ids = wanted(library, [text])[0] + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.op5_token_store(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_count_query(spark, awkward, library, tmp_path):
    awkward.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in token_counts.op7_token_counts(spark, str(tmp_path)).collect()), key=str)
    counts = [(r.doc_id, len((r.text or "").encode()), len(wanted(library, [r.text])[0])) for r in awkward.collect()]
    assert got == sorted(((d, b, n, n > 1024) for d, b, n in counts), key=str)


def test_packing_query(spark, awkward, library, tmp_path):
    awkward.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op4_best_fit_packing(spark, str(tmp_path)).collect()
    sequences_are_right(rows, 1024)
    want = []
    for r in awkward.collect():
        ids = wanted(library, [r.text])[0] + [2]
        bounds = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)


def sequences_are_right(rows, size):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= size for e in ends.values())
    return len(ends)


def test_packing_rows(spark, awkward, library):
    cut = packing.pieces(awkward, PATH, PATTERN, 2)
    rows = packing.pack(cut).collect()
    assert sequences_are_right(rows, 1024) >= 1
    got = sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in rows), key=str)
    want = []
    for r in awkward.collect():
        ids = wanted(library, [r.text])[0] + [2]
        bounds = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024), len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert got == sorted(want, key=str)
    whole = packing.sequences(packing.pack(cut)).collect()
    assert all(len(bytes(s.ids)) == 4 * s.length for s in whole)
    assert packing.pack(cut.limit(0)).count() == 0


def least_bins(lengths, size):
    """The optimum by trying every place for every piece, for a few pieces."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                put(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        put(i + 1, bins + [lengths[i]])

    put(0, [])
    return best


def packed(counts, size, **search):
    got = packing.bin_completion(counts, size, **search)
    used = {}
    for times, filling in got.plan:
        assert sum(filling) <= size
        for n in filling:
            used[n] = used.get(n, 0) + times
    assert used == {n: c for n, c in counts.items() if c} and got.bins == sum(t for t, _ in got.plan)
    return got


def test_bin_completion_finds_the_least():
    rng = random.Random(7)
    for _ in range(1000):
        size = rng.choice([20, 50, 100])
        lengths = sorted((rng.randrange(1, int(size * rng.choice([0.4, 0.6, 1])) + 1) for _ in range(rng.randrange(1, 11))), reverse=True)
        got = packed({n: lengths.count(n) for n in lengths}, size)
        assert got.bins == least_bins(lengths, size) and got.proved


@pytest.mark.parametrize("triplets", [10, 20])
def test_triplets_without_waste(triplets):
    for seed in range(4):
        rng, counts = random.Random(seed), {}
        for _ in range(triplets):
            a = rng.randrange(380, 500)
            b = rng.randrange(250, min(380, 1024 - a - 250))
            for n in (a, b, 1024 - a - b):
                counts[n] = counts.get(n, 0) + 1
        assert packed(counts, 1024).bins == triplets < sum(t for t, _ in packing.best_fit(counts, 1024))


def test_search_that_is_cut_short():
    rng = random.Random(5)
    counts = {rng.randrange(250, 500): rng.randrange(1, 9) for _ in range(60)}
    got = packed(counts, 1024, most_steps=1)
    assert got.bins <= sum(t for t, _ in packing.best_fit(counts, 1024)) and got.least <= packed(counts, 1024).bins
    assert packing.bin_completion({}).bins == 0 and packing.bin_completion({}).proved


def test_fillings_are_undominated():
    """Against the definition: no other filling's pieces hold those of the one, shared out among them."""
    rng = random.Random(2)

    def holds(a, b):
        return not b or any(holds([*a[:i], a[i] - b[0], *a[i + 1 :]], b[1:]) for i in range(len(a)) if a[i] >= b[0])

    for _ in range(60):
        room, counts = 20, {rng.randrange(1, 21): rng.randrange(1, 3) for _ in range(5)}
        flat = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        every = {tuple(c) for k in range(len(flat) + 1) for c in itertools.combinations(flat, k) if sum(c) <= room}
        want = {f for f in every if not any(o != f and holds(sorted(o), list(f)) for o in every)}
        assert set(packing.fillings(room, counts, room)) == want


def test_texts_are_encoded_in_runs_of_a_bounded_size(monkeypatch):
    """Runs end at a number of texts or of characters; a text above the limit is a run by itself; nulls and empty texts count as one each."""
    monkeypatch.setattr(word_encoder, "TOGETHER", 3)
    monkeypatch.setattr(word_encoder, "CHARACTERS", 10)
    texts = ["a" * 4, "b" * 6, "c", None, "", "d" * 30, "e", "f"]
    runs = list(word_encoder._parts(iter(texts)))
    assert runs == [["a" * 4, "b" * 6], ["c", None, ""], ["d" * 30], ["e", "f"]]
    assert list(word_encoder._parts([])) == []
