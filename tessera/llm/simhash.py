"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, Hamming checks, components.

``fingerprints`` gives each text a SimHash of 64 bits or a multiple. Two fingerprints that differ in at
most r bits agree on one of r + 1 disjoint blocks of bits; ``link_fingerprints`` sends the distinct
fingerprints to their blocks, and each block's run is compared inside its task, so no table of pairs is
ever made: a run leaves only the links of a spanning forest, at most one a member, which keep every
connection. A block that holds more than ``run_limit`` distinct fingerprints is dealt to finer blocks first:
inside it the remaining bits again differ in at most r places, so the same argument splits it without loss, as often as it
takes. Where blocks are too narrow to help, the run is cut into chunks, and each two of them are a run (``runs_of``).
``components`` then joins links to groups by rounds of neighbourhood minima, each round written to the shared folder.

For fingerprints of texts whose similarity may be as low as 0.8, r is too large for disjoint blocks of
useful width; ``near_duplicates`` then takes overlapping blocks of 256 bits, 48 of 16 bits for small corpora and more and wider ones
as a corpus grows (``block_plan``). Below as many differing bits as there are disjoint blocks among them the pigeonhole still holds
strictly; beyond, the share of pairs found is measured in the tests and the README.

Defined cases: a null or wordless text has fingerprint zero, and such texts link like any other; equal rows fall
into one group; a null ``doc_id`` takes part and is the smallest only if a group has no other; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written

SEED = 42
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: So many open pairs of a task's runs are held before the rows they belong to are marked.
OPEN_PAIRS = 1 << 20
#: A block's value takes so many bits of its key, the block's number the rest.
_VALUE_BITS = 48


def simhash(text: str | None, words: int = 3, lanes: int = 1, once: bool = False) -> list[int]:
    """``lanes`` unsigned 64-bit numbers; ``once`` counts each different shingle one time."""
    found = (text or "").encode().lower().split()  # bytes: lower() takes A-Z only, split() exactly \x20 and \x09-\x0D
    if not found:
        return [0] * lanes
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = [b" ".join(w) for w in zip(*[found[i:] for i in range(words)])]
    if once:
        shingles = list(dict.fromkeys(shingles))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashed), 4096):
            part = hashed[at : at + 4096]
            if lane:  # further lanes mix the same hash, each from another start
                part = (part + np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                part = part ^ (part >> np.uint64(32))
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(hashed)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, *, words: int = 3, lanes: int = 1, once: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, an array of ``lanes`` longs (the unsigned bits, as signed longs)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(simhash(t, words, lanes, once), np.uint64).view(np.int64) for t in texts])

    return docs.select(F.col(doc_id).alias("doc_id"), hashed(F.col(text)).alias("fp"))


def disjoint_blocks(bits: int, count: int) -> list[list[int]]:
    """``count`` blocks that share out the bits 0..bits-1 (0 is the highest)."""
    return [b.tolist() for b in np.array_split(np.arange(bits), count)]


def overlapping_blocks(bits: int, width: int, count: int, seed: int = SEED) -> list[list[int]]:
    """``count`` blocks of ``width`` bits from successive shuffles, so that as many as fit are disjoint."""
    rng, out, pool = np.random.default_rng(seed), [], []
    while len(out) < count:
        if len(pool) < width:
            pool = rng.permutation(bits).tolist()
        out.append(sorted(pool[:width]))
        pool = pool[width:]
    return out


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def _block_values(bits: np.ndarray, block: list[int]) -> np.ndarray:
    packed = np.packbits(bits[:, block], axis=1)
    out = np.zeros(len(bits), np.uint64)
    for col in packed.T:
        out = (out << np.uint64(8)) | col
    return out


def _stack(column: pd.Series) -> np.ndarray:
    """A row of unsigned longs for each fingerprint, given as lists of longs or as their bytes."""
    if len(column) and isinstance(column.iloc[0], bytes):
        return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)
    return np.array(column.tolist(), np.int64).view(np.uint64)


def _keys(blocks: list[list[int]]):
    """Rows (key, fp) for every block: its number and value in one long, and the fingerprint's bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            fps = _stack(pdf["fp"])
            bits, raw = _bit_matrix(fps), [row.tobytes() for row in fps]
            for n, block in enumerate(blocks):
                yield pd.DataFrame({"key": (n << _VALUE_BITS) + _block_values(bits, block).astype(np.int64), "fp": raw})

    return rows


def _free(path: str, blocks: list[list[int]], width: int, parts: int) -> np.ndarray:
    """The bits that a path of a block and of parts of the bits then free leaves."""
    first, *rest = map(int, path.split("/"))
    free = np.setdiff1d(np.arange(width), blocks[first])
    for j in rest:
        free = np.setdiff1d(free, np.array_split(free, parts)[j])
    return free


def _mixed(keys: np.ndarray, j: int, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash; two runs that happen to share it are compared needlessly."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + values * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j + 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _finer(blocks: list[list[int]], width: int, parts: int):
    """Splits rows (path, key, fp) by the pigeonhole over the bits that a row's path of blocks leaves free."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            bits = _bit_matrix(_stack(pdf["fp"]))
            for path, group in pdf.groupby("path", sort=False):
                for j, sub in enumerate(np.array_split(_free(path, blocks, width, parts), parts)):
                    yield pd.DataFrame({"path": f"{path}/{j}", "key": _mixed(group["key"].to_numpy(), j, _block_values(bits[group.index], sub.tolist())), "fp": group["fp"]})

    return rows


def _chunk_pairs(hot: DataFrame, run_limit: int) -> DataFrame:
    """Rows (key, fp) of runs that hold each pair of rows of a longer run: its chunks, two at a time. ``hot``: key, fp, count."""
    dealt = hot.withColumn("__c", F.ceil(3 * F.col("count") / run_limit).cast("int")).withColumn("__mine", F.expr("cast(pmod(xxhash64(fp), __c) as int)"))
    each = dealt.withColumn("__other", F.explode(F.expr("sequence(0, __c - 1)"))).filter("__other <> __mine")
    return each.select(F.xxhash64("key", F.least("__mine", "__other"), F.greatest("__mine", "__other")).alias("key"), "fp")


def runs_of(fps: DataFrame, blocks: list[list[int]], most: int, *, lanes: int = 1, run_limit: int = 4096) -> DataFrame:
    """Rows (key, fp): every two fingerprints that share a block and differ in at most ``most`` bits share a key. ``fp`` is in bytes.

    A key of more than ``run_limit`` rows is split by finer blocks again and again, as long as these are wide enough to part more
    than they repeat (``2**bits`` of four values or more for each part); then by pairs of chunks, which part any rows. No run is
    longer than about the limit; the pairs of a run of near copies that nothing parts stay all pairs, but over many tasks.
    """
    width, parts = 64 * lanes, most + 1
    keyed = written(fps.select("fp").distinct().mapInPandas(_keys(blocks), "key bigint, fp binary"), "blocks")
    free, done, path = width - max(map(len, blocks)), None, F.shiftright("key", _VALUE_BITS).cast("string")
    while True:
        hot = written(keyed.groupBy("key").count().filter(F.col("count") > run_limit), "hot")
        if not hot.head(1):
            rest = keyed.select("key", "fp")
            return rest if done is None else done.unionByName(rest)
        marked = keyed.join(hot, "key", "left")
        usual, over = marked.filter("`count` is null").select("key", "fp"), marked.filter("`count` is not null")
        done = usual if done is None else done.unionByName(usual)
        if 2 ** (free // parts) < 4 * parts:
            return done.unionByName(_chunk_pairs(over, run_limit))
        keyed, path = written(over.select(path.alias("path"), "key", "fp").mapInPandas(_finer(blocks, width, parts), "path string, key bigint, fp binary"), "finer"), F.col("path")
        free -= -(-free // parts)


def _roots(parent: np.ndarray) -> np.ndarray:
    """Each position's root; the parents are shortened to it."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent[:] = up


def _run_links(keys: np.ndarray, fps: np.ndarray, most: int, sure: int, fine: np.ndarray | None = None, fine_most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of linked pairs in runs of equal keys (rows are sorted by key), and which rows have open pairs.

    Without ``fine``, the links are a spanning forest of each run's pairs of at most ``sure`` bits; a row is open if it differs from one
    of another tree in more bits than that, up to ``most``. With ``fine``, the open pairs are decided: the links are those that differ
    in at most ``fine_most`` bits there and join two trees. So a run of n rows leaves fewer than n links, and no link that fails.
    """
    n = len(keys)
    parent, trees, open_ = np.arange(n), np.bincount(keys, minlength=1), np.zeros(n, bool)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, loose, held = [], [], [], 0

    def join(at: np.ndarray, shift: int, kept: bool) -> None:
        for i in at[parent[at] != parent[at + shift]].tolist():
            a, b = root(i), root(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                trees[keys[i]] -= 1
                if kept:
                    left.append(i)
                    right.append(i + shift)

    def mark() -> None:
        top = _roots(parent)
        for pairs in loose:
            pairs = pairs[top[pairs[:, 0]] != top[pairs[:, 1]]]
            open_[pairs.ravel()] = True
        loose.clear()

    at, shift = np.arange(n - 1), 1
    while len(at):
        at = at[at + shift < n]
        at = at[(keys[at] == keys[at + shift]) & (trees[keys[at]] > 1)]
        apart = np.bitwise_count(fps[at] ^ fps[at + shift]).sum(1).astype(np.int64)
        join(at[apart <= sure], shift, fine is None)
        between = at[(apart > sure) & (apart <= most)]
        if len(between) and fine is not None:
            join(between[np.bitwise_count(fine[between] ^ fine[between + shift]).sum(1, dtype=np.int64) <= fine_most], shift, True)
        elif len(between):
            loose.append(np.column_stack([between, between + shift]))
            held += len(between)
            if held > OPEN_PAIRS:
                mark()
                held = 0
        shift += 1
    mark()
    return np.array(left, np.int64), np.array(right, np.int64), open_


def _by_run(linked):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the run that may go on
        for pdf in batches:
            if not len(pdf):
                continue
            if held and pdf["key"].iloc[0] != held[0]["key"].iloc[0]:
                yield linked(pd.concat(held, ignore_index=True))
                held = []
            last = pdf["key"].iloc[-1]
            whole = int(np.searchsorted((pdf["key"] == last).to_numpy(), True))  # runs that ended for sure
            if whole:
                yield linked(pd.concat([*held, pdf.iloc[:whole]], ignore_index=True) if held else pdf.iloc[:whole])
                held = []
            held.append(pdf.iloc[whole:])
        if held:
            yield linked(pd.concat(held, ignore_index=True))

    return rows


def _compare(most: int, sure: int):
    """Links ``(a, b)`` with a null key, and a row (key, a) for each member of a run with open pairs."""

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = _stack(pdf["fp"])
        a, b, open_ = _run_links(pd.factorize(pdf["key"])[0], fps, most, sure)
        left, right = [*fps[a].view(np.int64), *fps[open_].view(np.int64)], [*fps[b].view(np.int64), *[None] * int(open_.sum())]
        return pd.DataFrame({"key": pd.array([*[None] * len(a), *pdf["key"].to_numpy()[open_].tolist()], "Int64"), "a": pd.Series(left, dtype=object), "b": pd.Series(right, dtype=object)})

    return _by_run(linked)


def _decide(most: int, sure: int, fine_most: int):
    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = _stack(pdf["fp"])
        a, b, _ = _run_links(pd.factorize(pdf["key"])[0], fps, most, sure, _stack(pdf["fine"]), fine_most)
        return pd.DataFrame({"a": list(fps[a].view(np.int64)), "b": list(fps[b].view(np.int64))}, dtype=object)

    return _by_run(linked)


def link_fingerprints(fps: DataFrame, blocks: list[list[int]], most: int, *, lanes: int = 1, sure: int | None = None, fine: DataFrame | None = None, fine_most: int = 0, run_limit: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that differ in at most ``most`` bits.

    Every connection by such links stays, though not every link: of each block's run a spanning forest is kept. With ``sure``, pairs of
    more bits than that are links only if their fingerprints in ``fine`` (``fp, fine``) differ in at most ``fine_most`` bits. They are looked
    up for the members of such pairs alone and compared in the same runs, so that nothing is left out for a link that fails.
    """
    sure = most if sure is None else sure
    runs = lambda rows: rows.repartition("key").sortWithinPartitions("key")
    found = runs(runs_of(fps, blocks, most, lanes=lanes, run_limit=run_limit)).mapInPandas(_compare(most, sure), "key bigint, a array<bigint>, b array<bigint>")
    if sure >= most:
        return found.select("a", "b")
    found = written(found, "pairs")
    wide = found.filter("key is not null").select("key", F.col("a").alias("fp")).join(fine.select("fp", "fine"), "fp")
    decided = runs(wide).mapInPandas(_decide(most, sure, fine_most), "a array<bigint>, b array<bigint>")
    return found.filter("key is null").select("a", "b").unionByName(decided)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one part as stars: each node with the smallest that the part's links reach, which joins the same nodes."""
    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    lists = False
    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            lists = lists or isinstance(a, np.ndarray)
            a, b = (tuple(a.tolist()), tuple(b.tolist())) if lists else (a, b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [n for n in parent if root(n) != n]
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        roots = [root(n) for n in part]
        yield pd.DataFrame({"a": [list(r) for r in roots] if lists else roots, "b": [list(n) for n in part] if lists else part})


def stars(links: DataFrame) -> DataFrame:
    """Fewer links ``(a, b)`` that join the same nodes: those of each part by themselves become stars."""
    made = written(links.select("a", "b"), "links").mapInPandas(_stars, links.select("a", "b").schema)  # a part's links at a time
    return made.distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has a link: the smallest node that links reach.

    Rounds of the large-star and small-star steps join the links: each node passes its smallest neighbour on to the others, so chains
    shorten by half or more a round; edges stay as many as the links at most.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        joined = large.join(low, large.b == low.n).select("a", "b", "m")
        star = joined.select(F.col("m").alias("a"), "b").unionByName(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = written(star.distinct(), "links")
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def group_fingerprints(fps: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint: the smallest doc_id of all documents that links and equal fingerprints reach.

    Nodes are named by their smallest doc_id (nulls last) and fingerprint, so a component's smallest node gives its id.
    """
    ids = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("least"))
    names = written(ids.select("fp", F.struct("least.none", "least.id", "fp").alias("name")), "names")
    of = lambda end, to: names.select(F.col("fp").alias(end), F.col("name").alias(to))
    edges = stars(links.select("a", "b")).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    number = components(edges)
    return names.join(number, names.name == number.node, "left").select("fp", F.coalesce("root", "name")["id"].alias("component_id"))


def group_documents(fps: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: each document with the smallest doc_id of its group."""
    named = group_fingerprints(fps, links).withColumnRenamed("fp", "__fp")
    return fps.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def block_plan(distinct: int, share: float, *, least_width: int = 16, most_alike: int = 256, found: float = 0.979) -> tuple[int, int]:
    """Width and number of blocks: chance puts at most ``most_alike`` of the fingerprints into a run, and a pair that differs in ``share`` of
    the bits agrees on a block with probability ``found``. 48 blocks of 16 bits up to 16 million fingerprints, 131 of 22 for 10**9."""
    width = max(least_width, math.ceil(math.log2(max(1, distinct) / most_alike)))
    return width, math.ceil(math.log(1 - found) / math.log(1 - (1 - share) ** width))


def _fingerprints_and_links(docs: DataFrame, *, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, lanes: int = 4, fine_lanes: int = 32, blocks: tuple[int, int] | None = None, run_limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and their links, of texts whose sets of ``words``-word shingles are ``similarity`` alike or more (Jaccard).

    Of two sets with Jaccard similarity J the cosine is about 2J / (1 + J), and their SimHashes differ in about arccos
    of that / pi of the bits. The first ``lanes`` words of a fingerprint of ``fine_lanes`` find pairs: two standard deviations below that
    share a pair is linked, up to two above it is looked at again with all bits, whose deviation is a third or less; half of that
    is allowed above the share, so that pairs just at the similarity are rather linked than not.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits, fine_bits = 64 * lanes, 64 * fine_lanes
    deviation = lambda n: float(np.sqrt(share * (1 - share) * n))
    spread = 2 * deviation(bits)
    fine = written(fingerprints(docs, words=words, lanes=fine_lanes, once=True, doc_id=doc_id, text=text), "fingerprints")
    fps = fine.select("doc_id", F.slice("fp", 1, lanes).alias("fp"))
    whole = fine.groupBy(F.slice("fp", 1, lanes).alias("short")).agg(F.min("fp").alias("fine")).withColumnRenamed("short", "fp")
    width, count = blocks or block_plan(fine.count(), share)
    links = link_fingerprints(fps, overlapping_blocks(bits, width, count), int(share * bits + spread), lanes=lanes, sure=int(share * bits - spread), fine=whole, fine_most=int(share * fine_bits + 0.5 * deviation(fine_bits)), run_limit=run_limit)
    return fps, links


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """Groups of texts whose shingles are alike: ``doc_id, fp, component_id``. The settings are those of ``_fingerprints_and_links``."""
    return group_documents(*_fingerprints_and_links(docs, **settings))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id, a null one only if there is no other.

    Rows are told apart by doc_id and the text's MD5, so unrelated texts stay although they share an id or have none; of
    rows with the same id and text, which are always of one group, one stays.
    """
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text"))
    keyed = docs.withColumn("__keep_key", key)
    kept = group_fingerprints(*_fingerprints_and_links(keyed, doc_id="__keep_key", text=text, **settings)).select(F.col("component_id").alias("__kept_key")).distinct()
    rows = keyed.join(kept, F.col("__keep_key") == F.col("__kept_key")).drop("__kept_key")
    return rows.dropDuplicates(["__keep_key"]).drop("__keep_key")


# ---------------------------------------------------------------- the registered query
def op10_simhash_groups(spark, sf_dir: str) -> DataFrame:
    fps = written(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    grouped = group_documents(fps, link_fingerprints(fps, disjoint_blocks(64, 3), 2))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
