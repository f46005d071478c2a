"""Best-fit packing of token pieces into sequences by bin completion with branch and bound.

Pieces of one length are alike, so the search works on the histogram of lengths, at most ``size`` rows whatever the
corpus. Best-fit decreasing gives the first incumbent. Bin completion then takes the longest piece that is left,
enumerates the undominated fillings of the room beside it, least waste first, applies one as often as the counts allow (or half as
often, and so on down to once), completes the rest by best fit, and if that is not good enough goes on with the rest; a branch ends
when its waste, or a lower bound of what is left, rules out the number of sequences asked for. The search stops at the lower bound, or
after ``most_steps`` steps, its only bound, with the best packing so far; ``Packing.proved`` says whether fewer are ruled out.

Pieces get their places without a global sort: a piece's rank among those of its length comes from its rank in a small
salted group plus the prefix sum of the groups before; runs of ranks map to sequences and offsets.

Defined cases: a null or empty text has only the end id; equal rows are packed each; a null doc_id is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written
from tessera.llm.word_encoder import word_encoder

log = logging.getLogger(__name__)
SIZE = 1024
#: Steps of a search.
MOST_STEPS = 600_000
#: A packing: (times used, lengths in order) for each filling.
Plan = list[tuple[int, tuple[int, ...]]]


# ---------------------------------------------------------------- the search, over a histogram
def best_fit(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Best-fit decreasing, bins with the same room together."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            times, held = open_bins[room].pop() if room is not None else (left, ())
            if room is not None and not open_bins[room]:
                del open_bins[room]
            free = size if room is None else room
            each = free // length
            used = min(times, -(-left // each))
            if used < times and room is not None:
                open_bins.setdefault(room, []).append((times - used, held))
            full, rest = divmod(left, each) if used * each > left else (used, 0)
            for n, k in ((full, each), (1, rest)):
                if n and k:
                    open_bins.setdefault(free - k * length, []).append((n, held + (length,) * k))
            left -= full * each + rest
    return [b for bins in open_bins.values() for b in bins]


def lower_bound(counts: dict[int, int], size: int = SIZE, most_parts: int = 12) -> int:
    """No packing has fewer sequences. For every threshold pieces that leave less room than it count as whole sequences and those below it
    as none; lengths are then rounded to parts of a sequence such that no sequence holds more than one (dual feasible functions)."""
    if not counts:
        return 0
    n, c = (np.array(x, np.int64) for x in zip(*counts.items()))
    best = -(-int((n * c).sum()) // size)
    for least in range(size // 2 + 1):
        v = np.where(n > size - least, size, np.where(n < least, 0, n))
        best = max(best, -(-int((v * c).sum()) // size))
        for k in range(1, most_parts + 1):
            parts = (k + 1) * v // size
            worth = np.where((k + 1) * v % size == 0, k * v, parts * size)  # in k * size-ths
            best = max(best, -(-int((worth * c).sum()) // (k * size)))
    return best


class RestBound:
    """``lower_bound`` for what is left at a node of the search: of its functions those that bound the whole histogram best, as one matrix."""

    def __init__(self, counts: dict[int, int], size: int, most_parts: int = 12, most: int = 512):
        self.lengths = np.array(sorted(counts), np.int64)
        self.at = {int(n): i for i, n in enumerate(self.lengths)}
        c, n, rows, units = np.array([counts[int(x)] for x in self.lengths], np.int64), self.lengths, [], []
        for least in range(size // 2 + 1):
            v = np.where(n > size - least, size, np.where(n < least, 0, n))
            for k in range(1, most_parts + 1):
                rows.append(np.where((k + 1) * v % size == 0, k * v, (k + 1) * v // size * size))
                units.append(k * size)
            rows.append(v)
            units.append(size)
        table, units = np.stack(rows), np.array(units, np.int64)
        _, first = np.unique(table / units[:, None], axis=0, return_index=True)
        best = first[np.argsort(-(table[first] @ c) / units[first], kind="stable")[:most]]
        self.table, self.units = table[best], units[best]

    def __call__(self, left: dict[int, int]) -> int:
        c = np.zeros(len(self.lengths), np.int64)
        for n, k in left.items():
            c[self.at[n]] = k
        return int((-(-(self.table @ c) // self.units)).max())


def _undominated(filling: list[int], room: int, spare: int) -> bool:
    """Whether no unused piece can take the place of pieces that it covers. ``spare``: a bit for each length with unused pieces."""
    def within(bits: int, width: int) -> int:
        """Bit s: there is a set bit in s .. s + width."""
        done = 0
        while done < width:
            step = min(done + 1, width - done)
            bits |= bits >> step
            done += step
        return bits

    slack = room - sum(filling)
    near = within(spare, slack)
    if near & 1:
        return False  # one more piece fits
    one, several = 0, 0  # the sums of one piece, and of two or more
    for n in filling:
        several |= (several | one) << n
        one |= 1 << n
    longer = within(spare >> 1, slack - 1) if slack else 0  # for a single piece only a longer one counts
    return not (several & near or one & longer)


def _sums(lengths: list[int], counts: dict[int, int], room: int) -> Iterator[int]:
    """For the first 0, 1, 2 ... of the lengths a number whose bit s says whether some of their pieces add up to s."""
    reach, within = 1, (1 << (room + 1)) - 1
    yield reach
    for n in lengths:
        left, step = min(counts[n], room // n), 1
        while left:
            k = min(step, left)
            reach |= (reach << (n * k)) & within
            left, step = left - k, 2 * step
        yield reach


def _hopeless(counts: dict[int, int], size: int, slack: int) -> bool:
    """Whether some piece has no filling beside it that wastes at most ``slack``."""
    if slack >= min(counts):
        return False
    *_, reach = _sums(sorted(counts), counts, size)
    return any(not reach >> max(0, size - n - slack) & ((1 << (min(slack, size - n) + 1)) - 1) for n in counts)


def fillings(room: int, counts: dict[int, int], most_waste: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of a room from the pieces in ``counts`` that wastes at most ``most_waste``, least waste first."""
    lengths = sorted(n for n in counts if counts[n] > 0 and n <= room)
    sums = list(_sums(lengths, counts, room))
    for waste in range(min(most_waste, room) + 1):
        if not sums[-1] >> (room - waste) & 1:
            continue
        stack = [(len(lengths), room - waste, ())]  # lengths still to choose from, the sum they have to make, (length, times) chosen
        while stack:
            i, need, chosen = stack.pop()
            if need == 0:
                used = dict(chosen)
                spare = sum(1 << n for n in lengths if counts[n] > used.get(n, 0))
                flat = [n for n, k in chosen for _ in range(k)]
                if _undominated(flat, room, spare):
                    yield tuple(flat)
                continue
            n = lengths[i - 1]
            for k in range(min(counts[n], need // n) + 1):  # the most is tried first
                if sums[i - 1] >> (need - k * n) & 1:
                    stack.append((i - 1, need - k * n, (*chosen, (n, k)) if k else chosen))


@dataclass(frozen=True)
class Packing:
    plan: Plan
    bins: int
    least: int  #: no packing has fewer, as far as was shown

    @property
    def proved(self) -> bool:
        return self.bins == self.least


def _state(counts: dict[int, int]) -> bytes:
    flat = np.array(sorted((n, c) for n, c in counts.items() if c), np.int64)
    return hashlib.blake2b(flat.tobytes(), digest_size=16).digest()


def _search(counts: dict[int, int], size: int, most_bins: int, nodes: float, bound: RestBound) -> tuple[Plan | None, float]:
    """A packing of at most ``most_bins``, or None, and the nodes that are left; the search was complete if there are some."""
    seen: set[bytes] = set()
    path: Plan = []

    def branches(left: dict[int, int], slack: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(times, filling with the longest, waste of one): each filling as often as it goes, half as often, and so on down to once."""
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        for filling in fillings(size - longest, rest, slack):
            whole = (longest, *filling)
            waste, times = size - sum(whole), min(left[n] // k for n, k in Counter(whole).items())
            times = min(times, slack // waste) if waste else times
            while times:
                yield times, whole, waste
                times //= 2

    def visit(left: dict[int, int], slack: int, used: int) -> tuple[Plan | None, Iterator]:
        """The whole packing if best fit completes it; else the branches of a state that was not visited."""
        ended = best_fit(left, size)
        if used + sum(t for t, _ in ended) <= most_bins:
            return [*path, *ended], iter(())
        key = _state(left)  # what is left tells what was packed, so equal states differ in nothing but their waste, and less comes first
        if (key, slack) in seen or used + bound(left) > most_bins or _hopeless(left, size, slack):
            return None, iter(())
        seen.add((key, slack))
        return None, branches(left, slack)

    slack = most_bins * size - sum(n * c for n, c in counts.items())
    if slack < 0:
        return None, nodes
    done, options = visit(counts, slack, 0)
    stack = [(counts, slack, 0, options)]
    while done is None and stack and nodes > 0:
        left, slack, used, options = stack[-1]
        choice = next(options, None)
        if choice is None:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        times, whole, waste = choice
        need = Counter(whole)
        rest = {n: c for n in left if (c := left[n] - times * need.get(n, 0))}
        path.append((times, whole))
        done, options = visit(rest, slack - times * waste, used + times)
        stack.append((rest, slack - times * waste, used + times, options))
    return done, nodes


def bin_completion(counts: dict[int, int], size: int = SIZE, most_steps: int | None = MOST_STEPS) -> Packing:
    """As few sequences as the search finds in ``most_steps``, its only bound, and how few there must be at least.

    With ``most_steps=None`` the search goes on until the number is proved to be the least, however long that takes.

    A node takes as many steps as there are different lengths. Best-fit decreasing is the first incumbent. A number of sequences between the lower bound and the incumbent is asked for: first the
    lower bound itself, then halfway. A complete search without result raises the bound, a result becomes the incumbent.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    plan = best_fit(counts, size)
    bins, least = sum(t for t, _ in plan), lower_bound(counts, size)
    tried = least  # fewer than these are ruled out, or were given up
    nodes = math.inf if most_steps is None else max(2, most_steps // max(1, len(counts)))
    bound = RestBound(counts, size) if tried < bins else None
    ask, share = least, nodes // 2 if most_steps is not None else nodes
    while tried < bins:
        found, left = _search(counts, size, ask, share, bound)
        if found is not None:
            plan, bins = found, sum(t for t, _ in found)
        else:
            if left > 0:
                least = max(least, ask + 1)
            tried = ask + 1
        ask, share = tried + (bins - 1 - tried) // 2, nodes if most_steps is None else max(1, nodes // 2 // max(1, (bins - tried).bit_length()))
    return Packing(plan, bins, least)


# ---------------------------------------------------------------- pieces and places
def pieces(docs: DataFrame, tokenizer: str, pattern: str | None, end_id: int, *, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit); long documents are cut from their end, so the first piece may be shorter."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            for at, got in enumerate(encoder.encode(x.as_py() for x in batch.column(1))):
                ids = got + end
                n = len(ids) // 4
                first = (n - 1) % size + 1
                for k, start in enumerate([0, *range(first, n, size)]):
                    stop = first if k == 0 else start + size
                    rows.append((at, k, start, stop - start, ids[4 * start : 4 * stop]))
            if rows:
                at, *cols = zip(*rows)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, cols, types)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids binary")


def pack(cut: DataFrame, size: int = SIZE, **search) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``. The table is read several times: give a written one.

    Every row also says how many ``sequences`` there are and how few there must be at least (``least_sequences``); if these are equal, the number
    is proved. ``most_steps=None`` searches until it is."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    packing = bin_completion(counts, size, **search)
    log.info("%d sequences, at least %d needed", packing.bins, packing.least)
    runs, ranked, base = [], Counter(), 0
    for times, lengths in packing.plan:
        at = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            runs.append((n, ranked[n], k, base, at))
            ranked[n] += times * k
            at += n * k
        base += times
    runs.sort()
    table = np.array(runs or [(0, 0, 1, 0, 0)], np.int64)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = table[np.searchsorted((table[:, 0] << 48) + table[:, 1], (n << 48) + r, "right") - 1]
        nth = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + nth // run[:, 2], "offset": run[:, 4] + nth % run[:, 2] * n})

    group = max(256, math.isqrt(max(counts.values(), default=1)))
    salts = F.create_map(*[F.lit(int(x)) for n, c in sorted(counts.items()) for x in (n, -(-c // group))]) if counts else F.create_map(F.lit(0), F.lit(1))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(salts, F.col("length").cast("int"))))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select(F.col("length").alias("__length"), F.col("__salt").alias("__group"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    rows = salted.withColumn("__rn", F.row_number().over(inside) - 1).join(firsts, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__group")))
    placed = rows.withColumn("__at", place("length", F.col("__first") + F.col("__rn")))
    said = [F.lit(n).cast("bigint").alias(name) for name, n in (("sequences", packing.bins), ("least_sequences", packing.least))]
    return placed.select(*cut.columns, "__at.sequence_id", "__at.offset", *said)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the pieces of each sequence joined in order (needs the ``ids`` of the pieces)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("length"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return pack(written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))
