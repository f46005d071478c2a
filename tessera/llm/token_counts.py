"""Token counts without token ids: byte-pair merging on a heap over a linked list of symbols.

Every word of the pre-tokenizer starts as its bytes. A heap holds the adjacent pairs that have a merge, by rank and
then place; the lowest is popped again and again, pairs that an earlier merge has changed are passed over, and the
list is relinked. The count is the number of bytes less the number of merges. Counts of words met before are kept in
a bounded table in each worker.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a special string inside a text counts as one token,
as the library takes it by default; equal rows are each returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.pretoken import byte_letters, word_finder

#: Words whose count a worker remembers; longer ones are merged each time.
MOST_WORDS, LONGEST = 400_000, 64


class MergeCounter:
    """Counts by the merges of a tokenizer file of the tokenizers library with a byte-level pre-tokenizer."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.words = word_finder(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        letters = self.letters
        symbols = [letters[b] for b in word.encode()]
        n, rank = len(symbols), self.rank
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after, merges = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged away or has grown
            symbols[i], symbols[j], merges = a + b, "", merges + 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return n - merges

    def plain(self, text: str) -> int:
        words, known = self.words(text), self.known
        new = set(words).difference(known)
        if new:
            if len(known) > MOST_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.merged(w)
        total = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + sum(1 for _ in self.special.finditer(text))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, *, limit: int = 1024, text: str = "text") -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(path, pattern).count
        return pa.array((count(t.as_py()) for t in texts), pa.int64())

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")
    return docs.withColumns({"n_bytes": size, "n_tokens": counted(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
