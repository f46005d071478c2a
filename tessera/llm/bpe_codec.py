"""Byte-level BPE encoding and decoding with tiktoken and a local file of ranks.

Texts longer than ``piece_chars`` are split first, only where a token of the pattern must end in any case:
before a space or line end that follows something else, or between a letter and a digit. Encoding the pieces one after
another gives the ids of the whole text, and no piece keeps the regex engine or a batch busy with megabytes.
A piece that stays long for want of such a place, say a megabyte of spaces, on which the library's own matching ends the
process, is cut into the pattern's matches here, and the library encodes each match. Decoding joins raw bytes; a text need not be cut at a character.

Defined cases: a null text counts as empty and has no ids; a run of text without such a place is encoded match by match;
equal rows are each returned; an empty table gives an empty result; other columns are ignored. Special strings
inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.pretoken import word_finder

PIECE_CHARS = 50_000
_SAFE = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """One encoder for each worker process, from lines of a base64 token and its rank."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where no token can cross."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def _matches(pattern: str):
    return word_finder(pattern)


def encode(text: str | None, codec: tiktoken.Encoding, size: int = PIECE_CHARS) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text or "", size):
        if len(piece) <= 2 * size:
            ids += codec.encode_ordinary(piece)
        else:
            for word in _matches(codec._pat_str)(piece):
                ids += codec._encode_single_piece(word)
    return ids


def id_lists(lists: pa.ListArray) -> Iterator[list[int]]:
    """The lists of an Arrow column of ids, by way of its flat numbers; a null list is empty."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    for at, to in zip(offsets, offsets[1:]):
        yield flat[at:to].tolist()


def encoded(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", to: str = "ids") -> DataFrame:
    """The rows with the token ids of their texts, ``array<int>``."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = encoding(rank_file, pattern)
        return pa.array((encode(t.as_py(), codec) for t in texts), pa.list_(pa.int32()))

    return docs.withColumn(to, ids(F.col(text)))


def decoded(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of token ids."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        codec = encoding(rank_file, pattern)
        return pa.array(map(codec.decode_bytes, id_lists(lists)), pa.binary())

    return raw(ids)


def coded(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", to: str = "code") -> DataFrame:
    """The rows with a struct of ``ids`` (``array<int>``) and ``raw``, the bytes that these ids decode to; a text is encoded once."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,raw:binary>")
    def both(texts: pa.Array) -> pa.Array:
        codec = encoding(rank_file, pattern)
        flat, ends, raw = [], [0], []
        for t in texts:
            ids = encode(t.as_py(), codec)
            flat.append(np.array(ids, np.int32))
            ends.append(ends[-1] + len(ids))
            raw.append(codec.decode_bytes(ids))
        numbers = np.concatenate(flat) if flat else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(raw, pa.binary())], ["ids", "raw"])

    return docs.withColumn(to, both(F.col(text)))


def digested(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", to: str = "code") -> DataFrame:
    """The rows with a struct of ``n_tokens``, and the hex digests of the decimal ids joined by spaces (``ids``) and of the bytes they decode to (``raw``).

    A task holds one text's ids at a time; neither ids nor bytes leave it.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,ids:string,raw:string>")
    def both(texts: pa.Array) -> pa.Array:
        codec = encoding(rank_file, pattern)
        rows = []
        for t in texts:
            ids = encode(t.as_py(), codec)
            rows.append({"n_tokens": len(ids), "ids": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "raw": hashlib.sha256(codec.decode_bytes(ids)).hexdigest()})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids", pa.string()), ("raw", pa.string())]))

    return docs.withColumn(to, both(F.col(text)))


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = digested(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "code.n_tokens", F.col("code.ids").alias("ids_sha256"), F.col("code.raw").alias("decoded_sha256"))
