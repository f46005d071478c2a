"""Token ids in flat binary files, with 64-bit document offsets, read through memory maps.

A store is a folder. Documents are sorted by ``doc_id`` and dealt to tasks by range; a task encodes them and writes one part
or more, each with ``<name>.bin``, the ids of its documents one after another as unsigned 16-bit numbers (32-bit for vocabularies over
65,536), ``<name>.idx``, the n + 1 signed 64-bit offsets of its documents in ids, and ``<name>.doc``, their doc_ids as
signed 64-bit numbers (nulls sort first and their count is in the manifest). Names carry a random part, and only files
of tasks that succeeded get into the manifest, so a task may run again at any time. The manifest has a row for each
part; a part's base, the ids in all parts before it, is the prefix sum of their counts.

Defined cases: a null or empty text has only the end id; rows with equal doc_id stand side by side, by a hash of the text; null
doc_ids come first; an empty table makes a store without ids; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, small_batches
from tessera.llm.word_encoder import word_encoder

MANIFEST = "task int, at int, name string, n_docs bigint, n_null bigint, n_tokens bigint, width int"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; Hadoop's ``s3a`` is Arrow's ``s3``."""
    return fs.FileSystem.from_uri(f"s3{uri[3:]}" if uri.startswith("s3a://") else uri)


def _keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tie, text``; ``tie`` orders rows of one doc_id."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))


def _encoding(tokenizer: str, pattern: str | None, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``doc_id, tie, n, ids`` from those of ``_keyed``: each document's ids with the end id, 2 or 4 bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, pattern)
        kind = np.dtype("<u2" if encoder.vocabulary <= 1 << 16 else "<u4")
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [np.frombuffer(got, "<u4").astype(kind).tobytes() + end for got in encoder.encode(x.as_py() for x in batch.column(2))]
            n = pa.array([len(i) // kind.itemsize for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(ids, pa.binary())], ["doc_id", "tie", "n", "ids"])

    return encode


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None, end_id: int, *, part_ids: int = 1 << 27, part_docs: int = 1 << 20, **columns) -> list[dict]:
    """Writes a store and returns its manifest: one small row for each part, with its base.

    Texts are sorted and encoded where they are written: in the shuffle they compress better than ids do. A part ends after ``part_ids`` ids or ``part_docs`` documents, so a task's
    lists of offsets and a file stay bounded (but for a single document that is longer).
    """
    where, path = _place(folder)
    where.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, out, width = TaskContext.get().partitionId(), 0, None, 2
        where, path = _place(folder)
        name, offsets, ids, nulls = "", [0], [], 0

        def closed() -> pa.RecordBatch:
            out.close()
            for end_name, values in (("idx", np.array(offsets, "<i8")), ("doc", np.array(ids, "<i8"))):
                with where.open_output_stream(f"{path}/{name}.{end_name}") as f:
                    f.write(values.tobytes())
            row = [task, at, name, len(ids), nulls, offsets[-1], width]
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["task", "at", "name", "n_docs", "n_null", "n_tokens", "width"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if out is not None and (offsets[-1] + n > part_ids or len(ids) >= part_docs):
                    yield closed()
                    at, out = at + 1, None
                if out is None:
                    name, offsets, ids, nulls, width = f"part-{uuid.uuid4().hex}", [0], [], 0, len(raw) // n
                    out = where.open_output_stream(f"{path}/{name}.bin")
                out.write(raw)
                offsets.append(offsets[-1] + n)
                ids.append(doc or 0)
                nulls += doc is None
        if out is not None:
            yield closed()

    small_batches(docs.sparkSession)
    encode = _encoding(tokenizer, pattern, end_id)
    rows = _keyed(docs, **columns).orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    rows.mapInArrow(lambda batches: write(encode(batches)), MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """The parts in order, each with the prefix sums ``base`` (ids before it)."""
    parts = [r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()]
    parts.sort(key=lambda p: (p["task"], p["at"]))
    for p, base in zip(parts, accumulate((p["n_tokens"] for p in parts), initial=0)):
        p["base"] = base
    return parts


def mapped(folder: str, name: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Numbers ``at`` to ``to`` of a file of the store: through a memory map where the folder is mounted, else read by range."""
    where, path = _place(folder)
    if isinstance(where, fs.LocalFileSystem):
        whole = np.memmap(f"{path}/{name}", kind, mode="r")
        return lambda at, to: whole[at:to]
    file, width = where.open_input_file(f"{path}/{name}"), np.dtype(kind).itemsize
    return lambda at, to: np.frombuffer(file.read_at((to - at) * width, at * width), kind)


def read_tokens(spark: SparkSession, folder: str, *, together: int = 1 << 22) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: each document's place in the whole store and its ids (little-endian unsigned 32-bit).

    About ``together`` ids at a time are read, or one document if it is longer.
    """
    parts = manifest(spark, folder)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p["name"], p["n_docs"], p["n_null"], p["width"], p["base"]) for p in parts], "name string, n_docs bigint, n_null bigint, width int, base bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                ids, offsets, docs = (mapped(folder, f"{p['name']}.{end}", kind) for end, kind in (("bin", f"<u{p['width']}"), ("idx", "<i8"), ("doc", "<i8")))
                at = 0
                while at < p["n_docs"]:
                    places = offsets(at, min(at + 512, p["n_docs"]) + 1)
                    n = max(1, int(np.searchsorted(places, places[0] + together, "right")) - 1)
                    places = places[: n + 1]
                    body = ids(int(places[0]), int(places[-1])).astype("<u4")
                    cut = [body[i - places[0] : j - places[0]].tobytes() for i, j in zip(places, places[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs(at, at + n), pa.int64(), mask=np.arange(at, at + n) < p["n_null"]),
                            pa.array(places[:-1] + p["base"], pa.int64()),
                            pa.array(np.diff(places), pa.int64()),
                            pa.array(cut, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at += n

    return listed.repartition(len(parts), "name").mapInArrow(read, schema)


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
