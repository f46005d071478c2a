"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; between stages the rows are written as Parquet and read again. All
but the last return the columns of ``documents``. What a stage decides takes effect: the classifier and the rules drop
rows, of near-duplicate groups one document stays, secrets are masked in the text, and packing places what is left.

Models are learned from the labelled rows of ``sf_dir``. The rules' stage reads a bounded sample of the labelled
documents anew (``labelled.MOST_LABELS``), since the stage before has dropped most of the bad examples among its input.

Defined cases: a null text counts as empty, and stays null where no stage changes it; equal rows are treated alike, and
near-duplicate removal keeps one of each group, whatever rows share a doc_id or have none; an empty table passes through; further columns are carried up to
the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_model, quality_rules, secret_scan, simhash
from tessera.llm.common import new_path, written
from tessera.llm.labelled import labelled_texts, usable
from tessera.llm.text_stats import shares, with_stats


def slim(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns in one struct ``rest``, where their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("rest"))


def whole(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again in their old order."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the classifier's cut."""
    labels = usable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = written(with_stats(slim(docs)), "stats")
    x = F.array(*shares(F.col("stats")).values())
    model = quality_model.fit(rows.select("doc_id", x.alias("x")).join(labels, "doc_id"))
    return whole(rows.filter(quality_model.score(x, model) >= quality_model.CUT), docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base thresholds or the learned decision list reject."""
    texts = labelled_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rules = quality_rules.learn_rules(with_stats(texts).select("doc_id", "stats", "label"))
    return whole(quality_rules.judged(with_stats(slim(docs)), rules).filter("kept"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (a null one if there is no other)."""
    return whole(simhash.keep_one(slim(docs)), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text; ``n_chars``, if there, follows the text."""
    found = secret_scan.scan_secrets(slim(docs), keep=("text", "rest"))
    masked = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets")))
    if "n_chars" in docs.columns:
        length = F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
        masked = masked.withColumn("rest", F.col("rest").withField("n_chars", length))
    return whole(masked, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: its token ids (little-endian, 32 bits each), and its place in a sequence."""
    import public_tokenizers

    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return packing.pack(written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids"), "pieces"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: The stages learn models, hash and tokenize, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = new_path(spark, f"stage{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
