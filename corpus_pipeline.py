"""From raw documents to packed training sequences, in five written stages.

Each stage reads docs (doc_id, text and lang; other columns, whatever their names, go along) and
all but the last return its columns. The same holds in all of them:

* a null id is an id like others; rows are told apart by id and text, so that of rows that
  share an id only those that a decision names go.
* null text counts as empty and stays null; very long texts are read whole.
* ties: repeated rows (equal ids and texts) share a decision; exact_dedup keeps one of them.
* empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import dedup_stream, packing, pii_feistel, quality_kn, simhash_gray
from heddle.llm.common import Scratch, arrow_limits, ship, unused

#: Keys of dropped rows that may be sent to every executor (16 bytes each); more are joined by a shuffle.
MOST_SENT = 1_000_000
#: What tells rows apart.
KEY = ["doc_id", "row_hash"]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are among those dropped; null ids are equal."""
    few = dropped.count() <= MOST_SENT
    names = {c: unused(docs, f"_dropped_{c}") for c in KEY}
    dropped = dropped.select(*[F.col(c).alias(names[c]) for c in KEY])
    value = {"doc_id": docs["doc_id"], "row_hash": F.xxhash64(F.coalesce(docs["text"], F.lit("")))}
    same = [value[c].eqNullSafe(dropped[names[c]]) for c in KEY]
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model accepts. A null language is one of its own; without labels all stay."""
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_kn.perplexities(spark, docs, labels)
    return _without(docs, Scratch(spark).write(found.filter(~F.col("kept")).select(KEY).distinct(), "rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts: that with the smallest id, a null id ahead of all; of rows
    that repeat an id and a text, one."""
    _ready(spark)
    rows = Scratch(spark).write(dedup_stream.dedup(spark, docs).groupBy(KEY).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    left = _without(docs, rows.filter(~F.col("kept")).select(KEY))
    return left if rows.filter("kept AND n > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (and, of those, text hash), of each group of near-duplicates.
    Here a null id comes behind all others; empty texts are one group."""
    _ready(spark)
    found = simhash_gray.near_duplicates(spark, docs)
    return _without(docs, Scratch(spark).write(found.filter("NOT first").select(KEY).distinct(), "copies"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars, where there is one, follows the text."""
    n = unused(docs, "_replaced")
    out = pii_feistel.pseudonymise(docs, pii_feistel.QUERY_KEY, count_col=n)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences of 2048 tokens; an empty text is its end alone."""
    _ready(spark)
    cut = Scratch(spark).write(packing.pieces(docs, packing.tokenizer_path()), "pieces")
    return packing.pack(spark, cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _ready(spark: SparkSession) -> None:
    ship(spark)
    arrow_limits(spark)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("pack", pack)]
#: The model, the tokens and the packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor kept, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with Scratch.dropped():  # what the stage wrote for itself goes, and so does what it read
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
