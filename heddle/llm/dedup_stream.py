"""Operator 3: exact deduplication as a stateful stream.

A pass over the texts logs (digest, id, locator) without any text. The locator is the row's
number in the log and the hash of its text as it was, which with the id finds the row in the
table again. The log is read as a stream into keyed state without expiry, kept on disk by the
RocksDB state store: digest -> smallest id, its locator, number of rows. Rows are combined within
each task before they reach the state, so a digest that holds a third of all rows
costs one row per task. On every hit (a digest seen more than once) the full bytes
are checked against the text that the locator names; texts that differ under one
digest are grouped again by their bytes.

Contract: texts are equal when identical after each run of space and 0x09-0x0D is
one space. The row with the smallest id stays.

* a null id is the smallest; null text counts as empty; empty texts form one group like any other.
* very long texts: only groups of two or more move texts, whole.
* ties: rows that repeat an id and text join one group; each row is returned.
* empty table: empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Members of a group that meet one copy of its representative.
MEMBERS_A_COPY = 256
#: Digests in a state partition, whose files cost some MB each; partitions at least.
STATE_ROWS, STATE_PARTS = 1_000_000, 16
#: Groups whose 8-byte keys may be sent to every executor; more are joined by a shuffle.
MOST_SENT = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _streamed(spark: SparkSession, scratch: Scratch, rows: int) -> DataFrame:
    """digest, keep_id, locator, keep_hash, n from the log, through the state store."""
    keep = {
        "spark.sql.streaming.internal.stateStore.partitions": str(max(STATE_PARTS, rows // STATE_ROWS)),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(scratch.path(f"state/of={number}"))

    try:
        log = spark.readStream.schema("doc_id long, digest binary, locator long, row_hash long").parquet(scratch.path("log"))
        state = log.groupBy("digest").agg(F.min(F.struct("doc_id", "locator", "row_hash")).alias("first"), F.count("*").alias("n"))
        query = state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.schema("digest binary, first struct<doc_id: long, locator: long, row_hash: long>, n long, batch int").parquet(scratch.path("state/*"))
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", "n", "first")).alias("x"))
    return last.select("digest", F.col("x.first.doc_id").alias("keep_id"), F.col("x.first.locator").alias("locator"), F.col("x.first.row_hash").alias("keep_hash"), F.col("x.n").alias("n"))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, and
    row_hash, a hash of the text as it was, which tells rows of one id apart.

    digest: the state's key, a function of the normalised text that gives hex
    digits; the groups are right for any digest, since hits compare bytes.
    """
    scratch = Scratch(spark)
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"), row)
    log = rows.select("doc_id", F.unhex(sha256(F.col("t"))).alias("sha"), F.unhex(digest(F.col("t"))).alias("digest"), "row_hash")
    # the locator is the row's number in the log, so it names one row even where ids repeat
    log = scratch.write(log.withColumn("locator", F.monotonically_increasing_id()), "log")
    shown = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"), "row_hash"]
    n_rows = log.count()
    if not n_rows:
        return log.select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept")).select(*shown)
    state = scratch.write(_streamed(spark, scratch, n_rows), "groups")
    found = log.join(state.select("digest", "keep_id", F.col("locator").alias("keep_locator"), "n"), "digest").withColumn("kept", F.col("locator") == F.col("keep_locator"))
    hits = state.filter("n > 1")
    n_hits = hits.count()
    if not n_hits:
        return found.select(*shown)
    # full bytes of the hits alone: their short keys filter the scan where they are few enough to send
    keyed = rows.withColumn("digest", F.unhex(digest(F.col("t"))))
    if n_hits <= MOST_SENT:
        keyed = keyed.withColumn("k", F.xxhash64("digest")).join(F.broadcast(hits.select(F.xxhash64("digest").alias("k")).distinct()), "k", "left_semi")
    # members are dealt over copies of their representative's text, a copy for each few hundred
    copies = F.ceil(F.col("n") / MEMBERS_A_COPY)
    members = keyed.join(hits.select("digest", "keep_id", "keep_hash", "n"), "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_hash"), copies))
    named = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    members = scratch.write(members.select("digest", named.alias("named"), "t", "n", "salt"), "members")
    # the text that the locator names
    first = members.filter("named").groupBy("digest").agg(F.min("t").alias("first_t"), F.max("n").alias("m"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / MEMBERS_A_COPY) - 1))).drop("m")
    bad = members.join(first, ["digest", "salt"]).filter(F.col("t") != F.col("first_t")).select("digest").distinct()
    bad = scratch.write(bad, "bad")
    if bad.isEmpty():
        scratch.drop("members")
        return found.select(*shown)
    # texts that differ under one digest: grouped again by their bytes, with the sound sha256 beside them
    again = members.join(bad, "digest", "left_semi").groupBy("digest", "t").agg(F.count("*").alias("n")).withColumn("sha", F.unhex(sha256(F.col("t"))))
    split = log.join(bad, "digest", "left_semi").groupBy("digest", "sha").agg(F.min(F.struct("doc_id", "locator")).alias("first"))
    split = split.join(again, ["digest", "sha"]).select("digest", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), "n")
    mended = log.join(split, ["digest", "sha"]).withColumn("kept", F.col("locator") == F.col("keep_locator"))
    return found.join(bad, "digest", "left_anti").select(*shown).unionByName(mended.select(*shown))


def op3_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""
