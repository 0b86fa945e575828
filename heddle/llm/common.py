"""What the corpus operators share: shared scratch tables, Arrow limits, sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python batch or one block of documents may hold, about.
BLOCK_BYTES = 16 << 20
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in spark.checkpoint.dir; a folder of our own is
    made only where that is unset and all runs in one process, as in local tests.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="heddle-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for a while; afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go as soon as the table that they were made for is written.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Scratch:
    """Tables written once to the shared folder and read again; they cut lineage.

    A lost executor costs a reread of files, never a recomputation. Tables that a
    lazy result still reads are removed when the session's process ends, or by
    dropped() once the result is written; drop() removes one as soon as nothing reads it.
    """

    _made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/heddle/{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(self._end)
        if Scratch._made is not None:
            Scratch._made.append(self)

    @staticmethod
    @contextmanager
    def dropped():
        """Removes at its end all tables of scratches made within: for a result that is written by then."""
        outer, Scratch._made = Scratch._made, []
        try:
            yield
        finally:
            made, Scratch._made = Scratch._made, outer
            for s in made:
                s._end()

    def _end(self) -> None:
        atexit.unregister(self._end)
        if self.spark.sparkContext._jsc is not None:
            try:
                for name in [*self.tables, ""]:
                    self.drop(name)
            except Exception:  # the JVM may be gone already; its files stay then
                return

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        with settings(self.spark, CLEANED):
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> DataFrame:
        """A table dealt by key, whose rows joins on the key needn't shuffle."""
        table = self.tables[name] = f"heddle_{uuid.uuid4().hex}"
        with settings(self.spark, CLEANED):
            df.write.mode("overwrite").format("parquet").option("compression", codec).option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_limits(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of long texts small: rows bound the batch, not the data."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_heddle_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="heddle-zip-"), "heddle_pkg.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    sc._heddle_sent = True


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers idle beside the next stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_length(text: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def blocks_for(total_bytes: int, block_bytes: int = BLOCK_BYTES, least: int = 1) -> int:
    return max(least, -(-int(total_bytes) // block_bytes))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(byte_length(F.col(text)))).first()[0] or 0)


def buckets_for(spark: SparkSession, docs: DataFrame, each: int) -> int:
    """Buckets of about `each` bytes by the optimizer's estimate, or by the texts where
    it has none. Small tables have more of them, so that few packs share one."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 56:  # stands for an unknown size
        size = total_bytes(docs)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(16 * size // each, 1024), size // each)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
