"""What the operators of this subpackage share: the folder that driver and executors both see, and table access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI. A temporary one stands in only on a local master, where all is one machine."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return "file://" + root if root.startswith("/") else root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glyphloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_glyphloom_path", None)
    if path:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, and Arrow batches in its session that hold few whole documents, unless the session was started with limits of its own."""
    given = df.sparkSession.sparkContext.getConf()
    for key, value in ARROW_BATCH.items():
        if not given.contains(key):
            df.sparkSession.conf.set(key, value)
    return df


# Python workers are used again by later stages, so what a stage keeps in one must not outlive it.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Say that this worker holds something for ``owner``, and how to let go of it."""
    _kept[owner] = drop


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def occupy(owner: str) -> None:
    """Drop what other owners keep in this worker."""
    for other in [k for k in _kept if k != owner]:
        _kept.pop(other)()


@dataclass(frozen=True)
class Tidy:
    """A function over an iterator of batches that has its worker to itself, and gives memory back when it ends."""

    run: Callable
    owner: str = ""

    def __call__(self, batches):
        occupy(self.owner)
        try:
            yield from self.run(batches)
        finally:
            give_back()


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on (extra columns of any name are left out); a null text is empty."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
