"""What the operators of this subpackage share: scratch tables, words, text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters between words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that the Python operators ask for: some documents are very long.
BATCH_ROWS = "512"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session, spark.checkpoint.dir; only a local session without one gets its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='folioscan-')}"
    spark.sparkContext.setCheckpointDir(base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that written() made, when nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Up to so many rows of ids, 30 MB, meet texts by broadcast, so that texts aren't moved to be met; more by shuffle.
BROADCAST_IDS = 500_000


def met(docs: DataFrame, ids: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """docs joined with a narrow table, whose size decides how."""
    ids = written(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone; else they wait for the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def lean() -> None:
    """In a Python worker: gives back to the system what earlier stages left, as one worker serves many."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows unless the session asks for another number than Spark's own 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words: what stands between ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != "")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as remainder 2: learnt from, never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(2))
