"""Small helpers shared by the corpus operators: shared scratch tables, tokenised words, columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all contracts here: space and tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
#: The same as a (Java and Python) regular expression class.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) a temporary folder of this machine is made, used
    as checkpoint folder, and removed at exit; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_quarry_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext._quarry_shared = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}/{name}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of work whose results have been written: it does so when its driver collects garbage."""
    import gc
    import time

    for _ in range(3):  # what the first finds unused, the next finds collected
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a whole input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: What operators keep in a worker process between tasks: functions made by ``lru_cache``.
_KEPT = []


def kept_between_tasks(cached):
    """Marks a function by ``lru_cache`` as one whose results ``lean`` tasks of the same process may drop."""
    _KEPT.append(cached)
    return cached


def drop_kept() -> None:
    for cached in _KEPT:
        cached.cache_clear()


def return_memory() -> None:
    """Hands memory that this process has freed back to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run`` of a ``mapInArrow`` whose tasks drop what other operators keep in the worker, and at their end hand back freed memory.

    Spark keeps workers for later tasks, so what one holds adds to the executor's memory in all later stages.
    """

    def task(batches):
        drop_kept()
        yield from run(batches)
        return_memory()

    return task


def free_name(df: DataFrame, name: str) -> str:
    """A column name for an operator's own use that the table does not have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, f"_q_{name}"
    while out.lower() in taken:
        out += "_"
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: str) -> list[str]:
    """Words of ``[^\\x20\\x09-\\x0D]+``, unchanged.

    ``str.split`` also cuts at other white space, so it serves ASCII texts without control
    separators only; all other texts have their separators made one first.
    """
    if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
        return text.split()
    if "\n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        text = text.translate(_TO_SPACE)
    return [w for w in text.split(" ") if w]


_TO_SPACE = {ord(c): " " for c in SEPARATORS}
