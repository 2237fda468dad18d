"""What the operators of this subpackage share: the scratch folder, written tables, tokenizers.

Scratch data goes to the folder that ``spark.checkpoint.dir`` names, which the driver and all executors
share. Only where that setting is absent (a local session, as in tests) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that all executors can read and write."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder's URI below the shared one that nothing else uses. It goes when the driver's process ends."""
    path = f"{shared_root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append(path)
    return path


def _sweep() -> None:
    for path in _made:
        with contextlib.suppress(OSError, ValueError, NotImplementedError):  # it may never have been written
            fs, at = filesystem(path)
            fs.delete_dir(at)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``__file`` and ``__row``: numbers of the file and of the row in it that each row is read from, so that a
    task that runs again finds the same. What does not come straight from files is written first."""
    where = F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    try:
        return df.select("*", *where)
    except AnalysisException:
        return written(df, name).select("*", *where)


def filesystem(uri: str):
    """pyarrow's file system for ``uri`` and the path in it; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def slots(spark: SparkSession) -> int:
    """Tasks that this cluster is set to deal a shuffle to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def log2_ceil(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))


def salted(count: F.Column, rows: int, *keys) -> F.Column:
    """Which of ceil(count / rows) parts a row falls into, by the hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.greatest(F.lit(1), F.ceil(count / F.lit(rows))).cast("long"))
