"""Intermediate tables in the folder that the cluster shares.

``stored`` cuts lineage: it writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back, so a lost
executor costs a read and not the work before it. Where that setting is absent a local session (tests, a laptop) gets a
temporary folder, once per application; on a cluster, whose machines share no such folder, it is an error.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Keys that are broadcast at most, see `joined`.
HOT_KEYS, HOT_ROWS = 100_000, 1_000

_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or an own one where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="claimloom-")
    return _own[app]


def _removed_at_the_end(spark: SparkSession, path: str) -> None:
    """Marks a path for removal when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Python workers get at most BATCH_ROWS rows or BATCH_BYTES bytes (one row at least) at once: both sides of the pipe hold whole batches."""
    before = {key: spark.conf.get(key, None) for key in (_BATCH, _BYTES)}
    for key, most in ((_BATCH, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        own = int(re.sub(r"\D", "", before[key] or "") or 0) if key == _BATCH else 0
        spark.conf.set(key, str(min(own, most) if own > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; it is removed when the application ends, or before by `forget`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/claimloom-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    _removed_at_the_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.claimloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that `stored` made, as it returned them, and that no plan in use reads any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.claimloom_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows and the columns of groups, a table with one row for each set of keys and how many rows have it in `size`.

    Groups of more than a HOT_KEYS-th of `total` rows (HOT_ROWS at least) are broadcast: there are fewer than HOT_KEYS of
    them, whatever the data, and their rows stay where they are. The rest meets in a shuffle, where no key is hot.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = groups.where(F.col(size) > most), groups.where(F.col(size) <= most)
    known = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(known, keys, "left_anti").join(cold, keys))
