"""Written intermediate tables: they cut lineage, and are read again after an executor is lost."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where none is set, a local session, whose
    executors are in the driver's process, gets a folder of its own; a cluster has to name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


#: Options of writing a table whose rows hold megabytes. Parquet's writer looks at its memory after a hundred rows, and its
#: reader holds up to 4,096 rows of a row group at once: so row groups are small, and looked at after each row.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: Bytes of a batch that a Python worker gets at once, where the session has Spark's own default.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Executors hold a heap and several workers side by side: batches of texts or large rows are kept small on both ends."""
    if spark.conf.get(BATCH_SETTING) == f"{64 << 20}b":
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df as a table in the shared folder and read it back. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "written_at", None):
            hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions below path, finished or not."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions below path, oldest first."""
    return [n for n in _numbers(spark, path) if exists(spark, f"{path}/v{n}/_READY")]


def current(spark: SparkSession, path: str) -> str:
    """The folder of the last complete version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is ingested below {path}")
    return f"{path}/v{found[-1]}"


def upcoming(spark: SparkSession, path: str) -> str:
    """A folder for the next version, which is this writer's alone: its mark is created only if it is not there. A number
    that a failed attempt has taken is not used again; readers see the last complete version until this one is committed."""
    n = (_numbers(spark, path) or [0])[-1] + 1
    while True:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_TAKEN")
        system = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            system.create(mark, False).close()
            return f"{path}/v{n}"
        except Exception:
            if not system.exists(mark):
                raise
            n += 1


class Outdated(RuntimeError):
    """Another writer has committed since this version was begun."""


def commit(spark: SparkSession, folder: str, keep: int = 2, base: int | None = None, needs: Callable[[int], set[int]] = lambda n: {n}) -> None:
    """Makes a version the current one, and deletes those that neither of the last ``keep`` needs. base: the version that
    this one was made from (0 for none); where that is not the current one any more, nothing is committed."""
    root = folder.rsplit("/", 1)[0]
    if base is not None and (versions(spark, root) or [0])[-1] != base:
        raise Outdated(f"{folder} is made from version {base}, which is not the last one")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_READY")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.create(path, True).close()
    found = versions(spark, root)
    held = set().union(*(needs(n) | {n} for n in found[-keep:]))
    for old in found[:-keep]:
        if old not in held:
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{old}"), True)


#: Bytes for each core under which a table is dealt anew before costly work: its scan would have fewer tasks than there are cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores; a large one, whose scan has tasks enough, as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df
