"""Session helpers: shared work folder, materialisation, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when the files it is read from have at most this size, some ten times as much in memory.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if set, else a folder of this process (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talklake-")
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_SCRATCH: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is deleted when the process ends, or by clean_up()."""
    path = f"{shared_dir(spark)}/talklake/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(clean_up)
    _SCRATCH.append(path)
    return path


def clean_up() -> None:
    """Delete what this process has written for its queries. Results that are read lazily must have been read."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  # the session may be ending; what is left is only scratch
            return
    _SCRATCH.clear()
    atexit.unregister(clean_up)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work path; missing paths are fine."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table."""
    fs, p = _fs(spark, path)
    files = fs.listStatus(p) if fs.exists(p) else []
    return ";".join(sorted(f"{s.getPath().getName()},{s.getLen()},{s.getModificationTime()}" for s in files))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and publish it by rename, so readers see the old or the new content."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    ctx.rename(tmp, p, options)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that mustn't exist yet, by rename; False if another writer was there first."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        ctx.rename(tmp, p, options)
    except Exception as e:  # the Java exception's class is only known by name here
        fs.delete(tmp, False)
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talklake_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_talklake_path", None)
    if path:
        remove(df.sparkSession, path)


def free_shuffles(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it finds them by the driver's collections."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def written_bytes(df: DataFrame) -> int | None:
    """Size of the files that materialise() wrote for df."""
    path = getattr(df, "_talklake_path", None)
    if not path:
        return None
    fs, p = _fs(df.sparkSession, path)
    return int(fs.getContentSummary(p).getLength())


def maybe_broadcast(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Broadcast hint only where the files df is read from (those of `written`, if it isn't materialised itself) are small.

    Beyond BROADCAST_BYTES the join is left to AQE, which shuffles.
    """
    size = written_bytes(df if written is None else written)
    return F.broadcast(df) if size is not None and size <= BROADCAST_BYTES else df


def hot_keys(df: DataFrame, keys: list[str], at: str, least: int = 200_000, parts: int = 10_000) -> list:
    """Keys with more than max(least, rows / parts) rows, with count and extent of at.

    At most `parts` keys can be above the bound, so the result may be collected and broadcast at any size.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    total = df.count()
    bound = max(least, total // parts)
    if total <= bound:
        return []
    return counts.where(F.col("_n") > bound).withColumn("_slices", F.ceil(F.col("_n") / bound).cast("int")).collect()
