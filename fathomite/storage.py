"""The shared folder of a cluster, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) is a local folder made; it goes at exit.
    On a cluster each executor would write to its own disk, so there a session without a shared folder is refused.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="fathomite-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


@contextmanager
def released(spark: SparkSession):
    """Inside, the shuffle files of an action go when it ends, so that they do not add up with those of later steps."""
    before = spark.conf.get(_FILE_CLEANUP, "false")
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_FILE_CLEANUP, before)


def materialize(df: DataFrame, tag: str, codec: str = "zstd", bucket_by: str | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    With ``bucket_by`` it is bucketed by that column into as many buckets as a shuffle has partitions, so that joins
    on the column read it where it lies. ``files`` limits the number of files, for a table known to be small: each file
    costs a local file system several short-lived processes, and a round of a loop should not write one per partition.

    This cuts lineage: a lost executor costs a re-read, not a re-run of the plan. The shuffle files of the write are
    released. The tables stay in the folder, for whoever holds the DataFrame, until the folder's owner clears it, as
    with checkpoints.
    """
    spark = df.sparkSession
    name = f"fathomite_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with released(spark):
        write = (df if files is None else df.coalesce(files)).write.option("compression", codec)
        if bucket_by is None:
            write.parquet(path)
        else:
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            write.bucketBy(buckets, bucket_by).option("path", path).format("parquet").saveAsTable(name)
            return spark.table(name)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path of ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder under ``path``, then make it the current version; the folder is returned.

    Versions are folders of their own, and a manifest of one line names the current one. It is replaced only when all of
    the new version is written, so readers see a whole version, the old or the new, and a writer that dies leaves the old
    one current. Old versions stay, for those who still read them, until ``prune``.
    """
    version = f"v_{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    fs, manifest = _at(spark, f"{path}/CURRENT")
    out = fs.create(manifest, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version of ``path``; None where nothing has been published."""
    fs, manifest = _at(spark, f"{path}/CURRENT")
    if not fs.exists(manifest):
        return None
    text = spark.read.text(f"{path}/CURRENT").first()
    return f"{path}/{text[0]}" if text and text[0] else None


def prune(spark: SparkSession, path: str) -> int:
    """Delete all versions of ``path`` but the current one, those too that were never finished; their number."""
    fs, top = _at(spark, path)
    kept = current(spark, path)
    if kept is None or not fs.exists(top):
        return 0
    old = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("v_") and f.getPath().getName() != kept.rsplit("/", 1)[1]]
    return sum(bool(fs.delete(p, True)) for p in old)


def once(df: DataFrame, name: str | None, build: Callable[[str], None]) -> str:
    """The folder of what ``build`` has made of ``df``, made now or found from an earlier call.

    It lies in the shared folder under ``name`` and a digest of the files that ``df`` reads, with their lengths and times:
    new files make a new version. ``name`` must tell apart what is made of the same files. Without a name, and for a frame
    that reads no files (made in memory), there is nothing to know it by, and it is built anew.
    """
    spark = df.sparkSession
    files = df.inputFiles() if name else []
    if files:
        states, wanted = [], {f.rsplit("/", 1)[1] for f in files}
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            fs, place = _at(spark, folder)
            states += sorted(f"{folder}/{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(place) if s.getPath().getName() in wanted)
        key = hashlib.md5("\n".join([name, *states]).encode()).hexdigest()
    else:
        key = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/fathomite_{name or 'own'}_{key}"
    return current(spark, path) or publish(spark, path, build)
