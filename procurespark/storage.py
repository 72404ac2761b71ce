"""Storage that every executor and the driver can reach: checkpoints and folders of one run."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on a local master; on a cluster
    that is an error, as no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="procurespark-checkpoints-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, with no lineage.

    A lost executor costs nothing but the reread of its part.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query made within has shuffled is removed when it ends, not only once the driver's memory is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, kind: str) -> str:
    """An unused path for files of one run below the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a finished run."""
    files, at = _at(spark, path)
    files.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path``; none if it isn't there."""
    files, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def create_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file that must not be there yet."""
    files, at = _at(spark, path)
    out = files.create(at, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    files, at = _at(spark, path)
    held = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held))
    finally:
        held.close()


def age_of(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds since 1970."""
    files, at = _at(spark, path)
    return files.getFileStatus(at).getModificationTime() / 1000


def publish(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file that is there whole or not at all; fails if there is one of its name.

    It is written under another name beside its place and renamed, which stores with an atomic rename do only where
    the name is free.
    """
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    create_file(spark, aside, content)
    jvm = spark._jvm
    try:
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path.replace(" ", "%20")), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        files.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path), options)
    finally:
        remove(spark, aside)
