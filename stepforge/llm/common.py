"""Shared-folder staging used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from stepforge.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where it is unset and everything runs in one JVM; on a cluster its absence is an error, since a
    folder of this machine would not be seen by others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stepforge-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, path: str) -> None:
    """Removes a folder at the end of the program, if the session is still there."""
    with contextlib.suppress(Exception):
        remove(spark, path)


def trim(spark: SparkSession) -> None:
    """Gives freed native memory of the driver's JVM (compilers, class loading, buffers) back to the system."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    for k, name in enumerate(names):
        kinds[k] = jvm.java.lang.Class.forName(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # through the interface, since the server's own class is in a closed module
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def release(spark: SparkSession) -> None:
    """Lets the driver give back what finished work held: plans and broadcasts in the JVM, freed arrays in Python."""
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(Exception):  # not every JVM has the command
        trim(spark)
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """A folder of Parquet tables below the shared folder; each table cuts lineage and survives lost executors.

    Results read some of the tables when they are asked for, so the folder stays until the program ends, but for what
    drop() removes before.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(sweep, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # shuffle files of a finished table are of no use any more; Spark removes them at once under this setting
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(key) if before is None else conf.set(key, before)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))
