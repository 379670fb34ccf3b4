"""Session helpers shared by every operator."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and give the session a checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``; only where that is unset (tests, a
    laptop) is a temporary one made, and only for a local master: executors of a cluster could not read it.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="locusflow-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later steps reread it instead of recomputing it."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*dfs: DataFrame) -> None:
    """Deletes the checkpoint files of results of ``cut`` that nothing reads any more; what came of them must be cut itself."""
    for df in dfs:
        try:
            found = df._jdf.logicalPlan().rdd().getCheckpointFile()
        except Py4JError:  # not such a result
            continue
        if found.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _trim(spark: SparkSession) -> None:
    """Gives what both processes of the driver have freed outside their collected heaps back to the system, which the C library's allocator
    does not do by itself: of some hundred threads it keeps a pool each. Nothing happens where the library or the JVM cannot."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        of = jvm.java.lang.Class.forName
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = (of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is not open to callers, its interface is
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # no such command
        pass


def tidy(spark: SparkSession) -> None:
    """Lets the context cleaner remove the shuffle files of plans that are no longer referenced, which it does only after a collection of the driver's memory,
    and gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    _trim(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
