"""Memory of the reused Python workers and of the driver."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def trim() -> None:
    """Hand freed memory back to the system; where the C library can't, only Arrow's."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, and at the end, what was freed goes back.

    A worker outlives its task and waits beside the next stage's, whose memory its own would narrow."""
    for batch in batches:
        yield batch
        del batch
        trim()
    trim()


def relieve(spark: SparkSession) -> bool:
    """Collect the driver JVM's garbage and hand freed memory back to the system; whether its C heap's was, too.

    An operator of many small jobs leaves plans, generated classes and file listings behind, each of them young, and heap
    that is once in use stays; without this the driver grows from run to run until its heap has its full size."""
    jvm = spark._jvm
    jvm.System.gc()
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(beans, args)
    except Exception:  # noqa: BLE001
        return False  # a JVM without this command, or not on Linux
    return True
