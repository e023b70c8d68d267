"""Helpers that the operators of this subpackage share: table reads, the shared
scratch folder, and Arrow batches seen as flat numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions.shipping import ship

#: Bytes of text that one numpy step works on; longer texts are taken whole.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session, or, only where that is unset and all runs in one process (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A folder of this application in the shared folder for intermediate tables. It goes when the driver ends with its context
    alive; what a crash leaves behind is named after the application."""
    path = f"{shared_dir(spark)}/lexiquarry-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_removed, spark, path)
    return path


_SCRATCH: set[str] = set()


def _removed(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._gateway is None:
        return
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def stored(frame: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: later stages neither
    recompute them nor depend on the executors that made them."""
    spark = frame.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    trim_driver(spark)
    return spark.read.schema(frame.schema).parquet(path)


def cut(frame: DataFrame) -> DataFrame:
    """The rows without their lineage, by a reliable checkpoint."""
    shared_dir(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    trim_driver(frame.sparkSession)
    return out


#: Rows of an Arrow batch, unless the session says otherwise: texts and shingle sets are
#: kilobytes each, so Spark's default of 10,000 rows would hold too much at once.
ARROW_ROWS = 1024


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """Let the driver's JVM return freed memory outside its heap to the system, and say whether it could: compiling the code of
    many plans leaves hundreds of megabytes behind in the allocator."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        # Through the public interface: the class of the server is closed to reflection.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        asked = gateway.new_array(jvm.java.lang.Object, 4)
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:  # not every JVM or C library has it
        return False
    return True


def frugal(run: Callable) -> Callable:
    """The function, with memory given back to the system when a task ends: workers live on and
    share the executor's memory with its other processes."""

    def go(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def mapped(frame: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function of this package."""
    spark = frame.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return frame.mapInArrow(frugal(run), schema)


def keeping(docs: DataFrame, keep: list[str], inputs: dict[str, Column], run: Callable, outputs: str) -> DataFrame:
    """The columns ``keep`` beside the outputs of a function of the inputs. What is kept travels in one
    struct, ``kept``, first in each batch both ways, so that no name of it can clash."""
    held = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(held.alias("kept"), *[c.alias(n) for n, c in inputs.items()])
    made = T.StructType.fromDDL(outputs)
    out = mapped(rows, run, T.StructType([rows.schema["kept"], *made.fields]))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], *made.names)


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """own (all columns of a row) and _row, a number of each row alone, and whether it is the doc_id: it is where those
    differ. Else numbers mean no order, and the rows are written, so that each keeps its own."""
    held = docs.select(F.struct("*").alias("own"))
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if twice.isEmpty():
        return held.withColumn("_row", F.col("own.doc_id").cast("long")), True
    return stored(held.withColumn("_row", F.monotonically_increasing_id())), False


def crc_fold(key: Column, folds: int) -> Column:
    """The fold of a key: the crc32 of its text modulo their number."""
    return F.crc32(key.cast("string")) % folds


def partitions(spark: SparkSession) -> int:
    """Number of parts that packed rows are dealt to: the session's own sizing."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (n + 1). Nulls
    count as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def longs(column: pa.Array) -> np.ndarray:
    """An integer column as int64; nulls become the least long, which sorts first."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
