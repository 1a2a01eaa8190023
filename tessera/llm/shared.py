"""What the operators share: cutting lineage, and carrying a table's own columns along."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import textbytes as tb


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this application.

    The cluster names its place in ``spark.checkpoint.dir``.  Only on one machine, as
    in tests, a temporary folder serves where the setting is absent.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a file of a table that is known to be small.
ROWS = 1 << 15


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    ``rows``, where it is known, is how many rows ``df`` has at most: few are written as few files.
    On a local folder without Hadoop's native library an executor starts a process for each
    file (``chmod``), which counts with all of the executor's memory until it runs.
    What is computed since the last shuffle is done by as many tasks, so it should be little.
    """
    checkpoint_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS)))).checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no table needs any more.

    It does when the driver's JVM collects garbage, which jobs of few tasks put off.
    """
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name for files of tasks below the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    local = path.removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(path)


def write_array(path: str, values: np.ndarray) -> None:
    """Write 64-bit integers to a new file of the shared folder."""
    store, place = _place(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(np.ascontiguousarray(values, np.int64))


def open_array(path: str) -> np.ndarray:
    """Such a file mapped into memory; read into it where the folder's store can't be mapped."""
    store, place = _place(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, np.int64, "r")
    with store.open_input_file(place) as file:
        return np.frombuffer(file.read(), np.int64)


def write_batch(path: str, batch: pa.RecordBatch) -> None:
    """Write columns to a new file of the shared folder."""
    store, place = _place(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)


def read_batch(path: str) -> pa.RecordBatch:
    """The columns of such a file."""
    store, place = _place(path)
    with store.open_input_file(place) as file:
        return pa.ipc.open_file(file).get_batch(0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Carried:
    """A table's own columns beside an operator's.

    ``pack`` puts all columns but the text into one struct ``row``, so that whatever an
    operator adds beside ``row`` and ``text`` can't clash with them; ``unpack`` gives
    them back in their order, followed by the results.  Columns named like a result,
    whatever their case, are replaced by it.
    """

    def __init__(self, df: DataFrame, results: str, text: str = "text") -> None:
        self.results = StructType.fromDDL(results) if results else StructType()
        named = {f.name.lower() for f in self.results.fields}
        self.columns = [c for c in df.columns if c.lower() not in named]
        self.text = text.lower()

    def pack(self, df: DataFrame, **inner: Column) -> DataFrame:
        """(row, text, and the columns ``inner``, which are expressions over the table's own)."""
        others = [quoted(c).alias(c) for c in self.columns if c.lower() != self.text]
        row = F.struct(*others) if others else F.lit(0)
        return df.select(row.alias("row"), quoted(self.text).alias("text"), *(c.alias(n) for n, c in inner.items()))

    def schema(self, packed: DataFrame) -> StructType:
        """Of what a task returns: row, text and the results."""
        return StructType([packed.schema["row"], packed.schema["text"], *self.results.fields])

    def batch(self, batch: pa.RecordBatch, results: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *results], names=["row", "text", *(f.name for f in self.results.fields)])

    def map(self, packed: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        return packed.mapInArrow(tb.tidy(run), self.schema(packed))

    def unpack(self, packed: DataFrame) -> DataFrame:
        own = [F.col("text").alias(c) if c.lower() == self.text else F.col("row").getField(c).alias(c) for c in self.columns]
        return packed.select(*own, *(F.col(f.name) for f in self.results.fields))


def field(df: DataFrame, column: str, name: str) -> StructField:
    """The type of a table's column under another name."""
    return StructField(name, df.select(quoted(column)).schema[0].dataType)
