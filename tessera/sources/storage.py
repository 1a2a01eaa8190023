"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine, where the setting is absent, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows no longer depend on how they came about."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """Remove a folder that nothing reads any more; false if there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it, for tasks that write files of their own."""
    local = path.removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(path)


def write_lines(path: str, lines: list[str]) -> None:
    """A new file of lines in a folder; it appears whole or not at all."""
    store, place = place_of(path)
    name = uuid.uuid4().hex
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/_{name}") as out:
        out.write("".join(f"{line}\n" for line in lines).encode())
    store.move(f"{place}/_{name}", f"{place}/{name}.json")


def read_lines(path: str) -> Iterator[str]:
    """The lines of all such files of a folder; none if there is no folder."""
    store, place = place_of(path)
    for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
            with store.open_input_file(info.path) as file:
                yield from file.read().decode().splitlines()


def written_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of such folders below ``path`` as JSON rows; none if there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
