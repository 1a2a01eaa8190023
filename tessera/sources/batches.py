"""Appends that may be repeated: each batch has a folder of its own, and old batches become few files.

A sink has a folder ``batch=K`` for each appended batch and, once batches were compacted, a folder
``upto=K`` with those up to K.  Both hold JSON lines in a folder for each first language.  Writing
a batch again replaces it, as a stream does that hands out its last batch again after a failure.  Batch numbers
grow, as those of a stream's batches do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.results import TRANSIENT
from tessera.sources.storage import removed

ROWS_PER_FILE = 100_000


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The batch up to which the sink is compacted (-1 for none), and the batches behind it; only whole folders count."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    paths = [s.getPath() for s in store.listStatus(place)] if store.exists(place) else []
    found = [(*p.getName().partition("=")[::2], p) for p in paths]
    upto = max((int(k) for kind, k, p in found if kind == "upto" and whole(p)), default=-1)
    return upto, sorted(int(k) for kind, k, p in found if kind == "batch" and int(k) > upto and whole(p))


def append(rows: DataFrame, path: str, batch_id: int, language: str = "first_language") -> bool:
    """Append accepted rows as a batch; one that is there already is replaced, one that was compacted stays (false)."""
    if batch_id <= _folders(rows.sparkSession, path)[0]:
        return False
    (folder,) = text.spare(rows, "language")
    kept = rows.drop(*TRANSIENT).withColumn(folder, F.col(language))
    kept.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).partitionBy(folder).json(f"{path}/batch={batch_id}")
    return True


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches, each once."""
    upto, batches = _folders(spark, path)
    folders = [f"{path}/upto={upto}"] * (upto >= 0) + [f"{path}/batch={k}" for k in batches]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folders)


def compact(spark: SparkSession, path: str, schema: str, language: str = "first_language", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write all batches anew as few files, and remove the old ones; returns the last batch in them (-1 if there was none).

    A language gets a file for each ``rows_per_file`` of its rows, at most; rows are dealt to them by a hash, so that one
    language may be written by many tasks.  The new folder counts once it is whole: a compaction that was killed
    leaves the sink as it was.  Nobody may read or append meanwhile.
    """
    upto, batches = _folders(spark, path)
    if not batches:
        return upto
    rows, last = read(spark, path, schema), batches[-1]
    of, n, file, folder = text.spare(rows, "_of", "_files", "_file", "language")
    sizes = rows.groupBy(F.col(language).alias(of)).agg(F.ceil(F.count("*") / F.lit(rows_per_file)).alias(n))
    dealt = rows.join(sizes, F.col(language).eqNullSafe(F.col(of))).withColumn(file, F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.col(n)))
    few = dealt.repartition(of, file).withColumn(folder, F.col(of)).drop(of, n, file)
    few.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).partitionBy(folder).json(f"{path}/upto={last}")
    for old in [f"upto={upto}"] * (upto >= 0) + [f"batch={k}" for k in batches]:
        removed(spark, f"{path}/{old}")
    return last
