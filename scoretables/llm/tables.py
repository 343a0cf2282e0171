"""Small helpers shared by the operators: scratch tables, bounded samples, Arrow slices."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Tasks that write a table of known size: one for so many rows, but some at least.
LEAST_TASKS, ROWS_A_TASK = 16, 50_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a local one only in a session of one JVM that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scoretables-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/scoretables/{name}-{uuid.uuid4().hex}"
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables made within, for results that have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files, target = _file_system(spark, path)
            files.delete(target, True)


def scratch(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and survives lost executors.

    ``rows``: about how many it has, where that is known. A small table is then written by a few tasks, as so many
    files of a few rows would cost more than the rows; a large one is left as it is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, rows // ROWS_A_TASK))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, keys: list[Column], bound: int, seed: int = 0) -> DataFrame:
    """All rows if there are at most ``bound``, else those whose hash falls under bound / count (about ``bound``)."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``max_bytes`` of the text column, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def map_text(df: DataFrame, schema: str, make: Callable, text: str = "text") -> DataFrame:
    """mapInArrow over text slices. ``make()`` runs once a task and returns a function from a slice to arrays."""

    def run(batches):
        names, work = None, None
        for part in slices(batches, text):
            work = work or make()
            out = work(part)
            names = names or list(out)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return df.mapInArrow(run, schema)
