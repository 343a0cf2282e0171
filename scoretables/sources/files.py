"""Files: result logs, name lists, manifests, JSON maps, chunk plans, provenance."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ("system", "task_id", "chunk_index", "piece_id", "performance", "status", "multi_pitch", "voice", "meter", "value", "harmony")


#: Statuses that are tried again.
RETRIED = ("timeout", "mv2h_failed")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a local one only in a session of one JVM that sets no ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scoretables-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/scoretables/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def put_aside(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its rows and their order in files stay the same however often it is read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result log as strings; nothing is guessed from the data."""
    return spark.read.schema(", ".join(f"{c} string" for c in RESULT_COLUMNS)).option("header", True).csv(path)


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a result log; a first write makes it, with its heading."""
    results.select(*(F.col(c).cast("string") for c in RESULT_COLUMNS)).write.mode("append").option("header", True).csv(path)


def strict_metrics(raw: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Metrics of successes whose numbers can all be read; null otherwise."""
    numbers = [F.col(m).try_cast("double") for m in metrics]
    good = F.col("status") == "success"
    for n in numbers:
        good = good & n.isNotNull()
    return raw.withColumns({m: F.when(good, n) for m, n in zip(metrics, numbers, strict=True)})


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``value``: each line of the name lists at the path."""
    return spark.read.text(path)


def text_lines(spark: SparkSession, path: str, suffix: str = ".krn") -> DataFrame:
    """``path`` (of the file), ``line_no`` (from 1) and ``line`` of the text files under a folder, at any depth.

    A file is one row before it is cut into lines, as a line has no number of its own in a split; scores are small files.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    return rows.select("path", F.posexplode("lines").alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk definitions of either dialect, told apart by the heading: ``piece_id`` or ``piece``, ``performance`` or none."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(coalesced(raw, "piece_id", "piece"), coalesced(raw, "performance", "perf"), *(F.col(c).cast("long") for c in ("chunk_index", "start_measure", "end_measure")))


def write_failures(results: DataFrame, folder: str) -> DataFrame:
    """Tab-separated lists of tasks that ran out of time and of those that failed otherwise, and one row of their counts."""
    timeout = F.col("status") == "timeout"
    failed = results.where(~F.col("status").isin("success"))
    for name, test in (("timeouts", timeout), ("errors", ~timeout)):
        failed.where(test).select("system", "task_id", "status").write.option("sep", "\t").csv(f"{folder}/{name}")
    return failed.agg(F.count_if(timeout).alias("n_timeout"), F.count_if(~timeout).alias("n_error"))


def write_retries(results: DataFrame, path: str) -> None:
    """Tasks whose status is tried again, tab-separated under a comment."""
    rows = results.where(F.col("status").isin(*RETRIED)).select(F.concat_ws("\t", "system", "task_id", "status").alias("value"))
    head = results.sparkSession.createDataFrame([("# system\ttask\tstatus",)], "value string")
    head.unionByName(rows).write.text(path)


def read_retries(spark: SparkSession, path: str) -> DataFrame:
    """The list again; comments and rows of fewer than three fields are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 3))
    return rows.select(*(F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("system", "task_id", "status"))))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One folder of JSON rows for each split."""
    manifest.write.partitionBy("split").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def map_rows(text: DataFrame, column: str, value_type: str) -> DataFrame:
    """Rows ``id`` and the fields of each value of JSON objects keyed by id."""
    return text.select(F.explode(F.from_json(column, f"map<string,{value_type}>")).alias("id", "value")).select("id", "value.*")


def coalesced(df: DataFrame, name: str, *aliases: str) -> Column:
    """The first of several column names for one thing that the table has and that is not null."""
    there = [F.col(a) for a in (name, *aliases) if a in df.columns]
    return (F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name)


def planned(spark: SparkSession, folder: str, make, **parameters) -> DataFrame:
    """A stored table if one was made with the same parameters, all of which are in its name; else it is made."""
    key = hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    path = f"{folder}/plan-{key}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        make(**parameters).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provenance(rows: DataFrame, strengths: dict[str, Column]) -> DataFrame:
    """A JSON record of what made each row, with its strengths as a map."""
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in strengths)), F.array(*strengths.values()))
    return rows.withColumn("record", F.to_json(F.struct("stem", F.lit("1").alias("version"), pairs.alias("k_values"))))


def provenance_back(rows: DataFrame) -> DataFrame:
    return rows.withColumn("record", F.from_json("record", "stem string, version string, k_values map<string,double>"))
