"""Results of detection runs as whole runs, an append-only register of findings, and exports.

A run's tables are written to a folder of its own; only when all are there is a line of a manifest written, and
readers see the runs that the manifest names.  A run that breaks off leaves nothing to see, and is written over
when it is tried again; a run that is there stays as it is.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _line(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    """One row, whole or not at all: a folder without Spark's mark of success is none."""
    rows = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def write_run(root: str, run_id: str, tables: dict[str, DataFrame], note: str = "") -> bool:
    """Write a run's tables (events, outcomes, classes, ...) as one; false if the run is already there."""
    spark = next(iter(tables.values())).sparkSession
    done = f"{root}/manifest/{run_id}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return False
    counts = {}
    for name, rows in tables.items():
        path = f"{root}/{name}/run={run_id}"
        rows.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.schema(rows.schema).parquet(path).count()
    _line(spark, done, {"run": run_id, "tables": json.dumps(counts, sort_keys=True), "note": note})
    return True


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: run, the rows of each of its tables, note."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [str(s.getPath()) for s in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if files.exists(place) else []
    return spark.read.parquet(*whole) if whole else spark.createDataFrame([], "run string, tables string, note string")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all whole runs, with the run's id."""
    ids = [r["run"] for r in runs(spark, root).filter(F.get_json_object("tables", f"$.{name}").isNotNull()).select("run").collect()]  # a row a run
    if not ids:
        raise LookupError(f"no run under {root} has a table {name!r}")
    return spark.read.option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/run={x}" for x in sorted(ids)))


def outcome_classes(results: DataFrame, classes: DataFrame) -> DataFrame:
    """Outcomes with how many classes their event belongs to (``classes``: event, class) and, of an event in several, the share that each link counts."""
    links = classes.groupBy("event").agg(F.count_distinct("class").alias("n_classes"))
    return results.join(classes.distinct(), "event").join(links, "event").withColumn("share", 1 / F.col("n_classes"))


# ---- register


def entry_id(entry: dict) -> str:
    """An id from an entry's content: equal entries have one id, others another, with no counter that writers could share."""
    return "F-" + hashlib.sha256(json.dumps(entry, sort_keys=True, default=str).encode()).hexdigest()[:20]


def register(spark: SparkSession, root: str, entry: dict) -> str:
    """Append a finding; one that is there already stays, and nothing is ever changed."""
    key = entry_id(entry)
    if not _exists(spark, f"{root}/{key}/_SUCCESS"):
        _line(spark, f"{root}/{key}", {"id": key, "title": str(entry.get("title", "")), "verdict": str(entry.get("verdict", "")), "content": json.dumps(entry, sort_keys=True, default=str)})
    return key


def registered(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/*")


# ---- exports

CSV = {
    "header": True, "nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One sorted CSV file a task with a header, times with microseconds, nested columns as JSON, an empty text apart from a null."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.orderBy(*order).select(*flat).write.mode("overwrite").options(**CSV, emptyValue='""').csv(path)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``export_csv`` wrote, with the given columns."""
    return spark.read.schema(schema).options(**CSV, emptyValue="", multiLine=True).csv(path)
