"""Table sinks that may run again.

A sink's rows belong to a run (``run_id``: a batch date, a job's name, a
micro-batch's number).  Every write is an attempt in folders of its own, and the
run's row in the manifest, written last, says which attempt counts.  A run that
is repeated replaces its rows, whichever partitions they are in; a run that dies
leaves what was there before; other runs stay.  Nothing is deleted or changed in
place, so the audit log is append-only.

* ``findings``: partitioned by severity (readers of CRITICAL/HIGH prune the rest).
* ``verdicts``: one row per message.
* ``audit``: the operator audit events.
* ``reports``: one JSON object per message, as JSON files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions.text import cut
from tripwire.operators.scan import findings_table

MANIFEST = T.StructType([T.StructField("attempt", T.StringType()), T.StructField("run_id", T.StringType())])


def write_run(rows: DataFrame, path: str, run_id: str, by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Make ``rows`` the rows of the run ``run_id`` in the table at ``path``."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    tagged = rows.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
    tagged.write.mode("append").partitionBy("run_id", "attempt", *by).format(fmt).save(f"{path}/rows")
    entry = spark.createDataFrame([(attempt, run_id)], MANIFEST)
    entry.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{path}/manifest")


def read_runs(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The rows that count, of all runs, with ``run_id``; ``schema`` has the columns that were written."""
    tags = [T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *tags])).format(fmt).load(f"{path}/rows")
    counts = spark.read.schema(MANIFEST).json(f"{path}/manifest")       # a row a run
    return rows.join(counts, ["run_id", "attempt"]).select(*schema.names, "run_id")


def write_findings(verdicts: DataFrame, path: str, keep=("msg_id",), mode: str = "append") -> None:
    """A plain table of findings, without runs: an append that is run again adds its rows again."""
    findings_table(verdicts, keep).write.mode(mode).partitionBy("severity").parquet(path)


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    verdicts.drop("findings").write.mode(mode).parquet(path)


def findings_run(verdicts: DataFrame, path: str, run_id: str, keep=("msg_id",)) -> T.StructType:
    rows = findings_table(verdicts, keep)
    write_run(rows, path, run_id, ["severity"])
    return rows.schema


def verdicts_run(verdicts: DataFrame, path: str, run_id: str) -> T.StructType:
    rows = verdicts.drop("findings", "text")
    write_run(rows, path, run_id)
    return rows.schema


def audit_run(events: DataFrame, path: str, run_id: str) -> T.StructType:
    write_run(events, path, run_id)
    return events.schema


def report_objects(verdicts: DataFrame, keep=("msg_id",)) -> DataFrame:
    """The JSON report's fields as columns, beside ``keep``."""
    found = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code"), f["detail"].alias("detail"), f["decoded"].alias("decoded")))
    return verdicts.select(*keep, cut(F.coalesce("text", F.lit("")), 200).alias("input_preview"), "risk_score", "verdict", "decoded_payload", found.alias("findings"))


def reports_run(verdicts: DataFrame, path: str, run_id: str, keep=("msg_id",)) -> T.StructType:
    """JSON files with one report a line; ``verdicts`` has the text."""
    rows = report_objects(verdicts, keep)
    write_run(rows, path, run_id, fmt="json")
    return rows.schema
