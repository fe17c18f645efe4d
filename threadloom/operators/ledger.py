"""Run ledger: events appended, the latest state as a view, artifacts, acceptance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = "run_id string, step_name string, status string, seq long, at timestamp, error string"
ERROR_CUT, IMPORT_ERROR_CUT = 4_000, 2_000


def event(df: DataFrame, error_cut: int = ERROR_CUT) -> DataFrame:
    """Events with the error text cut to what the ledger keeps."""
    return df.withColumn("error", F.left("error", F.lit(error_cut)))


def step_states(events: DataFrame) -> DataFrame:
    """Latest state of each step: a restart clears end time and error, started is the last start."""
    last = F.max_by(F.struct("status", "at", "error"), "seq").alias("s")
    started = F.max_by(F.when(F.col("status") == "running", F.col("at")), F.when(F.col("status") == "running", F.col("seq"))).alias("started_at")
    g = events.groupBy("run_id", "step_name").agg(last, started, F.count_if(F.col("status") == "running").alias("attempts"))
    return g.select("run_id", "step_name", F.col("s.status").alias("status"), "started_at", F.when(F.col("s.status") != "running", F.col("s.at")).alias("finished_at"), F.when(F.col("s.status") == "failed", F.col("s.error")).alias("error"), "attempts")


def run_states(steps: DataFrame) -> DataFrame:
    """failed if any step failed, running if any runs, else done."""
    return steps.groupBy("run_id").agg(F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(F.count_if(F.col("status") == "running") > 0, "running").otherwise("done").alias("status"), F.count("*").alias("steps"))


def check_counts(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, expected, actual, ok) by row counts."""
    out = None
    for name, want, have in checks:
        d = want.agg(F.count("*").alias("expected")).crossJoin(have.agg(F.count("*").alias("actual")))  # one row each
        d = d.select(F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))
        out = d if out is None else out.unionByName(d)
    return out


def check_present(name: str, ids: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """All ids are in the store: (check_name, expected, actual, ok)."""
    s = store.select(key).distinct().withColumn("_in", F.lit(1))
    g = ids.select(key).distinct().join(s, key, "left").agg(F.count("*").alias("expected"), F.count("_in").alias("actual"))
    return g.select(F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def same_set(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both sides hold the same ids; expected is the size of the union, actual of the common part."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    g = x.agg(F.count("*").alias("expected"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("actual"))
    return g.select(F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def one_profile(profiles: DataFrame) -> str:
    """The only profile's id; none or several are an error."""
    rows = profiles.select("id").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("exactly one profile is expected")
    return rows[0]["id"]


def validate_plan(limits: dict[str, int], run_limit: int) -> None:
    if sum(max(0, v) for v in limits.values()) <= 0:
        raise ValueError("all crawl limits are zero")
    if run_limit <= 0:
        raise ValueError("run limit must be positive")


def artifacts(files: DataFrame, run_id: Column, kind: Column) -> DataFrame:
    from threadloom.functions.ids import mime_type

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(run_id.alias("run_id"), name.alias("file_name"), kind.alias("kind"), mime_type(F.col("path")).alias("content_type"), "size_bytes", "sha256")
