"""Run-log views derived from the ``events`` table.

The reference keeps its run log in Python dicts and CSV files; the test data
has none, so the run log is derived from ``events`` by a fixed mapping.  The
Spark builders below and the SQL in ``FIXTURE_SQL`` express the same mapping;
the SQL is used verbatim as CTEs by the DuckDB oracle.

* ``runs``: one row per job run (dataset, cores, variant, timestamps, return code);
  durations are differences of the timestamps (``operators.runs.with_durations``)
* ``samples``: resource samples (run_key, ts, proc_id, cpu, mem_bytes, disk counters, progress)
* ``triggers``: pending events (run_key, ts, event)
* ``process_listings``: blocks of ``"<core> <name>"`` lines
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cores_of(key: Column) -> Column:
    """Core count assigned to a run key (``key % 4`` → 1, 2, 4, 8)."""
    m = key % 4
    return (F.when(m == 0, F.lit(1)).when(m == 1, F.lit(2))
             .when(m == 2, F.lit(4)).otherwise(F.lit(8)))


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    """A time some seconds later, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + F.round(seconds * 1e6).cast("bigint"))


def runs(events: DataFrame) -> DataFrame:
    """One row per run: the job starts, its action begins, the action ends."""
    dataset = (F.when(F.col("event_type") == "click", "en")
                .when(F.col("event_type") == "view", "fr")
                .when(F.col("event_type") == "purchase", "de")
                .otherwise("es"))
    e = (events.where(F.col("event_type") != "error")
               .withColumn("dataset", dataset).withColumn("cores", cores_of(F.col("user_id"))))
    # the experiment never ran "es" on 8 cores nor "fr" on 2
    e = e.where(~((F.col("dataset") == "es") & (F.col("cores") == 8))
                & ~((F.col("dataset") == "fr") & (F.col("cores") == 2)))
    start = F.col("ts").cast("timestamp")
    action = _plus_seconds(start, (F.col("event_id") % 10).cast("double"))
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("run_key"), F.col("ts"),
                    "dataset", "cores",
                    F.when(F.col("event_id") % 3 == 0, "failure").otherwise("baseline").alias("variant"),
                    start.alias("start_ts"), action.alias("action_ts"),
                    _plus_seconds(action, F.col("value")).alias("end_ts"),
                    F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 7).cast("double") * 0.5)
                     .alias("retry_s"),
                    (F.col("event_id") % 4).cast("int").alias("failure_reschedules"),
                    F.when(F.col("event_id") % 3 == 0, F.when(F.col("cores") < 8, 1).otherwise(0))
                     .otherwise(0).alias("failed_core_budget"),
                    F.col("cores").alias("total_cores"),
                    F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).alias("return_code"))


def samples(events: DataFrame) -> DataFrame:
    """Readings of the run's processes, several to a tick (a day), with the host's disk counters."""
    return (events.where(F.col("event_type") != "error")
                  .select(F.col("user_id").alias("run_key"),
                          F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"),
                          (F.col("event_id") % 3).alias("proc_id"),
                          F.col("value").alias("cpu"),
                          ((F.col("event_id") % 512).cast("double") * 1048576)
                          .alias("mem_bytes"),
                          (F.col("event_id") * 4096).alias("disk_read"),
                          (F.col("event_id") * 512).alias("disk_write"),
                          F.col("value").alias("progress")))


def triggers(events: DataFrame) -> DataFrame:
    """Pending events: a third of them on a tick, a third named, the others of equal text."""
    at = F.col("ts").cast("timestamp")
    return (events.where(F.col("event_type") == "error")
                  .select(F.col("user_id").alias("run_key"),
                          F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", at)).otherwise(at).alias("ts"),
                          F.when(F.col("event_id") % 3 == 2, F.lit("TASK_KILLED"))
                           .otherwise(F.concat(F.lit("TASK_KILLED "), F.lpad(F.col("event_id").cast("string"), 9, "0")))
                           .alias("event")))


def process_listings(events: DataFrame) -> DataFrame:
    """Process listings: two ``<core> <name>`` lines in a block, the first set in."""
    core = (F.col("user_id") % 8).cast("string")
    return events.select(F.concat(F.lit("\t"), core, F.lit(" "), F.col("event_type"), F.lit("\n"),
                                  core, F.lit(" idle")).alias("listing"))


# The same views as SQL text (DuckDB and Spark SQL both accept it).
FIXTURE_SQL = {
    "runs": """
SELECT * FROM (
SELECT event_id AS run_id, user_id AS run_key, ts,
       CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'fr'
                       WHEN 'purchase' THEN 'de' ELSE 'es' END AS dataset,
       CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS cores,
       CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'baseline' END AS variant,
       CAST(event_id % 10 AS DOUBLE) AS init_s,
       CAST(round(value * 1e6) AS BIGINT) / 1e6 AS processing_s,
       (event_id % 10 * 1000000 + CAST(round(value * 1e6) AS BIGINT)) / 1e6 AS runtime_s,
       CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 7 AS DOUBLE) * 0.5 END AS retry_s,
       CAST(event_id % 4 AS INTEGER) AS failure_reschedules,
       CASE WHEN event_id % 3 = 0 AND user_id % 4 <> 3 THEN 1 ELSE 0 END AS failed_core_budget,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS return_code
FROM events WHERE event_type <> 'error') r
WHERE NOT (dataset = 'es' AND cores = 8) AND NOT (dataset = 'fr' AND cores = 2)""",
    "samples": """
SELECT user_id AS run_key, date_trunc('day', ts) AS ts, event_id % 3 AS proc_id, value AS cpu,
       CAST(event_id % 512 AS DOUBLE) * 1048576 AS mem_bytes,
       event_id * 4096 AS disk_read, event_id * 512 AS disk_write, value AS progress
FROM events WHERE event_type <> 'error'""",
    "triggers": """
SELECT user_id AS run_key, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts,
       CASE WHEN event_id % 3 = 2 THEN 'TASK_KILLED'
            ELSE 'TASK_KILLED ' || lpad(CAST(event_id AS VARCHAR), 9, '0') END AS event
FROM events WHERE event_type = 'error'""",
    "process_listings": """
SELECT concat(chr(9), CAST(user_id % 8 AS VARCHAR), ' ', event_type, chr(10),
              CAST(user_id % 8 AS VARCHAR), ' idle') AS listing FROM events""",
}


def with_fixtures(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}" if names else sql
