"""The change feed as a stream: debounced events, deduplicated jobs and a job's state machine.

The batch forms are in operators.incremental; late events are dropped behind the watermark, which is our own choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.incremental import debounce

EVENTS = "path string, op string, ts timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """Events as JSON files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(folder)


def expand_moves(events: DataFrame) -> DataFrame:
    """path, target, op, ts: a move becomes a deletion and an upsert; creations and changes are upserts."""
    delete = F.struct(F.col("path").alias("path"), F.lit("DELETE").alias("op"))
    upsert = F.struct(F.when(F.col("op") == "move", F.col("target")).otherwise(F.col("path")).alias("path"), F.lit("UPSERT").alias("op"))
    each = F.when(F.col("op") == "move", F.array(delete, upsert)).when(F.col("op") == "delete", F.array(delete)).otherwise(F.array(upsert))
    return events.select("ts", F.explode(each).alias("e")).select("e.path", "e.op", "ts")


def relevant(events: DataFrame, endings: str = "py|js|ts|go|java|c|sql|md") -> DataFrame:
    return events.where(F.col("path").rlike(rf"\.({endings})$") & ~F.col("path").rlike(r"(^|/)(\.|node_modules/|__pycache__/)"))


def debounced(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    return debounce(events.withWatermark("ts", late), quiet, ["path"])


def dedup_jobs(jobs: DataFrame, within: str = "1 minute") -> DataFrame:
    """Each key once while it lies behind the watermark."""
    return jobs.withWatermark("ts", within).dropDuplicatesWithinWatermark(["dedup_key"])


def job_states(transitions: DataFrame, most: int = 3) -> DataFrame:
    """id, op (enqueue, claim, complete, fail) -> the status after each batch; state is a status and a count for each job."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("PENDING", 0)
        for df in frames:
            for op in df.sort_values("at")["op"]:
                if op == "claim" and status == "PENDING":
                    status, attempts = "CLAIMED", attempts + 1
                elif op == "complete" and status == "CLAIMED":
                    status = "DONE"
                elif op == "fail" and status == "CLAIMED":
                    status = "PENDING" if attempts < most else "FAILED"
        state.update((status, attempts))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts]})

    return transitions.groupBy("id").applyInPandasWithState(step, "id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)
