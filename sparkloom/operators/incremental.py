"""Incremental maintenance: what changed, upserts, the job queue, follow-ups and debouncing as plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.listings import latest


def changes(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "h") -> DataFrame:
    """key, op: insert, update or delete; rows with the same digest are skipped."""
    a, b = old.select(F.col(key).alias("k1"), F.col(digest).alias("h1")), new.select(F.col(key).alias("k2"), F.col(digest).alias("h2"))
    op = F.when(F.col("k1").isNull(), "insert").when(F.col("k2").isNull(), "delete").when(F.col("h1") != F.col("h2"), "update")
    return a.join(b, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k2", "k1").alias(key), op.alias("op")).where("op IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence = ()) -> DataFrame:
    """The last write wins; of several new rows of a key the first in `order` is it."""
    new = new.dropDuplicates(list(keys)) if not order else latest(new, keys, order)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence = ()) -> DataFrame:
    """Rows that are there stay; of several new rows of a key the first in `order` is inserted."""
    new = new.dropDuplicates(list(keys)) if not order else latest(new, keys, order)
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def regenerate(files: DataFrame, changed: Column, by: str, share: float = 0.05) -> DataFrame:
    """Which groups of files get a new summary: those of which more than a share has changed."""
    n, all_ = F.count(F.when(changed, 1)), F.count("*")
    return files.groupBy(by).agg(n.alias("changed"), all_.alias("total"), F.when(n / all_ > share, "REGENERATE_SUMMARY").otherwise("skip").alias("action"))


def reindex(derived: DataFrame, changed: DataFrame, fresh: DataFrame, owner: str = "id") -> DataFrame:
    """Derived rows after a change: those of changed or deleted files go, what was extracted anew comes. `changed` has
    `owner` and op, as `changes` gives them; `fresh` is extracted from inserted and updated files only."""
    gone = changed.where(F.col("op") != "insert").select(owner)
    return derived.join(gone, owner, "left_anti").unionByName(fresh)


def keep_manual(tags: DataFrame, changed: DataFrame, owner: str = "id") -> DataFrame:
    """Tags after a change: those by rules of changed or deleted files go, those by hand stay."""
    gone = changed.where(F.col("op") != "insert").select(owner, F.lit(True).alias("__gone"))
    rows = tags.join(gone, owner, "left").where(F.col("__gone").isNull() | (F.col("source") == "manual"))
    return rows.drop("__gone")


def enqueue(queue: DataFrame, jobs: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Jobs whose key isn't open already, each key once."""
    open_ = queue.where(F.col("status").isin("PENDING", "CLAIMED")).select(key)
    return jobs.dropDuplicates([key]).join(open_, key, "left_anti")


def claimable(queue: DataFrame, n: int, now: Column) -> DataFrame:
    """The next n pending jobs: highest priority, then earliest run_after, created_at and id."""
    due = queue.where((F.col("status") == "PENDING") & (F.col("run_after") <= now))
    return due.orderBy(F.desc("priority"), "run_after", "created_at", "id").limit(n)


def stale(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    return queue.where((F.col("status") == "CLAIMED") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def retain(queue: DataFrame, now: Column, days: int) -> DataFrame:
    """Without finished jobs older than so many days."""
    old = F.col("status").isin("DONE", "FAILED") & (F.col("completed_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return queue.where(~F.coalesce(old, F.lit(False)))


#: What follows a finished job: (job, follow-up, priority, condition); fixed values.
FOLLOW_UPS = (
    ("FULL_INDEX", "DOCS_SCAN", 9, None), ("FULL_INDEX", "EMBED_MISSING", 5, "auto_embed"), ("FULL_INDEX", "REGENERATE_SUMMARY", 2, None),
    ("REINDEX_FILE", "EMBED_MISSING", 5, "auto_embed"), ("REINDEX_MANY", "EMBED_MISSING", 5, "auto_embed"),
    ("DOCS_SCAN", "SUMMARIZE_FILES", 4, "auto_summaries"), ("DOCS_SCAN", "SUMMARIZE_SYMBOLS", 4, "auto_summaries"),
    ("SUMMARIZE_FILES", "EMBED_SUMMARIES", 3, "auto_embed"), ("SUMMARIZE_SYMBOLS", "EMBED_SUMMARIES", 3, "auto_embed"),
)


def follow_ups(done: DataFrame, flags: Sequence[str]) -> DataFrame:
    """repo, job -> repo, follow_up, priority, each once with its highest priority."""
    rows = [(a, b, p) for a, b, p, c in FOLLOW_UPS if c is None or c in flags]
    dag = done.sparkSession.createDataFrame(rows, "job string, follow_up string, priority int")
    return done.join(F.broadcast(dag), "job").groupBy("repo", "follow_up").agg(F.max("priority").alias("priority"))


def debounce(events: DataFrame, quiet: str, keys: Sequence[str], ts: str = "ts", op: str = "op") -> DataFrame:
    """Events of a key until it is quiet: the last one wins. Works on a stream behind a watermark, too."""
    w = F.session_window(ts, quiet)
    return events.groupBy(*keys, w.alias("w")).agg(F.max_by(op, ts).alias(op), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), op, "n")


def batch_jobs(events: DataFrame, many: int = 1) -> DataFrame:
    """repo, kind (code or doc), path -> one job each: DOCS_SCAN, REINDEX_FILE for one path, else REINDEX_MANY."""
    n = F.count_distinct("path")
    return events.groupBy("repo", "kind").agg(n.alias("n_paths"), F.when(F.col("kind") == "doc", "DOCS_SCAN").when(n <= many, "REINDEX_FILE").otherwise("REINDEX_MANY").alias("job"))


def latest_state(transitions: DataFrame) -> DataFrame:
    """Fold a job's transitions (id, at, op) to its status and attempts; a failure below three attempts is retried."""
    w = Window.partitionBy("id").orderBy("at")
    tried = transitions.withColumn("attempts", F.sum((F.col("op") == "claim").cast("int")).over(w))
    last = tried.groupBy("id").agg(F.max_by(F.struct("op", "attempts"), "at").alias("s"))
    op, n = F.col("s.op"), F.col("s.attempts")
    return last.select("id", F.when(op == "claim", "CLAIMED").when(op == "complete", "DONE").when((op == "fail") & (n < 3), "PENDING").when(op == "fail", "FAILED").otherwise("PENDING").alias("status"), n.alias("attempts"))
