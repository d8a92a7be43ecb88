"""Watching: file changes as a stream, detectors run again once it has been quiet for a while."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUIET = "250 milliseconds"


def relevant(path: Column) -> Column:
    """Sources and manifests, outside build and version-control folders."""
    return path.rlike(r"\.(rs|toml)$") & ~path.rlike(r"(^|/)(target|\.git)/")


def bursts(events: DataFrame, gap: str = QUIET, late: str = "10 minutes") -> DataFrame:
    """(start, end, paths, n) of runs of relevant changes (path, ts) with less than ``gap`` between two: the
    batch and the streaming form of a debounce.  Streams drop what is later than ``late``."""
    e = events.where(relevant(F.col("path")))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    # streams ask for a key beside the session; one workspace is one session
    s = sessions(e.withColumn("_one", F.length("path") * 0), gap, "_one", F.array_sort(F.collect_set("path")).alias("paths"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths", "n")


def sessions(events: DataFrame, gap: str, key: str, *aggs: Column) -> DataFrame:
    """(key, session_window, n, and the given aggregates) of runs of events (ts) of a key with less than ``gap`` between two."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"), *aggs)


def framed(findings: DataFrame) -> Iterator[str]:
    """A batch as lines of JSON, ended by a line that says how many there were."""
    n = 0
    for n, r in enumerate(findings.select(F.to_json(F.struct(*findings.columns)).alias("j")).toLocalIterator(), 1):
        yield r["j"]
    yield json.dumps({"event": "batch-end", "count": n})


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, ts) of the relevant files below ``root`` as they are now; contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{rs,toml}").load(root)
    return raw.select("path", F.col("modificationTime").alias("ts")).where(relevant(F.col("path")))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, ts, change) between two listings: added, changed (another time) or removed."""
    b = before.select("path", F.col("ts").alias("_ts"))
    state = F.when(F.col("_ts").isNull(), "added").when(F.col("ts").isNull(), "removed").otherwise("changed")
    return b.join(now.select("path", "ts"), "path", "full").where(~F.col("ts").eqNullSafe(F.col("_ts"))).select("path", "ts", state.alias("change"))


def follow(spark: SparkSession, root: str, recompute: Callable[[DataFrame], DataFrame], emit: Callable[[list[str]], None], quiet: float = 0.25, poll: float = 0.1, rounds: int | None = None, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> None:
    """Lists the files below ``root`` every ``poll`` seconds and compares (path, time) with what was published last: new, rewritten
    and removed files all count.  Once nothing has changed for ``quiet`` seconds, ``recompute`` runs on the changes, and its
    framed rows go to ``emit``.  Ends after ``rounds`` listings (never, by default)."""
    kind = "path string, ts timestamp"
    snap = lambda: spark.createDataFrame(listing(spark, root).collect(), kind)  # noqa: E731  one row per file of a workspace
    published = seen = snap()
    quiet_for = Debounce(quiet, clock)
    k = 0
    while rounds is None or k < rounds:
        now = snap()
        if changes(seen, now).take(1):
            quiet_for.event()
            seen = now
        elif quiet_for.ready():
            emit(list(framed(recompute(changes(published, now)))))
            published = now
        k += 1
        wait(poll)


def watch(events: DataFrame, recompute: Callable[[DataFrame], DataFrame], emit: Callable[[list[str]], None], checkpoint: str, once: bool = False, trigger: str = QUIET):
    """Runs ``recompute`` on the relevant changes of a stream of events (path, ts), a micro-batch at a time, and hands its
    framed rows to ``emit``."""
    def batch(rows: DataFrame, _: int) -> None:
        hit = rows.where(relevant(F.col("path")))
        if hit.take(1):
            emit(list(framed(recompute(hit))))

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=trigger)).start()


def latest(ticks: DataFrame, key: str = "workspace", tick: str = "tick") -> DataFrame:
    """Of several requests for one key the newest: older ones are superseded."""
    return ticks.groupBy(key).agg(F.max_by(F.struct(*ticks.columns), tick).alias("t")).select("t.*")


def retractions(published: DataFrame, findings: DataFrame, key: str = "file") -> DataFrame:
    """Keys that were published and have no finding any more: they get an empty publication."""
    return published.select(key).distinct().join(findings.select(key).distinct(), key, "left_anti")


def diagnostics(findings: DataFrame) -> DataFrame:
    """(file, diagnostics): findings by file, places counted from zero."""
    zero = lambda c: F.greatest(F.col(c) - 1, F.lit(0)).alias(c)
    each = findings.select("file", F.struct(zero("line"), zero("col"), F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3).alias("severity"), F.col("kind").alias("code")).alias("d"))
    return each.groupBy("file").agg(F.array_sort(F.collect_list("d")).alias("diagnostics"))


class Debounce:
    """A trailing-edge debounce for a driver loop: ready once ``quiet`` seconds passed since the last event."""

    def __init__(self, quiet: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.quiet, self.clock, self.last = quiet, clock, None

    def event(self) -> None:
        self.last = self.clock()

    def ready(self) -> bool:
        if self.last is None or self.clock() - self.last < self.quiet:
            return False
        self.last = None
        return True
