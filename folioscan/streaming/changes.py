"""Change detection over streams: the last hash of each path is state, so no batch reads the whole store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from folioscan.functions.scalars import normalize_path

STATE = "paths array<string>, hashes array<string>"
#: Paths are dealt to so many groups by hash. A group's hashes are one value, so that a batch asks the state once for
#: a group, not for each path: each question of a Python task is a message there and back. A checkpoint keeps its number.
GROUPS = 1 << 14
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "path string, sha256 string, mtime double, status string"


class LastHash(StatefulProcessor):
    """The rows of a group's paths, in order of mtime and hash, each against the one of its path before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("hashes", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        last = dict(zip(*self.last.get(), strict=True)) if self.last.exists() else {}
        low, changed = float("-inf"), False
        for r in sorted(rows, key=lambda r: (low if r.mtime is None else r.mtime, r.sha256 or "")):
            before = last.get(r.key)
            status = "inserted" if before is None else "skipped" if before == r.sha256 else "updated"
            yield Row(path=r.path, sha256=r.sha256, mtime=r.mtime, status=status)
            if r.sha256 is not None and r.sha256 != before:
                last[r.key], changed = r.sha256, True
        if changed:
            self.last.update((list(last), list(last.values())))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        self.last.update((initialState.paths, initialState.hashes))

    def close(self) -> None:
        pass


def _group() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int").alias("group")


def statuses_of(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, sha256, mtime and status (inserted, updated or skipped) of a stream of rows with the first three.

    State is one hash a path, whatever its slashes, in RocksDB: on disk and in the checkpoint, not in
    memory. A batch reads the groups of its paths, one in GROUPS of the known paths each. known (path,
    sha256): what is there before the first batch; read then and never again. Rows of one path in one
    batch are taken in order of mtime and hash. A null hash is updated, but for an unknown path, and
    isn't remembered.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    path = normalize_path(F.col("path")).alias("key")
    keyed = rows.select("path", "sha256", F.col("mtime").cast("double").alias("mtime"), path).withColumn("group", _group()).groupBy("group")
    first = None
    if known is not None:
        each = known.filter("sha256 IS NOT NULL").groupBy(path).agg(F.max("sha256").alias("sha256"))
        lists = each.groupBy(_group()).agg(F.collect_list(F.struct("key", "sha256")).alias("k"))
        first = lists.select("group", F.col("k.key").alias("paths"), F.col("k.sha256").alias("hashes")).groupBy("group")
    return keyed.transformWithState(LastHash(), OUT, "Append", "None", first)


COUNTED = ("inserted", "updated", "skipped")


class Progress(StreamingQueryListener):
    """Counts by status while a job runs, as its batches end; no second pass over its rows.

    counts: rows so far by status, and processed; batches: how many ended. For spark.streams.addListener().
    """

    def __init__(self, name: str = "statuses") -> None:
        self.name, self.batches = name, 0
        self.counts = dict.fromkeys([*COUNTED, "processed"], 0)

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches += 1
            for k in self.counts:
                self.counts[k] += seen[k] or 0

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass


def counted(statuses: DataFrame, name: str = "statuses") -> DataFrame:
    """The same rows; their counts by status are observed under the name as they pass."""
    return statuses.observe(name, *(F.count_if(F.col("status") == s).alias(s) for s in COUNTED), F.count(F.lit(1)).alias("processed"))


def detect(rows: DataFrame, out: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Writes the statuses of all that is new in a stream to Parquet, each once; a restart with the same checkpoint goes on."""
    return counted(statuses_of(rows, known)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
