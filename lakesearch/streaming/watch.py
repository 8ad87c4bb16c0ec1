"""Watching sources: snapshots and change streams, debounced per knowledge base, that trigger updates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import snapshot_diff
from ..sources.files import snapshot
from ..versions import Versions

DEBOUNCE, WATERMARK, POLL = "2 seconds", "10 seconds", "2 seconds"


def debounce(changes: DataFrame, gap: str = DEBOUNCE, watermark: str = WATERMARK) -> DataFrame:
    """changes: (kb_id, ts). One row per burst: it ends when nothing came for ``gap``. Works on streams and tables."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", watermark)
    bursts = changes.groupBy("kb_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"))
    return bursts.select("kb_id", F.col("w.start").alias("first"), F.col("w.end").alias("fires_at"), "changes")


class Poll:
    """Compares each snapshot of a folder with the one before; fires once no more changes come.

    The latest snapshot and whether a change waits are a state in the checkpoint folder, replaced as a whole, so a
    restarted watcher finds what changed meanwhile and what it hadn't done yet. A changed snapshot resets the wait;
    the first quiet poll after it fires. If the update fails, the next quiet poll tries again.
    """

    def __init__(self, spark: SparkSession, root: str, state: str, update: Callable[[], None]):
        self.spark, self.root, self.state, self.update = spark, root, state, update
        self.versions = Versions(spark, state, "POLL")

    def __call__(self) -> bool:
        """One poll; whether it fired."""
        n, was = self.versions.read() or (0, {"snapshot": None, "pending": False})
        name = f"snapshot-{uuid.uuid4().hex}"
        snapshot(self.spark, self.root).write.parquet(f"{self.state}/{name}")
        read = lambda at: self.spark.read.schema("path string, state string").parquet(f"{self.state}/{at}")
        changed = was["snapshot"] is not None and not snapshot_diff(read(was["snapshot"]), read(name), ["path"], "state").isEmpty()
        n = self.versions.publish({"snapshot": name, "pending": was["pending"] or changed}, n)
        if was["snapshot"]:
            self.versions.fs.delete(self.versions.path(f"{self.state}/{was['snapshot']}"), True)
        if changed or not was["pending"]:
            return False
        try:
            self.update()
        except Exception as e:  # noqa: BLE001  the watcher outlives a failed update
            print(f"update of {self.root} failed: {e}")
            return True
        self.versions.publish({"snapshot": name, "pending": False}, n)
        return True


def watch(spark: SparkSession, roots: dict[str, str], update: Callable[[str], None], checkpoint: str) -> list[StreamingQuery]:
    """A poll every two seconds for each knowledge base, driven by a stream; new, changed and deleted files count."""
    out = []
    for kb, root in roots.items():
        poll = Poll(spark, root, f"{checkpoint}/{kb}/snapshots", lambda kb=kb: update(kb))
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
        out.append(
            ticks.writeStream.foreachBatch(lambda df, i, poll=poll: poll()).trigger(processingTime=POLL)
            .option("checkpointLocation", f"{checkpoint}/{kb}/stream").queryName(f"watch_{kb}").start()
        )
    return out


def stop(spark: SparkSession) -> int:
    """Stop all watchers; returns how many ran."""
    mine = [q for q in spark.streams.active if (q.name or "").startswith("watch_")]
    for q in mine:
        q.stop()
    return len(mine)
