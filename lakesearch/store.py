"""Knowledge bases on disk: Parquet generations behind a pointer, jobs, and incremental updates.

Layout below ``root``: ``kbs/<gen>``, ``jobs/<gen>``, and for each base ``chunks/<kb_id>/<gen>``, ``postings/<kb_id>/<gen>``
and ``terms/<kb_id>/<gen>`` hold Parquet; the newest ``CURRENT.<n>`` names the generations in use. Postings and terms are
sorted by term, so that a search reads the row groups of its terms. A writer makes new generations and then
publishes the next pointer; a crash before that leaves the old state. Generations that no pointer needs any more
stay for ``GRACE_MS``, so that plans made before still read them. One writer at a time; a second one gets a Conflict.

In postings and searches a chunk is named by a number: ``BASE_BITS`` of its base's number, then the place at which the
generation's write put it. Numbers are unique, not hashed.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import bm25
from .plans.search import Index
from .versions import Versions

KB = "id string, name string, description string, source_type string, source_path string, source_options string, created_at long, updated_at long, chunk_count long, file_count long, embedding_model string, status string"
JOB = "kb_id string, operation string, status string, phase string, message string, started_at long, last_progress_at long, finished_at long, total_files long, files_seen long, files_done long, chunks_seen long, chunks_added long, chunks_removed long, chunks_unchanged long, error_message string"
CHUNK = "kb_id string, file_path string, ord long, content string, start_line int, end_line int, metadata_json string, file_type string, content_hash string, index_text string, content_tokenized string, dl int, indexed_at long, id string, embedding array<float>"
NUMBERED = f"{CHUNK}, seq long"
POSTING = "term string, id long, kb_id string, dl int, tf long, positions array<int>"
TERM = "term string, df long, cf long"
VERSION = 2
GRACE_MS = 3_600_000
#: A number has 13 bits for the base, 17 for the partition of the write and 33 for the row.
BASE_BITS, PART_BITS, ROW_BITS = 13, 17, 33


def empty() -> dict:
    return {"version": VERSION, "kbs": None, "jobs": None, "chunks": {}, "postings": {}, "terms": {}, "numbers": {}, "retired": []}


class Store:
    def __init__(self, spark: SparkSession, root: str, grace_ms: int = GRACE_MS):
        self.spark, self.root, self.grace_ms = spark, root.rstrip("/"), grace_ms
        self.pointer = Versions(spark, self.root, "CURRENT")
        self._path, self.fs = self.pointer.path, self.pointer.fs
        if self.pointer.read() is None:
            if any(self.fs.exists(self._path(f"{self.root}/{x}")) for x in ("kbs", "chunks")):
                raise ValueError(f"{self.root} holds generations but no pointer that can be read; nothing was changed")
            self.pointer.publish(empty(), 0)
        elif self.state()["version"] < VERSION:
            self._migrate()

    def state(self) -> dict:
        self._number, found = self.pointer.read()
        if found["version"] > VERSION:
            raise ValueError("the store was written by a later version")
        return found

    def _publish(self, state: dict, *gone: str | None) -> None:
        """The next state; generations ``gone`` are deleted once their grace is over."""
        now = int(time.time() * 1000)
        old = [*state.get("retired", ()), *([p, now] for p in gone if p)]
        late = [p for p, at in old if now - at >= self.grace_ms]
        self._number = self.pointer.publish({**state, "retired": [x for x in old if x[0] not in late]}, self._number)
        for path in late:
            self.fs.delete(self._path(f"{self.root}/{path}"), True)

    def _migrate(self) -> None:
        """Version 1 named chunks by hashes of their ids and kept no terms: its chunks are numbered and indexed anew."""
        old = self.state()
        state = {**empty(), "kbs": old["kbs"], "jobs": old["jobs"]}
        for kb, path in old["chunks"].items():
            self._index(state, kb, self._read(path, CHUNK))
        self._publish(state, *old["chunks"].values(), *old["postings"].values())

    def _index(self, state: dict, kb_id: str, chunks: DataFrame) -> None:
        """Write the chunks of a base with their numbers, then postings and terms from what was written."""
        taken = set(state["numbers"].values()) - {state["numbers"].get(kb_id)}
        number = state["numbers"].setdefault(kb_id, next((i for i in range(1 << BASE_BITS) if i not in taken), -1))
        if number < 0:
            raise ValueError(f"a store holds {1 << BASE_BITS} bases at most")
        # The write of a generation gives every row its number; what reads it later sees these numbers.
        width = 1 << (PART_BITS + ROW_BITS)
        numbered = lambda df: df.select(*names(CHUNK), (F.monotonically_increasing_id() + F.lit(number * width)).alias("seq"))
        at = self._write(numbered(chunks), f"chunks/{kb_id}")
        most = self._read(at, NUMBERED).agg(F.max("seq")).first()[0]
        if most is not None and most >= (number + 1) * width:  # more partitions than there are numbers for
            wide, at = at, self._write(numbered(self._read(at, CHUNK).coalesce(1 << PART_BITS)), f"chunks/{kb_id}")
            self.fs.delete(self._path(f"{self.root}/{wide}"), True)
        state["chunks"][kb_id] = at
        post = bm25.postings(self._read(at, NUMBERED).withColumn("id", F.col("seq"))).select(names(POSTING))
        at = state["postings"][kb_id] = self._write(post.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), f"postings/{kb_id}")
        terms = bm25.terms_of(self._read(at, POSTING)).select(names(TERM))
        state["terms"][kb_id] = self._write(terms.repartitionByRange("term").sortWithinPartitions("term"), f"terms/{kb_id}")

    def _read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if path is None else self.spark.read.schema(schema).parquet(f"{self.root}/{path}")

    def _write(self, df: DataFrame, folder: str) -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    def kbs(self) -> DataFrame:
        return self._read(self.state()["kbs"], KB).orderBy(F.desc("updated_at"), "id")

    def jobs(self) -> DataFrame:
        """The latest job of each base."""
        return self._read(self.state()["jobs"], JOB)

    def chunks(self, kb_id: str | None = None) -> DataFrame:
        paths = self.state()["chunks"]
        wanted = [p for k, p in paths.items() if kb_id in (None, k)]
        return self.spark.read.schema(CHUNK).parquet(*(f"{self.root}/{p}" for p in wanted)) if wanted else self._read(None, CHUNK)

    def index(self) -> Index:
        """All bases for a search: statistics are of all, whatever is searched. Chunks go by their numbers there."""
        state = self.state()
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in state[kind].values())) if state[kind] else self._read(None, schema)
        chunks = read("chunks", NUMBERED).withColumn("key", F.col("id")).withColumn("id", F.col("seq"))
        terms = read("terms", TERM).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return Index(chunks, read("postings", POSTING), bm25.doc_stats(chunks), terms)

    def find(self, target: str) -> dict | None:
        """A base by id, else by name."""
        rows = [r.asDict() for r in self.kbs().filter((F.col("id") == target) | (F.col("name") == target)).limit(2).collect()]
        return next((r for r in rows if r["id"] == target), rows[0] if rows else None)

    def put(self, kb: dict, chunks: DataFrame | None = None) -> None:
        """Insert or replace a base and, if given, its chunks, in one step."""
        state = self.state()
        gone: list[str | None] = []
        if chunks is not None:
            gone = [state[kind].get(kb["id"]) for kind in ("chunks", "postings", "terms")]
            self._index(state, kb["id"], chunks)
        row = self.spark.createDataFrame([tuple(kb.get(x) for x in names(KB))], KB)
        rest = self._read(state["kbs"], KB).filter(F.col("id") != kb["id"])
        was, state["kbs"] = state["kbs"], self._write(rest.unionByName(row).coalesce(1), "kbs")
        self._publish(state, was, *gone)

    def start_job(self, kb_id: str, operation: str, now: int) -> None:
        self.update_job(kb_id, reset=True, operation=operation, status="running", phase="scanning", started_at=now, last_progress_at=now)

    def update_job(self, kb_id: str, reset: bool = False, **values) -> None:
        """Merge values into the base's job; fields that aren't named keep their values unless reset."""
        state = self.state()
        old = self._read(state["jobs"], JOB)
        was = None if reset else old.filter(F.col("kb_id") == kb_id).first()
        row = {**(was.asDict() if was else {}), "kb_id": kb_id, **values}
        new = self.spark.createDataFrame([tuple(row.get(x) for x in names(JOB))], JOB)
        path, state["jobs"] = state["jobs"], self._write(old.filter(F.col("kb_id") != kb_id).unionByName(new).coalesce(1), "jobs")
        self._publish(state, path)

    def finish_job(self, kb_id: str, status: str, now: int, error: str | None = None) -> None:
        self.update_job(kb_id, status=status, phase=status, finished_at=now, last_progress_at=now, error_message=error)

    def remove(self, kb_id: str) -> None:
        state = self.state()
        gone = [state[kind].pop(kb_id, None) for kind in ("chunks", "postings", "terms")]
        state["numbers"].pop(kb_id, None)
        kbs, jobs = state["kbs"], state["jobs"]
        state["kbs"] = self._write(self._read(kbs, KB).filter(F.col("id") != kb_id).coalesce(1), "kbs")
        state["jobs"] = self._write(self._read(jobs, JOB).filter(F.col("kb_id") != kb_id).coalesce(1), "jobs")
        self._publish(state, kbs, jobs, *gone)

    def clear(self) -> None:
        state = self.state()
        gone = [state["kbs"], state["jobs"], *(p for kind in ("chunks", "postings", "terms") for p in state[kind].values())]
        self._publish({**empty(), "retired": state["retired"]}, *gone)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
