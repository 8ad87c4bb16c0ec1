"""The engine: plan, add, search, update, status, doctor, show, remove, export, import and clear."""

from __future__ import annotations

import contextlib
import json
import os
import re
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import report
from .functions import text
from .operators import bm25, chunkers, diff, diversify, health
from .plans import search as plans
from .sources import files
from .store import CHUNK, GRACE_MS, Store, names

BATCH, API_CHARS, MODEL = 64, 20_000, "hashing-256"
#: So many queries of a batch have their terms pushed into the scan of the postings.
FEW_QUERIES = 64
Embedder = Callable[[list[str]], np.ndarray]
Progress = Callable[[str], None]
POLL_SECONDS = 0.2


class Cancelled(RuntimeError):
    """The caller asked to stop."""


def hashing_embedder(texts: list[str], width: int = 256) -> np.ndarray:
    """Feature hashing of words, of unit length. For tests and as a default without a model: it knows no meaning."""
    import zlib

    out = np.zeros((len(texts), width), np.float32)
    for i, x in enumerate(texts):
        for w in re.findall(r"\w+", x.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % width] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def api_embedder(url: str, model: str, key: str | None = None, max_chars: int = API_CHARS, fallback: Embedder | None = None) -> Embedder:
    """An embeddings endpoint of the common JSON form; inputs are cut to max_chars. If it fails, ``fallback`` embeds."""

    def embed(texts: list[str]) -> np.ndarray:
        try:
            return ask(texts)
        except Exception as e:  # noqa: BLE001  whatever the endpoint does
            if fallback is None:
                raise
            print(f"the embeddings endpoint failed, the fallback is used: {e}")
            return fallback(texts)

    def ask(texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": model, "input": [t[:max_chars] for t in texts]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        with urllib.request.urlopen(request) as r:
            rows = sorted(json.load(r)["data"], key=lambda x: x["index"])
        return np.array([x["embedding"] for x in rows], np.float32)

    return embed


def with_embeddings(chunks: DataFrame, embedder: Embedder, column: str = "index_text", prefix: str = "passage: ") -> DataFrame:
    """Add embedding, in batches of 64 texts at most."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows: list = []
            for i in range(0, len(s), BATCH):
                rows += list(embedder([prefix + (x or "") for x in s.iloc[i : i + BATCH]]))
            yield pd.Series(rows, dtype=object)

    return chunks.withColumn("embedding", embed(F.col(column)))


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, embedder: Embedder = hashing_embedder, scorer: plans.Scorer = plans.lexical_overlap,
        clock: Callable[[], int] | None = None, grace_ms: int = GRACE_MS, stale_ms: int = health.STALE_MS,
    ):
        """grace_ms: how long old generations stay for plans that were made before; 0 deletes them at once. stale_ms: a
        job without progress for longer is stuck."""
        self.stale_ms = stale_ms
        self.spark, self.store, self.embedder, self.scorer = spark, Store(spark, root, grace_ms), embedder, scorer
        self.now = clock or (lambda: int(time.time() * 1000))

    # Sources

    def kind(self, source: str) -> str:
        """url, directory, file (of this machine or of a store that is named by a URI) or text."""
        if re.match(r"https?://", source):
            return "url"
        return files.kind(source) or "text"

    def _scan(self, source: str, options: dict, content: bool) -> DataFrame:
        return files.scan(self.spark, source, options.get("include_suggested_text", False), options.get("include_paths") or (), options.get("exclude_paths") or (), content=content)

    def _files(self, kb_id: str, source: str, kind: str, options: dict) -> DataFrame:
        """(kb_id, file_path, content) of a source."""
        if kind == "directory":
            rows = self._scan(source, options, True).filter("reason is null").select(F.col("rel_path").alias("file_path"), "content")
        elif kind == "url":
            with urllib.request.urlopen(source) as r:  # raises on other answers than success
                page = self.spark.createDataFrame([(source, r.read().decode("utf-8", "replace"))], "file_path string, html string")
            rows = page.select("file_path", text.strip_html(F.col("html")).alias("content"))
        elif kind == "file":
            if source.lower().endswith((".pdf", ".docx")):
                rows = files.documents(self.spark, source).withColumn("file_path", F.lit(source))
            else:
                rows = files.single(self.spark, source)
        else:
            rows = files.inline(self.spark, kb_id, source).drop("kb_id")
        return rows.withColumn("kb_id", F.lit(kb_id))

    def _described(self, chunks: DataFrame, now: int) -> DataFrame:
        from pyspark.sql import Window

        # A dense order over files, then places in the file: ids follow from it and from the hash.
        order = Window.partitionBy("kb_id", "content_hash").orderBy("file_path", "ord")
        return (
            chunks.withColumn("indexed_at", F.lit(now)).withColumn("ord", F.col("ord").cast("long"))
            .withColumn("id", F.sha2(F.concat_ws("\x00", "kb_id", "content_hash", F.row_number().over(order).cast("string")), 256))
        )

    # The eleven operations

    def plan(self, source: str, **options) -> dict:
        kind = self.kind(source)
        if kind != "directory":
            return {"source_type": kind, "files": 1, "bytes": files.stat(source)[0] if kind == "file" else len(source.encode()), "skipped": {}}
        scanned = self._scan(source, options, False)
        row = files.plan(scanned).first()
        return {"source_type": kind, "files": row.files, "bytes": row.bytes, "skipped": {r.reason: r.files for r in files.skipped(scanned).collect()}, "samples": [r.asDict() for r in files.skipped_samples(scanned).collect()]}

    @contextlib.contextmanager
    def _running(self, kb: dict, operation: str, progress: Progress | None, cancelled: Callable[[], bool] | None) -> Iterator[Callable[..., None]]:
        """A job of a base. The body gets a function that notes a step: its message goes to ``progress`` and, with the
        named fields, into the job. ``cancelled`` is asked at each step and, by a thread, while Spark works: the jobs
        under way stop, and Cancelled is raised. A failure ends the job."""
        sc, tag, over = self.spark.sparkContext, f"lakesearch-{uuid.uuid4().hex}", threading.Event()
        asked = cancelled or (lambda: False)

        def step(message: str, **fields) -> None:
            if progress:
                progress(message)
            self.store.update_job(kb["id"], message=message, last_progress_at=self.now(), **fields)
            if asked():
                raise Cancelled("Cancelled")

        def poll() -> None:
            while not over.wait(POLL_SECONDS):
                if asked():
                    sc.cancelJobsWithTag(tag)

        self.store.start_job(kb["id"], operation, self.now())
        watcher = threading.Thread(target=poll, daemon=True)
        sc.addJobTag(tag)
        if cancelled:
            watcher.start()
        what = "Update" if operation == "update" else "Indexing"
        try:
            yield step
            self.store.finish_job(kb["id"], "succeeded", self.now())
        except Exception as e:
            over.set()
            sc.removeJobTag(tag)
            stopped = isinstance(e, Cancelled) or asked()
            self.store.update_job(kb["id"], message=f"{what} cancelled." if stopped else f"{what} failed.")
            self.store.finish_job(kb["id"], "cancelled" if stopped else "failed", self.now(), str(e)[:500])
            if stopped and not isinstance(e, Cancelled):
                raise Cancelled("Cancelled") from e
            raise
        finally:
            over.set()
            sc.removeJobTag(tag)

    def add(
        self, source: str, name: str, description: str | None = None, progress: Progress | None = None,
        cancelled: Callable[[], bool] | None = None, **options,
    ) -> dict:
        if self.store.find(name):
            raise ValueError(f"a knowledge base named {name} exists")
        kind, now = self.kind(source), self.now()
        kb = {"id": str(uuid.uuid4()), "name": name, "description": description, "source_type": kind, "source_path": None if kind == "text" else source, "source_options": json.dumps(options) if options else None, "created_at": now, "updated_at": now, "chunk_count": 0, "file_count": 0, "embedding_model": MODEL, "status": "indexing"}
        self.store.put(kb)
        try:
            with self._running(kb, "add", progress, cancelled) as step:
                total = self._planned(source, kind, options, step)
                return self._index(kb, self._described(chunkers.chunks(self._files(kb["id"], source, kind, options)), now), step, total)
        except Exception:
            self.store.remove(kb["id"])  # nothing of a failed addition stays
            raise

    def _planned(self, source: str, kind: str, options: dict, step: Callable[..., None]) -> int | None:
        total = None
        if kind == "directory":
            row = files.plan(self._scan(source, options, False)).first()
            total = row.files
            step(f"Planned directory scan: {total} files, {report.size(row.bytes)}, {row.skipped} skipped", phase="planning", total_files=total)
        step("Scanning source...", phase="scanning")
        return total

    def _index(self, kb: dict, chunks: DataFrame, step: Callable[..., None], total: int | None = None) -> dict:
        began = self.now()
        ready = chunks if "embedding" in chunks.columns else with_embeddings(chunks, self.embedder)
        self.store.put({**kb, "status": "indexing"}, ready)
        n = self._counts(kb["id"])
        step(f"Scanned {n.f} files: {report.progress(n.c, self.now() - began, n.f, total)}", phase="storing", files_seen=n.f, files_done=n.f, chunks_seen=n.c, chunks_added=n.c)
        kb = {**kb, "status": "ready", "chunk_count": n.c, "file_count": n.f, "updated_at": self.now()}
        self.store.put(kb)
        step(f"Ready: {n.c} chunks from {n.f} files.")
        return kb

    def _counts(self, kb_id: str):
        return self.store.chunks(kb_id).agg(F.count("*").alias("c"), F.count_distinct("file_path").alias("f")).first()

    def update(self, target: str, progress: Progress | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
        """Match by identity hash; only added chunks are embedded, the others keep their rows. A base without any
        change isn't written again."""
        kb = self._need(target)
        if not kb["source_path"]:
            raise ValueError(f"{kb['name']} has no source to update from")
        if kb["source_type"] != "url" and not files.exists(kb["source_path"]):
            raise ValueError(f"the source of {kb['name']} is missing: {kb['source_path']}")
        now, options, kind = self.now(), json.loads(kb["source_options"] or "{}"), kb["source_type"]
        both = None
        try:
            with self._running(kb, "update", progress, cancelled) as step:
                total = self._planned(kb["source_path"], kind, options, step)
                old = self.store.chunks(kb["id"])
                new = self._described(chunkers.chunks(self._files(kb["id"], kb["source_path"], kind, options)), now)
                both = diff.match(old, new).persist()
                counts = {r.change: r.n for r in both.groupBy("change").agg(F.count("*").alias("n")).collect()}
                out = {k: counts.get(k, 0) for k in ("added", "removed", "unchanged")}
                step(f"Changes: {out['added']} added, {out['removed']} removed, {out['unchanged']} unchanged. Embedding update batch of {out['added']} chunks.", phase="embedding", **{f"chunks_{k}": v for k, v in out.items()})
                if out["added"] or out["removed"]:
                    kept = both.filter("change = 'unchanged'").select("old.*").select(names(CHUNK))
                    added = with_embeddings(both.filter("change = 'added'").select("new.*"), self.embedder).select(names(CHUNK))
                    self.store.put(kb, kept.unionByName(added))
                n = self._counts(kb["id"])
                self.store.put({**kb, "status": "ready", "chunk_count": n.c, "file_count": n.f, "updated_at": self.now()})
                step(f"Ready: {n.c} chunks from {n.f} files.", files_seen=n.f, files_done=n.f, total_files=total)
                return out
        except Exception:
            self.store.put({**kb, "status": "error", "updated_at": self.now()})
            raise
        finally:
            if both is not None:
                both.unpersist()

    def _need(self, target: str) -> dict:
        if not (kb := self.store.find(target)):
            raise ValueError(f"no knowledge base {target}")
        return kb

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, kb_id: str | None = None, offset: int = 0, **filters) -> dict:
        """One query; ``search_many`` takes a table of them."""
        kbs = [self._need(kb_id)] if kb_id else [r.asDict() for r in self.store.kbs().collect()]
        warnings = [f'"{k["name"]}" is {k["status"]}; search skipped until indexing is ready' for k in kbs if k["status"] not in ("ready", "stale")]
        ready = tuple(k["id"] for k in kbs if k["status"] in ("ready", "stale") and k["chunk_count"])
        if not ready:
            return {"results": [], "total_count": 0, "has_more": False, "warnings": warnings, "mode_used": mode}
        o = plans.Options(mode, limit, offset, ready, scorer=self.scorer, **filters)
        rows = [r.asDict(True) for r in self.search_many([query], o).orderBy("position").collect()]
        names = {k["id"]: k["name"] for k in kbs}
        for r in rows:
            r["kb_name"] = names.get(r["kb_id"], "unknown")
        return {"results": rows, "total_count": rows[0]["total"] if rows else 0, "has_more": bool(rows and rows[0]["has_more"]), "warnings": warnings, "mode_used": rows[0].get("mode_used", mode) if rows else mode}

    def search_many(self, queries: list[str], o: plans.Options) -> DataFrame:
        vectors = self.embedder([f"query: {q}" for q in queries])
        asked = self.spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, vectors))], "query_id long, raw string, vector array<float>")
        index = self.store.index()
        if len(queries) <= FEW_QUERIES:  # then their terms are few, and only these postings are read
            words = bm25.phrases(asked.select("query_id", F.concat_ws(" ", text.query_text(F.col("raw")), "raw").alias("query")))
            terms = [r.t for r in words.select(F.explode("words").alias("t")).distinct().collect()]
            wanted = F.col("term").isin(terms)
            index = replace(index, postings=index.postings.filter(wanted), terms=index.terms.filter(wanted))
            o = replace(o, share_texts=False)
        return plans.search(index, asked, o)

    def status(self) -> DataFrame:
        return health.diagnose(*self._health(), self.stale_ms)

    def _health(self):
        kbs = self.store.kbs().withColumnRenamed("id", "kb_id")
        rows, dropped = None, None
        for kb in self.store.kbs().collect():  # the bases, not their files
            if kb.source_type not in ("directory", "file") or not kb.source_path or not (found := files.kind(kb.source_path)):
                continue  # texts, pages and missing sources can't be compared
            if found == "directory":
                scanned = self._scan(kb.source_path, json.loads(kb.source_options or "{}"), False).withColumn("kb_id", F.lit(kb.id))
            else:
                one = [(kb.id, kb.source_path, files.stat(kb.source_path)[1], None)]
                scanned = self.spark.createDataFrame(one, "kb_id string, rel_path string, mtime long, reason string")
            good = scanned.filter("reason is null").select("kb_id", F.col("rel_path").alias("file_path"), "mtime")
            bad = scanned.filter("reason is not null").select("kb_id", "reason")
            rows, dropped = (good, bad) if rows is None else (rows.unionByName(good), dropped.unionByName(bad))
        chunks = self.store.chunks()
        if rows is None:
            rows = self.spark.createDataFrame([], "kb_id string, file_path string, mtime long")
            dropped = self.spark.createDataFrame([], "kb_id string, reason string")
        watched = chunks.join(rows.select("kb_id").distinct(), "kb_id", "left_semi")
        return kbs, watched, rows, dropped, self.store.jobs(), self.now()

    def doctor(self) -> dict:
        if self.store.kbs().isEmpty():
            return {"health_score": 65, "issues": [{"severity": "blocking", "kind": "empty", "message": "No knowledge bases are indexed."}]}
        found = health.issues(self.status())
        return {**health.health_score(found).first().asDict(), "issues": [r.asDict() for r in found.collect()]}

    def report(self, watchers: int = 0) -> str:
        """The status of all bases as text."""
        return report.status(self.store.root, [r.asDict() for r in self.store.kbs().collect()], [r.asDict() for r in self.status().collect()], self.now(), watchers)

    def summary(self) -> str | None:
        """One line that tells an agent which bases there are; None without any."""
        return report.available([r.asDict() for r in self.store.kbs().collect()])

    def show(self) -> list[dict]:
        return [r.asDict() for r in self.store.kbs().collect()]

    def remove(self, target: str) -> None:
        self.store.remove(self._need(target)["id"])

    def clear(self) -> None:
        self.store.clear()

    def export(self, target: str, path: str) -> None:
        kb = self._need(target)
        rows = self.store.chunks(kb["id"]).withColumn("place", F.col("ord")).drop("ord")
        ranked = diversify.numbered(rows, F.col("file_path"), F.col("place"), F.col("id"), out="ord")
        files.export_jsonl(ranked, path, kb["name"], kb["description"], kb["source_type"])

    def import_(self, path: str, progress: Progress | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
        """The base becomes one of type text; nothing stays if a line is broken."""
        from pyspark.sql import Window

        header, rows = files.import_jsonl(self.spark, path)
        now = self.now()
        kb = {"id": str(uuid.uuid4()), "name": header["name"], "description": header.get("description"), "source_type": "text", "created_at": now, "updated_at": now, "chunk_count": 0, "file_count": 0, "embedding_model": MODEL, "status": "indexing"}
        self.store.put(kb)
        try:
            with self._running(kb, "import", progress, cancelled) as step:
                w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "content")
                placed = rows.withColumn("kb_id", F.lit(kb["id"])).withColumn("ord", F.row_number().over(w))
                return self._index(kb, self._described(chunkers.describe(placed), now), step)
        except Exception:
            self.store.remove(kb["id"])
            raise

    def inject(self, conversations: DataFrame, limit: int = 3) -> DataFrame:
        """For each conversation: the best chunks for its last user message of five characters or more."""
        asked = last_user_message(conversations).select(F.col("conv_id").alias("query_id"), F.col("text").alias("raw"))
        found = plans.search(self.store.index(), asked, plans.Options("fast", limit))
        return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x.content), "\n\n").alias("context"))


def last_user_message(conversations: DataFrame) -> DataFrame:
    asked = conversations.filter((F.col("role") == "user") & (F.length("text") >= 5))
    return asked.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
