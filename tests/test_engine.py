"""The engine end to end: adding, searching, updating, health, import and export, watching."""

import json
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch import engine as e, report
from lakesearch.plans.search import Options
from lakesearch.streaming import watch

GO = "package errors\n\nfunc ParseFailure%d(input string) error {\n\treturn wrap(input, \"parse failure %d happened in the reader\")\n}\n"


def write(root, paths):
    for p, content in paths.items():
        at = Path(root, p)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)


@pytest.fixture
def engine(spark, tmp_path):
    now = [1_700_000_000_000]
    made = e.Engine(spark, str(tmp_path / "store"), clock=lambda: now[0], grace_ms=0)
    made.clock = now
    return made


def paths_of(found):
    return [r["file_path"] for r in found["results"]]


def test_add_search_and_remove(engine, tmp_path):
    write(tmp_path / "a", {
        "src/errors.go": GO % (1, 1), "src/errors_test.go": GO.replace("ParseFailure", "TestParseFailure") % (1, 1),
        "README.md": "# Tool\n\n## Install\n\nRun the zanzibar installer and then setup the configuration of the tool.\n",
        ".env": "SECRET=1\n" * 20, "node_modules/x.js": "function zanzibar() { return 'module code that is not indexed'; }",
    })
    kb = engine.add(str(tmp_path / "a"), "a")
    assert kb["file_count"] == 3 and kb["status"] == "ready"
    with pytest.raises(ValueError):
        engine.add("some other text that is long enough to be a chunk of its own", "a")
    assert paths_of(engine.search("zanzibar", "fast")) == ["README.md"]
    found = engine.search("parse failure")
    assert found["total_count"] == 2 and paths_of(found)[0] == "src/errors.go"
    assert paths_of(engine.search("test parse failure"))[0] == "src/errors_test.go"
    assert engine.search("quux frobnicate nonsense")["results"] == []
    assert engine.search("parse failure", file_type="md")["results"] == []
    assert paths_of(engine.search("parse failure", path_contains="_test")) == ["src/errors_test.go"]
    auto = engine.search("ParseFailure1", "auto")
    assert auto["mode_used"] == "fast" and auto["results"][0]["kb_name"] == "a"
    for mode in ("semantic", "deep", "adaptive"):
        assert engine.search("zanzibar installer", mode)["results"][0]["file_path"] == "README.md", mode
    engine.remove("a")
    assert engine.show() == [] and engine.store.chunks().count() == 0 and engine.search("zanzibar")["results"] == []
    assert not list(Path(tmp_path / "store" / "chunks").glob("*/*"))


def test_paging(engine, tmp_path):
    write(tmp_path / "p", {f"n{i:02}.txt": f"zebra topic number {i} " + "filler words to make the chunk long enough " * 2 for i in range(25)})
    engine.add(str(tmp_path / "p"), "p")
    pages = [engine.search("zebra topic", limit=10, offset=o, diversity="off") for o in (0, 10, 20)]
    assert [len(p["results"]) for p in pages] == [10, 10, 5] and [p["has_more"] for p in pages] == [True, True, False]
    assert len({f for p in pages for f in paths_of(p)}) == 25 and {p["total_count"] for p in pages} == {25}


def test_filtered_recall(engine, tmp_path):
    write(tmp_path / "g", {f"src/f{i}.go": GO % (i, i) for i in range(45)} | {"notes.md": "# N\n\nparse failure notes about the reader and what happened there.\n"})
    engine.add(str(tmp_path / "g"), "g")
    assert len(engine.search("parse failure reader", limit=50, file_type="go")["results"]) >= 40


def test_update(engine, tmp_path):
    root = tmp_path / "u"
    write(root, {f"f{i}.txt": f"document {i} about marmots and their burrows in the high mountains" for i in range(70)})
    write(root, {"copy1.txt": "the same long text stands in two files of this folder, word by word"})
    engine.add(str(root), "u")
    assert engine.update("u") == {"added": 0, "removed": 0, "unchanged": 71}
    write(root, {f"f{i}.txt": f"document {i} about ibexes and their horns in the high mountains" for i in range(70)})
    assert engine.update("u") == {"added": 70, "removed": 70, "unchanged": 1}
    assert engine.search("marmots", "fast")["results"] == [] and engine.search("ibexes", "fast", limit=5)["total_count"] > 4
    (root / "copy1.txt").unlink()
    assert engine.update("u") == {"added": 0, "removed": 1, "unchanged": 70}
    assert engine.store.jobs().first().status == "succeeded"
    with pytest.raises(ValueError):
        engine.update("nothing")


def test_update_keeps_options_and_reports_failures(engine, tmp_path):
    root = tmp_path / "o"
    write(root, {"dist/a.js": "export function kept() { return 'a built file that was asked for by its path'; }", "b.txt": "other " * 20})
    engine.add(str(root), "o", include_paths=["dist"])
    assert engine.update("o") == {"added": 0, "removed": 0, "unchanged": 2}
    write(root, {"b.txt": "changed " * 20})
    engine.embedder = None
    with pytest.raises(Exception):
        engine.update("o")
    assert engine.show()[0]["status"] == "error" and engine.store.jobs().first().status == "failed"
    assert engine.store.chunks().count() == 2  # the old chunks stay
    (root / "b.txt").unlink()
    (root / "dist" / "a.js").unlink()
    (root / "dist").rmdir()
    root.rmdir()
    with pytest.raises(ValueError):
        engine.update("o")


def test_equal_files(engine, tmp_path):
    text = "one text that two files share, long enough to be a chunk by itself for sure"
    write(tmp_path / "d", {"a.txt": text, "b.txt": text})
    engine.add(str(tmp_path / "d"), "d")
    (tmp_path / "d" / "a.txt").unlink()
    assert engine.update("d") == {"added": 0, "removed": 1, "unchanged": 1}
    assert [r.orphans for r in engine.status().collect()] == [0]


def test_batches_and_vectors(spark, tmp_path):
    sizes = []

    def embed(texts):
        open(tmp_path / "sizes", "a").write(f"{len(texts)}\n")
        return e.hashing_embedder(texts)

    made = e.Engine(spark, str(tmp_path / "store"), embed)
    write(tmp_path / "v", {f"f{i}.txt": f"file number {i} with enough words in it to become a chunk of text" for i in range(150)})
    made.add(str(tmp_path / "v"), "v")
    sizes = list(map(int, (tmp_path / "sizes").read_text().split()))
    assert max(sizes) <= 64 and sum(sizes) == 150
    v = np.array(made.store.chunks().first().embedding)
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-5)


def test_failed_add_leaves_nothing(engine, tmp_path):
    engine.embedder = None
    write(tmp_path / "x", {"a.txt": "words " * 30})
    with pytest.raises(Exception):
        engine.add(str(tmp_path / "x"), "x")
    assert engine.show() == [] and engine.store.jobs().count() == 0


def test_status_and_doctor(engine, tmp_path):
    assert engine.doctor()["health_score"] == 65
    write(tmp_path / "h", {"a.txt": "first file " * 20, "b.txt": "second file " * 20})
    engine.clock[0] = int(time.time() * 1000) + 10_000
    kb = engine.add(str(tmp_path / "h"), "h")
    row = engine.status().first()
    assert (row.stale, row.orphans, row.coverage_percent, row.stuck) == (0, 0, 100, False)
    assert engine.doctor() == {"health_score": 100, "blocking": 0, "warning": 0, "info": 0, "issues": []}
    (tmp_path / "h" / "b.txt").unlink()
    write(tmp_path / "h", {"c.txt": "third file " * 20, "d.png": "x"})
    row = engine.status().first()
    assert (row.orphans, row.coverage_percent, row.skipped) == (1, 100, 1)
    engine.store.put({**engine.store.find("h"), "status": "indexing", "updated_at": engine.now()})
    engine.store.start_job(kb["id"], "update", engine.now())
    assert not engine.status().first().stuck
    assert engine.search("first file")["results"] == [] and "indexing" in engine.search("first file")["warnings"][0]
    engine.clock[0] += 15 * 60 * 1000
    assert engine.status().first().stuck
    assert {i["kind"] for i in engine.doctor()["issues"]} == {"stuck", "orphans", "skipped"}
    told = engine.report()
    assert "h: indexing, 2 chunks, 2 files" in told and "orphans: 1 files" in told and "Health: 0 stale, 1 orphans, 1 stuck" in told
    assert "h (2 chunks, 2 files)" in engine.summary()


def test_export_and_import(engine, tmp_path):
    write(tmp_path / "e", {f"f{i}.md": f"# Title {i}\n\nsome paragraphs about walrus number {i} and its life in the sea\n" for i in range(5)})
    engine.add(str(tmp_path / "e"), "e", "about walruses")
    engine.export("e", str(tmp_path / "out"))
    before = engine.search("walrus number", "fast")["total_count"]
    engine.clear()
    assert engine.show() == []
    kb = engine.import_(str(tmp_path / "out"))
    assert (kb["name"], kb["source_type"], kb.get("source_path"), kb["chunk_count"], kb["file_count"]) == ("e", "text", None, 5, 5)
    assert engine.search("walrus number", "fast")["total_count"] == before
    (tmp_path / "bad.jsonl").write_text(json.dumps({"name": "bad"}) + "\n{broken\n")
    with pytest.raises(ValueError):
        engine.import_(str(tmp_path / "bad.jsonl"))
    assert [k["name"] for k in engine.show()] == ["e"]


def test_sources(engine, tmp_path):
    kb = engine.add("an inline text about pelicans that is long enough to be one chunk of text", "inline")
    assert kb["source_type"] == "text" and kb["source_path"] is None
    write(tmp_path, {"one.txt": "a single file about cormorants that is long enough to be a chunk"})
    assert engine.add(str(tmp_path / "one.txt"), "file")["source_type"] == "file"
    (tmp_path / "bin.txt").write_bytes(b"a\x00b")
    with pytest.raises(ValueError):
        engine.add(str(tmp_path / "bin.txt"), "binary")
    plan = engine.plan(str(tmp_path))
    assert plan["files"] >= 1 and plan["source_type"] == "directory"
    assert paths_of(engine.search("cormorants", "fast")) == [str(tmp_path / "one.txt")]


def test_inject(engine, spark):
    engine.add("the otter lives near rivers and lakes and it can swim very well indeed", "zoo")
    talk = spark.createDataFrame([(1, 0, "user", "where do otter live"), (1, 1, "assistant", "hm"), (2, 0, "user", "hey"), (1, 2, "user", "otter rivers"), (1, 3, "user", "ok")], "conv_id long, turn long, role string, text string")
    got = engine.inject(talk).collect()
    assert [r.query_id for r in got] == [1] and "otter lives near rivers" in got[0].context


def test_search_many(engine):
    engine.add("alpha beacons shine over the harbour at night, and ships find their way home", "one")
    engine.add("beta lanterns hang in the garden in summer, and guests sit below them for hours", "two")
    rows = engine.search_many(["harbour ships", "garden guests", "nothing here fits"], Options("hybrid")).collect()
    assert sorted((r.query_id, r.content.split()[0]) for r in rows) == [(0, "alpha"), (1, "beta")]


def test_few_terms_are_pushed_down(engine):
    engine.add("alpha beacons shine over the harbour at night, and ships find their way home", "one")
    plan = engine.search_many(["harbour"], Options("fast"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,harbour)" in plan


def test_texts():
    assert [report.size(n) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KB", "3.0 MB", "5.00 GB"]
    assert [report.duration(x) for x in (-1, 0, 1, 59_000, 60_000, 61_001, float("inf"))] == ["0s", "0s", "1s", "59s", "1m", "1m 2s", "0s"]
    assert report.progress(100, 10_000, 5, 10, 2) == "5/10 files, 100 chunks, 10.0 chunks/s, elapsed 10s, file ETA 10s, skipped 2"
    assert report.available([]) is None


def test_debounce_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:10")], "kb_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table = sorted((r.kb_id, r.changes) for r in watch.debounce(rows).collect())
    assert table == [("a", 1), ("a", 2), ("b", 1)]
    source = tmp_path / "changes"
    rows.coalesce(1).write.parquet(str(source))
    late = spark.createDataFrame([("z", "2024-01-01 01:00:00")], "kb_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    q = watch.debounce(spark.readStream.schema(rows.schema).parquet(str(source))).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.processAllAvailable()
    got = sorted((r.kb_id, r.changes) for r in spark.table("bursts").collect())
    q.stop()
    assert got == table


def test_poll(engine, spark, tmp_path):
    root = tmp_path / "w"
    write(root, {"a.txt": "the first file of the watched folder, with words enough to be a chunk"})
    engine.add(str(root), "w")
    seen = []
    poll = watch.Poll(spark, str(root), str(tmp_path / "state"), lambda: seen.append(engine.update("w")))
    assert [poll(), poll()] == [False, False]
    write(root, {"b.txt": "the second file came later, and the watcher has to find it by itself"})
    assert [poll(), poll(), poll()] == [False, True, False] and seen == [{"added": 1, "removed": 0, "unchanged": 1}]
    (root / "a.txt").unlink()
    assert poll() is False
    write(root, {"c.txt": "a third file comes before the wait is over, so that the wait starts again"})
    assert [poll(), poll()] == [False, True] and seen[1] == {"added": 1, "removed": 1, "unchanged": 1}
    poll.update = lambda: 1 / 0
    write(root, {"c.txt": "x"})
    assert [poll(), poll()] == [False, True]


def test_watch(spark, tmp_path):
    write(tmp_path / "w", {"a.txt": "x"})
    seen = []
    watch.watch(spark, {"w": str(tmp_path / "w")}, seen.append, str(tmp_path / "cp"))
    for i in range(60):
        time.sleep(1)
        if i == 8:
            write(tmp_path / "w", {"b.txt": "y"})
        if seen:
            break
    assert watch.stop(spark) == 1 and seen == ["w"]


def test_restarted_watcher_finds_what_changed_meanwhile(engine, spark, tmp_path):
    root = tmp_path / "w"
    write(root, {"a.txt": "x"})
    seen = []
    new = lambda: watch.Poll(spark, str(root), str(tmp_path / "state"), lambda: seen.append(1))
    assert new()() is False
    write(root, {"b.txt": "y"})  # while no watcher runs
    assert new()() is False and new()() is True and seen == [1]
    write(root, {"c.txt": "z"})
    again = new()
    again.update = lambda: 1 / 0
    assert [again(), again()] == [False, True]  # the failed update stays pending
    assert new()() is True and seen == [1, 1] and new()() is False


class Crash(BaseException):
    pass


def test_a_crash_while_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    from lakesearch import store as st, versions

    at = str(tmp_path / "store")
    kb = {"id": "k1", "name": "one", "status": "ready", "created_at": 1, "updated_at": 1}
    st.Store(spark, at).put(kb)
    real = versions.Versions.publish

    class Broken:
        """The file system, until the call of a given name."""

        def __init__(self, fs, call):
            self.fs, self.call = fs, call

        def __getattr__(self, name):
            if name == self.call:
                raise Crash
            return getattr(self.fs, name)

    for call in ("create", "rename", "delete"):
        made = st.Store(spark, at)
        made.pointer.fs = Broken(made.pointer.fs, call)
        before = made.state()["kbs"]
        for n in range(versions.KEEP + 1):
            try:
                made.put({**kb, "id": f"{call}{n}", "name": call})
            except Crash:
                break
        again = st.Store(spark, at)  # never starts anew
        names = {r.id for r in again.kbs().collect()}
        assert "k1" in names and (call == "delete" or again.state()["kbs"] == before)
    assert real is versions.Versions.publish


def test_an_old_reader_finishes_and_a_second_writer_is_told(spark, tmp_path):
    from lakesearch import store as st, versions

    made = st.Store(spark, str(tmp_path / "store"))
    made.put({"id": "a", "name": "a", "updated_at": 1})
    old = made.kbs()
    other = st.Store(spark, str(tmp_path / "store"))
    state = other.state()
    made.put({"id": "b", "name": "b", "updated_at": 2})
    made.clear()
    assert [r.id for r in old.collect()] == ["a"] and made.kbs().count() == 0
    with pytest.raises(versions.Conflict):
        other._publish(state)
    late = st.Store(spark, str(tmp_path / "store"), grace_ms=0)
    late.put({"id": "c", "name": "c", "updated_at": 3})
    assert len(list(Path(tmp_path / "store" / "kbs").iterdir())) == 1


def test_a_store_without_a_pointer_is_left_alone(spark, tmp_path):
    from lakesearch import store as st

    st.Store(spark, str(tmp_path / "s")).put({"id": "a", "name": "a"})
    for x in Path(tmp_path / "s").glob("CURRENT*"):
        x.unlink()
    with pytest.raises(ValueError):
        st.Store(spark, str(tmp_path / "s"))
    assert list(Path(tmp_path / "s" / "kbs").iterdir())


def test_stores_of_version_one_are_migrated(engine, spark, tmp_path):
    """Version 1: one pointer file, chunks without numbers, postings by hashes of ids, no terms."""
    from lakesearch import store as st
    from lakesearch.operators import bm25

    engine.add("Some text about zanzibar that is long enough to be a chunk of its own in the base.", "t")
    kb = engine.store.find("t")
    at = tmp_path / "old"
    chunks = engine.store.chunks(kb["id"])
    chunks.write.parquet(f"{at}/chunks/{kb['id']}/g")
    bm25.postings(chunks.withColumn("id", F.xxhash64("id"))).write.parquet(f"{at}/postings/{kb['id']}/g")
    engine.store.kbs().write.parquet(f"{at}/kbs/g")
    state = {"version": 1, "kbs": "kbs/g", "jobs": None, "chunks": {kb["id"]: f"chunks/{kb['id']}/g"}, "postings": {kb["id"]: f"postings/{kb['id']}/g"}}
    (at / "CURRENT").write_text(json.dumps(state))
    made = e.Engine(spark, str(at))
    assert made.store.state()["version"] == st.VERSION
    assert made.search("zanzibar", "fast")["total_count"] == 1
    assert made.store.index().chunks.first().id == 0


def test_chunks_of_several_bases_have_numbers_of_their_own(engine, tmp_path):
    for i in range(3):
        write(tmp_path / f"d{i}", {f"f{k}.txt": f"base {i} file {k} holds the word zanzibar among others, and enough of them" for k in range(4)})
        engine.add(str(tmp_path / f"d{i}"), f"d{i}")
    engine.remove("d0")
    write(tmp_path / "d3", {"g.txt": "a base that takes the place of the first with the word zanzibar and enough others"})
    engine.add(str(tmp_path / "d3"), "d3")
    ids = [r.id for r in engine.store.index().chunks.collect()]
    assert len(set(ids)) == 9 and len({i >> 50 for i in ids}) == 3
    assert engine.search("zanzibar", "fast", 20)["total_count"] == 9


def test_single_files_are_compared_with_their_source(engine, tmp_path):
    import os

    at = tmp_path / "single.txt"
    at.write_text("Single file content about authentication tokens and sessions, of some length.")
    engine.add(str(at), "single")
    later = engine.now() / 1000 - 5
    os.utime(at, (later, later))
    row = engine.status().first()
    assert (row.stale, row.orphans, row.current, row.coverage_percent) == (0, 0, 1, 100)
    later = engine.now() / 1000 + 5
    os.utime(at, (later, later))
    assert engine.status().first().stale == 1
    at.unlink()
    assert engine.status().first().stale == 0  # a missing source can't be compared


def test_sources_by_uri(engine, tmp_path):
    write(tmp_path / "u", {"a.txt": "a file that is named by a URI, and has words enough to be one chunk of text"})
    assert engine.kind(f"file://{tmp_path}/u") == "directory" and engine.kind(f"file://{tmp_path}/u/a.txt") == "file"
    assert engine.kind("see s3://bucket/key for the words of this text") == "text" and engine.kind("https://a.b/c") == "url"
    assert engine.add(f"file://{tmp_path}/u", "folder")["file_count"] == 1
    assert engine.add(f"file://{tmp_path}/u/a.txt", "file")["chunk_count"] == 1
    assert engine.plan(f"file://{tmp_path}/u/a.txt")["bytes"] == 75


def test_progress(engine, tmp_path):
    write(tmp_path / "p", {f"doc-{i}.txt": f"Progress document {i} about stable indexing and observable batches. " * 3 for i in range(30)})
    seen = []
    kb = engine.add(str(tmp_path / "p"), "p", progress=seen.append)
    job = engine.store.jobs().filter(F.col("kb_id") == kb["id"]).first()
    assert (job.status, job.phase, job.total_files, job.files_done, job.chunks_added) == ("succeeded", "succeeded", 30, 30, 30)
    assert job.message.startswith("Ready: 30 chunks")
    for part in ("Planned directory scan: 30 files", "Scanning", "Scanned 30 files", "chunks/s", "Ready: 30 chunks"):
        assert any(part in x for x in seen), part
    write(tmp_path / "p", {"doc-1.txt": "Changed document about stable indexing and observable changes of the batches."})
    seen.clear()
    assert engine.update("p", progress=seen.append) == {"added": 1, "removed": 1, "unchanged": 29}
    assert any("Embedding update batch" in x for x in seen)
    before = engine.store.state()["chunks"]
    assert engine.update("p") == {"added": 0, "removed": 0, "unchanged": 30} and engine.store.state()["chunks"] == before


def test_cancellation(engine, spark, tmp_path):
    at = tmp_path / "source.txt"
    at.write_text("Initial content about authentication tokens and sessions, long enough to be a chunk.")
    kb = engine.add(str(at), "c")
    at.write_text("Changed content about billing invoices and payments, long enough to be a chunk too.")
    with pytest.raises(e.Cancelled):
        engine.update("c", cancelled=lambda: True)
    job = engine.store.jobs().filter(F.col("kb_id") == kb["id"]).first()
    assert job.status == "cancelled" and job.message == "Update cancelled."
    assert "authentication" in engine.store.chunks(kb["id"]).first().content
    # Spark's own work stops too: the embedder would take minutes.
    slow = e.Engine(spark, str(tmp_path / "slow"), embedder=lambda texts: time.sleep(300))
    began = time.time()
    with pytest.raises(e.Cancelled):
        slow.add(str(at), "s", cancelled=lambda: time.time() - began > 15)
    assert time.time() - began < 120 and slow.show() == []


def test_a_failing_endpoint_falls_back():
    embed = e.api_embedder("http://127.0.0.1:9/none", "m", max_chars=5, fallback=lambda texts: np.ones((len(texts), 3)))
    assert embed(["a", "b"]).shape == (2, 3)
    with pytest.raises(OSError):
        e.api_embedder("http://127.0.0.1:9/none", "m")(["a"])
