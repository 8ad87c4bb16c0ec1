import base64
import gzip
import hashlib
import random
from collections import Counter

from lakesearch.llm import warc


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        for _ in range(30):
            runs = [sorted((rng.randrange(6), i, j) for j in range(rng.randrange(7))) for i in range(k)]
            got = list(warc.LoserTree(runs, lambda r: r[0]))
            assert [x[0] for x in got] == sorted(x[0] for r in runs for x in r)
            assert Counter(got) == Counter(x for r in runs for x in r)


def test_records():
    raw = [warc.record("response", 5, "http://é.x/a: b", warc.NO_DATE, "D", 7, None, b"a\r\n\r\nb\r\n"), warc.record("revisit", None, "", warc.NO_DATE, "D", 7, 5, b"")]
    stream = b"".join(map(gzip.compress, raw))
    (at, h, body), (at2, h2, body2) = warc.parse(stream)
    assert at == 0 and body == b"a\r\n\r\nb\r\n" and h["WARC-Target-URI"] == "http://é.x/a: b"
    assert stream[at2:].startswith(gzip.compress(raw[1])[:4]) and body2 == b"" and h2["WARC-Refers-To"] == "<urn:page:5>"
    assert gzip.decompress(stream[at2:]) == raw[1]


def test_round_trip(spark):
    rng = random.Random(2)
    bodies = ["<p>one</p>", "zwei é", None, "", "x" * 300_000, "\r\n\r\n"]
    rows = [(i, f"http://{rng.choice(['a', 'B', 'c.a'])}.com/{rng.randrange(5)}?q#f", rng.choice([*bodies, f"own {i}"]), 0) for i in range(300)]
    rows += [(7000, None, "alone", 0), (None, "no scheme", "null id", 0), (7001, "x://", "twin", 0), (7001, "x://", "twin", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    captures = warc.round_trip(df)
    got = captures.collect()
    want = Counter()
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        last = max(j for j, _, h, _ in rows if (h or "") == (html or "") and (j is not None or i is None)) if i is not None else None
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    order = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert len({(r.archive, r.offset) for r in got}) == len(got)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_histories_of_a_url(spark, monkeypatch, tmp_path):
    """Several captures of a URL at several times, in archives and runs of a few rows, with runs moved to files."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    monkeypatch.setattr(warc, "RANGE_ROWS", 60)
    rng = random.Random(5)
    rows = [(i, f"http://a.com/{rng.randrange(3)}", f"body {rng.randrange(40)}", f"20{rng.randrange(10, 24)}-01-0{rng.randrange(1, 9)}T00:00:00Z") for i in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").repartition(3)
    folder = str(tmp_path / "archives")
    warc.write_archives(df, folder, F.col("at"))
    names = [p.name for p in (tmp_path / "archives").iterdir()]
    assert len(names) > 3 and all(n.startswith("part-") for n in names)
    captures = warc.materialize(warc.read_archives(spark, folder), "captures")
    for held in (1, warc.HELD_BYTES):
        got = warc.merge_index(captures, held=held).collect()
        want = sorted((warc.url_key(u), t, i) for i, u, _, t in rows)
        assert [(r.urlkey, r.timestamp, r.page_id) for r in got] == want
    # A repeated task leaves no archive of an attempt before.
    mine = sum(n.startswith("part-00000-") for n in names)
    for k in range(mine, mine + 2):
        (tmp_path / "archives" / f"part-00000-{k:05d}.warc.gz").write_bytes(b"old")
    warc.write_archives(df, folder, F.col("at"))
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == sorted(names)


def test_runs_in_files(tmp_path):
    import pyarrow as pa

    def batch(keys):
        n = len(keys)
        columns = [keys, ["t"] * n, list(range(n)), ["response"] * n, [None] * n, [1] * n, ["d"] * n, ["a"] * n, list(range(n))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 1, 3, 6, 7) else pa.int64()) for i, c in enumerate(columns)], warc.NAMES)

    runs = warc.Runs(str(tmp_path / "runs"), held=100)
    rng = random.Random(3)
    keys = []
    for _ in range(20):
        part = [f"k{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        keys += part
        runs.add(batch(sorted(part) if rng.random() < 0.5 else part))
    assert any(isinstance(r, str) for r in runs.runs)
    assert [r[0] for r in runs.merged()] == sorted(keys)
    runs.close()
    assert not (tmp_path / "runs").exists()
