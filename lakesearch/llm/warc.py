"""Operator 3: WARC archives with an index that is merged from sorted runs.

Writing. Pages become records of ``.warc.gz`` archives, one gzip member a record, so that a record can be
read alone. Of the records with equal payloads the one with the largest id is the *response*; the others
are *revisit* records, which name it and hold no payload. A task writes its archives under names of its
own attempt, begins another beyond ``ARCHIVE_BYTES``, and moves all to their final places at its end; what an
earlier attempt left there is replaced or deleted.

Reading. ``read_archives`` streams the archives of a folder, a record at a time; payload digests are computed
anew from what is read. A revisit has its payload's size and digest in its header.

Indexing. The reader sorts its captures by (URL key, timestamp, id) into runs of ``RUN_ROWS``: the key has the
host's labels reversed, so that the pages of a domain stand together. The runs are merged by key ranges, of
which there are as many as the captures need at ``RANGE_ROWS`` each. Ranges are over the whole sort key, so a
URL or host with most captures is spread like any other; the ranges in order are the globally ordered capture
histories. A task takes its range's part of every run as it arrives (a run ends where the order breaks, so the
result doesn't hang on how rows arrive) and merges the parts by a loser tree. It keeps them as Arrow batches;
beyond ``HELD_BYTES`` finished parts move to files in the shared folder, of which the tree holds a slice of
``SLICE`` rows each. So memory depends neither on the index nor on the size of a range.

Edge cases: null html is an empty payload, null URLs have an empty target. Ids may be null (a record, but
never the one that others revisit) or repeat (rows that share the largest id are all responses). Extra columns are ignored. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from io import BytesIO
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, scratch, small_batches

NO_DATE = "1970-01-01T00:00:00Z"
MIN_PAYLOAD = 0
#: Compressed bytes after which a task begins another archive; captures of a sorted run and of a range.
ARCHIVE_BYTES, RUN_ROWS, RANGE_ROWS = 256 << 20, 50_000, 200_000
#: Arrow bytes that a merging task holds before it moves runs to files; rows of a run that are Python objects at once.
HELD_BYTES, SLICE = 128 << 20, 256
CAPTURE = "urlkey string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, date: str, digest: str, size: int, refers_to: int | None, body: bytes) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(stream: BinaryIO | bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset of the gzip member, headers, body) of each record; one record is in memory at a time."""
    stream = BytesIO(stream) if isinstance(stream, bytes) else stream
    at, ahead = 0, stream.read(1 << 16)
    while ahead:
        member, parts, size = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not ahead:
                raise ValueError(f"the record at {at} is cut off")
            parts.append(member.decompress(ahead))
            size += len(ahead)
            ahead = member.unused_data if member.eof else stream.read(1 << 16)
        size -= len(ahead)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield at, fields, rest[: int(fields["Content-Length"])]
        at += size
        ahead = ahead or stream.read(1 << 16)


def store_of(place: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs

    if place.startswith("file:"):
        place = "/" + re.sub("^file:/*", "", place)
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def url_key(url: str | None) -> str:
    """Host labels reversed, comma-joined, then ``)`` and the path with its query, lower-cased."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    host, cut, path = rest.partition("/")
    return ",".join(reversed(host.lower().split("."))) + ")/" + path.lower()


class LoserTree:
    """Merges k sorted iterators; each next row costs one path of comparisons from a leaf to the root."""

    def __init__(self, runs: Iterable[Iterable], key: Callable):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.runs))
        self.rows: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(len(self.runs)):
            self._pull(i)
        self.tree = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._replay(i, build=True)

    def _pull(self, i: int) -> None:
        row = next(self.runs[i], None) if i < len(self.runs) else None
        self.rows[i], self.keys[i] = row, None if row is None else self.key(row)

    def _before(self, a: int, b: int) -> bool:
        """Ended runs come last; equal keys come in the order of the runs."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, i: int, build: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            loser = self.tree[node]
            if loser == -1 and build:
                self.tree[node] = winner
                return
            if self._before(loser, winner):
                self.tree[node], winner = winner, loser
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            w = self.tree[0]
            row = self.rows[w]
            if row is None:
                return
            yield row
            self._pull(w)
            self._replay(w)


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """pages: (page_id, url, timestamp, payload). Adds digest and refers_to (null for responses).

    The largest id of each digest is found on narrow rows with map-side pre-aggregation; a payload that
    most pages share is one row of the small side, and AQE splits its rows on the other.
    """
    keyed = pages.withColumn("digest", F.sha1(F.coalesce("payload", F.lit("").cast("binary"))))
    rows = keyed.filter(F.octet_length("payload") >= min_payload)
    last = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1"), "payloads")
    return keyed.join(last, "digest", "left").withColumn(
        "refers_to", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    ).drop("last", "copies")


def write_archives(pages: DataFrame, folder: str, timestamp: Column | None = None) -> None:
    """Write pages (page_id, url, html) as archives into folder, a path or URI that all executors share."""
    prepared = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
        (F.lit(NO_DATE) if timestamp is None else timestamp).alias("timestamp"),
    )
    write = _writer(folder)
    done = resolve(prepared).select(
        F.col("page_id").cast("string").alias("page_id"), F.col("refers_to").cast("string").alias("refers_to"), "url", "timestamp", "payload"
    )
    done.mapInPandas(write, "archive string").write.format("noop").mode("overwrite").save()


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        mine = f"part-{context.partitionId():05d}-"
        tail = ".warc.gz"
        own = lambda k: f"{root}/_{mine}{k:05d}.{context.taskAttemptId()}"
        out, made, size = None, 0, 0
        for b in batches:
            for page_id, refers_to, url, date, payload in zip(b["page_id"], b["refers_to"], b["url"], b["timestamp"], b["payload"]):
                if out is None:
                    out, size = store.open_output_stream(own(made), compression=None), 0
                    made += 1
                payload = bytes(payload)
                known = refers_to is not None and refers_to == refers_to
                text = record(
                    "revisit" if known else "response", page_id, url or "", date, bare_digest(payload), len(payload),
                    refers_to if known else None, b"" if known else payload,
                )
                size += out.write(packed := gzip.compress(text, 1, mtime=0)) or len(packed)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        names = [f"{mine}{k:05d}{tail}" for k in range(made)]
        for k, name in enumerate(names):
            store.move(own(k), f"{root}/{name}")
        # An earlier attempt may have moved more of its own; their numbers have no gap.
        while store.get_file_info(old := f"{root}/{mine}{made:05d}{tail}").type != fs.FileType.NotFound:
            store.delete_file(old)
            made += 1
        if names:
            yield pd.DataFrame({"archive": names})

    return write


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives of a folder, one row a record, in sorted runs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                store, at = store_of(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows = []
                    for offset, h, body in parse(stream):
                        own = h["WARC-Record-ID"][10:-1]
                        to = h.get("WARC-Refers-To")
                        size, digest = (len(body), bare_digest(body)) if to is None else (int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:])
                        rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], own or None, h["WARC-Type"], to and to[10:-1], size, digest, path.rpartition("/")[2], offset))
                        if len(rows) == RUN_ROWS:
                            yield from _run(rows)
                            rows = []
                    yield from _run(rows)

    return _ids_long(files.mapInPandas(read, TEXT_IDS))


NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
#: Ids as text, as pandas has no null among whole numbers.
TEXT_IDS = CAPTURE.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")


def _ids_long(rows: DataFrame) -> DataFrame:
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def order(r: tuple) -> tuple:
    """The sort key of a capture: URL key, timestamp, id (null first); archive and offset make it unique."""
    return r[0], r[1], r[2] is not None, int(r[2] or 0), r[7], r[8]


def _run(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    rows.sort(key=order)
    for i in range(0, len(rows), 5000):
        yield pd.DataFrame(rows[i : i + 5000], columns=NAMES)


class Runs:
    """Sorted runs of one merging task: Arrow batches, or files once more than ``held`` bytes are in memory."""

    def __init__(self, folder: str, held: int = HELD_BYTES):
        self.folder, self.held = folder, held
        self.runs: list[list[pa.RecordBatch] | str] = []
        self.size, self.last, self.made = 0, None, 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Append rows; a run ends where a row comes before the one it follows."""
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        begin = 0
        for i, r in enumerate(rows):
            key = order(r)
            if self.last is None or key < self.last:
                self._extend(batch.slice(begin, i - begin))
                begin = i
                self._spill()
                self.runs.append([])
            self.last = key
        self._extend(batch.slice(begin))

    def _extend(self, part: pa.RecordBatch) -> None:
        if part.num_rows:
            # a slice shares the whole batch's buffers; taken rows own theirs
            self.runs[-1].append(part.take(pa.array(range(part.num_rows))))
            self.size += self.runs[-1][-1].nbytes

    def _spill(self) -> None:
        """Move the runs in memory, all of them finished, to one file each."""
        if self.size <= self.held:
            return
        store, root = store_of(self.folder)
        store.create_dir(root, recursive=True)
        for i, run in enumerate(self.runs):
            if isinstance(run, list) and run:
                with store.open_output_stream(path := f"{root}/{self.made:06d}.arrow") as out, pa.ipc.new_file(out, run[0].schema) as w:
                    for batch in run:
                        for at in range(0, batch.num_rows, SLICE):
                            w.write_batch(batch.slice(at, SLICE))
                self.runs[i], self.made = path, self.made + 1
        self.size = 0

    def rows(self, run: list[pa.RecordBatch] | str) -> Iterator[tuple]:
        if isinstance(run, str):
            with store_of(self.folder)[0].open_input_file(run) as f:
                found = pa.ipc.open_file(f)
                for i in range(found.num_record_batches):
                    yield from zip(*(c.to_pylist() for c in found.get_batch(i).columns))
            return
        for batch in run:
            for at in range(0, batch.num_rows, SLICE):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))

    def merged(self) -> Iterator[tuple]:
        return iter(LoserTree([self.rows(r) for r in self.runs], order))

    def close(self) -> None:
        if self.made:
            store, root = store_of(self.folder)
            store.delete_dir(root)


def merge_index(captures: DataFrame, ranges: int | None = None, held: int = HELD_BYTES) -> DataFrame:
    """captures, a written table: the same rows in global order of (urlkey, timestamp, page_id)."""
    spark = captures.sparkSession
    small_batches(spark)
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(captures.count() / RANGE_ROWS))
    cut = captures.repartitionByRange(n, "urlkey", "timestamp", F.col("page_id").asc_nulls_first(), "archive", "offset")
    folder = scratch(spark, "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = Runs(f"{folder}/{TaskContext.get().taskAttemptId()}", held)
        schema = None
        try:
            for b in batches:
                schema = b.schema
                runs.add(b)
            out = []
            for row in runs.merged():
                out.append(row)
                if len(out) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        finally:
            runs.close()

    return cut.select(NAMES).mapInArrow(merge, CAPTURE)


def round_trip(pages: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and merge the index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch(spark, "warc")
    write_archives(pages, folder, timestamp)
    if not _exists(spark, folder):
        return spark.createDataFrame([], CAPTURE)
    return merge_index(materialize(read_archives(spark, folder), "captures"))


def _exists(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder + "/part-*.warc.gz")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
