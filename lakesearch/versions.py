"""A small state that is replaced as a whole: numbered JSON files, of which the newest counts.

A new number is written beside the file before and renamed into its place, so a crash at any point leaves the
old state or the new one. Files that can't be parsed are passed over; the ``KEEP`` newest files are kept.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

KEEP = 3


class Conflict(RuntimeError):
    """Another writer has published this number."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.root, self.name = root.rstrip("/"), name
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.root))

    def _numbers(self) -> list[int]:
        found = (re.fullmatch(re.escape(self.name) + r"\.(\d+)", x.getPath().getName()) for x in self.fs.listStatus(self.path(self.root)))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _load(self, name: str) -> dict | None:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def read(self) -> tuple[int, dict] | None:
        """(number, state) of the newest state, or None."""
        for n in self._numbers():
            if (found := self._load(f"{self.name}.{n:012d}")) is not None:
                return n, found
        # The form before numbers.
        old = self._load(self.name) if self.fs.exists(self.path(f"{self.root}/{self.name}")) else None
        return None if old is None else (0, old)

    def publish(self, state: dict, after: int) -> int:
        """Make state the one that follows the number ``after``; raises Conflict if another one did."""
        numbers = self._numbers()
        if numbers and numbers[0] > after:
            raise Conflict(f"{self.root}/{self.name} has changed; read it again")
        temporary = self.path(f"{self.root}/_{self.name}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(temporary, self.path(f"{self.root}/{self.name}.{after + 1:012d}")):
            self.fs.delete(temporary, False)
            raise Conflict(f"{self.root}/{self.name} has changed; read it again")
        for n in numbers[KEEP - 1 :]:
            self.fs.delete(self.path(f"{self.root}/{self.name}.{n:012d}"), False)
        return after + 1
