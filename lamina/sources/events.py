"""Changes of a file tree as a stream: adds, changes and removals, from the difference of two listings.

An offset is the number of a listing. The first task that reads a folder for an offset lists it and stores the listing, in one step, in
the state folder; whoever reads that offset again, after a lost task or a restart, takes the stored one. So each
change appears in one batch, and in it however often it is run. Folders at the top are listed by tasks of their own.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import _Reader, _Slice

CREATE, MODIFY, REMOVE = "create", "modify", "remove"
TOP = "."


class _Change(InputPartition):
    def __init__(self, top: str, start: int, end: int):
        self.top, self.start, self.end = top, start, end


def difference(before: dict, now: dict) -> Iterator[tuple]:
    """(path, kind, size, mtime_ns) of two listings {path: [size, mtime_ns]}, by path; a removal has what was there."""
    for path in sorted({*before, *now}):
        if path not in now:
            yield path, REMOVE, *before[path]
        elif path not in before:
            yield path, CREATE, *now[path]
        elif before[path] != now[path]:
            yield path, MODIFY, *now[path]


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.walk, self.state = _Reader(options), options["state"]

    def _numbers(self) -> list[int]:
        try:
            return sorted(int(x) for x in os.listdir(self.state) if re.fullmatch(r"\d+", x))
        except FileNotFoundError:
            return []

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self, *_) -> dict:
        return {"listing": max(self._numbers(), default=0) + 1}

    def _tops(self, number: int) -> set[str]:
        folder = os.path.join(self.state, str(number))
        return {TOP if x == TOP + "top" else unquote(x) for x in os.listdir(folder) if not x.endswith(".draft")} if os.path.isdir(folder) else set()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["listing"], end["listing"]
        os.makedirs(os.path.join(self.state, str(b)), exist_ok=True)
        now = {s.top or TOP for s in self.walk.partitions()}
        return [_Change(t, a, b) for t in sorted(now | self._tops(a) | self._tops(b))]

    def _file(self, number: int, top: str) -> str:
        return os.path.join(self.state, str(number), quote(top, safe="") if top != TOP else TOP + "top")

    def _stored(self, number: int, top: str) -> dict | None:
        try:
            with open(self._file(number, top), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _listed(self, number: int, top: str) -> dict:
        """The listing of an offset, the stored one if there is any."""
        if (found := self._stored(number, top)) is not None:
            return found
        there = top == TOP or os.path.isdir(os.path.join(self.walk.root, top))
        rows = self.walk.read(_Slice("" if top == TOP else top, top != TOP)) if there else ()
        found = {r[0]: [r[1], r[2]] for r in rows if r[1] is not None}
        draft = f"{self._file(number, top)}.{uuid.uuid4().hex}.draft"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(found, f)
        try:
            os.link(draft, self._file(number, top))  # never over what another attempt has stored
        except FileExistsError:
            found = self._stored(number, top)
        finally:
            os.unlink(draft)
        return found

    def read(self, partition: _Change) -> Iterator[tuple]:
        before = self._stored(partition.start, partition.top) or {}
        yield from difference(before, self._listed(partition.end, partition.top))

    def commit(self, end: dict) -> None:
        """Listings before the last one that a batch has ended with are of no more use."""
        for n in self._numbers():
            if n < end["listing"]:
                folder = os.path.join(self.state, str(n))
                for x in os.listdir(folder):
                    os.unlink(os.path.join(folder, x))
                os.rmdir(folder)


class FileEvents(DataSource):
    """Options: path, state, and those of the file tree."""

    @classmethod
    def name(cls) -> str:
        return "fileevents"

    def schema(self) -> str:
        return "path string, kind string, size bigint, mtime_ns bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def file_events(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    """A stream of (path, kind, size, mtime_ns) over a folder that every executor sees, as it sees ``state``, where listings are kept.

    The first batch reports all files as created. Files that change and change back between two batches are not reported; nor are
    folders, or what the ignore rules leave out (``options`` of the file tree).
    """
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("fileevents").option("path", root).option("state", state).options(**options).load()
