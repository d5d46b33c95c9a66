"""Follows log files that grow and are rotated, as a streaming source.

A file is known by its first line, not by its name: it stays the same file when it is renamed, or copied and
then truncated, and it is a new one when its name holds other content.  The offset of a stream is, for every
file, the byte after the last whole line that has been taken; a line without its end waits.

Only the driver looks at sizes and line ends (the tail of each file, in small blocks).  Lines are read by tasks, in
ranges of bounded size, so the files must lie where the workers see them.
"""

import glob
import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from wirelens import schemas
from wirelens.session import ship_package
from wirelens.sources.eve import CORRUPT

BLOCK, RANGE, FIRST = 1 << 16, 8 << 20, 1 << 20  # bytes looked at together, read by one task, searched for a first line
REMEMBERED = 10_000  # files whose offset is kept after they are gone


def identity(path: str) -> str | None:
    """Digest of the first line; None while there is no whole line."""
    with open(path, "rb") as f:
        line = f.readline(FIRST)
    return hashlib.sha1(line).hexdigest()[:20] if line.endswith(b"\n") else None


def listed(pattern: str) -> dict[str, tuple[str, int]]:
    """Path and size of every followed file; of two that begin alike (a copy before its original is cut) the longer."""
    found = {}
    for path in sorted(glob.glob(pattern), key=lambda p: (os.path.getmtime(p) if os.path.exists(p) else 0, p)):
        try:
            name, size = identity(path), os.path.getsize(path)
        except FileNotFoundError:  # renamed since: seen under its new name, or next time
            continue
        if name and size > found.get(name, ("", -1))[1]:
            found[name] = (path, size)
    return found


def last_line_end(path: str, low: int, high: int) -> int:
    """The byte after the last line end between ``low`` and ``high``, else ``low``."""
    with open(path, "rb") as f:
        while high > low:
            begin = max(low, high - BLOCK)
            f.seek(begin)
            at = f.read(high - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            high = begin
    return low


def line_end_after(path: str, low: int, high: int, rows: int) -> tuple[int, int]:
    """(the byte after the line end that closes at most ``rows`` lines, how many there are)."""
    taken = 0
    with open(path, "rb") as f:
        f.seek(low)
        while taken < rows and low < high:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            low, taken = low + len(line), taken + 1
    return low, taken


class LineRange(InputPartition):
    def __init__(self, path: str, name: str, begin: int, low: int, high: int):
        self.path, self.name, self.begin, self.low, self.high = path, name, begin, low, high


class Follower(DataSourceStreamReader):
    def __init__(self, pattern: str, from_end: bool, max_rows: int | None):
        self.pattern, self.from_end, self.max_rows = pattern, from_end, max_rows
        self.reached: dict[str, int] | None = None  # known once a batch has been planned here

    def _key(self, name: str, size: int, known: dict) -> str:
        """A file that is shorter than what was last taken of it has begun anew."""
        again = 0
        while f"{name}:{again + 1}" in known:
            again += 1
        key = f"{name}:{again}" if again else name
        return f"{name}:{again + 1}" if known.get(key, 0) > size else key

    def initialOffset(self) -> dict:
        ends = {name: last_line_end(path, 0, size) for name, (path, size) in listed(self.pattern).items()} if self.from_end else {}
        self.reached = dict(ends)
        return {"files": ends}

    def latestOffset(self) -> dict:
        known = self.reached or {}
        ends, room = dict(known), self.max_rows if self.reached is not None else None
        for name, (path, size) in listed(self.pattern).items():
            key = self._key(name, size, known)
            low = known.get(key, 0)
            if room is None:
                ends[key] = last_line_end(path, low, size)
            elif room and size > low:
                ends[key], taken = line_end_after(path, low, size, room)
                room -= taken
            if ends.get(key) == 0:
                del ends[key]
        return {"files": ends}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, until = start["files"], end["files"]
        self.reached = dict(list(until.items())[-REMEMBERED:])
        paths = {name: path for name, (path, _) in listed(self.pattern).items()}
        out = []
        for key, high in until.items():
            name, begin = key.split(":")[0], before.get(key, 0)
            out += [LineRange(paths.get(name, ""), name, begin, low, min(low + RANGE, high)) for low in range(begin, high, RANGE)]
        return out

    def _open(self, part: LineRange):
        """The file by its first line: it may have been renamed since the batch was planned."""
        for path in [part.path, *sorted(glob.glob(self.pattern))]:
            try:
                if path and identity(path) == part.name and os.path.getsize(path) >= part.high:
                    return open(path, "rb")
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"lines {part.low} to {part.high} of a followed file are gone (first seen as {part.path})")

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        with self._open(partition) as f:
            at = partition.low
            if at > partition.begin:  # a line belongs to the range in which it begins
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.high:
                lines = []
                while at < partition.high and len(lines) < 10_000:
                    line = f.readline()
                    lines.append((line.rstrip(b"\r\n").decode("utf-8", "replace"), at))
                    at += len(line)
                values, places = zip(*lines)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.name] * len(lines), pa.string()),
                                                  pa.array(places, pa.int64())], ["value", "file", "position"])

    def commit(self, end: dict) -> None:
        pass


class FollowedLines(DataSource):
    """Options: path (a name or pattern), from_end (true: only what comes from now on), max_rows (of one batch)."""

    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "value string, file string, position long"

    def streamReader(self, schema: StructType) -> Follower:
        rows = self.options.get("max_rows")
        return Follower(self.options["path"], self.options.get("from_end", "false").lower() == "true", int(rows) if rows else None)


def followed_lines(spark: SparkSession, path: str, from_end: bool = False, max_rows: int | None = None) -> DataFrame:
    """(value, file, position): the lines of the files that match ``path``, each once, in batches of at most ``max_rows``.

    A restarted stream goes on behind its checkpoint; its first batch takes what has gathered, whatever its size,
    because the source learns where the stream stands when that batch is planned.
    """
    ship_package(spark).dataSource.register(FollowedLines)
    reader = spark.readStream.format("followed_lines").option("path", path).option("from_end", str(from_end).lower())
    return (reader.option("max_rows", max_rows) if max_rows else reader).load()


def src_eve_follow(spark: SparkSession, path: str, from_end: bool = True, max_rows: int | None = None) -> DataFrame:
    """Sensor events of a log that is still written, with unreadable lines in ``_corrupt_record``."""
    lines = followed_lines(spark, path, from_end, max_rows)
    schema = schemas.EVE if CORRUPT in schemas.EVE.names else StructType([*schemas.EVE.fields]).add(CORRUPT, "string")
    event = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(event.alias("e")).select("e.*")
