import json
import os
import shutil

import pytest

from wirelens.sources import follow
from wirelens.sources.eve import CORRUPT, good_lines
from wirelens.streaming import jobs


class Tail:
    """A stream over a log folder whose lines are kept per batch, and that can be stopped and started again."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.batches = spark, folder, options, []
        self.path = os.path.join(folder, "eve.json")

    def start(self):
        lines = follow.followed_lines(self.spark, self.path + "*", **self.options)
        keep = lambda batch, _: self.batches.append([r.value for r in batch.orderBy("file", "position").collect()])
        self.query = jobs.stream_microbatch(lines, keep, os.path.join(self.folder, "checkpoint"), 0.1)

    def settle(self):
        self.query.processAllAvailable()

    def lines(self):
        return [x for b in self.batches for x in b]

    def add(self, *texts, end="\n"):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write("".join(t + "\n" for t in texts[:-1]) + texts[-1] + end)


@pytest.fixture
def tail(spark, tmp_path):
    made = Tail(spark, str(tmp_path))
    yield made
    made.query.stop()


def test_growing_rotated_and_restarted(tail):
    tail.start()
    tail.settle()  # nothing there yet
    tail.add("a1", "a2", "half", end="")
    tail.settle()
    assert tail.lines() == ["a1", "a2"]  # a line without its end waits
    tail.add(" a line", "é a4")
    tail.settle()
    assert tail.lines() == ["a1", "a2", "half a line", "é a4"]
    os.rename(tail.path, tail.path + ".1")  # rotation by rename, with lines that nobody has read
    with open(tail.path + ".1", "a") as f:
        f.write("a5\n")
    tail.add("b1")
    tail.settle()
    assert sorted(tail.lines()[4:]) == ["a5", "b1"]
    tail.query.stop()
    tail.add("b2")
    shutil.copy(tail.path, tail.path + ".2")  # rotation by copy and truncation, while the stream is down
    open(tail.path, "w").close()
    tail.add("c1", "c2")
    tail.start()
    tail.settle()
    assert sorted(tail.lines()[6:]) == ["b2", "c1", "c2"]
    open(tail.path, "w").close()  # truncated in place
    tail.add("d1")
    tail.settle()
    tail.query.stop()
    tail.start()
    tail.settle()
    tail.add("d2")
    tail.settle()
    assert tail.lines()[9:] == ["d1", "d2"] and len(tail.lines()) == 11


def test_same_content_after_truncation_is_read_again(tail):
    tail.add("x", "y")
    tail.start()
    tail.settle()
    open(tail.path, "w").close()
    tail.add("x")
    tail.settle()
    tail.add("z")
    tail.settle()
    assert tail.lines() == ["x", "y", "x", "z"]


def test_from_end_and_rows_of_a_batch(tail):
    tail.options = {"from_end": True, "max_rows": 50}
    tail.add(*[f"old {i}" for i in range(30)])
    tail.start()
    tail.settle()
    assert tail.lines() == []
    tail.add(*[f"new {i}" for i in range(120)])
    tail.settle()
    assert tail.lines() == [f"new {i}" for i in range(120)] and max(map(len, tail.batches)) == 50


def test_ranges_meet_at_line_ends(tail, monkeypatch, tmp_path):
    path = str(tmp_path / "log")
    texts = ["x" * n for n in (0, 1, 5, 63, 64, 65, 200, 0, 0, 7)] * 9
    with open(path, "w") as f:
        f.write("first\n" + "".join(t + "\n" for t in texts))
    monkeypatch.setattr(follow, "RANGE", 64)
    reader = follow.Follower(path, False, None)
    reader.initialOffset()
    parts = reader.partitions({"files": {}}, reader.latestOffset())
    read = [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert len(parts) > 50 and read == ["first", *texts]
    os.rename(path, path + ".old")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    tail.start()


def test_events(spark, tmp_path):
    path = str(tmp_path / "eve.json")
    with open(path, "w") as f:
        f.write(json.dumps({"timestamp": "2024-01-01T00:00:00+0000", "event_type": "flow", "flow_id": 7, "src_ip": "1.1.1.1"}) + "\nnot json\n")
    out = []
    query = jobs.stream_microbatch(follow.src_eve_follow(spark, path, from_end=False), lambda b, _: out.extend(
        [*b.select("event_type", "flow_id", CORRUPT).collect(), good_lines(b).count()]), str(tmp_path / "c"), 0.1)
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in out[:-1]] == [("flow", "7", None), (None, None, "not json")] and out[-1] == 1
