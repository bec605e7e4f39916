"""The tailing source: appends, rotation, truncation, restarts; nothing lost, nothing doubled."""

import os
import random
import shutil

import pytest

from logvane.sources import tail
from logvane.sources.ingest import tail_lines


class Log:
    """A folder of logs, a stream over it, and what has been written."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.written = []
        (folder / "logs").mkdir()

    def path(self, name):
        return str(self.folder / "logs" / name)

    def add(self, name, *lines, end="\n"):
        with open(self.path(name), "a") as file:
            file.write("\n".join(lines) + end)
        self.written += lines

    def run(self):
        """One run of the query to the end of what is there; every run is a restart."""
        stream = tail_lines(self.spark, self.options.pop("pattern", self.path("")), **self.options)
        query = (
            stream.writeStream.format("parquet")
            .option("path", str(self.folder / "out"))
            .option("checkpointLocation", str(self.folder / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        found = self.spark.read.parquet(str(self.folder / "out"))
        return sorted(r.log_line for r in found.collect())


def test_appends_rotations_and_truncations(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add("app.log", "a1", "a2", "")
    log.add("other.log", "o1 é", "o2\tx")
    assert log.run() == sorted(log.written)
    log.add("app.log", "a3")
    with open(log.path("app.log"), "a") as file:
        file.write("begun ")
    assert log.run() == sorted(log.written)
    log.add("app.log", "and ended")
    log.written[-1] = "begun and ended"
    assert log.run() == sorted(log.written)
    # renamed with a line unread, new file of the old name
    log.add("app.log", "a4")
    os.rename(log.path("app.log"), log.path("app.log.1"))
    log.add("app.log", "b1", "b2")
    assert log.run() == sorted(log.written)
    # copied away and truncated
    log.add("app.log", "b3")
    shutil.copy(log.path("app.log"), log.path("app.log-20240101"))
    os.truncate(log.path("app.log"), 0)
    log.add("app.log", "c1")
    assert log.run() == sorted(log.written)
    # truncated without a copy, and begun with the same line again
    os.truncate(log.path("other.log"), 0)
    log.add("other.log", "o1 é")
    assert log.run() == sorted(log.written)
    # the last line of a rotated file has no line end
    log.add("app.log", "no end", end="")
    os.rename(log.path("app.log"), log.path("app.log.2"))
    os.remove(log.path("app.log.1"))
    assert log.run() == sorted(log.written)
    assert log.run() == sorted(log.written)


def test_pieces_give_every_line_once(spark, tmp_path):
    draw = random.Random(1)
    log = Log(spark, tmp_path, splitBytes="17")
    for _ in range(3):
        log.add("x.log", *["y" * draw.choice([0, 1, 5, 16, 17, 40]) for _ in range(60)])
        assert log.run() == sorted(log.written)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    text = open(log.path("x.log"), "rb").read()
    assert sorted(r.position for r in found) == [0, *[k + 1 for k, c in enumerate(text) if c == 10][:-1]]


def test_only_files_of_the_pattern(spark, tmp_path):
    log = Log(spark, tmp_path)
    log.add("x.txt", "not this")
    log.written.clear()
    log.add("x.log", "this")
    log.options["pattern"] = log.path("*.log")
    assert log.run() == ["this"]


def test_no_files_yet_and_a_share_per_micro_batch(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path / "none"), "maxBytesPerTrigger": "10"})
    start = reader.initialOffset()
    assert reader.partitions(start, reader.latestOffset()) == []
    os.makedirs(tmp_path / "none")
    (tmp_path / "none" / "a.log").write_text("12345\n789\nthis line is longer than its share\nz\n")
    seen, offset = [], start
    for _ in range(6):
        ahead = reader.latestOffset()
        seen += [v for p in reader.partitions(offset, ahead) for b in reader.read(p) for v in b.column(0).to_pylist()]
        offset = ahead
    assert seen == ["12345", "789", "this line is longer than its share", "z"]


def test_a_file_that_is_gone_for_a_moment(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("1\n2\n")
    reader = tail.TailReader({"path": str(tmp_path)})
    start = reader.initialOffset()
    first = reader.latestOffset()
    os.rename(path, tmp_path.parent / "hidden")
    second = reader.latestOffset()
    os.rename(tmp_path.parent / "hidden", path)
    path.write_text(path.read_text() + "3\n")
    third = reader.latestOffset()
    ranges = [[(p.begin, p.end) for p in reader.partitions(a, b)] for a, b in ((start, first), (first, second), (second, third))]
    assert ranges == [[(0, 4)], [], [(4, 6)]]


def test_a_batch_is_read_again_after_its_file_was_renamed(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("1\n2\n")
    reader = tail.TailReader({"path": str(tmp_path)})
    pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(path, tmp_path / "a.log.1")
    path.write_text("new\n")
    assert [b.column(0).to_pylist() for p in pieces for b in reader.read(p)] == [["1", "2"]]
    os.remove(tmp_path / "a.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(pieces[0]))
