"""Growing log files as a stream: a file is followed by what it is, not by what it is called.

An offset says for every file how many bytes of whole lines have been read. A file is known by its
first line, and on a local disk by its inode too; so a log that is renamed when it is rotated is read
on where it was left, and the new file of the old name from its start. A file that has become shorter
was truncated and is read from its start again. A last line without a line end waits for it, except
in a rotated file, which nobody writes to any more.

Files are read in pieces of `SPLIT_BYTES`, each by a task of its own. Offsets are the query's own, in
its checkpoint, so a restart neither loses nor doubles lines. What is written between two looks at a
file that is truncated meanwhile cannot be seen by any reader.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").load("/var/log")
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 1024
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
#: Names of files that a rotation has put aside: a number or a day behind the name.
ROTATED = r"(\.\d+|-\d{8}|\.\d{4}-\d{2}-\d{2})$"
#: Looks at the folder for which a file that is gone is remembered, so that a rename that falls
#: between two listings is not taken for a new file.
REMEMBERED = 100
BATCH_LINES = 8192
SCHEMA = "value string, path string, position long"


class Piece(InputPartition):
    """Lines of one file that start in `begin` … `end` - 1; `first` is where the batch begins in it."""

    def __init__(self, key: str, path: str, first: int, begin: int, end: int, last: int):
        self.key, self.path, self.first = key, path, first
        self.begin, self.end, self.last = begin, end, last


class Folder:
    """Files below a path, or matching a pattern, on any file system that Arrow can open."""

    def __init__(self, path: str, rotated: str = ROTATED):
        uri = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
        head, _, tail = uri.rpartition("/")
        pattern = any(c in tail for c in "*?[")
        self.pattern = tail if pattern else "*"
        self.files, self.root = pafs.FileSystem.from_uri(head if pattern else uri)
        self.local = isinstance(self.files, pafs.LocalFileSystem)
        self.rotated = re.compile(rotated)

    def key(self, path: str) -> str | None:
        """What a file is; None while it has no whole line."""
        try:
            with self.files.open_input_file(path) as file:
                head = file.read(HEAD_BYTES)
            inode = os.stat(path).st_ino if self.local else ""
        except FileNotFoundError:
            return None
        line, end, _ = head.partition(b"\n")
        if not end and len(head) < HEAD_BYTES and not (head and self.rotated.search(path)):
            return None
        return f"{hashlib.sha256(line).hexdigest()[:24]}-{inode}"

    def whole_lines(self, path: str, size: int, floor: int, whole: bool) -> int:
        """Bytes up to the last line end among the first `size`, at least `floor`.

        All of them if they are the `whole` file and nobody writes on.
        """
        if whole and self.rotated.search(path):
            return size
        with self.files.open_input_file(path) as file:
            at = size
            while at > floor:
                begin = max(floor, at - BLOCK)
                file.seek(begin)
                found = file.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return floor

    def snapshot(self) -> dict[str, tuple[str, int]]:
        """Of every file with a whole line: its key, path, and size."""
        selector = pafs.FileSelector(self.root, recursive=True, allow_not_found=True)
        found = {}
        for info in sorted(self.files.get_file_info(selector), key=lambda i: i.path):
            name = info.path.removeprefix(self.root).lstrip("/")
            if info.type != pafs.FileType.File or not fnmatch.fnmatch(name, self.pattern):
                continue
            key = self.key(info.path)
            # copies that are the same by first line: told apart by their place in the listing
            while key is not None and key in found:
                key += "+"
            if key is not None:
                found[key] = (info.path, info.size)
        return found

    def find(self, key: str, path: str) -> str:
        """Where the file is now; it may have been renamed since."""
        if self.key(path) == key.rstrip("+"):
            return path
        here = self.snapshot().get(key)
        if here is None:
            raise FileNotFoundError(f"{path} is gone, and no file of the same beginning is left")
        return here[0]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.folder = Folder(options["path"], options.get("rotated", ROTATED))
        self.most = int(options.get("maxBytesPerTrigger", 0))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, dict[str, Any]] | None = None

    def initialOffset(self) -> dict:
        self.known = {}
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Where reading could go now.

        With `maxBytesPerTrigger`, every file gets an equal share of it beyond what is known to be
        read; only the first micro-batch after a restart takes all there is, as the source is not
        told where it had stopped.
        """
        before = self.known or {}
        here = self.folder.snapshot()
        files = {key: {"path": path, "end": size, "gone": 0} for key, (path, size) in here.items()}
        for key, file in before.items():
            if key not in files and file["gone"] < REMEMBERED:
                files[key] = {**file, "gone": file["gone"] + 1}
        begins = {key: self._begin(key, before, files) for key in here}
        share = self.most // max(1, len(here)) if self.most and self.known is not None else 0
        for key, (path, size) in here.items():
            limit = min(size, begins[key] + share) if share else size
            end = self.folder.whole_lines(path, limit, begins[key], limit == size)
            if end == begins[key] and limit < size:  # one line longer than the share
                end = self.folder.whole_lines(path, size, begins[key], True)
            files[key]["end"] = end
        self.known = files
        return {"files": files}

    def _begin(self, key: str, start: dict, end: dict) -> int:
        """Where to read on in a file that is there at the end of a micro-batch."""
        last, own = end[key]["end"], start.get(key)
        if own is not None:
            return own["end"] if own["end"] <= last else 0
        path = end[key]["path"]
        if self.folder.rotated.search(path):  # copied away, and the log itself truncated or removed
            for other, old in start.items():
                now = end.get(other, {"gone": 1, "end": 0})
                left = now["gone"] or now["end"] < old["end"]
                same = other.partition("-")[0] == key.partition("-")[0]
                if same and left and path.startswith(old["path"]) and old["end"] <= last:
                    return old["end"]
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pieces = []
        for key, file in end["files"].items():
            if file["gone"]:
                continue
            first, last = self._begin(key, start["files"], end["files"]), file["end"]
            for begin in range(first, last, self.split):
                pieces.append(Piece(key, file["path"], first, begin, min(begin + self.split, last), last))
        if self.known is None:
            self.known = dict(end["files"])
        return pieces

    def commit(self, end: dict) -> None:
        if self.known is None:
            self.known = dict(end["files"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.options["path"], self.options.get("rotated", ROTATED))
        path = folder.find(partition.key, partition.path)
        with folder.files.open_input_file(path) as raw:
            yield from _batches(raw, partition)


def _batches(raw: pa.NativeFile, piece: Piece) -> Iterator[pa.RecordBatch]:
    """The lines of a piece with the byte each starts at; a cut line belongs to the piece it starts in."""
    at = piece.begin
    if at > piece.first:
        raw.seek(at - 1)
        at = at - 1 + len(_line(raw, piece.last - at + 1))
    raw.seek(at)
    here, cut = at, b""
    values, positions, size = [], [], 0
    while at < piece.end:
        more = raw.read(min(BLOCK, piece.last - here))
        here += len(more)
        *lines, cut = (cut + more).split(b"\n")
        if not more:  # the end of a rotated file
            lines, cut = [cut] * bool(cut), b""
        for line in lines:
            if at >= piece.end:
                break
            values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            positions.append(at)
            size += len(line)
            at += len(line) + 1
            if len(values) == BATCH_LINES or size > 8 * BLOCK:
                yield _made(values, positions, piece.path)
                values, positions, size = [], [], 0
        if not more:
            break
    if values:
        yield _made(values, positions, piece.path)


def _line(raw: pa.NativeFile, most: int) -> bytes:
    """From here to the next line end, at most `most` bytes; leaves the file right behind it."""
    start, found = raw.tell(), b""
    while len(found) < most:
        more = raw.read(min(BLOCK, most - len(found)))
        if not more:
            break
        end = more.find(b"\n")
        if end >= 0:
            found += more[: end + 1]
            raw.seek(start + len(found))
            return found
        found += more
    return found


def _made(values: list[str], positions: list[int], path: str) -> pa.RecordBatch:
    columns = [pa.array(values, pa.string()), pa.array([path] * len(values)), pa.array(positions, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["value", "path", "position"])


class LogTail(DataSource):
    """Options: `path` (a folder, or a pattern of its files), `maxBytesPerTrigger`, `rotated`."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(dict(self.options))
