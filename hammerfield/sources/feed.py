"""A streaming Python data source for feeds that are files of JSON lines which grow at their end.

The offset of a file is how far it has been read: bytes, records and the SHA-256 of those bytes. A batch takes whole
lines of each file, `batch` records at most or, where none are named, about STRETCH bytes: a batch costs a second or two
whatever it holds, so their number must not grow with small counts of records. While a stream runs, a file that stays as
it is is read and hashed on from where it stood. Where a stream resumes, the bytes that were read before must still be
the same; a file that was changed, shortened or removed is an error, since its records could no longer be told from
those imported. Spark's checkpoint says what a batch holds; the cursor, which commit() writes, only says where to look
on after a restart, and may lag behind it by a batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class RecordFeed(DataSource):
    """spark.readStream.format("record_feed") with path (a folder, read with its sub-folders), cursor (a file's place) and
    batch (records of a file a batch; none: STRETCH bytes): file, n (place of the record in its file, from 1), outcome (ok, or invalid
    for a line that is no JSON object), record (JSON text, null unless ok). Blank lines are no records.
    """

    @classmethod
    def name(cls) -> str:
        return "record_feed"

    def schema(self) -> str:
        return "file string, n long, outcome string, record string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options["path"], self.options["cursor"], int(self.options["batch"]) if "batch" in self.options else None)


class Stretch(InputPartition):
    """Bytes from `start` to `end` of a file, and the record that comes first in them."""

    def __init__(self, uri: str, file: str, start: int, end: int, first: int, records: int):
        self.uri, self.file, self.start, self.end, self.first, self.records = uri, file, start, end, first, records


def outcome_of(line: bytes) -> tuple[str, str | None]:
    try:
        text = line.decode()
        return ("ok", text.strip()) if isinstance(json.loads(text), dict) else ("invalid", None)
    except ValueError:
        return "invalid", None


class FeedReader(DataSourceStreamReader):
    STRETCH, CHUNK = 64 << 20, 1 << 20  # bytes of a file a batch, and bytes held at once

    def __init__(self, path: str, cursor: str, batch: int | None):
        self.path, self.cursor, self.batch = path.rstrip("/"), cursor, batch
        self.ends: dict | None = None  # as last told or committed
        self.known: dict[str, tuple] = {}  # digest and state (size, time) of a file whose read part was checked in that state
        self.hashed: dict[str, tuple] = {}  # the same, and the running hash of the read part

    # -- on the driver ---------------------------------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.ends is None:
            self.ends = self._saved()
        files = self._files()
        self._present(self.ends, files)
        self.ends = {name: self._further(name, info, self.ends.get(name, {"bytes": 0, "records": 0, "sha256": ""})) for name, info in sorted(files.items())}
        return self.ends

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        files = self._files()
        self._present(end, files)
        out = []
        for name, to in sorted(end.items()):
            since = start.get(name, {"bytes": 0, "records": 0})
            self._check(name, files[name], to)
            if to["bytes"] > since["bytes"]:
                out.append(Stretch(f"{self.path}/{name}", name, since["bytes"], to["bytes"], since["records"] + 1, to["records"] - since["records"]))
        if self.ends is None:
            self.ends = end
        return out

    def commit(self, end: dict) -> None:
        system, path = self._system(self.cursor)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(end).encode())
        system.move(f"{path}.new", path)

    def _saved(self) -> dict:
        system, path = self._system(self.cursor)
        if not system.get_file_info(path).is_file:
            return {}
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    @staticmethod
    def _system(uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def _files(self) -> dict:
        from pyarrow import fs

        system, top = self._system(self.path)
        found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        names = ((f.path[len(top) + 1 :], f) for f in found if f.is_file)
        return {n: f for n, f in names if not any(part.startswith(("_", ".")) for part in n.split("/"))}

    @staticmethod
    def _present(offset: dict, files: dict) -> None:
        gone = sorted(n for n, o in offset.items() if o["bytes"] and n not in files)
        if gone:
            raise ValueError(f"files that were partly read are gone: {gone}")

    def _check(self, name: str, info, offset: dict):
        """The file, open where the offset ends, and the hash of all before; an error if that is not what was read."""
        state = (info.size, info.mtime_ns)
        if self.known.get(name) == (offset["sha256"], state):
            return
        _, digest = self._open(info, offset)
        if offset["bytes"] and digest.hexdigest() != offset["sha256"]:
            raise ValueError(f"the part of {name} that was read has changed")
        self.known[name] = (offset["sha256"], state)

    def _open(self, info, offset: dict):
        if info.size < offset["bytes"]:
            raise ValueError(f"{info.path} is shorter than the part that was read")
        system, _ = self._system(self.path)
        stream, digest, left = system.open_input_stream(info.path), hashlib.sha256(), offset["bytes"]
        while left:
            data = stream.read(min(left, self.CHUNK))
            digest.update(data)
            left -= len(data)
        return stream, digest

    def _further(self, name: str, info, offset: dict) -> dict:
        if info.size == offset["bytes"] and self.known.get(name) == (offset["sha256"], (info.size, info.mtime_ns)):
            return offset
        state = (info.size, info.mtime_ns)
        stream, digest = self._resumed(name, info, offset)
        at, n, held = offset["bytes"], offset["records"], b""
        most = float("inf") if self.batch is None else n + self.batch
        last = at + self.STRETCH if self.batch is None else float("inf")
        with stream:
            while n < most and at < last and (data := stream.read(self.CHUNK)):
                held += data
                whole, held = self._lines(held, most - n)
                digest.update(whole)
                at, n = at + len(whole), n + sum(map(bool, map(bytes.strip, whole.split(b"\n"))))
        out = {"bytes": at, "records": n, "sha256": digest.hexdigest() if at else ""}
        self.known[name], self.hashed[name] = (out["sha256"], state), (out["sha256"], state, digest)
        return out

    def _resumed(self, name: str, info, offset: dict):
        """As _open, checked; a file in the state in which it was hashed last is not read again."""
        *hashed, digest = self.hashed.get(name, (None, None, None))
        if offset["bytes"] and hashed == [offset["sha256"], (info.size, info.mtime_ns)]:
            system, _ = self._system(self.path)
            stream = system.open_input_file(info.path)
            stream.seek(offset["bytes"])
            return stream, digest.copy()
        stream, digest = self._open(info, offset)
        if offset["bytes"] and digest.hexdigest() != offset["sha256"]:
            raise ValueError(f"the part of {name} that was read has changed")
        return stream, digest

    @staticmethod
    def _lines(data: bytes, most: float) -> tuple[bytes, bytes]:
        """The whole lines of data up to the one of record `most`, and the rest."""
        end = data.rfind(b"\n") + 1
        if data.count(b"\n") >= most:
            at = 0
            while most and at < end:
                line = data[at : (cut := data.find(b"\n", at) + 1)]
                at, most = cut, most - bool(line.strip())
            end = at
        return data[:end], data[end:]

    # -- on the executors --------------------------------------------------------------------------------------------

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, path = self._system(partition.uri)
        n, left, held = partition.first - 1, partition.end - partition.start, b""
        with system.open_input_file(path) as f:
            f.seek(partition.start)
            while left and (data := f.read(min(left, self.CHUNK))):
                left -= len(data)
                *lines, held = (held + data).split(b"\n")
                for line in lines:
                    if line.strip():
                        n += 1
                        yield partition.file, n, *outcome_of(line)
        if left or held:
            raise ValueError(f"{partition.file} has changed while it was read")
        if n != partition.first - 1 + partition.records:
            raise ValueError(f"{partition.file} has changed while it was read")
