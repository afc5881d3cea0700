"""Whole files written by tasks to the shared folder: under a name of the attempt first, then renamed."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(uri: str, data: bytes) -> None:
    """Write a file atomically; a repeated attempt of a task replaces it with the same bytes."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
