"""A Python data source that publishes rows as text documents, all of them or none.

Tasks write files of their own attempt; nothing refers to them yet. When all tasks are done, commit() writes the manifest
that names the files of the successful attempts, in one move, and removes what it does not name: files of failed
attempts and of earlier versions. A failed job removes its files and leaves the manifest, and so the last good version,
as it was; what its tasks still write while they are stopped goes with the next commit. Readers follow the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class Documents(DataSource):
    """df.write.format("documents") with path, and head, join, tail (texts around and between the rows' `body`), most (rows
    of a document) and suffix. Writing again replaces what is published. A null body is no row.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return DocumentWriter(o["path"].rstrip("/"), o.get("head", ""), o.get("join", "\n"), o.get("tail", ""), int(o.get("most", "50000")), o.get("suffix", "txt"), schema.fieldNames().index("body"))


@dataclass
class Written(WriterCommitMessage):
    files: list  # (name, rows)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, join: str, tail: str, most: int, suffix: str, column: int):
        self.path, self.head, self.join, self.tail, self.most, self.suffix, self.column = path, head, join, tail, most, suffix, column
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        system, top = _system(self.path)
        system.create_dir(f"{top}/files", recursive=True)
        made, stream, rows = [], None, 0
        prefix = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"

        def close() -> None:
            stream.write(self.tail.encode())
            stream.close()
            made[-1] = (made[-1][0], rows)

        for row in iterator:
            body = row[self.column]
            if body is None:
                continue
            if stream is not None and rows == self.most:
                close()
                stream = None
            if stream is None:
                made.append((f"{prefix}-{len(made):04d}.{self.suffix}", 0))
                stream, rows = system.open_output_stream(f"{top}/files/{made[-1][0]}"), 0
                stream.write(self.head.encode())
            stream.write((self.join if rows else "").encode() + body.encode())
            rows += 1
        if stream is not None:
            close()
        return Written(made)

    def commit(self, messages: list) -> None:
        named = sorted(f for m in messages if m is not None for f in m.files)
        system, top = _system(self.path)
        system.create_dir(f"{top}/files", recursive=True)
        body = {"files": [{"file": n, "rows": r} for n, r in named], "rows": sum(r for _, r in named)}
        with system.open_output_stream(f"{top}/manifest.json.{self.job}") as f:
            f.write(json.dumps(body).encode())
        system.move(f"{top}/manifest.json.{self.job}", f"{top}/manifest.json")
        self._remove(lambda name: name not in {n for n, _ in named})

    def abort(self, messages: list) -> None:
        self._remove(lambda name: name.startswith(self.job))

    def _remove(self, unwanted) -> None:
        from pyarrow import fs

        system, top = _system(self.path)
        for f in system.get_file_info(fs.FileSelector(f"{top}/files", allow_not_found=True)):
            if f.is_file and unwanted(f.base_name):
                system.delete_file(f.path)


def publish(rows: DataFrame, path: str, **options) -> None:
    """Publish the column body of rows under path; see Documents for the options."""
    rows.sparkSession.dataSource.register(Documents)
    rows.select("body").write.format("documents").option("path", path).options(**{k: str(v) for k, v in options.items()}).mode("append").save()


def manifest(path: str) -> dict:
    """What is published under path: files (file, rows) and rows; nothing where no version is."""
    system, top = _system(path.rstrip("/"))
    if not system.get_file_info(f"{top}/manifest.json").is_file:
        return {"files": [], "rows": 0}
    with system.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def published(spark: SparkSession, path: str) -> DataFrame:
    """file and text of the documents of the published version."""
    files = [f"{path.rstrip('/')}/files/{f['file']}" for f in manifest(path)["files"]]
    if not files:
        return spark.createDataFrame([], "file string, text string")
    return spark.read.text(files, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"), F.col("value").alias("text"))
