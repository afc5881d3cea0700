"""A Python data source for record feeds that come in pages of JSON, one file a page.

Every page is read by a task of its own and has an outcome: ok, temporary (the page says that it is not ready), denied
(it says that access is refused) or invalid (no JSON, or no list of records). A page that is not ok gives one row without
a record, so that nothing is lost silently.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTS = ("records", "data", "items", "results")


class PagedJson(DataSource):
    """spark.read.format("paged_json").option("path", <folder>): page, outcome, record (JSON text), next."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page string, outcome string, record string, next string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["path"])


class Page(InputPartition):
    def __init__(self, uri: str):
        self.value = uri


def outcome_of(body: str) -> tuple[str, list, str | None]:
    """(outcome, records, next page) of one page."""
    try:
        found = json.loads(body)
    except ValueError:
        return "invalid", [], None
    if isinstance(found, list):
        return "ok", found, None
    if not isinstance(found, dict):
        return "invalid", [], None
    if found.get("error"):
        return ("denied" if found.get("code") in (401, 403) else "temporary"), [], None
    records = next((found[k] for k in LISTS if isinstance(found.get(k), list)), None)
    following = found.get("next")
    return ("invalid", [], None) if records is None else ("ok", records, None if following is None else str(following))


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(fs.FileSelector(path))
        return [Page(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.value) as f:
            outcome, records, following = outcome_of(f.read().decode("utf-8", "replace"))
        name = partition.value.rpartition("/")[2]
        if outcome != "ok":
            yield name, outcome, None, None
        for record in records:
            yield name, outcome, json.dumps(record, sort_keys=True), following
