"""A paged source as a Spark data source, and the manners of a polite reader."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, path: str, offset: int, limit: int | None):
        self.path, self.offset, self.limit = path, offset, limit


def _files(uri: str) -> tuple[FileSystem, str]:
    """File system and path of a folder's address: any that pyarrow knows (hdfs, s3, file ...), or a mounted path."""
    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.options = [f.name for f in schema.fields], options

    def _rows(self, fs: FileSystem, path: str) -> list[dict]:
        try:
            with fs.open_input_stream(path) as f:
                return json.loads(f.read()).get(self.options.get("field", "items"), [])
        except (ValueError, AttributeError):
            return []  # an unreadable page is skipped, the rest kept

    def partitions(self) -> list[Page]:
        """One partition a stored page, or a stretch of ``limit`` rows of one, so pages are read side by side."""
        fs, root = _files(self.options["path"])
        paths = sorted(f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".json"))
        limit = int(self.options.get("limit", 0)) or None
        return [Page(p, at, limit) for p in paths for at in (range(0, max(1, len(self._rows(fs, p))), limit) if limit else (0,))]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = self._rows(_files(self.options["path"])[0], partition.path)
        for r in rows[partition.offset : partition.offset + partition.limit if partition.limit else None]:
            yield tuple(r.get(n) for n in self.names)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("pages").schema(...).load(folder)``.

    The folder must be in reach of all executors. Each file is one answer: an object with a list under ``field``;
    ``limit`` cuts long answers into pages of so many rows.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def retry_after(value: str | None, now: datetime | None = None) -> float:
    """Seconds a Retry-After header asks for: a number or a date; 0 for none or nonsense."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value))
    except ValueError:
        try:
            at = parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return 0.0
        return max(0.0, (at - (now or datetime.now(timezone.utc))).total_seconds())


class Gate:
    """Spacing between requests: doubled by a refusal, an eighth less after a success, within bounds."""

    def __init__(self, least: float = 1.0, most: float = 60.0):
        self.least, self.most, self.spacing = least, most, least

    def refused(self, asked: float = 0.0) -> float:
        self.spacing = min(self.most, max(self.spacing * 2, asked))
        return self.spacing

    def passed(self) -> float:
        self.spacing = max(self.least, self.spacing * 7 / 8)
        return self.spacing
