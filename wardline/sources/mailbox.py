"""A data source for folders of mail, .eml files and mbox files, in batches and as a stream; no network.

``spark.dataSource.register(MailSource)``, then ``spark.read.format("mail").load(folder)`` or ``spark.readStream``. Files are
listed and read by ``pyarrow.fs``, so a folder is a path or a URI (hdfs://, s3://) that driver and executors see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wardline.sources.messages import parse_raw

SCHEMA = "path string, position int, content binary"
ENDINGS = (".eml", ".mbox")
#: A line that begins a message of an mbox file stands at its start or after an empty line.
_FROM = re.compile(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n")


def split_mbox(content: bytes) -> list[bytes]:
    """Messages of an mbox file, without the lines that begin them; quoted From lines lose their sign."""
    cuts = [m.span() for m in _FROM.finditer(content)]
    ends = [a for a, _ in cuts[1:]] + [len(content)] * bool(cuts)
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", content[b:end]) for (_, b), end in zip(cuts, ends, strict=True)]


def _listed(folder: str) -> list[tuple[int, str]]:
    """(time of the last change in nanoseconds, path) of the mail files of a folder and those below it, in order."""
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.path.lower().endswith(ENDINGS) and not f.base_name.startswith((".", "_")))


class _File(InputPartition):
    def __init__(self, folder: str, path: str):
        super().__init__(path)
        self.folder = folder


def _read(part: _File) -> Iterator[tuple]:
    system = fs.FileSystem.from_uri(part.folder)[0] if "://" in part.folder else fs.LocalFileSystem()
    with system.open_input_stream(part.value) as f:
        content = f.read()
    messages = split_mbox(content) if part.value.lower().endswith(".mbox") else [content]
    for k, m in enumerate(messages):
        yield part.value, k, m


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(self.folder, p) for _, p in _listed(self.folder)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are the time and path of the last file seen: files must be moved in whole, not written to again."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [_File(self.folder, p) for t, p in _listed(self.folder) if low < (t, p) <= high]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class MailSource(DataSource):
    """(path, position, content): each message of the folder's files."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def read_mail(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Parsed messages of a folder (``sources.messages``), as a batch or a stream in which each comes once."""
    spark.dataSource.register(MailSource)
    rows = (spark.readStream if stream else spark.read).format("mail").load(folder)
    return parse_raw(rows.selectExpr("concat(path, '#', position) as path", "content"))
