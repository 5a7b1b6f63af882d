"""Folders of files as Spark data sources: transcripts to read, and documents to write, one file for each row.

``spark.dataSource.register(TranscriptFiles)``, then ``spark.read.format("transcripts").load(folder)`` gives a row for each
file: path, name, the header's columns, body, and ``error`` where a file could not be read as a transcript, so that bad files
are set aside and stop nothing. A task reads a group of files of about ``groupBytes``.

``rows.write.format("documents").save(folder)`` writes rows (name, document) as ``folder/name``. Tasks write below a staging
folder that no reader sees; only when all are done the job moves the files to their places, and a job that fails
takes the staging folder with it. The folder may be on any file system that Arrow opens by URI.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_HEADER_DATES = ((r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (2, 1, 0)), (r"(\d{4})-(\d{1,2})-(\d{1,2})", (0, 1, 2)), (r"(\d{1,2})/(\d{1,2})/(\d{4})", (2, 0, 1)))
#: A worker holds a group's texts, or a batch of rows to write, several times over.
GROUP_BYTES = 2 << 20
BATCH_BYTES = 2 << 20


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)


def header_fields(text: str) -> tuple[str | None, str | None, date | None, str, str | None]:
    """(title, guest, date, body, error) as ``functions.text.header`` and the admission's rules have them."""
    lines = text.split("\n")
    if not lines[0].startswith("Title:"):
        return None, None, None, text, "no header"
    rule = next((i for i, x in enumerate(lines) if re.fullmatch("─+", x.strip())), None)
    after = rule
    if rule is None:
        after = next((i for i in range(1, len(lines)) if not lines[i].strip() and lines[i - 1].startswith("Episode:")), None)
    said = {}
    for line in lines[:rule]:
        for label in ("Title:", "Guest:", "Date:"):
            if line.startswith(label):
                said[label] = line[len(label) :].strip()
    body = text if after is None else "\n".join(lines[after + 1 :]).strip()
    title, guest = said.get("Title:"), said.get("Guest:")
    error = "no title" if not title else "no guest" if not guest else None
    return title, guest, _date(said.get("Date:") or ""), body, error


def _date(text: str) -> date | None:
    for pattern, order in _HEADER_DATES:
        if m := re.fullmatch(pattern, text):
            try:
                return date(*(int(m[k + 1]) for k in order))
            except ValueError:
                continue
    return None


@dataclass
class FileGroup(InputPartition):
    paths: tuple[str, ...]


class TranscriptReader(DataSourceReader):
    def __init__(self, folder: str, group_bytes: int):
        self.folder, self.group_bytes = folder, group_bytes

    def partitions(self) -> list[FileGroup]:
        """Files in order of their paths, in groups of about ``group_bytes``."""
        files, root = opened(self.folder)
        infos = sorted((i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in i.path[len(root) :].split("/"))), key=lambda i: i.path)
        groups, held, size = [], [], 0
        for i in infos:
            if held and size + i.size > self.group_bytes:
                groups.append(FileGroup(tuple(held)))
                held, size = [], 0
            held.append(i.path)
            size += i.size
        return [*groups, FileGroup(tuple(held))]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        files, _ = opened(self.folder)
        for path in partition.paths:
            name = posixpath.basename(path)
            try:
                with files.open_input_stream(path) as f:
                    text = f.read().decode("utf-8").strip()
            except (OSError, UnicodeDecodeError) as e:
                yield path, name, None, None, None, None, f"not readable: {type(e).__name__}"
                continue
            title, guest, day, body, error = header_fields(text)
            yield path, name, title, guest, day, body, error if name.lower().endswith(".txt") else "not a text file"


class TranscriptFiles(DataSource):
    """Options: ``path``, ``groupBytes``."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "path string, name string, title string, guest string, date date, body string, error string"

    def reader(self, schema: StructType) -> TranscriptReader:
        return TranscriptReader(self.options["path"], int(self.options.get("groupbytes", self.options.get("groupBytes", GROUP_BYTES))))


@dataclass
class Staged(WriterCommitMessage):
    names: tuple[str, ...]
    folder: str


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{opened(self.folder)[1]}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        """One attempt of a task writes to a folder of its own, so attempts that died leave nothing that is moved."""
        files, _ = opened(self.folder)
        mine = f"{self._staging()}/{uuid.uuid4().hex}"
        files.create_dir(mine, recursive=True)
        names = []
        for row in rows:
            if not row["name"] or "/" in row["name"] or row["name"].startswith((".", "_")):
                raise ValueError(f"not the name of a file: {row['name']!r}")
            with files.open_output_stream(f"{mine}/{row['name']}") as f:
                f.write((row["document"] or "").encode())
            names.append(row["name"])
        return Staged(tuple(names), mine)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.folder)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        if self.overwrite:
            keep = set(names)
            for i in files.get_file_info(fs.FileSelector(root)):
                if i.type == fs.FileType.File and i.base_name not in keep:
                    files.delete_file(i.path)
        for m in done:
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, _ = opened(self.folder)
        if files.get_file_info(self._staging()).type == fs.FileType.Directory:
            files.delete_dir(self._staging())


class DocumentFiles(DataSource):
    """Rows (name, document) as files; mode append keeps other files, overwrite removes them. Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def slug(title: str | None) -> str:
    """Lower case, with single dashes for all but letters and digits; at most sixty characters."""
    return re.sub(r"[^a-z0-9]+", "-", (title or "").lower()).strip("-")[:60].strip("-") or "untitled"


def register(spark) -> None:
    """Makes both formats known to the session, which keeps the bound on batches: rows reach a worker by whole batches."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(name).rstrip("b")
    if have.isdigit() and int(have) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    spark.dataSource.register(TranscriptFiles)
    spark.dataSource.register(DocumentFiles)


