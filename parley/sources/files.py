"""Histories as a Spark data source: `spark.read.format("history")`, `readStream` and `write`, a file a conversation.

    spark.dataSource.register(HistorySource)
    spark.read.format("history").load(folder)

Reading: every file under the folder named by its conversation's number (`12.json`, or anything under a folder `conv_id=12`) is one document, decoded
whole in the task that reads it: a blank or undecodable one is an empty history, or with the option `strict` an error. Files are dealt to
parts of about `split_bytes`. A stream reads the files that have come or changed since the last batch, by their time of change.

Writing: rows come sorted by conversation and place, see write_histories(). A task writes a document as its rows come, so it holds a batch of rows,
never a document. Each write has a folder of its own; what the files are is told by one small file, `_current`, that names the folders that count. It is
put in place at commit, by a rename, so that readers see all of a write or nothing, and after an aborted one what was there before.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from parley.schema import MESSAGE_COLUMNS, VERSION

COLUMNS = "conv_id bigint, pos bigint, id string, author string, text string, is_favorite boolean"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("id", pa.string()), ("author", pa.string()), ("text", pa.string()), ("is_favorite", pa.bool_())])
#: the file that names the folders of a table written here, and the start of these folders' names
CURRENT, GENERATION = "_current", "_write-"
_CONVERSATION = re.compile(r"(?:^|/)(?:conv_id=(-?\d+)/[^/]*|(-?\d+)\.json)$")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a path of this machine, or of an address that pyarrow knows (file, hdfs, s3, gs, abfs)."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9]*://", path) else (fs.LocalFileSystem(), re.sub("^file:/*", "/", path))


def conversation_of(path: str) -> int | None:
    found = _CONVERSATION.search(path)
    return int(found[1] or found[2]) if found and not basename(path).startswith(("_", ".")) else None


def current(system: fs.FileSystem, root: str) -> list[str]:
    """The folders whose files count: those that the last commit named, or the folder itself where nothing was written here."""
    if system.get_file_info(f"{root}/{CURRENT}").type == fs.FileType.NotFound:
        return [root]
    with system.open_input_stream(f"{root}/{CURRENT}") as f:
        return [f"{root}/{name}" for name in json.loads(f.read())]


def listed(path: str) -> list[tuple[int, str, int]]:
    """Time of change (ns), path and size of each document, in this order."""
    system, root = file_system(path)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = []
    for folder in current(system, root):
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            below = info.path[len(folder) :]
            if info.type == fs.FileType.File and conversation_of(info.path) is not None and GENERATION not in below:
                found.append((info.mtime_ns or 0, info.path, info.size))
    return sorted(found)


def messages_of(document: bytes) -> list[dict] | None:
    """The messages of a document, each with all four fields of its own type; None where it isn't a history."""
    try:
        parsed = json.loads(document.decode())
    except (UnicodeDecodeError, ValueError, RecursionError):
        return None
    if not isinstance(parsed, dict) or type(parsed.get("version")) is not int or not isinstance(parsed.get("messages"), list):
        return None
    whole = lambda m: isinstance(m, dict) and all(isinstance(m.get(k), str) for k in ("id", "author", "text")) and isinstance(m.get("isFavorite"), bool)
    return parsed["messages"] if all(map(whole, parsed["messages"])) else None


@dataclass
class Files(InputPartition):
    paths: list[str]


def dealt(files: list[tuple[int, str, int]], split_bytes: int) -> list[Files]:
    """Files in parts of about so many bytes; one larger than that is a part by itself."""
    parts: list[Files] = []
    size = split_bytes
    for _, path, own in sorted(files, key=lambda f: f[1]):
        if size + own > split_bytes and (size or not parts):
            parts.append(Files([]))
            size = 0
        parts[-1].paths.append(path)
        size += own
    return parts


class _Reading:
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path in partition.paths:
            conv_id = conversation_of(path)
            with system.open_input_stream(path) as f:
                document = f.read()
            messages = messages_of(document)
            if messages is None and self.strict:
                raise ValueError(f"not a history: conversation {conv_id}")
            for at in range(0, len(messages or []), 10_000):
                some = messages[at : at + 10_000]
                text = lambda k, rows=some: pa.array([m[k].encode("utf-8", "replace").decode() for m in rows], pa.string())
                author = pa.array(["ASSISTANT" if m["author"] == "ASSISTANT" else "USER" for m in some])
                columns = [pa.array([conv_id] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), text("id"), author, text("text"), pa.array([m["isFavorite"] for m in some])]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


class HistoryReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        files = listed(self.path)
        if not files and self.strict:
            raise FileNotFoundError(f"no history in {self.path}")
        return dealt(files, self.split_bytes) or [Files([])]


class HistoryStream(_Reading, DataSourceStreamReader):
    """Offsets: the newest time of change that was read, and the files of just that time."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "paths": []}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path)
        return {"at": files[-1][0], "paths": [p for t, p, _ in files if t == files[-1][0]]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after = lambda t, p: t > start["at"] or (t == start["at"] and p not in start["paths"])
        until = lambda t, p: t < end["at"] or (t == end["at"] and p in end["paths"])
        return dealt([f for f in listed(self.path) if after(f[0], f[1]) and until(f[0], f[1])], self.split_bytes) or [Files([])]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class HistoryWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.generation = f"{GENERATION}{uuid.uuid4().hex}"
        missing = set(MESSAGE_COLUMNS) - set(names)
        if missing:
            raise ValueError(f"a history needs the columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        folder = f"{self.generation}/{uuid.uuid4().hex}"  # of this attempt alone
        now, out, files = None, None, 0
        try:
            for batch in iterator:
                for m in batch.to_pylist():
                    if m["conv_id"] != now or out is None:
                        if out:
                            out.write(b" ]\n}")
                            out.close()
                        else:
                            system.create_dir(f"{root}/{folder}", recursive=True)
                        now, files = m["conv_id"], files + 1
                        if system.get_file_info(f"{root}/{folder}/{now}.json").type != fs.FileType.NotFound:
                            raise ValueError(f"rows of conversation {now} don't come together: see write_histories()")
                        out = system.open_output_stream(f"{root}/{folder}/{now}.json")
                        out.write(f'{{\n  "version" : {VERSION},\n  "messages" : [ '.encode())
                        join = ""
                    said = [f'"{k}" : {json.dumps(m[c], ensure_ascii=False)}' for k, c in (("id", "id"), ("author", "author"), ("text", "text"), ("isFavorite", "is_favorite"))]
                    out.write((join + "{\n    " + ",\n    ".join(said) + "\n  }").encode())
                    join = ", "
            if out:
                out.write(b" ]\n}")
        finally:
            if out:
                out.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the folders of the tasks' attempts that succeeded, then deletes what is no longer named."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old = [] if self.overwrite else [f[len(root) + 1 :] for f in current(system, root) if f != root]
        with system.open_output_stream(f"{root}/{CURRENT}.new") as f:
            f.write(json.dumps(old + [m.folder for m in messages if m and m.files]).encode())
        system.move(f"{root}/{CURRENT}.new", f"{root}/{CURRENT}")
        kept = {f.split("/")[0] for f in old} | {self.generation}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = basename(info.path)
            if self.overwrite and name.startswith(GENERATION) and name not in kept:
                system.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.generation}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.generation}")


class HistorySource(DataSource):
    """Options: path (or the argument of load and save), strict, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> HistoryStream:  # noqa: N802
        return HistoryStream(self.options)

    def writer(self, schema, overwrite: bool) -> HistoryWriter:
        return HistoryWriter(self.options["path"], schema.fieldNames(), overwrite)


def write_histories(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes each conversation's document as path/.../<conv_id>.json. A document is one file, so one task's work, row by row;
    conversations are dealt to tasks by their number. mode: overwrite, or append (of conversations that aren't there yet)."""
    messages.sparkSession.dataSource.register(HistorySource)
    rows = messages.where("conv_id is not null").select(MESSAGE_COLUMNS).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    rows.write.format("history").mode(mode).save(path)
