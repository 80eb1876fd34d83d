"""A corpus folder as a stream of changes.

A streaming source whose offsets are listings of the folder. A micro-batch is the difference of two
listings: files that came, files whose length or time is another, files that went. Each listing is kept
as a small table in the source's state folder until no batch can ask for it, so a replayed batch gets the
same rows. The listing is made on the driver, as Spark's own file source does; the difference is made by
tasks, each for its share of the paths.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from vellum import config
from vellum.sources.files import filesystem

NAME = "corpus_changes"
SCHEMA = "path STRING, length BIGINT, modified TIMESTAMP, listed TIMESTAMP, event STRING"
NEW, CHANGED, DELETED = "new", "changed", "deleted"
_LISTING = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])
NONE = ""


class CorpusChanges(DataSource):
    """Options: ``path`` (the folder), ``state`` (a folder of the stream's own that driver and executors share and that
    outlives the application), ``extensions`` (comma-separated) and ``parts`` (tasks of a batch)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options)


class Share(InputPartition):
    def __init__(self, start: str, end: str, part: int) -> None:
        self.start, self.end, self.part = start, end, part


def list_files(root: str, extensions) -> list[tuple[str, int, int]]:
    """``(path as Spark writes it, length, milliseconds of the last change)`` of the files that the batch listing finds:
    supported extensions, not empty, no name or folder below ``root`` that starts with a dot or an underscore."""
    from pyarrow import fs

    found, inner, prefix = filesystem(root)
    wanted, out = {e.lower().lstrip(".") for e in extensions}, []
    base = inner.rstrip("/")
    for info in found.get_file_info(fs.FileSelector(base, recursive=True)):
        names = info.path[len(base):].strip("/").split("/")
        if info.type != fs.FileType.File or not info.size or any(n[:1] in ("_", ".") for n in names):
            continue
        if "." in names[-1] and names[-1].rsplit(".", 1)[1].lower() in wanted:
            out.append((prefix + info.path, info.size, info.mtime_ns // 1_000_000))
    return sorted(out)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.state = options["path"], options["state"].rstrip("/")
        self.extensions = [e for e in options.get("extensions", ",".join(config.SUPPORTED_EXTENSIONS)).split(",") if e]
        self.parts = int(options.get("parts", "8"))

    def initialOffset(self) -> dict:
        return {"listing": NONE}

    def latestOffset(self) -> dict:
        """The name of the newest listing: one made now, unless the folder is as the last one says. A name
        begins with its time, so names sort by age."""
        now, files = time.time_ns(), list_files(self.root, self.extensions)
        shares: list[list] = [[] for _ in range(self.parts)]
        for f in files:
            shares[zlib.crc32(f[0].encode()) % self.parts].append(f)
        tables = [pa.table([pa.array(c, t.type) for c, t in zip(zip(*s) if s else ([], [], []), _LISTING, strict=True)], schema=_LISTING) for s in shares]
        known = self._names()
        if known and all(self._load(known[-1], k).equals(t) for k, t in enumerate(tables)):
            return {"listing": known[-1]}
        name = f"{now:020d}-{self.parts}-{uuid.uuid4().hex}"
        found, inner, _ = filesystem(self.state)
        found.create_dir(f"{inner}/{name}", recursive=True)
        for k, t in enumerate(tables):
            with found.open_output_stream(f"{inner}/{name}/{k}") as out:
                pq.write_table(t, out)
        with found.open_output_stream(f"{inner}/{name}/whole") as out:  # last: a listing without it was cut short
            out.write(b"")
        return {"listing": name}

    def _names(self) -> list[str]:
        from pyarrow import fs

        found, inner, _ = filesystem(self.state)
        infos = found.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        names = sorted(i.path.rsplit("/", 2)[1] for i in infos if i.base_name == "whole")
        return [n for n in names if n.split("-")[1] == str(self.parts)]

    def _load(self, name: str, part: int) -> pa.Table:
        found, inner, _ = filesystem(self.state)
        if name == NONE:
            return _LISTING.empty_table()
        with found.open_input_file(f"{inner}/{name}/{part}") as source:
            return pq.read_table(source, schema=_LISTING)

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(start["listing"], end["listing"], k) for k in range(self.parts)]

    def read(self, share: Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        at = lambda ms: datetime.fromtimestamp(ms // 1000, timezone.utc).replace(microsecond=ms % 1000 * 1000)
        listed = at(int(share.end.split("-")[0]) // 1_000_000)
        before = {r["path"]: r for r in self._load(share.start, share.part).to_pylist()}
        for r in self._load(share.end, share.part).to_pylist():
            old = before.pop(r["path"], None)
            if old != r:
                yield (r["path"], r["length"], at(r["modified"]), listed, NEW if old is None else CHANGED)
        for path, r in before.items():
            yield (path, r["length"], at(r["modified"]), listed, DELETED)

    def commit(self, end: dict) -> None:
        """Listings older than ``end`` are asked for no more."""
        found, inner, _ = filesystem(self.state)
        for name in self._names():
            if name < end["listing"]:
                found.delete_dir(f"{inner}/{name}")


def stream_changes(spark: SparkSession, root: str, state: str, extensions=config.SUPPORTED_EXTENSIONS, parts: int = 8):
    """The changes of the files below ``root``: ``(path, length, modified, listed, event)``."""
    spark.dataSource.register(CorpusChanges)
    return (spark.readStream.format(NAME).option("path", root).option("state", state)
            .option("extensions", ",".join(extensions)).option("parts", str(parts)).load())
