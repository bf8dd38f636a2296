"""The ``arc`` and ``restored`` data sources: one file a row.

Read: ``spark.read.format("arc").load(dir)`` gives name, header fields, payload and error. Write: rows (name, archive)
become files that end in ``.abc``. ``restored`` only writes: rows (restored_name, restored) become files of just those
names; rows without content are left out; of rows with one name the last written stays. Paths are reached through Python on driver and executors, so the folder has to be mounted on all of
them; elsewhere read with ``binaryFile`` and parse with ``functions.header``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from bitloom.functions.constants import ALGORITHM_LABELS, FILE_TYPE_LABELS, HEADER_BYTES, MAGIC

SCHEMA = "name string, file_type int, algorithm_id int, padding_bits int, extension string, header_bytes int, archive binary, error string"


def fields(data: bytes) -> tuple:
    """Header fields of an archive, and the first error."""
    if len(data) < HEADER_BYTES:
        return None, None, None, None, None, "short"
    if data[:4] != MAGIC:
        return None, None, None, None, None, "magic"
    ft, algo, pad, n = data[4:HEADER_BYTES]
    ext = data[HEADER_BYTES : HEADER_BYTES + n]
    problem = "file_type" if ft not in FILE_TYPE_LABELS else "algorithm_id" if algo not in ALGORITHM_LABELS else "padding_bits" if pad > 7 else "extension_truncated" if len(ext) < n else "extension_ascii" if not ext.isascii() else None
    return (ft, algo, pad, ext.decode(), HEADER_BYTES + n, None) if problem is None else (None, None, None, None, None, problem)


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Files(InputPartition):
    paths: list[str]


class ArcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.per_task = _local(options["path"]), int(options.get("filesPerTask", "64"))

    def partitions(self) -> list[Files]:
        paths = sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if f.lower().endswith(".abc"))
        return [Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                data = f.read()
            *head, problem = fields(data)
            yield (os.path.basename(path), *head, data, problem)


@dataclass
class Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


class ArcWriter(DataSourceWriter):
    """Files get their names only when the whole job has succeeded."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool, name: str = "name", content: str = "archive", suffix: str = ".abc"):
        self.root, self.overwrite, self.suffix = _local(options["path"]), overwrite, suffix
        self.at = columns.index(name), columns.index(content)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.root, exist_ok=True)
        at, task, out = self.at, TaskContext.get().taskAttemptId(), []
        for k, row in enumerate(rows):
            if row[at[1]] is None and not self.suffix:
                continue
            name = os.path.basename(row[at[0]] or "") or "unnamed"
            final = os.path.join(self.root, name if name.lower().endswith(self.suffix) else f"{name}{self.suffix}")
            part = f"{final}.{task}-{k}.part"
            with open(part, "wb") as f:
                f.write(bytes(row[at[1]] or b""))
            out.append((part, final))
        return Written(out)

    def commit(self, messages) -> None:
        written = [p for m in messages if m for p in m.paths]
        if self.overwrite:
            new = {final for _, final in written}
            for f in os.listdir(self.root) if os.path.isdir(self.root) else []:
                if f.endswith(self.suffix) and os.path.join(self.root, f) not in new:
                    os.remove(os.path.join(self.root, f))
        for part, final in written:
            os.replace(part, final)

    def abort(self, messages) -> None:
        for m in messages:
            for part, _ in m.paths if m else []:
                if os.path.exists(part):
                    os.remove(part)


class Arc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArcReader:
        return ArcReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArcWriter:
        return ArcWriter(self.options, schema.fieldNames(), overwrite)


class Restored(DataSource):
    @classmethod
    def name(cls) -> str:
        return "restored"

    def schema(self) -> str:
        return "restored_name string, restored binary"

    def writer(self, schema, overwrite: bool) -> ArcWriter:
        return ArcWriter(self.options, schema.fieldNames(), overwrite, "restored_name", "restored", "")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arc)
    spark.dataSource.register(Restored)
