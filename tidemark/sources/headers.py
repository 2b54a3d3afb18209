"""First lines of files as a Spark data source that reads no more of a file than it must.

A partition is a few files; of each the first bytes are read, and more only until
a line is whole.  Files are opened through Arrow's file systems, so any store
that these know will do; ``first_lines`` says whether a folder is in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once; the most that a line may have; files of a task.
BYTES, MOST, FILES = 4096, 1 << 20, 32
SCHEMA = "path string, size long, bytes_read long, header string"


def _store(folder: str):
    """Arrow's file system and its name for a folder; what it does not know is a ValueError."""
    from pyarrow import fs

    found = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return found[0], found[1].rstrip("/")


def _hidden(relative: str) -> bool:
    """Spark's readers pass over these too."""
    return any(part[0] in "._" for part in PurePosixPath(relative).parts)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class Reader(DataSourceReader):
    """Options: path, suffix, bytes."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.bytes = options["path"], options.get("suffix", ".csv"), int(options.get("bytes", BYTES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.folder)
        listed = sorted((f.path, f.path[len(root) :].lstrip("/"), f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        found = [(path, f"{self.folder.rstrip('/')}/{inside}", size) for path, inside, size in listed if path.endswith(self.suffix) and not _hidden(inside)]
        return [Files(list(few)) for few in batched(found, FILES)] or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        for path, name, size in part.files:
            with store.open_input_stream(path, buffer_size=None) as f:
                held = b""
                while b"\n" not in held and b"\r" not in held and len(held) < MOST and (more := f.read(self.bytes)):
                    held += more
            line = held.replace(b"\r", b"\n").split(b"\n", 1)[0]
            yield name, size, len(held), line.decode("utf-8", "replace").removeprefix("﻿")


class HeaderSource(DataSource):
    """``spark.read.format("file_headers").load(folder)``: path, size, bytes_read and header of every file below."""

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def _known(spark: SparkSession, folder: str) -> bool:
    """Whether Arrow means the same folder as Spark, and has it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:") and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return False
    try:
        store, root = _store(folder)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (ValueError, OSError, NotImplementedError):
        return False


def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """path and header of every CSV file below ``folder``; in a store that only Spark reaches, from the first blocks that its text reader gives."""
    if _known(spark, folder):
        spark.dataSource.register(HeaderSource)
        return spark.read.format("file_headers").load(folder).select("path", "header")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
    lines = lines.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "place").alias("line"))
    return first.select("path", F.regexp_extract("line", r"^\x{FEFF}?([^\r\n]*)", 1).alias("header"))
