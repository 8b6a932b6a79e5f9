"""A source of the files below a folder, hidden ones included.

Spark's own binary source leaves out names that begin with a dot or an
underscore; this data source doesn't.  The driver lists paths and sizes and
deals them to partitions of bounded size; tasks read.  The folder is a path or
a URI of any store that Arrow can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.functions.globs import selected
from kindred.shared import filesystem
from kindred.sources.languages import extensions_for, language_of

SCHEMA = "file_path string, absolute_path string, size long, mtime double, raw binary"


class _Files(InputPartition):
    def __init__(self, value: list[str]):
        self.value = value


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.root = filesystem(options["path"])
        self.most = int(options.get("partitionBytes", 32 << 20))
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)

    def _listed(self) -> Iterator[tuple[str, int]]:
        """(path, size) of each file; links to folders of this machine aren't followed."""
        if isinstance(self.files, pafs.LocalFileSystem):
            for folder, _, names in os.walk(self.root):
                for path in (os.path.join(folder, name) for name in sorted(names)):
                    if os.path.isfile(path):
                        yield path, os.path.getsize(path)
        else:
            found = self.files.get_file_info(pafs.FileSelector(self.root, recursive=True))
            yield from sorted((x.path, x.size or 0) for x in found if x.type == pafs.FileType.File)

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path, n in self._listed():
            if self.extensions and os.path.splitext(path)[1].lower() not in self.extensions:
                continue
            held.append(path)
            size += n
            if size >= self.most:
                parts.append(_Files(held))
                held, size = [], 0
        return [*parts, _Files(held)] if held or not parts else parts

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.value:
            try:
                info = self.files.get_file_info(path)
                with self.files.open_input_file(path) as f:
                    raw = f.read()
            except OSError:
                continue  # a file that can't be read has no row
            yield os.path.relpath(path, self.root), path, len(raw), info.mtime_ns / 1e9 if info.mtime_ns is not None else None, raw


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, focus: list[str] | None = None, language: str | None = None, absolute_excludes: bool = True) -> DataFrame:
    """(file_path, language, content, size, mtime) of the source files below ``root``.

    Text is read as UTF-8, with bad bytes replaced and line ends as ``\\n``.
    Exclusions are held against the relative path and, with
    ``absolute_excludes``, the absolute one, so that a tree below a folder of
    an excluded name has no files.
    """
    wanted = extensions_for(language)
    spark.dataSource.register(TreeSource)
    if not wanted:
        return spark.createDataFrame([], "file_path string, language string, content string, size long, mtime double")
    rows = spark.read.format("source_tree").option("extensions", ",".join(sorted(wanted))).load(root)
    rows = rows.filter(selected(F.col("file_path"), F.col("absolute_path") if absolute_excludes else None, exclude, focus))
    content = F.regexp_replace(F.make_valid_utf8(F.col("raw").cast("string")), "\r\n?", "\n")
    return rows.select("file_path", (F.lit(language) if language else language_of(F.col("file_path"))).alias("language"), content.alias("content"), "size", "mtime")


