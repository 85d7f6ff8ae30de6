"""A file tree as a table: a Python data source with nanosecond times and modes, and Spark's own for contents."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import hashing
from . import ignore

ALWAYS_SKIPPED = ".git"
#: What becomes of symbolic links: left out, shown as links, or followed.
SKIP, SHOW, FOLLOW = "skip", "show", "follow"


class _Slice(InputPartition):
    def __init__(self, top: str, deep: bool):
        self.top, self.deep = top, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"  # the keys come in lower case
        on = lambda name, default: options.get(name, default) == "true"
        self.skip_git, self.hidden, self.empty, self.errors = on("skipgit", "true"), on("hidden", "true"), on("emptyfolders", "false"), on("errors", "false")
        self.links, self.parents = options.get("links", SKIP), on("parents", "true")
        everywhere = ignore.Rules.read(options.get("globalfile") or ignore.global_file()) if on("gitfiles", "true") else None
        self.ignore = ignore.Ignore(on("ignorefiles", "true"), on("gitfiles", "true"), on("requiregit", "true"), everywhere)

    def partitions(self) -> list[InputPartition]:
        """The files at the top, and each directory there with all below it."""
        dirs = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=self.links == FOLLOW)]
        return [_Slice("", False), *(_Slice(d, True) for d in sorted(dirs))]

    def _failed(self, path: str, why: object) -> Iterator[tuple]:
        if self.errors:
            yield path, None, None, None, str(why)

    def _row(self, path: str, s: os.stat_result) -> tuple:
        return (path, s.st_size, s.st_mtime_ns, s.st_mode, None)[: 5 if self.errors else 4]

    def _folder(self, folder: str, levels: list[ignore.Level], above: list[tuple[int, int]], only: str | None, deep: bool) -> Iterator[tuple]:
        """Rows of a folder: its entries by name, each folder's own where it stands. only: a name that alone is looked at."""
        here = os.path.relpath(folder, self.root)
        path = lambda name: name if here == "." else f"{here}/{name}"
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            yield from self._failed("" if here == "." else here, e)
            return
        levels, n = [*levels, self.ignore.level(folder)], 0
        for name in names if only is None else [only]:
            if self.skip_git and name == ALWAYS_SKIPPED or not self.hidden and name.startswith("."):
                continue
            full = os.path.join(folder, name)
            try:
                s = os.stat(full) if self.links == FOLLOW else os.lstat(full)
            except OSError as e:
                yield from self._failed(path(name), e)
                continue
            is_folder = stat.S_ISDIR(s.st_mode)
            if self.ignore.verdict(full, is_folder, levels):
                continue
            if not is_folder:
                if only is None and (stat.S_ISREG(s.st_mode) or stat.S_ISLNK(s.st_mode) and self.links == SHOW):
                    n += 1
                    yield self._row(path(name), s)
            elif (s.st_dev, s.st_ino) in above:
                yield from self._failed(path(name), "the folder holds itself")
            elif deep:
                n += 1
                yield from self._folder(full, levels, [*above, (s.st_dev, s.st_ino)], None, True)
        if self.empty and deep and only is None and not n:
            yield self._row("" if here == "." else here, os.stat(folder))

    def read(self, partition: _Slice) -> Iterator[tuple]:
        above = self.ignore.levels_above(self.root) if self.parents else []
        s = os.stat(self.root)
        yield from self._folder(self.root, above, [(s.st_dev, s.st_ino)], partition.top or None, partition.deep)


class FileTreeSource(DataSource):
    """Options: path, skipGit, ignoreFiles, gitFiles, requireGit, globalFile, parents, hidden, links (skip, show, follow), emptyFolders,
    errors. One partition for each directory at the top."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, size bigint, mtime_ns bigint, mode int" + (", error string" if self.options.get("errors") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def file_tree(spark: SparkSession, root: str, *, skip_git: bool = True, ignore_files: bool = True, git_files: bool | None = None, require_git: bool = True, global_file: str = "", parents: bool = True, hidden: bool = True, links: str = SKIP, empty_folders: bool = False, errors: bool = False) -> DataFrame:
    """(path, size, mtime_ns, mode) of the files below a folder that every executor sees; with ``errors`` also (error), and a row
    with a message and nulls for each entry that can't be read, such as a folder that links make hold itself.

    ignore_files: .ignore files hold; git_files (the same if None): what git ignores, in a work tree of git unless
    require_git is off; parents: ignore files above the folder too. links: skip leaves symbolic links out, show gives rows with their own
    mode, follow takes what they name. empty_folders: folders in which nothing is found are rows, with the mode of a folder.
    """
    spark.dataSource.register(FileTreeSource)
    flags = {"skipGit": skip_git, "ignoreFiles": ignore_files, "gitFiles": ignore_files if git_files is None else git_files, "requireGit": require_git, "parents": parents, "hidden": hidden, "emptyFolders": empty_folders, "errors": errors}
    source = spark.read.format("filetree").option("path", root).option("links", links).option("globalFile", global_file)
    return source.options(**{k: str(v).lower() for k, v in flags.items()}).load()


def tree_walk(spark: SparkSession, root: str, *, no_ignore: bool = False, follow_symlinks: bool = False, include_empty_dirs: bool = False) -> DataFrame:
    """(path, size, mtime_ns, mode) of what a tree digest covers: hidden names are left out, links are their own files unless followed."""
    return file_tree(spark, root, ignore_files=not no_ignore, hidden=False, links=FOLLOW if follow_symlinks else SHOW, empty_folders=include_empty_dirs)


def scan_errors(walked: DataFrame) -> DataFrame:
    """(files, errors): how many rows of a walk with ``errors`` are files, and how many could not be read."""
    return walked.agg(F.count_if(F.col("error").isNull()).alias("files"), F.count("error").alias("errors"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, digest, fast_digest) of contents in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    return files.select(path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), hashing.xxh64(F.col("content")).alias("fast_digest"))


def changed_only(walked: DataFrame, cache: DataFrame) -> DataFrame:
    """Walked files whose size or time differ from the cache: only these need their contents read."""
    same = cache.where("status = 1").select("path", "size", "mtime_ns")
    return walked.join(same, ["path", "size", "mtime_ns"], "left_anti")
