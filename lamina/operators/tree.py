"""Merkle trees over paths: digests of directories, bottom-up, one level per step.

A directory's digest is that of its children's encodings in order, so the children of one directory meet
in one group by definition; levels are few (the depth of the paths), and only digests move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..scratch import materialize

NUL = b"\x00"
#: How git writes the modes of a folder, a plain file, an executable and a link.
FOLDER, PLAIN, EXECUTABLE, LINK = "40000", "100644", "100755", "120000"


def git_mode(mode: Column) -> Column:
    """Of a file's mode bits: a link, an executable if anyone may execute it, or a plain file."""
    link = mode.bitwiseAND(F.lit(0o170000)) == 0o120000
    return F.when(link, LINK).when(mode.bitwiseAND(F.lit(0o111)) != 0, EXECUTABLE).otherwise(PLAIN)


def _join(parts: Column) -> Column:
    """The binaries of an array as one; through hex, since a fold would copy all before it for each."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def native_entry(kind: Column, name: Column, digest: Column) -> Column:
    """kind (D or F), name, NUL, digest."""
    return F.concat(F.encode(kind, "utf-8"), F.encode(name, "utf-8"), F.lit(NUL), digest)


def native_digest() -> Column:
    """Of a group of children: SHA-256 of their encodings in byte order, so directories come first."""
    return hashing.sha256(_join(F.array_sort(F.collect_list(native_entry(F.col("kind"), F.col("name"), F.col("digest"))))))


def git_digest() -> Column:
    """Of a group of children: a tree in git's object format, directories ordered as if their names ended in a slash."""
    dir_, mode = F.col("kind") == "D", F.col("mode")
    order = F.encode(F.when(dir_, F.concat("name", F.lit("/"))).otherwise(F.col("name")), "utf-8")
    entry = F.concat(F.encode(F.concat(mode, F.lit(" "), F.col("name")), "utf-8"), F.lit(NUL), F.col("digest"))
    body = _join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))), lambda x: x["e"]))
    header = F.encode(F.concat(F.lit("tree "), F.octet_length(body).cast("string")), "utf-8")
    return hashing.sha1(F.concat(header, F.lit(NUL), body))


def fast_digest() -> Column:
    """Of a group of children: the 64-bit xxHash of their native encodings, as eight bytes, the lowest first."""
    hexed = F.lpad(F.hex(hashing.xxh64(_join(F.array_sort(F.collect_list(native_entry(F.col("kind"), F.col("name"), F.col("digest"))))))), 16, "0")
    return F.unhex(F.concat(*(F.substring(hexed, at, 2) for at in range(15, 0, -2))))


def max_depth(files: DataFrame) -> int:
    return files.agg(F.max(paths.depth(F.col("path")))).first()[0] or 0


def nodes(files: DataFrame, *, depth: int | None = None, digest: Callable[[], Column] = native_digest) -> DataFrame:
    """(tree, path, kind, mode, digest, n_files, n_dirs) of every file and directory of the trees in ``files`` (tree, path, digest, and
    mode as git writes it; PLAIN without that column).

    The root is the path ''. ``depth``: that of the deepest path, looked up if not given. Trees without files have no rows.
    """
    deepest = max_depth(files) if depth is None else depth
    cols = ["tree", "path", "kind", "mode", "digest", "n_files", "n_dirs"]
    mode = F.col("mode") if "mode" in files.columns else F.lit(PLAIN)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    leaves = files.select("tree", "path", F.lit("F").alias("kind"), mode.alias("mode"), "digest", one.alias("n_files"), none.alias("n_dirs"), paths.depth(F.col("path")).alias("d"))
    levels, dirs = [leaves.select(cols)], None
    for d in range(deepest, -1, -1):
        here = leaves.where(F.col("d") == d).select(cols)
        here = here if dirs is None else here.unionByName(dirs)
        grouped = here.withColumn("name", paths.basename(F.col("path"))).groupBy("tree", paths.parent(F.col("path")).alias("parent"))
        dirs = grouped.agg(digest().alias("digest"), F.sum("n_files").alias("n_files"), (F.sum("n_dirs") + F.count_if(F.col("kind") == "D")).alias("n_dirs"))
        dirs = dirs.select("tree", F.col("parent").alias("path"), F.lit("D").alias("kind"), F.lit(FOLDER).alias("mode"), "digest", "n_files", "n_dirs")
        levels.append(dirs)
    return reduce(DataFrame.unionByName, levels)


def roots(files: DataFrame, *, depth: int | None = None, digest: Callable[[], Column] = native_digest) -> DataFrame:
    """(tree, digest, n_files, n_dirs) of the roots."""
    return nodes(files, depth=depth, digest=digest).where("path = ''").select("tree", "digest", "n_files", "n_dirs")


def diff(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """(path, kind, change) of nodes that differ between two trees (path, kind, digest), from the root down.

    A level only joins the children of directories that differ, so equal subtrees are never looked into. Both
    trees and each level are written once: a plan that held all levels would double with each.
    """
    part = lambda t, k: t.select("path", paths.parent(F.col("path")).alias("parent"), paths.depth(F.col("path")).alias("d"), F.col("kind").alias(f"kind_{k}"), F.col("digest").alias(f"digest_{k}"))
    a, b = materialize(part(left, "a"), "left"), materialize(part(right, "b"), "right")

    def level(x: DataFrame, y: DataFrame) -> DataFrame:
        rows = x.drop("parent", "d").join(y.drop("parent", "d"), "path", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        change = F.when(F.col("digest_a").isNull(), "A").when(F.col("digest_b").isNull(), "D").otherwise("M")
        return rows.select("path", F.coalesce("kind_b", "kind_a").alias("kind"), change.alias("change"))

    found = [materialize(level(a.where("path = ''"), b.where("path = ''")), "level")]
    for d in range(depth + 1):
        open_dirs = found[-1].where("kind = 'D'").select(F.col("path").alias("parent"))
        below = lambda t, d=d, open_dirs=open_dirs: t.where((F.col("d") == d) & (F.col("path") != "")).join(open_dirs, "parent", "left_semi")
        found.append(materialize(level(below(a), below(b)), "level"))
    return reduce(DataFrame.unionByName, found)
