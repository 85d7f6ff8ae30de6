"""Tree objects of snapshots, and trees as a walk prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import tree

#: Modes of a directory and of a plain file.
DIR_MODE, FILE_MODE = 0o040000, 0o100644


def snapshot_trees(entries: DataFrame, objects: DataFrame, snapshots: DataFrame, *, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(directories, roots) of the trees over each snapshot's own present files.

    directories: (snapshot_id, path, digest) of all directories but the roots, to be stored as objects with mode DIR_MODE.
    roots: (snapshot_id, root) of every snapshot; null where it has no present file, as one of deletions only.
    ``objects`` has digests as binaries.
    """
    files = entries.where("status = 1").join(objects.select("object_id", "digest"), "object_id").select(F.col("snapshot_id").alias("tree"), "path", "digest")
    nodes = tree.nodes(files, depth=depth).where("kind = 'D'")
    directories = nodes.where("path <> ''").select(F.col("tree").alias("snapshot_id"), "path", "digest")
    roots = nodes.where("path = ''").select(F.col("tree").alias("snapshot_id"), F.col("digest").alias("root"))
    return directories, snapshots.select("snapshot_id").join(roots, "snapshot_id", "left")


def checked(files: DataFrame, width: int) -> DataFrame:
    """``files`` (digest binary, others); a digest of another length than ``width`` bytes is an error when it is read."""
    wrong = F.octet_length("digest") != width
    return files.withColumn("digest", F.when(wrong, F.raise_error(F.concat(F.lit(f"a digest must have {width} bytes: "), "path")).cast("binary")).otherwise(F.col("digest")))


def listing(nodes: DataFrame, *, blob_only: bool = False, max_depth: int | None = None, summarize: bool = False, show_root: bool = False, as_json: bool = False) -> DataFrame:
    """(path, line) of a tree's nodes (path, kind, digest, mode) as a walk prints them: octal mode, type, digest, path; or as JSON.

    blob_only: no trees; max_depth: names in a path at most; summarize: the root alone; show_root: the root (``.``) too.
    """
    rows = nodes.where("kind = 'F'") if blob_only else nodes
    root = F.col("path") == ""
    if summarize:
        rows = rows.where(root)
    else:
        rows = rows if show_root else rows.where(~root)
        rows = rows if max_depth is None else rows.where(root | (paths.depth(F.col("path")) < max_depth))
    mode = F.lpad("mode", 6, "0") if "mode" in nodes.columns else F.when(F.col("kind") == "D", f"{DIR_MODE:06o}").otherwise(f"{FILE_MODE:06o}")
    kind = F.when(F.col("kind") == "D", "tree").otherwise("blob")
    shown = F.when(root, ".").otherwise(F.col("path"))
    if as_json:
        line = F.to_json(F.struct(mode.alias("mode"), kind.alias("type"), F.lower(F.hex("digest")).alias("digest"), shown.alias("path")))
    else:
        line = F.concat(mode, F.lit(" "), kind, F.lit(" "), F.lower(F.hex("digest")), F.lit("\t"), shown)
    return rows.select("path", line.alias("line"))


def walk_order(path: str = "path") -> Column:
    """Sorts nodes as a walk that reports each directory after what is in it: at each level by name, a directory's
    own row behind its children's."""
    # After its children: the path's separators become the lowest character, the end of a directory the highest.
    inside = F.replace(F.col(path), F.lit("/"), F.lit("\u0001"))
    return F.when(F.col(path) == "", F.lit("\U0010ffff")).when(F.col("kind") == "D", F.concat(inside, F.lit("\u0001\U0010ffff"))).otherwise(inside)
