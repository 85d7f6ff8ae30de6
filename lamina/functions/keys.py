"""Keys of a table that holds every entity, key ranges in it, store settings, and names as pages show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import paths

#: The prefixes and the sort key that stored tables use.
REPO, SNAP, OBJ, STORE, MACHINE, CACHE, ENTRY, REPLICA, TYPE, META = "REPO#", "SNAP#", "OBJ#", "STORE#", "MACHINE#", "CACHE#", "ENTRY#", "REPLICA#", "_TYPE#", "#META"
SOURCE, PATH = "#SRC#", "#PATH#"


def named(prefix: str, name: Column) -> Column:
    """A prefix and a name or text: partition keys of repositories, objects, stores; sort keys of cached paths, entries, replicas."""
    return F.concat(F.lit(prefix), name.cast("string"))


def numbered(prefix: str, value: Column) -> Column:
    """A prefix and an id in 19 digits, so that keys sort as ids do."""
    return F.concat(F.lit(prefix), paths.padded_id(value))


def of_source(repository: Column, machine: Column) -> Column:
    """Index key of the snapshots that a machine has pushed to a repository; ``padded_id`` of the source's snapshot sorts them."""
    return F.concat(F.lit(REPO), repository, F.lit(SOURCE), machine.cast("string"))


def of_path(repository: Column, path: Column) -> Column:
    """Index key of a path's history; ``padded_id`` of the snapshot sorts it."""
    return F.concat(F.lit(REPO), repository, F.lit(PATH), path)


def get(table: DataFrame, pk: str, sk: str) -> DataFrame:
    return table.where((F.col("pk") == pk) & (F.col("sk") == sk))


def query(table: DataFrame, pk: str, *, begins_with: str = "", after: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a partition key whose sort key begins with a text, from beyond a key on, in their order.

    Both conditions are ranges on columns, which reach a Parquet scan; the last key of a page is the ``after`` of the next.
    """
    rows = table.where((F.col("pk") == pk) & F.col("sk").startswith(begins_with))
    rows = rows if after is None else rows.where(F.col("sk") > after)
    rows = rows.orderBy("sk")
    return rows if limit is None else rows.limit(limit)


CIPHERS = "encrypt boolean, key_file string, cipher string"


def store_config(config: Column) -> Column:
    """(encrypt, key_file, cipher) of a store's JSON settings; what can't be read counts as not set, encryption as off."""
    parsed = F.from_json(config, CIPHERS)
    return F.struct(F.coalesce(parsed["encrypt"], F.lit(False)).alias("encrypt"), parsed["key_file"].alias("key_file"), parsed["cipher"].alias("cipher"))


def scheme(url: Column) -> Column:
    """Lower-case scheme of a url; 'file' without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("file"))


def is_http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def display_name(path: Column, directory: Column) -> Column:
    """What follows the directory (with its slash) that a page shows; the whole path elsewhere."""
    inside = (directory != "") & F.startswith(path, directory)
    return F.when(inside, F.substr(path, F.length(directory) + 1)).otherwise(path)


def parent_of_page(directory: Column) -> Column:
    """The directory above a page's; null at the root."""
    bare = F.regexp_replace(directory, "/$", "")
    return F.when(directory != "", paths.parent(bare))


def breadcrumbs(directory: Column) -> Column:
    """(label, path) of each directory from the top to this one."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(x.alias("label"), F.array_join(F.slice(parts, 1, i + 1), "/").alias("path")))


def rfc3339(moment: Column, *, zoned: bool = True) -> Column:
    """A moment in UTC, whatever the session's zone; a time without a zone as it stands."""
    moment = F.to_utc_timestamp(moment, F.current_timezone()) if zoned else moment
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    """The moment an RFC 3339 text names, with ``Z`` or an offset; null for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.upper(text)))
