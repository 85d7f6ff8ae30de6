"""Scalar expressions on slash-separated relative paths and on sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory of a path; '' at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top; empty at the root."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(F.size(parts) > 1, steps).otherwise(F.array().cast("array<string>"))


def as_prefix(directory: Column) -> Column:
    """A directory as a prefix of its children: trimmed, with a slash at its end; '' for the root."""
    bare = F.btrim(directory, F.lit("/"))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("/")))


def blob_path(hex_digest: Column) -> Column:
    """Where a blob lies in a store; names under four digits lie flat."""
    deep = F.concat_ws("/", F.lit("objects"), F.substring(hex_digest, 1, 2), F.substring(hex_digest, 3, 2), hex_digest)
    return F.when(F.length(hex_digest) < 4, F.concat(F.lit("objects/"), hex_digest)).otherwise(deep)


def human_size(size: Column) -> Column:
    """Decimal units with one place from a thousand on: the exact binary quotient is rounded, halves to even."""
    def in_unit(n: int, unit: str) -> Column:
        quotient = size / F.lit(float(n))
        whole = F.floor(quotient)
        # Twentieths of the fraction, exact: it has 52 binary places at most.
        twentieths = ((quotient - whole) * F.lit(2.0**52)).cast("long") * 20
        tenth, rest = F.shiftright(twentieths, 53), twentieths.bitwiseAND(F.lit((1 << 53) - 1))
        up = (rest > (1 << 52)) | ((rest == (1 << 52)) & (tenth % 2 == 1))
        tenths = whole * 10 + tenth + up.cast("int")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))

    return F.when(size >= 1_000_000_000, in_unit(10**9, "G")).when(size >= 1_000_000, in_unit(10**6, "M")).when(size >= 1000, in_unit(1000, "K")).otherwise(F.concat(size.cast("string"), F.lit("B")))


def short_digest(hex_digest: Column) -> Column:
    return F.coalesce(F.substring(hex_digest, 1, 12), F.lit("-" * 12))


def fast_digest_hex(value: Column) -> Column:
    """Sixteen lower-case hex digits of a 64-bit number, two's complement."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def padded_id(value: Column) -> Column:
    return F.lpad(value.cast("string"), 19, "0")


def status_label(status: Column) -> Column:
    return F.when(status == 1, "present").otherwise("deleted")


def change_summary(added: Column, modified: Column, deleted: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("+"), added), F.concat(F.lit("~"), modified), F.concat(F.lit("-"), deleted))


def file_kind(mode: Column) -> Column:
    """directory, symlink, executable or regular, from Unix mode bits."""
    kind = mode.bitwiseAND(F.lit(0o170000))
    return F.when(kind == 0o040000, "directory").when(kind == 0o120000, "symlink").when(mode.bitwiseAND(F.lit(0o111)) != 0, "executable").otherwise("regular")
