"""Encrypted blobs: inspection of their headers, and AES-256-GCM encryption and decryption as column expressions.

Layout: a header of 32 bytes (magic, flags, nonce), in version 1 a block with the data key wrapped for one or
more keys, then chunks of 8 KiB times a power of two, each sealed under the nonce with the chunk's number; version 1
marks the last chunk and binds header and key block to the first, version 0 ends its text with a check value.
Other ciphers than AES and keys derived from passwords are recognised in headers, not computed.
"""

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = bytes.fromhex("ae71")
ALGORITHMS = {0: "aes256gcm", 1: "chacha20-poly1305", 2: "xchacha20-poly1305"}
HEADER, TAG, NONCE, SLOT, KDF_PARAMS, BASE_CHUNK = 32, 16, 12, 52, 28, 8192
DEFAULT_KIND = 7


def _part(b: Column, at: int | Column, n: int | Column) -> Column:
    """Bytes from the 0-based ``at`` on."""
    return F.substring(b, (at if isinstance(at, Column) else F.lit(at)) + 1, n if isinstance(n, Column) else F.lit(n))


def _number(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("long")


def key_id(key: bytes | Column) -> Column:
    """The first four bytes of the key's SHA-256."""
    return _part(F.unhex(F.sha2(key if isinstance(key, Column) else F.lit(key), 256)), 0, 4)


def inspect(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds what a header says: valid, version, chunk_size, algorithm, nonce (hex), kdf, key_ids (hex, version 1 only)."""
    c = F.col(content)
    flags = _number(_part(c, 2, 2))
    code = flags.bitwiseAND(F.lit(15))
    name = F.when(code == 0, ALGORITHMS[0]).when(code == 1, ALGORITHMS[1]).when(code == 2, ALGORITHMS[2])
    valid = (F.octet_length(c) >= HEADER) & (_part(c, 0, 2) == F.lit(MAGIC)) & (flags.bitwiseAND(F.lit(0x0F00)) == 0) & (code <= 2)
    nonce = F.when(code == 2, 24).otherwise(NONCE)
    version = F.shiftright(flags, 12).bitwiseAND(F.lit(15))
    kdf, slots = _number(_part(c, HEADER + 2, 1)), _number(_part(c, HEADER + 3, 1))
    first = HEADER + 4 + nonce + F.when(kdf == 1, KDF_PARAMS).otherwise(0)
    ids = F.transform(F.sequence(F.lit(0), slots.cast("int") - 1), lambda k: F.lower(F.hex(_part(c, first + k * SLOT, 4))))
    v1 = valid & (version == 1)
    return files.select(
        "*",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(valid, version).alias("version"),
        F.when(valid, F.lit(BASE_CHUNK) * F.pow(F.lit(2), F.shiftright(flags, 4).bitwiseAND(F.lit(15))).cast("long")).alias("chunk_size"),
        F.when(valid, name).alias("algorithm"),
        F.when(valid, F.lower(F.hex(_part(c, 4, nonce)))).alias("nonce"),
        F.when(v1, F.when(kdf == 1, "argon2id").otherwise("none")).alias("kdf"),
        F.when(v1 & (slots > 0), ids).alias("key_ids"),
    )


def _nonce_of(nonce: Column, k: Column, last: Column) -> Column:
    """The nonce of chunk k: the number is added without carry at its end, the first bit turned for the last chunk."""
    low = F.unhex(F.lpad(F.hex(_number(_part(nonce, 8, 4)).bitwiseXOR(k.cast("long"))), 8, "0"))
    first = F.when(last, _number(_part(nonce, 0, 1)).bitwiseXOR(F.lit(128))).otherwise(_number(_part(nonce, 0, 1)))
    return F.concat(F.unhex(F.lpad(F.hex(first), 2, "0")), _part(nonce, 1, 7), low)


def _bytes(parts: Column) -> Column:
    """The parts as one, null if one is null; through hex, since a fold would copy all before it for each."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), "", "not hex"))


def _seal(text: Column, key: Column, nonce: Column, size: int, aad: Column | None) -> Column:
    """All chunks of a text; with ``aad`` the last is marked and the first bound to it."""
    n = F.greatest(F.ceil(F.octet_length(text) / size).cast("int"), F.lit(1))

    def chunk(k: Column) -> Column:
        last = (k == n - 1) if aad is not None else F.lit(False)
        more = F.when(k == 0, aad).otherwise(F.unhex(F.lit(""))) if aad is not None else F.lit(b"")
        return _part(F.aes_encrypt(_part(text, k * size, size), key, F.lit("GCM"), F.lit("DEFAULT"), _nonce_of(nonce, k, last), more), NONCE, 1 << 30)

    return _bytes(F.transform(F.sequence(F.lit(0), n - 1), chunk))


def _open(body: Column, key: Column, nonce: Column, size: Column, aad: Column | None) -> Column:
    """The text of all chunks; null if one fails."""
    n = F.greatest(F.ceil(F.octet_length(body) / size).cast("int"), F.lit(1))

    def chunk(k: Column) -> Column:
        last = (k == n - 1) if aad is not None else F.lit(False)
        more = F.when(k == 0, aad).otherwise(F.unhex(F.lit(""))) if aad is not None else F.lit(b"")
        return F.try_aes_decrypt(F.concat(_nonce_of(nonce, k, last), _part(body, k * size.cast("int"), size.cast("int"))), key, F.lit("GCM"), F.lit("DEFAULT"), more)

    return _bytes(F.transform(F.sequence(F.lit(0), n - 1), chunk))


def entropy(row: Column) -> Column:
    """56 fresh random bytes for each row: nonce, data key, nonce of the data key."""
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(NONCE + 32 + NONCE) for _ in rows])

    return F.pandas_udf(run, "binary").asNondeterministic()(row)


def encrypt(rows: DataFrame, key: bytes, *, content: str = "content", chunk_kind: int = DEFAULT_KIND) -> DataFrame:
    """Replaces ``content`` by its version 1 envelope under a fresh data key."""
    rows = rows.withColumn("__e", entropy(F.col(content)))
    e = F.col("__e")
    nonce, dek, dek_nonce = _part(e, 0, NONCE), _part(e, NONCE, 32), _part(e, NONCE + 32, NONCE)
    flags = (1 << 12 | chunk_kind << 4).to_bytes(2, "big")
    header = F.concat(F.lit(MAGIC + flags), nonce, F.lit(bytes(HEADER - 4 - NONCE)))
    wrapped = _part(F.aes_encrypt(dek, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), dek_nonce, header), NONCE, 48)
    block = F.concat(F.lit((4 + NONCE + SLOT).to_bytes(2, "big") + b"\x00\x01"), dek_nonce, key_id(key), wrapped)
    sealed = _seal(F.col(content), dek, nonce, (BASE_CHUNK << chunk_kind) - TAG, F.concat(header, block))
    return rows.withColumn(content, F.concat(header, block, sealed)).drop("__e")


def encrypt_v0(rows: DataFrame, key: bytes, *, content: str = "content") -> DataFrame:
    """Replaces ``content`` by its version 0 envelope."""
    rows = rows.withColumn("__e", entropy(F.col(content)))
    nonce, check = _part(F.col("__e"), 0, NONCE), _part(F.col("__e"), NONCE, TAG)
    sealed = _seal(F.concat(F.col(content), check), F.lit(key), nonce, BASE_CHUNK - TAG, None)
    return rows.withColumn(content, F.concat(F.lit(MAGIC + b"\0\0"), nonce, check, sealed)).drop("__e")


def decrypt(rows: DataFrame, key: bytes, *, content: str = "content") -> DataFrame:
    """Replaces ``content`` by its text, of either version; null if it is no AES envelope, for another key, cut or changed."""
    c = F.col(content)
    rows = inspect(rows.select("*", F.lit(1).alias("__k")), content)
    header, nonce, size = _part(c, 0, HEADER), _part(c, 4, NONCE), F.col("chunk_size")
    length = _number(_part(c, HEADER, 2)).cast("int")
    block = _part(c, HEADER, length)
    first = 4 + NONCE + F.when(F.col("kdf") == "argon2id", KDF_PARAMS).otherwise(0)
    mine = F.array_position("key_ids", F.lower(F.hex(key_id(key)))).cast("int")
    slot = F.when(mine > 0, _part(block, first + (mine - 1) * SLOT, SLOT))
    dek = F.try_aes_decrypt(F.concat(_part(block, 4, NONCE), _part(slot, 4, 48)), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), header)
    rows = rows.withColumn("__dek", F.when(F.col("version") == 1, dek))
    new = _open(_part(c, HEADER + length, 1 << 30), F.col("__dek"), nonce, size, F.concat(header, block))
    old = _open(_part(c, HEADER, 1 << 30), F.lit(key), nonce, size, None)
    whole = F.octet_length(old) - TAG
    old = F.when(_part(old, whole, TAG) == _part(c, 4 + NONCE, TAG), _part(old, 0, whole))
    text = F.when((F.col("algorithm") == ALGORITHMS[0]) & (F.col("version") == 1), new).when((F.col("algorithm") == ALGORITHMS[0]) & (F.col("version") == 0), old)
    return rows.withColumn(content, text).drop("__k", "__dek", "valid", "version", "chunk_size", "algorithm", "nonce", "kdf", "key_ids")


def encrypt_name(name: Column, key: bytes, nonce: Column) -> Column:
    """A file name sealed under a nonce, which stands at its end, in URL-safe base64 without padding."""
    sealed = F.aes_encrypt(F.encode(name, "utf-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)
    return F.rtrim(F.translate(F.base64(F.concat(_part(sealed, NONCE, 1 << 30), _part(sealed, 0, NONCE))), "+/\r\n", "-_"), F.lit("="))


def decrypt_name(name: Column, key: bytes) -> Column:
    """The name again; null if it fails."""
    raw = F.unbase64(F.translate(name, "-_", "+/"))
    n = F.octet_length(raw)
    return F.decode(F.try_aes_decrypt(F.concat(_part(raw, n - NONCE, NONCE), _part(raw, 0, n - NONCE)), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")), "utf-8")
