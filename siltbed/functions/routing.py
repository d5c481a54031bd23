"""Routing and naming as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.functions.scalars import utc


def check_bits(n_bits: int) -> int:
    if not 4 <= n_bits <= 16:
        raise ValueError("n_bits must be from 4 to 16")
    return n_bits


def check_index(index: int, n_bits: int = 8) -> int:
    if not 0 <= index < 1 << check_bits(n_bits):
        raise ValueError(f"a shard index of {n_bits} bits must be from 0 to {(1 << n_bits) - 1}")
    return index


def normalize_uid(uid: Column) -> Column:
    """Text of a text or whole-number uid; other types are an error."""
    ok = F.typeof(uid).isin("string", "tinyint", "smallint", "int", "bigint", "void") | F.startswith(F.typeof(uid), F.lit("decimal"))
    return F.when(ok, uid.cast("string")).otherwise(F.raise_error(F.lit("a uid must be text or a whole number")).cast("string"))


def date_dir(created_at: Column) -> Column:
    """The UTC day."""
    return F.replace(F.left(utc(created_at).cast("string"), F.lit(10)), F.lit("-"), F.lit(""))


def shard_index(uid: Column, n_bits: int = 8) -> Column:
    """Digits: the number modulo 2^n (its last 16 digits suffice, as 10^16 is a multiple of 2^16); else CRC-32 of UTF-8."""
    mask = (1 << check_bits(n_bits)) - 1
    uid = uid.cast("string")
    number = F.right(uid, F.lit(16)).try_cast("bigint")
    return F.when(uid.rlike(r"\A[0-9]+\z"), number.bitwiseAND(mask)).otherwise(F.crc32(F.encode(uid, "utf-8")).bitwiseAND(mask)).cast("int")


def shard_hex(index: Column, n_bits: int = 8) -> Column:
    return F.format_string(f"%0{max(1, check_bits(n_bits) // 4)}X", index)


def object_key(day: Column, hex_: Column) -> Column:
    return F.concat(day, F.lit("/"), hex_, F.lit(".des"))


def shard_file(day: Column, hex_: Column, seq: Column) -> Column:
    return F.format_string("%s_%s_%04d.des", day, hex_, seq)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with Z; a fraction of six digits only where there is one."""
    text = F.replace(utc(ts).cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text), F.lit("Z"))


def meta_file(shard: Column) -> Column:
    """The sidecar's name."""
    return F.concat(F.regexp_replace(shard, r"\.des\z", ""), F.lit(".meta"))


def bigfile_key(digest: Column, folder: str = "") -> Column:
    return F.concat(F.lit(f"{folder.rstrip('/')}/" if folder else ""), F.lit("_bigFiles/"), digest)


def metadata_key(uid: Column, ts: Column) -> Column:
    return F.concat(uid, F.lit(":"), iso_utc(ts))


def ext_key(uid: Column, ts: Column) -> Column:
    return F.concat(F.lit("_ext_retention/"), date_dir(ts), F.lit("/"), uid, F.lit("_"), iso_utc(ts), F.lit(".dat"))


#: Suffixes whose content is compressed already.
SKIP_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".gz", ".zip", ".bz2", ".xz"]


def should_compress(name: Column, codec: str = "zstd") -> Column:
    suffix = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    return F.lit(codec != "none") & ~suffix.isin(SKIP_SUFFIXES)
