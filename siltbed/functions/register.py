"""The engine's expressions as SQL functions: temporary ones of a session, made of built-in functions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> parameters, result, expression
FUNCTIONS = {
    "shard_index": ("uid string, n_bits int", "int", "cast(case when uid rlike '\\\\A[0-9]+\\\\z' then try_cast(right(uid, 16) as bigint) else crc32(encode(uid, 'utf-8')) end & (shiftleft(1L, n_bits) - 1) as int)"),
    "shard_hex": ("i int, n_bits int", "string", "lpad(hex(i), greatest(1, n_bits div 4, length(hex(i))), '0')"),
    "date_dir": ("at timestamp_ntz", "string", "replace(left(cast(at as string), 10), '-', '')"),
    "object_key": ("day string, hex_ string", "string", "concat(day, '/', hex_, '.des')"),
    "uid_of_key": ("k string", "string", "substring_index(k, ':', 1)"),
    "key_fingerprint": ("k string", "string", "concat('SHA256:', rtrim('=', base64(unhex(sha2(k, 256)))))"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
