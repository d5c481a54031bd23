"""Canonical views over the driver's tables, each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, UNTIL, CUT = "2024-01-31 12:00:00", "2024-01-10 00:00:00", "2024-01-24 00:00:00"
BITS, MOST, BIG = 4, 20_000, 8192

FILES = """select case when event_id % 2 = 0 then cast(event_id as {text}) else concat(event_type, '-', cast(event_id as {text}), case event_id % 5 when 0 then '.jpg' when 1 then '.txt' when 2 then '.json' when 3 then '.tar.gz' else '' end) end as uid,
 ts as created_at, 1 + (event_id * 7919) % 5000 as size_bytes, case when event_id % 11 = 0 then null else event_id % 3 = 0 end as archived, event_id as ord, event_type, user_id, value from {events}"""


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FILES.format(text="string", events="{events}"), events=table(spark, sf, "events"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    uid = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int))")
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return d.select("doc_id", uid.alias("uid"), created.alias("created_at"), body.alias("payload"), F.octet_length(body).cast("long").alias("size_bytes"), F.col("doc_id").alias("ord"))


SQL_FILES = FILES.format(text="varchar", events="events")
#: CRC-32 in list functions: DuckDB has none.
_TABLE = "(select list(c order by n) from (select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from (select unnest(range(256)) n)))"
SQL_ROUTED = f"""crc as (select {_TABLE} t), f as ({SQL_FILES}), routed as (select f.*, strftime(created_at, '%Y%m%d') date_dir,
 cast(case when regexp_full_match(uid, '[0-9]+') then cast(right(uid, 16) as bigint) & 15
 else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(uid, ''), lambda x: ord(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) & 15 end as integer) shard_index from f, crc),
 located as (select *, format('{{:X}}', shard_index) shard_hex, date_dir || '/' || format('{{:X}}', shard_index) || '.des' object_key from routed)"""
SQL_PLAN = f"""o as (select *, row_number() over (partition by date_dir, shard_hex order by ord) rn from located),
 plan as (select date_dir, shard_hex, uid, created_at, size_bytes, ord, rn, 0::bigint shard_seq, size_bytes total from o where rn = 1
 union all select o.date_dir, o.shard_hex, o.uid, o.created_at, o.size_bytes, o.ord, o.rn, p.shard_seq + case when p.total + o.size_bytes > {MOST} then 1 else 0 end, case when p.total + o.size_bytes > {MOST} then o.size_bytes else p.total + o.size_bytes end
 from plan p join o on o.date_dir = p.date_dir and o.shard_hex = p.shard_hex and o.rn = p.rn + 1)"""
SQL_PAYLOADS = """select doc_id, case when doc_id % 2 = 0 then cast(doc_id as varchar) else source || '/' || cast(doc_id as varchar) || '.txt' end uid,
 timestamp '2024-01-01' + to_days(cast(doc_id % 30 as integer)) created_at, encode(coalesce(text, '')) payload, octet_length(encode(coalesce(text, ''))) size_bytes, doc_id ord from documents"""
