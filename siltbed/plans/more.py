"""Further queries of the catalogue: sidecars, requests, retention, configuration, streams, text and URL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import register, scalars
from siltbed.functions import routing as r
from siltbed.operators import access, archive, audit, lifecycle, monitoring, planner, resolve
from siltbed.plans import views as v
from siltbed.plans.views import BIG, BITS, MOST, SQL_FILES, SQL_PAYLOADS, ntz
from siltbed.sources import datasource, retention, shards, sidecar
from siltbed.streaming import cycle
from siltbed.streaming.packing import pack_stream

_Q, _SQL = {}, {}
_F = f"with files as ({SQL_FILES})"
_PAY = f"with pay as ({SQL_PAYLOADS})"
_NOW = "1998-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession, what: str) -> str:
    """A new folder that the cluster shares, deleted when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


# --- sidecars and audit


def _entries(s, d) -> DataFrame:
    p = v.payloads(s, d)
    name = F.concat(F.date_format("created_at", "yyyyMMdd"), F.lit(".des"))
    key = F.when(F.col("doc_id") % 5 == 0, F.col("uid")).otherwise(r.metadata_key(F.col("uid"), F.col("created_at")))
    return p.select("doc_id", name.alias("shard_file"), F.lit(0).cast("long").alias("shard_size"), key.alias("key"), "uid", "created_at", F.col("size_bytes").alias("uncompressed_size"), F.sha2("payload", 256).alias("checksum"), F.lit("sha256").alias("checksum_algo"))


def _tombstones(entries: DataFrame) -> DataFrame:
    dead = entries.where("doc_id % 17 = 0")
    return dead.select("shard_file", r.metadata_key(F.col("uid"), F.col("created_at")).alias("key"), r.iso_utc(F.col("created_at")).alias("deleted_at"), F.lit("ops").alias("deleted_by"), F.lit("GDPR").alias("reason"), F.lit(None).cast("string").alias("ticket_id"))


def _parsed(s, d) -> DataFrame:
    e = _entries(s, d)
    return sidecar.parse(sidecar.to_json(e, _tombstones(e), ntz("2024-02-01 00:00:00")))


_KEYS = f"{_PAY}, e as (select *, strftime(created_at, '%Y%m%d') || '.des' shard_file, case when doc_id % 5 = 0 then uid else uid || ':' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') end \"key\" from pay)"


@query(f"{_KEYS} select shard_file, \"key\", uid, case when doc_id % 5 = 0 then null else created_at end entry_at, size_bytes uncompressed_size, sha256(payload) checksum from e")
def sidecar_explode(s, d):
    return sidecar.explode_entries(_parsed(s, d)).select("shard_file", "key", "uid", F.col("created_at").alias("entry_at"), "uncompressed_size", "checksum")


@query(f"{_KEYS} select shard_file, uid, created_at, 'GDPR' reason from e where doc_id % 17 = 0")
def sidecar_tombstones(s, d):
    return sidecar.explode_tombstones(_parsed(s, d)).select("shard_file", "uid", "created_at", "reason")


@query(f"{_KEYS} select shard_file, count(*)::double entries, count(*) filter (doc_id % 17 = 0)::double deleted_files from e group by 1")
def sidecar_stats(s, d):
    return _parsed(s, d).select("shard_file", F.element_at("stats", F.lit("entries")).alias("entries"), F.element_at("stats", F.lit("deleted_files")).alias("deleted_files"))


@query(f"{_KEYS} select distinct shard_file from e where day(created_at) % 3 = 0")
def sidecars_missing(s, d):
    names = _entries(s, d).select("shard_file", F.day("created_at").alias("day")).distinct()
    there = names.where("day % 3 <> 0").select(r.meta_file(F.col("shard_file")).alias("meta_file"))
    return sidecar.missing(names, there).select("shard_file")


@query(f"{_KEYS} select doc_id req_id, case when doc_id % 5 = 0 then 'bare' when doc_id % 7 = 0 then 'only' else 'exact' end how from e where doc_id % 35 <> 0")
def entry_lookup(s, d):
    e = _entries(s, d)
    at = F.when(F.col("doc_id") % 7 == 0, F.col("created_at") + F.expr("interval 1 hour")).otherwise(F.col("created_at"))
    entry_at = F.when(F.col("doc_id") % 5 != 0, F.col("created_at"))
    found = resolve.entry_with_fallback(e.where("doc_id % 35 <> 0").select(F.col("doc_id").alias("req_id"), "uid", at.alias("created_at")), e.select("uid", entry_at.alias("created_at"), "checksum"))
    return found.select("req_id", F.element_at(F.array(F.lit("exact"), F.lit("bare"), F.lit("only")), F.col("rank") + 1).alias("how"))


@query(f"{_KEYS} select substr(\"key\", 1, case when instr(\"key\", ':') > 0 then instr(\"key\", ':') - 1 else length(\"key\") end) uid, case when doc_id % 5 = 0 then null else created_at end as \"at\" from e")
def split_keys(s, d):
    return _entries(s, d).select(scalars.uid_of_key(F.col("key")).alias("uid"), scalars.try_parse_iso(scalars.time_of_key(F.col("key"))).alias("at"))


@query(f"{_KEYS} select uid, checksum_status from (select uid, doc_id, case when doc_id % 19 = 0 then 'corrupted' when doc_id % 23 = 0 then 'corrupted' when doc_id % 7 = 0 then 'missing_checksum' else 'verified' end checksum_status from e) where doc_id < 100 order by doc_id limit 100")
def checksum_sample(s, d):
    e = audit.first_entries(_entries(s, d).where("doc_id < 100"), 100, "doc_id")
    algo = F.when(F.col("doc_id") % 19 == 0, "md5").otherwise("sha256")
    stored = F.when(F.col("doc_id") % 19 == 0, "x").when(F.col("doc_id") % 23 == 0, "0").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("checksum"))
    return audit.checksum_audit(v.payloads(s, d), e.select("uid", "created_at", stored.alias("checksum"), algo.alias("checksum_algo"))).select("uid", F.col("status").alias("checksum_status"))


@query(f"{_F} select uid, 'missing' status from files where ord % 23 = 0 order by ord limit 10")
def first_errors(s, d):
    f = v.files(s, d).withColumn("file_location", F.concat(F.lit("/data/"), "uid"))
    listing = f.where("ord % 23 <> 0").select(F.col("file_location").alias("path"), F.col("size_bytes").alias("length"))
    return audit.first_errors(archive.validate(f, listing)).select("uid", "status")


_MANIFEST = f"with recursive {v.SQL_ROUTED}, {v.SQL_PLAN}, m as (select distinct date_dir || '_' || shard_hex || '_' || lpad(cast(shard_seq as varchar), 4, '0') || '.des' shard_file from plan)"


@query(f"{_MANIFEST} select shard_file from m order by md5('7:' || shard_file), shard_file limit 100")
def random_shards(s, d):
    return audit.random_shards(planner.manifest(planner.plan(planner.route(v.files(s, d), BITS), MOST)).select("shard_file"), 100, 7)


@query(f"{_MANIFEST}, x as (select date_dir || '_' || shard_hex || '_' || lpad(cast(shard_seq as varchar), 4, '0') || '.des' shard_file, size_bytes from plan) select round(sum(size_bytes)::double / sum(size_bytes // 2 + 1)::double, 6) compression_ratio, count(*) - count(distinct shard_file) calls_saved, round(100.0 * (1 - count(distinct shard_file)::double / count(*)), 6) calls_saved_pct from x")
def compression_figures(s, d):
    p = planner.plan(planner.route(v.files(s, d), BITS), MOST).withColumn("shard_file", r.shard_file(F.col("date_dir"), F.col("shard_hex"), F.col("shard_seq")))
    return audit.compression(p.select("shard_file", F.col("size_bytes").alias("size"), F.expr("size_bytes div 2 + 1").alias("length")))


# --- shards and streams: written, read back


@query(f"{_PAY} select uid, sha256(payload) checksum, size_bytes > {BIG} is_bigfile from pay")
def shard_roundtrip(s, d):
    p = v.payloads(s, d).withColumn("shard_file", F.concat(F.date_format("created_at", "yyyyMMdd"), F.lit("_00_0000.des")))
    folder = _scratch(s, "shards")
    shards.write_shards(p, folder, threshold=BIG).write.mode("overwrite").parquet(f"{folder}/manifest")
    back = shards.read_payloads(shards.read_entries(shards.list_shards(s, folder)))
    return back.select("uid", F.sha2("payload", 256).alias("checksum"), "is_bigfile")


@query(f"{_F} select uid, created_at from files")
def stream_pack_window(s, d):
    folder = _scratch(s, "stream")
    f = v.files(s, d)
    f.write.parquet(f"{folder}/in")
    stream = s.readStream.schema(f.schema).parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        pack_stream(stream, f"{folder}/out", f"{folder}/checkpoint", BITS, MOST).awaitTermination()
    return s.read.parquet(f"{folder}/out").select("uid", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"{_PAY} select uid, sha256(payload) checksum, size_bytes \"size\" from pay")
def shard_source(s, d):
    """The folder again, through spark.read.format."""
    p = v.payloads(s, d).withColumn("shard_file", F.concat(F.date_format("created_at", "yyyyMMdd"), F.lit("_00_0000.des")))
    folder = _scratch(s, "shards")
    shards.write_shards(p, folder, threshold=BIG).write.mode("overwrite").parquet(f"{folder}/manifest")
    datasource.register(s)
    return s.read.format("shard").load(folder).select("uid", F.sha2("payload", 256).alias("checksum"), "size")


@query(f"{_PAY} select uid, sha256(payload) checksum from pay where doc_id % 6 = 0 and doc_id % 9 <> 0")
def extended_copies(s, d):
    """Copies of what is extended for the first time, read back."""
    p = v.payloads(s, d)
    known = p.where("doc_id % 9 = 0").select("uid", "created_at", ntz("2030-01-01 00:00:00").alias("due_date"))
    requests = p.where("doc_id % 3 = 0").select("uid", "created_at", F.when(F.col("doc_id") % 2 == 0, ntz("2031-01-01 00:00:00")).otherwise(ntz("2020-01-01 00:00:00")).alias("due_date"))
    folder = _scratch(s, "extended")
    actions, _ = retention.extend(known, requests, p, folder, ntz("2024-02-01 00:00:00"))
    moved = p.join(actions.where("action = 'moved'").select("uid", "created_at"), ["uid", "created_at"], "left_semi")
    retention.copy(moved, folder).write.mode("overwrite").parquet(f"{folder}/_copied")
    return retention.read(s.read.parquet(f"{folder}/_copied")).select("uid", F.sha2("payload", 256).alias("checksum"))


@query(f"with {v.SQL_ROUTED} select uid, date_dir, shard_index, shard_hex, object_key from located")
def sql_functions(s, d):
    """Routing once more, in SQL with the engine's functions."""
    register.register(s)
    return s.sql("select uid, date_dir(created_at) date_dir, shard_index(uid, 4) shard_index, shard_hex(shard_index(uid, 4), 4) shard_hex, object_key(date_dir(created_at), shard_hex(shard_index(uid, 4), 4)) object_key from {files}", files=v.files(s, d))


# --- sources and URIs

_PLACE = "case ord % 5 when 0 then 's3://bucket-' || ord % 3 || '/day/' || uid when 1 then 's3:///' || uid when 2 then 's3://bucket/' || uid || '?x=1' when 3 then '/data/' || uid else 's3://bucket/' end"


def _places(s, d):
    u = F.col("uid")
    at = F.col("ord") % 5
    place = F.when(at == 0, F.concat(F.lit("s3://bucket-"), F.col("ord") % 3, F.lit("/day/"), u)).when(at == 1, F.concat(F.lit("s3:///"), u)).when(at == 2, F.concat(F.lit("s3://bucket/"), u, F.lit("?x=1"))).when(at == 3, F.concat(F.lit("/data/"), u)).otherwise(F.lit("s3://bucket/"))
    return v.files(s, d).withColumn("file_location", place)


@query(f"{_F}, p as (select *, {_PLACE} loc from files) select uid, starts_with(loc, 's3://') is_s3, case when ord % 5 = 0 then 'bucket-' || ord % 3 end bucket, case when ord % 5 = 0 then 'day/' || uid end \"key\" from p")
def object_uris(s, d):
    loc = F.col("file_location")
    return _places(s, d).select("uid", scalars.is_s3(loc).alias("is_s3"), scalars.s3_bucket(loc).alias("bucket"), scalars.s3_key(loc).alias("key"))


@query(f"{_F}, p as (select *, {_PLACE} loc from files) select case when starts_with(loc, 's3://') then 'no reader of objects' when ord % 2 = 0 then 'no file' when ord % 7 = 0 then 'not a file' else 'ok' end state, count(*) n from p group by 1")
def validate_locations(s, d):
    f = _places(s, d)
    listing = f.where("ord % 2 = 1 and ord % 5 = 3").select(F.col("file_location").alias("path"), (F.col("ord") % 7 != 0).alias("is_file"))
    error = cycle.check_locations(f, listing, False).withColumn("state", F.coalesce(F.regexp_extract("error", r"\A(no reader of objects|no file|not a file)", 1), F.lit("ok")))
    return error.groupBy("state").agg(F.count("*").alias("n"))


@query(f"{_F} select ord event_id, case when ord % 3 = 0 then uid end uid from files")
def url_uids(s, d):
    u = F.col("uid")
    url = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("http://host:1/api/files/"), u, F.lit("?x=1"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("http://host/file/"), u)).otherwise(F.concat(F.lit("http://host/"), u))
    return v.files(s, d).select(F.col("ord").alias("event_id"), scalars.uid_of_url(url).alias("uid"))


@query(f"{_F} select ord event_id, case ord % 3 when 0 then 'http://h/files/1?created_at=2024' when 1 then 'http://h/files/1?x=1&created_at=2024-01-01T00%3A00%3A00Z' else 'http://h/files/1?created_at=2024-01-01T00%3A00%3A00Z' end url from files")
def url_times(s, d):
    url = F.element_at(F.array(F.lit("http://h/files/1?created_at=2024"), F.lit("http://h/files/1?x=1"), F.lit("http://h/files/1")), (F.col("ord") % 3).cast("int") + 1)
    return v.files(s, d).select(F.col("ord").alias("event_id"), scalars.with_created_at(url, F.lit("2024-01-01T00:00:00Z")).alias("url"))


@query(f"{_F} select uid, case ord % 4 when 0 then created_at when 1 then created_at - interval 2 hour when 2 then date_trunc('day', created_at) end as \"at\" from files")
def iso_times(s, d):
    text, at = F.col("created_at").cast("string"), F.col("ord") % 4
    iso = F.when(at == 0, F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).when(at == 1, F.concat(text, F.lit("+02:00"))).when(at == 2, F.left(text, F.lit(10))).otherwise(F.lit("yesterday"))
    return v.files(s, d).select("uid", scalars.try_parse_iso(iso).alias("at"))


@query("select c_custkey, 'SHA256:' || rtrim(to_base64(unhex(sha256(c_name))), '=') fingerprint, case when c_custkey % 3 = 0 then c_name end name_back from customer")
def fingerprints(s, d):
    c = v.table(s, d, "customer")
    coded = F.when(F.col("c_custkey") % 3 == 0, F.base64(F.encode("c_name", "utf-8"))).otherwise(F.lit("no base64!"))
    return c.select("c_custkey", scalars.fingerprint(F.encode("c_name", "utf-8")).alias("fingerprint"), F.decode(scalars.try_base64(coded), "utf-8").alias("name_back"))


@query("select c_custkey, case c_custkey % 3 when 0 then '' when 1 then 'a/' else 'a/b/' end p, 2 entries, c_custkey * 2 found from customer")
def prefixes_and_maps(s, d):
    at = F.col("c_custkey") % 3
    text = F.when(at == 0, "").when(at == 1, "a/").otherwise("a/b")
    index = scalars.put(F.create_map(F.lit("x"), F.col("c_custkey"), F.lit("y"), F.col("c_custkey")), F.lit("x"), F.col("c_custkey") * 2)
    return v.table(s, d, "customer").select("c_custkey", scalars.prefix(text).alias("p"), F.size(index).alias("entries"), scalars.entry(index, F.lit("x")).alias("found"))


# --- retention and business


def _updates(s, d):
    rows = v.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid"), F.col("l_shipdate").cast("timestamp_ntz").alias("updated_at")).agg(F.max("l_partkey").alias("part"))
    return rows.select("uid", "updated_at", (F.col("updated_at") + F.make_dt_interval(days=F.col("part").cast("int") % 90 + 1)).alias("due_date"), F.lit("case").alias("reason"), F.lit("ops").alias("updated_by"))


def _held(s, d):
    status = F.when(F.col("o_orderkey") % 3 == 0, "deleted").when(F.col("o_orderkey") % 3 == 1, "expired").otherwise("active")
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("due_date"), status.alias("status"))


_UPD = "with u as (select l_orderkey uid, cast(l_shipdate as timestamp) updated_at, cast(l_shipdate as timestamp) + to_days(cast(max(l_partkey) % 90 + 1 as integer)) due_date from lineitem group by 1, 2), f as (select o_orderkey uid, case when o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) end due_date, case o_orderkey % 3 when 0 then 'deleted' when 1 then 'expired' else 'active' end status from orders)"


@query(f"{_UPD} select f.uid, coalesce(l.due_date, f.due_date) due_date, case when l.uid is not null and f.status in ('active', 'expired') then 'extended' else f.status end status, l.uid is not null in_extended_retention from f left join (select * from (select *, row_number() over (partition by uid order by updated_at desc, due_date desc) n from u) where n = 1) l on l.uid = f.uid")
def retention_update(s, d):
    return lifecycle.extend(_held(s, d), _updates(s, d))[0].select("uid", "due_date", "status", "in_extended_retention")


@query(f"{_UPD} select u.uid, case when row_number() over w = 1 then f.due_date else lag(u.due_date) over w end previous_due_date, u.due_date new_due_date from u join f on u.uid = f.uid window w as (partition by u.uid order by u.updated_at, u.due_date)")
def retention_history(s, d):
    return lifecycle.extend(_held(s, d), _updates(s, d))[1].select("uid", "previous_due_date", "new_due_date")


@query("with recursive f as (select user_id \"key\", ts, event_id, row_number() over (partition by user_id order by ts, event_id) rn from events), r as (select \"key\", event_id, rn, true accepted, ts last from f where rn = 1 union all select f.\"key\", f.event_id, f.rn, f.ts - r.last >= interval 1 day, case when f.ts - r.last >= interval 1 day then f.ts else r.last end from r join f on f.\"key\" = r.\"key\" and f.rn = r.rn + 1) select event_id, accepted from r")
def spaced_updates(s, d):
    log = v.table(s, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return lifecycle.spaced_updates(log, 86400).select("event_id", "accepted")


@query(f"{_F} select ord event_id, case when ord % 5 = 0 or ord % 7 = 0 then 400 when ord % 3 = 0 then 404 when ord % 11 = 0 then 410 else 200 end http_code from files")
def delete_requests(s, d):
    f = v.files(s, d)
    by = F.when(F.col("ord") % 5 == 0, "  ").otherwise("ops")
    reason = F.when(F.col("ord") % 7 == 0, "boredom").otherwise("GDPR")
    requests = f.select(F.col("ord").alias("event_id"), "uid", "created_at", by.alias("deleted_by"), reason.alias("reason"))
    return lifecycle.deletions(requests, f.where("ord % 3 <> 0"), f.where("ord % 11 = 0")).select("event_id", "http_code")


@query(f"{_F}, b as (select ord, strftime(created_at, '%Y%m%d') as day_, uid, case when ord % 3 = 0 then 'a' when ord % 3 = 1 then 'b' end shard from files) select ord req_id, shard target from b")
def delete_target(s, d):
    f = planner.route(v.files(s, d), BITS)
    requests = f.select(F.col("ord").alias("req_id"), *resolve.KEY, "created_at")
    entries = f.where("ord % 3 = 0").select(*resolve.KEY, F.lit("a").alias("shard_file"), F.when(F.col("ord") % 2 == 0, F.col("created_at")).alias("created_at"))
    index = f.where("ord % 3 < 2").select(*resolve.KEY, F.lit("b").alias("shard_file"))
    return resolve.delete_target(requests, entries, index).select("req_id", "target")


@query("select o_orderkey uid, l_partkey case_number, c_mktsegment department from orders join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey join customer on c_custkey = o_custkey")
def case_files(s, d):
    bridge = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("case_number")).distinct()
    return v.table(s, d, "orders").join(bridge, "o_orderkey").join(v.table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(F.col("o_orderkey").alias("uid"), "case_number", F.col("c_mktsegment").alias("department"))


@query(f"select o_orderkey uid, date_diff('second', timestamp '{_NOW}', case when o_orderkey % 4 = 0 then cast(o_orderdate as timestamp) + interval 30 day else cast(o_orderdate as timestamp) + interval 365 day end) seconds_left from orders")
def time_until_expiration(s, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    due = F.when(F.col("o_orderkey") % 4 == 0, at + F.expr("interval 30 days"))
    left = scalars.time_left(due, at, F.lit(365), ntz(_NOW))
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("uid"), (F.extract(F.lit("DAY"), left) * 86400 + F.extract(F.lit("HOUR"), left) * 3600 + F.extract(F.lit("MINUTE"), left) * 60 + F.extract(F.lit("SECOND"), left)).cast("long").alias("seconds_left"))


@query(f"{_F} select uid, ord % 5 retry_count from files where ord % 5 < 3")
def retry_backlog(s, d):
    return archive.retry_backlog(v.files(s, d).select("uid", (F.col("ord") % 5).alias("retry_count")))


# --- requests: accepted-only states, verified by a recursion in SQL

_LOG = f"{_F}".replace("with files", "with recursive files") + ", l as (select user_id \"key\", created_at ts, ord event_id, ord % 5000 nonce, row_number() over (partition by user_id order by created_at, ord) rn, row_number() over (partition by ord % 5000 order by created_at, ord) rm from files)"


def _log(s, d):
    return v.files(s, d).select(F.col("user_id").cast("long").alias("key"), F.col("created_at").alias("ts"), F.col("ord").alias("event_id"), (F.col("ord") % 5000).cast("long").alias("nonce"))


@query(f"{_LOG}, r as (select \"key\", event_id, rn, true accepted, [ts] held from l where rn = 1 union all select \"key\", event_id, rn, len(kept) < 2, case when len(kept) < 2 then list_append(kept, ts) else kept end from (select l.\"key\", l.event_id, l.rn, l.ts, list_filter(r.held, lambda x: x >= l.ts - interval 1 day) kept from r join l on l.\"key\" = r.\"key\" and l.rn = r.rn + 1)) select event_id, accepted from r")
def rate_limit(s, d):
    return access.rate_limit(_log(s, d), 2, 86400).select("event_id", "accepted")


@query(f"{_LOG}, r as (select nonce, event_id, rm, false replay, ts stored from l where rm = 1 union all select l.nonce, l.event_id, l.rm, l.ts - r.stored <= interval 20 day, case when l.ts - r.stored <= interval 20 day then r.stored else l.ts end from r join l on l.nonce = r.nonce and l.rm = r.rm + 1) select event_id, replay from r")
def nonce_replay(s, d):
    return access.replays(_log(s, d), 20 * 86400).select("event_id", "replay")


def _keys(s):
    text = ["ssh-ed25519 AAAA0", "ssh-ed25519 AAAA1", "ssh-ed25519 AAAA2"]
    rows = [(text[0], ["read"], None, None, None, None), (text[1], ["read", "write"], ["1"], None, "2024-01-15 00:00:00", None), (text[2], ["read"], None, ["9"], None, None)]
    t = s.createDataFrame(rows, "public_key string, permissions array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, expires_at string, max_requests_per_hour int")
    return t.withColumns({"expires_at": F.col("expires_at").cast("timestamp_ntz"), "fingerprint": scalars.fingerprint(F.encode("public_key", "utf-8"))})


@query(
    f"""{_F}, q as (select ord event_id, uid, created_at, ord % 4 k, case when ord % 13 = 0 then 'missing_headers' when ord % 17 = 0 or ord % 4 = 3 then 'invalid_sig'
 when ord % 4 = 1 and created_at > timestamp '2024-01-15' then 'expired' when ord % 19 = 0 then 'invalid_sig' when ord % 23 = 0 then 'invalid_sig'
 when (ord % 4 = 1 and not starts_with(uid, '1')) or (ord % 4 = 2 and starts_with(uid, '9')) then 'forbidden' else 'success' end status from files)
 select event_id, status, case status when 'success' then 200 when 'forbidden' then 403 else 401 end http_code from q"""
)
def request_verification(s, d):
    f, n = v.files(s, d), F.col("ord")
    key = F.concat(F.lit("ssh-ed25519 AAAA"), n % 4, F.lit(" someone@host"))
    at = F.when(n % 19 == 0, F.col("created_at") + F.expr("interval 301 seconds")).otherwise(F.col("created_at"))
    requests = f.select(
        n.alias("event_id"), F.col("created_at").alias("ts"), "uid", r.iso_utc(F.col("created_at")).alias("created_at"), F.lit("read").alias("action"),
        F.base64(F.encode(key, "utf-8")).alias("public_key"), F.when(n % 17 == 0, "no base64!").otherwise(F.base64(F.encode(F.when(n % 23 == 0, "bad").otherwise("good"), "utf-8"))).alias("signature"),
        F.when(n % 13 == 0, "").otherwise(r.iso_utc(at)).alias("timestamp"), n.cast("string").alias("nonce"),
    )
    return access.verify(requests, _keys(s), lambda key, signature, text: F.decode(signature, "utf-8") == "good").select("event_id", "status", "http_code")


# --- monitoring


@query("select round(100.0 * count(*) filter (o_orderstatus = 'F') / count(*), 6) success_pct, round(sum(o_custkey)::double / sum(o_orderkey % 50 + 1)::double, 6) files_per_second, round((sum(o_custkey * 1000)::double / 1048576) / sum(o_orderkey % 50 + 1)::double, 6) mib_per_second, round(quantile_cont((o_orderkey % 50 + 1)::double, 0.95), 6) p95_seconds from orders")
def cycle_figures(s, d):
    o = v.table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure")
    return monitoring.cycle_figures(o.select(status.alias("status"), F.col("o_custkey").alias("files"), (F.col("o_custkey") * 1000).alias("bytes"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("seconds")))


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)
