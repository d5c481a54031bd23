"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltbed.functions import routing as r
from siltbed.operators import access, archive, audit, lifecycle, monitoring, planner, resolve
from siltbed.plans import more
from siltbed.plans import views as v
from siltbed.plans.views import BIG, BITS, CUT, MOST, NOW, SQL_FILES, SQL_PAYLOADS, SQL_PLAN, SQL_ROUTED, UNTIL, ntz

_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _files(s, d):
    return v.files(s, d)


def _routed(s, d):
    return planner.route(v.files(s, d), BITS)


def _planned(s, d):
    return planner.plan(_routed(s, d), MOST)


def _index(s, d):
    m = _planned(s, d).withColumn("shard_file", r.shard_file(F.col("date_dir"), F.col("shard_hex"), F.col("shard_seq")))
    return planner.offsets(m).withColumn("length", F.col("size_bytes"))


def _state(s, d, late: int = 0):
    """The watermark ten days into the files' time, or `late` days more; now is the last file's time."""
    until = F.date_trunc("day", F.min("created_at")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(9 + late))
    return _files(s, d).agg(F.lit(1).alias("id"), until.alias("archived_until"), F.max("created_at").alias("now")).withColumn("lag_days", F.lit(7))


_F = f"with files as ({SQL_FILES})"
_S = f"{_F}, state as (select 1 id, date_trunc('day', min(created_at)) + interval 9 day archived_until, max(created_at) now_, 7 lag_days from files), target as (select *, date_trunc('day', now_ - interval 7 day) cut from state)"
_R = f"with {SQL_ROUTED}"
_P = f"with recursive {SQL_ROUTED}, {SQL_PLAN}"
_I = f"{_P}, idx as (select *, date_dir || '_' || shard_hex || '_' || lpad(cast(shard_seq as varchar), 4, '0') || '.des' shard_file, 8 + coalesce(sum(size_bytes) over (partition by date_dir, shard_hex, shard_seq order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from plan)"
_PAY = f"with pay as ({SQL_PAYLOADS})"


@query(f"{_R} select uid, created_at, date_dir, shard_index, shard_hex, object_key from located")
def route_files(s, d):
    return _routed(s, d).select("uid", "created_at", "date_dir", "shard_index", "shard_hex", "object_key")


def _zones(s):
    return s.createDataFrame([("zone-a", 0, 4), ("zone-b", 5, 9), ("zone-c", 10, 15)], "zone string, start int, end int")


@query(f"{_R} select case when shard_index <= 4 then 'zone-a' when shard_index <= 9 then 'zone-b' else 'zone-c' end as zone, count(*) n from located group by 1")
def route_zone(s, d):
    return resolve.zone_of(_routed(s, d), _zones(s)).groupBy("zone").agg(F.count("*").alias("n"))


@query("with z as (select n_nationkey n, n_nationkey % 13 a, n_nationkey % 13 + n_nationkey % 4 b from nation), i as (select unnest(range(0, 17)) x) select x::integer shard_index, count(*) zones from z, i where x between a and b group by x having count(*) > 1 or x > 15")
def zone_overlap_check(s, d):
    at = F.col("n_nationkey").cast("int")
    zones = v.table(s, d, "nation").select(F.concat(F.lit("zone-"), at).alias("zone"), (at % 13).alias("start"), (at % 13 + at % 4).alias("end"))
    return resolve.zone_overlaps(zones, BITS)


@query(f"{_F} select uid, created_at, size_bytes from files where created_at < timestamp '{CUT}' and archived is false order by created_at, uid limit 500")
def fetch_archivable_topn(s, d):
    return archive.fetch(_files(s, d), ntz(CUT), 500).select("uid", "created_at", "size_bytes")


def _stats_sql(cut: str, size: str = "size_bytes") -> str:
    return f"{_F} select count(*) total_files, coalesce(sum({size}), 0)::bigint total_size_bytes, min(created_at) oldest, max(created_at) newest from files where created_at < timestamp '{cut}' and archived is false"


@query(_stats_sql(CUT))
def archive_statistics(s, d):
    return archive.statistics(archive.eligible(_files(s, d), ntz(CUT)))


@query(_stats_sql("2000-01-01"))
def archive_statistics_empty(s, d):
    return archive.statistics(archive.eligible(_files(s, d), ntz("2000-01-01")))


@query(_stats_sql(CUT, "0"))
def archive_statistics_no_size(s, d):
    return archive.statistics(archive.eligible(_files(s, d), ntz(CUT)), with_size=False)


@query(f"{_F} select uid, created_at, file_location from (select *, '/data/' || uid file_location from files) where created_at > timestamp '{UNTIL}' and created_at <= timestamp '{CUT}'")
def window_scan(s, d):
    return archive.in_window(_files(s, d), ntz(UNTIL), ntz(CUT)).select("uid", "created_at", F.concat(F.lit("/data/"), "uid").alias("file_location"))


@query(f"{_F} select uid, created_at from files where created_at > timestamp '{UNTIL}' or (created_at = timestamp '{UNTIL}' and uid > '1') order by created_at, uid limit 100")
def keyset_page(s, d):
    return archive.after_key(_files(s, d), ntz(UNTIL), F.lit("1")).orderBy("created_at", "uid").limit(100).select("uid", "created_at")


_CRC = f"with crc as (select {v._TABLE} t), files as ({SQL_FILES}), c as (select uid, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(uid, ''), lambda x: ord(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) h from files, crc)"


@query(f"{_CRC} select uid from c where h % 4 = 1")
def worker_split(s, d):
    return archive.worker(_files(s, d), 1, 4).select("uid")


@query(f"{_CRC} select count(*) total, count(distinct h % 4) workers, 1::bigint most_workers_of_a_file from c")
def worker_split_complete(s, d):
    """Every file has one worker."""
    f = _files(s, d)
    out = None
    for i in range(4):
        part = archive.worker(f, i, 4).select("ord", F.lit(i).alias("w"))
        out = part if out is None else out.union(part)
    files = out.groupBy("ord").agg(F.count("*").alias("n"), F.min("w").alias("w"))
    return files.agg(F.count("*").alias("total"), F.countDistinct("w").alias("workers"), F.max("n").alias("most_workers_of_a_file"))


@query(f"{_S} select archived_until window_start, greatest(archived_until, cut) window_end, lag_days from target")
def window_compute(s, d):
    return archive.compute_window(_state(s, d), F.col("now")).drop("id")


@query(f"{_S} select id, archived_until + interval 60 day archived_until, lag_days from target")
def watermark_advance_noop(s, d):
    return archive.advance(_state(s, d, 60), archive.compute_window(_state(s, d, 60), F.col("now")))


@query(f"{_S} select id, greatest(archived_until, cut) archived_until, lag_days from target")
def watermark_advance_forward(s, d):
    return archive.advance(_state(s, d), archive.compute_window(_state(s, d), F.col("now")))


@query(f"{_S} select date_diff('second', archived_until, cut) lag_seconds, date_diff('second', archived_until, cut) / 86400.0 lag_days_value from target")
def watermark_lag(s, d):
    return archive.lag(_state(s, d), F.col("now"))


@query(f"{_F} select coalesce(max(case when archived then created_at end), timestamp '{NOW}' - interval 30 day) archived_until from files")
def watermark_seed(s, d):
    return _files(s, d).agg(F.coalesce(F.max(F.when(F.col("archived"), F.col("created_at"))), ntz(NOW) - F.expr("interval 30 days")).alias("archived_until"))


@query(f"{_F} select count(*) total_files, coalesce(sum(size_bytes), 0)::bigint total_size_bytes, min(created_at) oldest, max(created_at) newest from files where created_at > timestamp '{UNTIL}' and created_at <= timestamp '{CUT}'")
def pending_stats(s, d):
    return archive.statistics(archive.in_window(_files(s, d), ntz(UNTIL), ntz(CUT)))


@query(f"{_F} select count(*) total_files, coalesce(sum(size_bytes), 0)::bigint total_size_bytes, min(created_at) oldest, max(created_at) newest from files where created_at <= timestamp '{UNTIL}'")
def archived_stats(s, d):
    return archive.statistics(_files(s, d).where(F.col("created_at") <= ntz(UNTIL)))


@query(f"{_F} select round(avg(size_bytes), 6) avg_size, round(sum(size_bytes) / (50.0 * 1048576), 6) estimated_seconds from files where created_at > timestamp '{UNTIL}' and created_at <= timestamp '{CUT}'")
def pending_derived(s, d):
    return archive.in_window(_files(s, d), ntz(UNTIL), ntz(CUT)).agg(F.round(F.avg("size_bytes"), 6).alias("avg_size"), F.round(F.sum("size_bytes").cast("double") / (50.0 * 1048576), 6).alias("estimated_seconds"))


@query(f"{_F} select case when created_at <= timestamp '{UNTIL}' then 'archived' else 'pending' end status, count(*) n, sum(size_bytes)::bigint bytes from files group by 1")
def archived_status_case(s, d):
    status = F.when(F.col("created_at") <= ntz(UNTIL), "archived").otherwise("pending")
    return _files(s, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(f"{_F} select cast(created_at as date) as day, count(*) n, sum(size_bytes)::bigint bytes from files where created_at > timestamp '{UNTIL}' - interval 30 day and created_at <= timestamp '{UNTIL}' group by 1 order by 1 desc limit 30")
def daily_rollup(s, d):
    rows = archive.in_window(_files(s, d), ntz(UNTIL) - F.expr("interval 30 days"), ntz(UNTIL))
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("day")).limit(30)


@query(f"{_F} select uid, case when created_at <= timestamp '{UNTIL}' then true else archived end archived from files")
def hybrid_flag_update(s, d):
    return _files(s, d).select("uid", F.when(F.col("created_at") <= ntz(UNTIL), True).otherwise(F.col("archived")).alias("archived"))


@query(f"{_F} select uid, case when ord % 10 = 0 then true else archived end archived from files")
def mark_archived(s, d):
    f = _files(s, d)
    return archive.mark(f, f.where("ord % 10 = 0")).select("uid", "archived")


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def duplicates_having(s, d):
    return v.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_LAST = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) n from lineitem) where n = 1")
def dedupe_keep_latest(s, d):
    order = [F.desc(c.strip()) for c in _LAST.split(",")]
    return archive.keep_latest(v.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], *order).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


@query(f"{_R} select date_dir, shard_hex, (sum(size_bytes)::bigint + {MOST - 1}) // {MOST} estimated_shards from located group by 1, 2")
def estimate_shards(s, d):
    return planner.estimate(_routed(s, d), MOST)


@query(f"{_P} select date_dir, shard_hex, uid, size_bytes, shard_seq from plan")
def pack_plan(s, d):
    return _planned(s, d).select("date_dir", "shard_hex", "uid", "size_bytes", "shard_seq")


@query(f"{_P} select date_dir, shard_hex, shard_seq, count(*) file_count, sum(size_bytes)::bigint total_size, date_dir || '_' || shard_hex || '_' || lpad(cast(shard_seq as varchar), 4, '0') || '.des' shard_file from plan group by 1, 2, 3")
def pack_manifest(s, d):
    return planner.manifest(_planned(s, d))


@query(f'{_I} select shard_file, uid, "offset", size_bytes from idx')
def shard_offsets(s, d):
    return _index(s, d).select("shard_file", "uid", "offset", "size_bytes")


@query(f"{_PAY} select uid, size_bytes > {BIG} is_bigfile, case when size_bytes > {BIG} then sha256(payload) end bigfile_hash, case when size_bytes > {BIG} then 0 else size_bytes end::bigint inline_bytes from pay")
def bigfile_split(s, d):
    return audit.split_bigfiles(v.payloads(s, d), BIG).select("uid", "is_bigfile", "bigfile_hash", F.col("inline_bytes").cast("long").alias("inline_bytes"))


@query(f'{_PAY} select sha256(payload) bigfile_hash, count(*) "references", min(size_bytes) bigfile_size from pay where size_bytes > {BIG} group by 1')
def bigfile_dedupe(s, d):
    return audit.bigfile_uploads(audit.split_bigfiles(v.payloads(s, d), BIG))


@query(f"{_F} select uid, lower(regexp_extract(uid, '[^/](\\.[^./]+)$', 1)) not in ('.jpg', '.jpeg', '.png', '.gif', '.gz', '.zip', '.bz2', '.xz') compressible from files")
def compressible_flag(s, d):
    return _files(s, d).select("uid", r.should_compress(F.col("uid")).alias("compressible"))


_ISO = "case when epoch_us(created_at) % 1000000 = 0 then strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') else strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') end"


@query(f"{_F} select uid || ':' || {_ISO} meta_key, '_ext_retention/' || strftime(created_at, '%Y%m%d') || '/' || uid || '_' || {_ISO} || '.dat' ext_key from files")
def metadata_keys(s, d):
    return _files(s, d).select(r.metadata_key(F.col("uid"), F.col("created_at")).alias("meta_key"), r.ext_key(F.col("uid"), F.col("created_at")).alias("ext_key"))


@query(f"{_PAY} select uid, sha256(payload) checksum from pay")
def checksum_rebuild(s, d):
    return v.payloads(s, d).select("uid", F.sha2("payload", 256).alias("checksum"))


@query(f"{_PAY} select case when doc_id % 7 = 0 then 'missing_checksum' when doc_id % 11 = 0 then 'corrupted' else 'verified' end status, count(*) n from pay group by 1")
def checksum_audit(s, d):
    p = v.payloads(s, d)
    stored = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "0").otherwise(F.sha2("payload", 256))
    return audit.checksum_audit(p, p.select("uid", "created_at", stored.alias("checksum"))).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_PAY} select uid, 'missing_in_meta' side from pay where doc_id % 37 = 0 union all select 'extra-' || doc_id, 'missing_in_shard' from pay where doc_id % 101 = 0")
def index_vs_metadata(s, d):
    p = v.payloads(s, d)
    meta = p.where("doc_id % 37 <> 0").select("uid").union(p.where("doc_id % 101 = 0").select(F.concat(F.lit("extra-"), "doc_id")))
    return audit.differences(p, meta)


def _requests(s, d):
    f = _files(s, d)
    at = F.when(F.col("ord") % 7 == 0, F.col("created_at") + F.expr("interval 1 day")).otherwise(F.col("created_at"))
    uid = F.when(F.col("ord") % 19 == 0, F.concat(F.lit("unknown-"), "uid")).otherwise(F.col("uid"))
    return planner.route(f.select(uid.alias("uid"), at.alias("created_at"), F.col("ord").alias("req_id")), BITS)


_REQ = f"""{_I}, req0 as (select case when ord % 19 = 0 then 'unknown-' || uid else uid end uid, case when ord % 7 = 0 then created_at + interval 1 day else created_at end created_at, ord req_id from f),
 req as (select *, strftime(created_at, '%Y%m%d') date_dir from req0), hits as (select date_dir, uid, min(shard_file) shard_file from idx group by 1, 2), found as (select req.*, hits.shard_file from req left join hits using (date_dir, uid))"""


@query(f"{_REQ} select req_id, shard_file from found")
def lookup_local(s, d):
    return resolve.lookup(_requests(s, d), _index(s, d)).select("req_id", "shard_file")


@query(f"{_REQ} select req_id from found where shard_file is not null")
def lookup_exists(s, d):
    return resolve.exists(_requests(s, d), _index(s, d)).select("req_id")


_RES = f"{_REQ}, t as (select distinct uid, created_at from f where ord % 17 = 0), e as (select distinct uid, created_at from f where ord % 13 = 0), st as (select req_id, case when shard_file is not null and t.uid is not null then 'deleted' when e.uid is not null then 'ext_retention' when shard_file is not null then 'shard' else 'not_found' end status from found left join t using (uid, created_at) left join e using (uid, created_at))"


@query(f"{_RES} select req_id, status, case status when 'deleted' then 410 when 'not_found' then 404 else 200 end http_code from st")
def lookup_resolve(s, d):
    f = _files(s, d)
    return resolve.resolve(_requests(s, d), _index(s, d), f.where("ord % 17 = 0"), f.where("ord % 13 = 0")).select("req_id", "status", "http_code")


@query(f"{_F} select uid, created_at, case when ord % 34 = 0 then 'again' else 'first' end reason from files where ord % 17 = 0")
def tombstone_upsert(s, d):
    f = _files(s, d).where("ord % 17 = 0").select("uid", "created_at", "ord")
    old = f.select("uid", "created_at", F.lit("first").alias("reason"), F.col("created_at").alias("deleted_at"))
    new = f.where("ord % 34 = 0").select("uid", "created_at", F.lit("again").alias("reason"), (F.col("created_at") + F.expr("interval 1 day")).alias("deleted_at"))
    return lifecycle.upsert(old, new, ["uid", "created_at"], "deleted_at").select("uid", "created_at", "reason")


@query(f"{_I} select shard_file, count(*) entries, count(*) filter (ord % 17 = 0) deleted_files, count(*) filter (ord % 17 = 0) / count(*) deletion_ratio from idx group by 1")
def tombstone_stats(s, d):
    return lifecycle.tombstone_stats(_index(s, d), _files(s, d).where("ord % 17 = 0"))


@query(f"{_F} select uid, created_at, case when ord % 5 = 0 then 'rejected' when ord % 13 = 0 then 'updated' else 'moved' end as action from files where ord % 3 = 0")
def retention_upsert(s, d):
    f = _files(s, d)
    due = F.when(F.col("ord") % 5 == 0, ntz("2023-01-01 00:00:00")).otherwise(ntz("2030-01-01 00:00:00"))
    return lifecycle.retention_upsert(f.where("ord % 13 = 0"), f.where("ord % 3 = 0").select("uid", "created_at", due.alias("due_date")), ntz(NOW)).select("uid", "created_at", "action")


@query(f'{_I} select shard_file, uid, 8 + coalesce(sum(size_bytes) over (partition by shard_file order by "offset", uid rows between unbounded preceding and 1 preceding), 0)::bigint new_offset from idx where ord % 17 <> 0')
def repack_after_delete(s, d):
    return lifecycle.repack(_index(s, d), _files(s, d).where("ord % 17 = 0")).select("shard_file", "uid", "new_offset")


@query(f"{_P}, m as (select count(*) n, sum(size_bytes)::bigint b from plan group by date_dir, shard_hex, shard_seq) select sum(n)::bigint files, count(*) shards, sum(b)::bigint bytes, round(sum(n) / count(*), 6) object_reduction, round(100.0 * sum(b)::double / sum(ceil(b / 4096.0) * 4096)::double, 6) efficiency_pct, round(avg(b), 6) mean_shard from m")
def storage_efficiency(s, d):
    return audit.efficiency(planner.manifest(_planned(s, d)))


def _business(s, d):
    o, l, c = (v.table(s, d, t) for t in ("orders", "lineitem", "customer"))
    history = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("extension_count"))
    return o.join(history, "o_orderkey", "left").join(c, o.o_custkey == c.c_custkey, "left")


@query("select o_orderkey uid, o_custkey case_number, c_mktsegment department, coalesce(n, 0) extension_count from orders left join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey")
def files_with_retention(s, d):
    return _business(s, d).select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("case_number"), F.col("c_mktsegment").alias("department"), F.coalesce("extension_count", F.lit(0)).alias("extension_count"))


@query("select l_orderkey uid, count(*) extension_count from orders join lineitem on l_orderkey = o_orderkey group by 1 order by 2 desc, 1 limit 10")
def most_extended_top10(s, d):
    o, l = v.table(s, d, "orders"), v.table(s, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy(F.col("l_orderkey").alias("uid")).agg(F.count("*").alias("extension_count")).orderBy(F.desc("extension_count"), "uid").limit(10)


@query("select o_orderstatus status, count(*) n, round(sum(o_totalprice)::double, 2) total from orders group by 1")
def storage_by_status(s, d):
    return v.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))


@query("select count(*) n, count(case when o_orderstatus = 'F' then 1 end) finished, count(*) filter (o_orderstatus = 'O') open from orders")
def conditional_counts(s, d):
    return v.table(s, d, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("select o_orderkey uid, o_orderdate from orders where o_orderstatus = 'O' and o_custkey % 7 = 0 order by o_orderdate desc, o_orderkey limit 50")
def list_files_filtered(s, d):
    return v.table(s, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 7 == 0)).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("uid"), "o_orderdate")


_DUE = "greatest(0, floor(date_diff('second', timestamp '1998-01-01', cast(o_orderdate as timestamp) + interval 365 day) / 86400.0))::bigint"


def _days(at: str):
    due = F.unix_seconds((F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 365 days")).cast("timestamp"))
    return F.greatest(F.lit(0), F.floor((due - F.unix_seconds(F.lit(at).cast("timestamp"))) / 86400)).cast("long")


@query(f"select o_orderkey uid, {_DUE} days_left from orders")
def days_until_expiration(s, d):
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("uid"), _days("1998-01-01").alias("days_left"))


@query(f"select count(*) n from orders where o_orderstatus = 'O' and {_DUE} between 1 and 30")
def expiring_soon(s, d):
    return v.table(s, d, "orders").where((F.col("o_orderstatus") == "O") & _days("1998-01-01").between(1, 30)).agg(F.count("*").alias("n"))


@query("select l_orderkey, l_shipdate, lag(l_shipdate) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey) previous from lineitem")
def retention_history_lag(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey")
    return v.table(s, d, "lineitem").select("l_orderkey", "l_shipdate", F.lag("l_shipdate").over(w).alias("previous"))


@query(f"{_F} select case when ord % 23 = 0 then 'missing' when ord % 29 = 0 then 'size_mismatch' else 'ok' end status, count(*) n from files group by 1")
def validate_sources(s, d):
    f = _files(s, d).withColumn("file_location", F.concat(F.lit("/data/"), "uid"))
    listing = f.where("ord % 23 <> 0").select(F.col("file_location").alias("path"), F.when(F.col("ord") % 29 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("length"))
    return archive.validate(f, listing).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_F} select count(*) files_processed, count(*) filter (ord % 23 <> 0) files_migrated, count(*) filter (ord % 23 = 0) files_failed, sum(case when ord % 23 <> 0 then size_bytes end)::bigint total_size_bytes from files")
def cycle_result(s, d):
    f = _files(s, d).withColumn("file_location", F.concat(F.lit("/data/"), "uid"))
    return archive.cycle(archive.validate(f, f.where("ord % 23 <> 0").select(F.col("file_location").alias("path"), F.col("size_bytes").alias("length"))))


def _log(s, d):
    return _files(s, d).select(F.col("user_id").cast("long").alias("key"), F.col("created_at").alias("ts"), "uid", F.col("event_type").alias("action"), F.col("ord").alias("event_id"), (F.col("ord") % 5000).cast("long").alias("nonce"))


@query(f"{_F} select ord event_id, (user_id % 4 = 0 or event_type = 'click') and (user_id % 4 < 2 or starts_with(uid, 'click')) and not (user_id % 4 = 1 and starts_with(uid, 'view')) allowed from files")
def permission_check(s, d):
    log = _log(s, d)
    actions = F.when(F.col("key") % 4 == 0, F.array(F.col("action"))).otherwise(F.array(F.lit("click")))
    allow = F.when(F.col("key") % 4 < 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("click")))
    deny = F.when(F.col("key") % 4 == 1, F.array(F.lit("view"))).otherwise(F.array().cast("array<string>"))
    return log.select("event_id", access.allowed(F.col("uid"), F.col("action"), actions, allow, deny).alias("allowed"))


@query(f"{_F} select ord event_id, case when ord % 31 = 0 then 401 when ord % 37 = 0 then 403 else 200 end http_code from files")
def access_status(s, d):
    status = F.when(F.col("event_id") % 31 == 0, "expired").when(F.col("event_id") % 37 == 0, "forbidden").otherwise("success")
    return _log(s, d).select("event_id", access.http_code(status).alias("http_code"))


_M = f"{_F}, m as (select event_type as name, created_at ts, ord event_id, value, ord % 1000 + 1 as counter from files)"


def _metrics(s, d):
    return _files(s, d).select(F.col("event_type").alias("name"), F.col("created_at").alias("ts"), F.col("ord").alias("event_id"), "value", (F.col("ord") % 1000 + 1).alias("counter"))


@query(f"{_M}, x as (select *, lag(counter) over (partition by name order by ts, event_id) b from m) select name, sum(case when b is null then 0 when counter < b then counter else counter - b end)::bigint as increase, round(sum(case when b is null then 0 when counter < b then counter else counter - b end)::double / (floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint), 6) rate from x group by name")
def metric_rate(s, d):
    return monitoring.increase(_metrics(s, d))


@query(f"{_M} select round(count(*) filter (name = 'click') / nullif(count(*) filter (name in ('click', 'view')), 0), 6) ratio from m")
def hit_ratio(s, d):
    hits, all_ = F.count_if(F.col("name") == "click"), F.count_if(F.col("name").isin("click", "view"))
    return _metrics(s, d).agg(F.round(F.try_divide(hits, all_), 6).alias("ratio"))


_BOUNDS = [1, 5, 10, 30, 60, 120, 300]


@query(f"{_M}, b as (select unnest([1::double, 5, 10, 30, 60, 120, 300, 'inf'::double]) le) select name, le, count(*) filter (value <= le)::bigint n from m, b group by 1, 2")
def histogram_buckets(s, d):
    return monitoring.histogram(_metrics(s, d), _BOUNDS)


@query(f"{_M}, b as (select unnest([1::double, 5, 10, 30, 60, 120, 300, 'inf'::double]) le), h as (select name, le, count(*) filter (value <= le) n from m, b group by 1, 2), x as (select *, coalesce(lag(le) over w, 0) low, coalesce(lag(n) over w, 0) before, max(n) over (partition by name) total from h window w as (partition by name order by le)) select name, round(min(case when le = 'inf'::double then low else low + (le - low) * (total * 0.95 - before) / (n - before) end)::double, 6) as quantile from x where n >= total * 0.95 and before < total * 0.95 group by name")
def histogram_quantile(s, d):
    return monitoring.histogram_quantile(monitoring.histogram(_metrics(s, d), _BOUNDS), 0.95)


@query(f"{_M} select name, count(*) n, round(sum(value)::double, 4) total from m group by 1")
def sum_by(s, d):
    return _metrics(s, d).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{_M}, x as (select *, lag(value) over (partition by name order by ts, event_id) b from m) select name, count(*) filter (value <> b) changes from x group by 1")
def stall_detect(s, d):
    return monitoring.changes(_metrics(s, d))


@query(f"{_M}, x as (select *, sum(case when value > 60 then 0 else 1 end) over (partition by name order by ts, event_id) i from m) select name, min(ts) since, max(ts) until, count(*) samples from x where value > 60 group by name, i having floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 600")
def held_above(s, d):
    return monitoring.held_above(_metrics(s, d), 60, 600)


def queries():
    return _Q | more.queries()


def oracle_sql():
    return _SQL | more.oracle_sql()
