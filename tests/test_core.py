import base64
import hashlib
import struct
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.functions import routing as r
from siltbed.functions import signatures
from siltbed.operators import access, archive, metrics, monitoring, planner, report
from siltbed.sources import config, datasource, files, retention, shard_format, shards, sidecar, tables
from siltbed.sources.state import State
from siltbed.streaming import cycle
from siltbed.streaming.packing import pack_stream


def test_routing_values(spark):
    rows = spark.createDataFrame([("12345", 8), ("abc123", 8), ("12\n", 8)], "uid string, n int")
    assert [x[0] for x in rows.select(r.shard_index(F.col("uid"), 8)).collect()][:2] == [57, 92]
    assert spark.range(1).select(r.shard_hex(F.lit(4095), 12), r.shard_hex(F.lit(1023), 10), r.shard_hex(F.lit(57), 8)).first()[:] == ("FFF", "3FF", "39")
    for bad in (3, 24):
        with pytest.raises(ValueError):
            r.check_bits(bad)


def test_next_fit(spark):
    rows = [(str(100 + 256 * i), f"2024-01-01 0{i}:00:00", s, i) for i, s in enumerate([60, 60, 30, 10, 200, 1])]
    files = spark.createDataFrame(rows, "uid string, created_at string, size_bytes long, ord long").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    out = planner.plan(planner.route(files, 8), 100).orderBy("ord").collect()
    assert [x.shard_seq for x in out] == [0, 1, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        planner.plan(planner.route(files, 8), 0)
    with pytest.raises(Exception, match="negative"):
        planner.plan(planner.route(files.withColumn("size_bytes", F.lit(-1)), 8), 100).collect()


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.text("abc123_-", min_size=1, max_size=8), st.binary(max_size=128), max_size=8))
def test_shard_round_trip(files):
    shard, big = shard_format.write(((u, d, {"n": 1}) for u, d in files.items()), threshold=64)
    assert {u: shard_format.read(shard, u, big) for u in files} == files
    for broken in (shard[:-1], b"XXXX" + shard[4:], shard[:-13]):
        with pytest.raises(ValueError):
            shard_format.read_index(broken)


def legacy_shard(rows, codec=0):
    """A version 1 shard, written by hand: no flags, no notes."""
    body, index, at = b"", b"", 8
    for uid, data in rows:
        packed = shard_format.packed(data, shard_format.NAMES[codec])
        index += struct.pack("<H", len(uid.encode())) + uid.encode() + struct.pack("<QQBQQ", at, len(packed), codec, len(packed), len(data))
        body, at = body + packed, at + len(packed)
    index = struct.pack("<I", len(rows)) + index
    return b"DES2\x01\0\0\0" + body + index + b"DESI" + struct.pack("<Q", len(index))


@pytest.mark.parametrize("codec", [0, 1, 2])
def test_legacy_shard(codec):
    rows = [("a", b"hello" * 20), ("né", b""), ("a", b"later wins")]
    shard = legacy_shard(rows, codec)
    assert shard_format.read(shard, "a") == b"later wins" and shard_format.read(shard, "né") == b""
    assert shard_format.read_index(shard)["a"]["meta"] == {}


def test_version_2_layout():
    """Byte for byte, from the layout as it is published."""
    shard, big = shard_format.write([("u", b"xyz", {"k": 1}), ("b", b"0123456789", None)], threshold=5, codec="none")
    digest = hashlib.sha256(b"0123456789").hexdigest()
    index = struct.pack("<I", 2) + struct.pack("<H1sBQQBQQI", 1, b"u", 0, 8, 3, 0, 3, 3, 7) + b'{"k":1}' + struct.pack("<H1sBH64sQI", 1, b"b", 1, 64, digest.encode(), 10, 0)
    assert shard == b"DES2\x02\0\0\0" + b"xyz" + index + b"DESI" + struct.pack("<Q", len(index)) and big == {digest: b"0123456789"}


@pytest.mark.parametrize("profile", sorted(shard_format.PROFILES))
def test_profiles(profile):
    codec, level = shard_format.PROFILES[profile]
    shard, _ = shard_format.write([("a.txt", b"text " * 500, None), ("a.jpg", b"x" * 90, None)], codec=codec, level=level, compress=lambda u: not u.endswith(".jpg"))
    index = shard_format.read_index(shard)
    assert index["a.txt"]["codec"] == codec and index["a.txt"]["length"] < 500 and index["a.jpg"]["codec"] == "none"
    assert shard_format.read(shard, "a.txt") == b"text " * 500
    broken = bytearray(shard)
    broken[12] ^= 255
    with pytest.raises(ValueError):
        shard_format.read(bytes(broken), "a.txt")


def test_ranges(tmp_path):
    """Header, footer and index cost three reads, a payload one more."""
    shard, _ = shard_format.write([(str(i), bytes([i]) * 1000, None) for i in range(50)])
    (tmp_path / "x.des").write_bytes(shard)
    with files.Ranges(f"file://{tmp_path}/x.des") as ranges:
        index = shard_format.fetch_index(ranges, ranges.size)
        assert ranges.calls == 3 and len(index) == 50
        assert shard_format.fetch(ranges, index["7"]) == b"\7" * 1000 and ranges.calls == 4


def test_files():
    assert files.bucket_and_key("s3://b/a/c.txt") == ("b", "a/c.txt") and files.is_s3("s3://b/k") and not files.is_s3("/data")
    for bad in ("s3://b", "s3:///k", "/x", "s3://b/k?x=1", "s3://b/k#f"):
        with pytest.raises(ValueError):
            files.bucket_and_key(bad)
    assert [files.prefix(x) for x in ("", "a", "a/")] == ["", "a/", "a/"]
    waits, calls = [], []

    def call(e):
        calls.append(1)
        if len(calls) < 3:
            raise e
        return "done"

    assert files.retried(lambda: call(OSError("SlowDown")), sleep=waits.append) == "done" and waits == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        files.retried(lambda: call(OSError("NoSuchKey")), sleep=waits.append)
    assert len(calls) == 1


@pytest.fixture
def listed(spark, tmp_path):
    """Files of two days and their sources: text, an image, a large one twice."""
    contents = {"1": b"one " * 40, "257": b"two", "a.jpg": b"\xff" * 60, "513": b"L" * 500, "b.bin": b"L" * 500, "769": b""}
    rows = []
    for i, (uid, data) in enumerate(contents.items()):
        (tmp_path / f"src{i}").write_bytes(data)
        rows.append((uid, f"2024-01-0{1 + i % 2} 0{i}:00:00.5", len(data), f"file://{tmp_path}/src{i}", i))
    table = spark.createDataFrame(rows, "uid string, created_at string, size_bytes long, source_path string, ord long")
    return table.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), contents


def test_pack_and_read_back(spark, tmp_path, listed):
    table, contents = listed
    folder = f"file://{tmp_path}/out"
    made = shards.pack(table, folder, most=200, threshold=400).collect()
    assert sum(m["file_count"] for m in made) == 6 and len({d for m in made for d in m["bigfiles"]}) == 1
    assert len(list((tmp_path / "out" / "_bigFiles").iterdir())) == 1  # equal contents are stored once
    listing = shards.list_shards(spark, folder)
    assert {r["shard_file"] for r in listing.collect()} == {m["shard_file"] for m in made}
    back = {r["uid"]: bytes(r["payload"]) for r in shards.read_payloads(shards.read_entries(listing)).collect()}
    assert back == contents
    key = made[0]["shard_file"].split("_")
    assert shards.list_shards(spark, folder, key[0], key[1]).count() < listing.count()
    assert bytes(shards.lookup(spark, folder, "257", "2024-01-02T00:00:00Z").first()["payload"]) == b"two"
    assert shards.lookup(spark, folder, "257", "2024-01-01").count() == 0
    (tmp_path / "out" / "20240109_00_0000.des").write_bytes(legacy_shard([("old", b"v1")]))
    assert shards.read_payloads(shards.read_entries(shards.list_shards(spark, folder, "20240109"))).first()["payload"] == b"v1"
    with pytest.raises(Exception, match="source_path is missing"):
        shards.read_sources(table.withColumn("source_path", F.lit(None).cast("string"))).collect()
    assert shards.pack(table.limit(0), f"{folder}2").count() == 0


def test_sidecars(spark, tmp_path, listed):
    table, contents = listed
    folder = f"file://{tmp_path}/out"
    shards.pack(table, folder, most=200, threshold=400).collect()
    listing = shards.list_shards(spark, folder)
    assert sidecar.missing(listing, shards.list_sidecars(spark, folder)).count() == listing.count()
    rebuilt = sidecar.entries_of(shards.read_payloads(shards.read_entries(listing))).withColumn("shard_size", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "shard_file string, key string, deleted_at string, deleted_by string, reason string, ticket_id string")
    sidecar.write(sidecar.to_json(rebuilt, none, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), folder).collect()
    assert sidecar.missing(listing, shards.list_sidecars(spark, folder)).count() == 0
    got = {r["uid"]: r for r in sidecar.explode_entries(sidecar.read(spark, folder)).collect()}
    assert {u: r["checksum"] for u, r in got.items()} == {u: hashlib.sha256(x).hexdigest() for u, x in contents.items()}
    assert got["1"]["key"] == "1:2024-01-01T00:00:00.500000Z" and str(got["1"]["created_at"]) == "2024-01-01 00:00:00.500000"
    for bad in ('{"version": 1}', "[]", '{"version": 1, "shard_file": "x", "shard_size": -1, "created_at": "2024-01-01", "last_updated": "2024-01-01", "index": {}, "tombstones": {}}'):
        with pytest.raises(Exception):
            sidecar.parse(spark.createDataFrame([(bad,)], "json string")).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"uid": "a", "created_at": "2024-01-01T01:00:00+02:00", "size_bytes": "5"}, {"uid": 2, "created_at": "2024-01-02T00:00:00Z", "size_bytes": 7, "source_path": "/x"}]')
    rows = shards.read_manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r["uid"], str(r["created_at"]), r["size_bytes"], r["source_path"]) for r in rows] == [("a", "2023-12-31 23:00:00", 5, None), ("2", "2024-01-02 00:00:00", 7, "/x")]


def test_clock_of_the_session(spark):
    """Days and texts are of UTC, whatever the session's zone, also where its clock jumps."""
    at = ["2024-01-01 01:00:00Z", "2024-03-10 07:30:00Z", "2024-03-10 02:30:00Z", "2024-11-03 05:30:00Z", "2024-11-03 06:30:00.25Z"]
    want = [("20240101", "2024-01-01T01:00:00Z"), ("20240310", "2024-03-10T07:30:00Z"), ("20240310", "2024-03-10T02:30:00Z"), ("20241103", "2024-11-03T05:30:00Z"), ("20241103", "2024-11-03T06:30:00.250000Z")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = spark.createDataFrame([(x, x[:-1]) for x in at], "a string, n string").select(F.col("a").cast("timestamp").alias("a"), F.col("n").cast("timestamp_ntz").alias("n"))
            assert [tuple(r) for r in rows.select(r.date_dir(F.col("a")), r.iso_utc(F.col("a"))).collect()] == want
            assert [tuple(r) for r in rows.select(r.date_dir(F.col("n")), r.iso_utc(F.col("n"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unknown_sizes(spark):
    rows = spark.createDataFrame([("1", "2024-01-01", None, 0), ("1", "2024-01-01", "60", 1), ("1", "2024-01-01", "60", 2)], "uid string, created_at string, size_bytes string, ord long").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert [x["shard_seq"] for x in planner.plan(planner.route(rows), 100).orderBy("ord").collect()] == [0, 0, 1]


def test_coercion(spark):
    rows = spark.createDataFrame([(7, "2024-01-01T00:00:00+01:00", "12")], "uid int, created_at string, size_bytes string")
    assert tuple(map(str, archive.coerce(rows, strict=False).first())) == ("7", "2023-12-31 23:00:00", "12")
    with pytest.raises(TypeError):
        archive.coerce(rows)
    with pytest.raises(Exception, match="uid"):
        archive.coerce(rows.withColumn("uid", F.lit(1.5)), strict=False).collect()
    with pytest.raises(Exception, match="not a time"):
        archive.coerce(rows.withColumn("created_at", F.lit("soon")), strict=False).collect()
    assert r.check_index(255) == 255
    for bad in (-1, 256):
        with pytest.raises(ValueError):
            r.check_index(bad)


def test_configuration(spark, tmp_path):
    assert config.substitute({"a": ["${X}-${Y:dflt}", 3], "b": "${Z:}"}, {"X": "1"}) == {"a": ["1-dflt", 3], "b": ""}
    for bad in ("${X}", "${X:1"):
        with pytest.raises(ValueError):
            config.substitute(bad, {})
    (tmp_path / "m.yaml").write_text("database: {url: '${URL:sqlite}'}\n")
    assert config.load_migration(tmp_path / "m.yaml", {}) == {"database": {"url": "sqlite"}}
    (tmp_path / "z.json").write_text('{"zones": [{"name": "a", "range": {"start": 0, "end": 127}, "s3": {"bucket": "b"}}, {"name": "c", "range": {"start": 128, "end": 255}, "s3": {"bucket": "d", "prefix": "p"}}]}')
    n_bits, zones = config.load_zones(spark, tmp_path / "z.json")
    assert n_bits == 8 and [tuple(z) for z in zones.collect()] == [("a", 0, 127, "b", "", None, None), ("c", 128, 255, "d", "p", None, None)]
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.json")
    for name, text in (("l.json", "[]"), ("x.toml", ""), ("q.json", '{"zones": [{"name": 1}]}'), ("r.json", "{}")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            config.load_zones(spark, tmp_path / name)
    (tmp_path / "k.yml").write_text("authorized_keys:\n- public_key: ssh-ed25519 AAAA someone\n  permissions: [read]\n  expires_at: '2024-01-01T00:00:00Z'\n  max_requests_per_hour: 5\n")
    key = config.load_keys(spark, tmp_path / "k.yml").first()
    assert key["public_key"] == "ssh-ed25519 AAAA" and key["fingerprint"] == "SHA256:" + base64.b64encode(hashlib.sha256(b"ssh-ed25519 AAAA").digest()).decode().rstrip("=")
    for bad in ({"public_key": 1}, {"public_key": "ssh-rsa A", "permissions": "read"}, {"public_key": "ssh-rsa A", "max_requests_per_hour": 0}, {"public_key": "ssh-rsa A", "expires_at": 7}, {"public_key": "ssh-rsa A", "allowed_prefixes": [1]}):
        with pytest.raises(ValueError):
            config.keys(spark, {"authorized_keys": [bad]})


def test_state(spark, tmp_path):
    now = lambda text: F.lit(text).cast("timestamp_ntz")
    state = State(spark, f"file://{tmp_path}/state")
    with pytest.raises(RuntimeError):
        state.get()
    state.ensure(now("2024-01-01"), 3)
    state.ensure(now("2030-01-01"), 9)
    assert state.get().first()["lag_days"] == 3
    assert str(state.advance(state.window(now("2024-01-10 05:00:00"))).first()["archived_until"]) == "2024-01-07 00:00:00"
    version = state.version()
    assert str(state.advance(state.window(now("2024-01-05"))).first()["archived_until"]) == "2024-01-07 00:00:00" and state.version() == version
    assert str(state.adjust(days=-2).first()["archived_until"]) == "2024-01-05 00:00:00"
    assert str(state.adjust(to=now("2024-02-01")).first()["archived_until"]) == "2024-02-01 00:00:00"
    with pytest.raises(ValueError):
        state.adjust()
    assert str(state.mark_day(now("2024-03-01 12:00:00"), now("2024-01-01"), 3).first()["archived_until"]) == "2024-02-27 00:00:00"


def test_cycles(spark, tmp_path, listed):
    table, contents = listed
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    state = State(spark, f"file://{tmp_path}/state")
    state.ensure(F.lit("2023-12-31").cast("timestamp_ntz"), 3)
    made = cycle.by_watermark(table, state, now, f"file://{tmp_path}/wm", most=200)
    assert made.agg(F.sum("file_count")).first()[0] == 3 and str(state.get().first()["archived_until"]) == "2024-01-02 00:00:00"
    assert cycle.by_watermark(table, state, now, f"file://{tmp_path}/wm", most=200) is None
    flagged = table.withColumn("archived", F.lit(False)).withColumn("file_location", F.col("source_path"))
    listing = flagged.where("uid <> '257'").select(F.col("file_location").alias("path"), F.col("size_bytes").alias("length"))
    counters, marked = cycle.by_flag(flagged, F.lit("2024-02-01").cast("timestamp_ntz"), listing, f"file://{tmp_path}/flag", most=200, cleanup=True)
    got = counters.first()
    assert (got["files_processed"], got["files_migrated"], got["files_failed"]) == (6, 5, 1) and got["shards_created"] > 0
    assert {r["uid"] for r in marked.where("archived").collect()} == set(contents) - {"257"}
    assert not (tmp_path / "src0").exists() and (tmp_path / "src1").exists()  # the file that failed keeps its source
    stop, runs = threading.Event(), []

    def one():
        runs.append(1)
        if len(runs) == 3:
            stop.set()
        if len(runs) == 2:
            raise OSError("once")

    errors = []
    assert cycle.repeated(one, 0, stop, errors.append) == 3 and len(errors) == 1


def test_ed25519():
    """The second test of RFC 8032, section 7.1."""
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    good = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    text = "ssh-ed25519 " + base64.b64encode(struct.pack(">I11sI", 11, b"ssh-ed25519", 32) + key).decode()
    assert signatures.verify(text, good, b"\x72") and not signatures.verify(text, good, b"\x73")
    assert not signatures.verify(text, good[:-1] + b"\1", b"\x72") and not signatures.verify("ssh-ed25519 AAAA", good, b"") and not signatures.verify("x", good, b"")


def test_rsa_and_ecdsa():
    """Signatures made here from private numbers, by the textbook."""
    p, q, e, text = 2**521 - 1, 2**607 - 1, 65537, b"message"
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8
    tail = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(text).digest()
    signed = pow(int.from_bytes(b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail), d, n).to_bytes(size)
    pack = lambda *parts: b"".join(struct.pack(">I", len(x)) + x for x in parts)
    number = lambda x: x.to_bytes(x.bit_length() // 8 + 1)
    key = "ssh-rsa " + base64.b64encode(pack(b"ssh-rsa", number(e), number(n))).decode()
    assert signatures.verify(key, signed, text) and not signatures.verify(key, signed, b"other")
    secret, k, order = 123456789, 987654321, signatures._N256
    at = signatures._p256_times(k, signatures._G256)
    rr = at[0] % order
    ss = pow(k, -1, order) * (int.from_bytes(hashlib.sha256(text).digest()) + rr * secret) % order
    der = b"".join(b"\x02" + bytes([len(number(x))]) + number(x) for x in (rr, ss))
    point = signatures._p256_times(secret, signatures._G256)
    key = "ecdsa-sha2-nistp256 " + base64.b64encode(pack(b"ecdsa-sha2-nistp256", b"nistp256", b"\4" + point[0].to_bytes(32) + point[1].to_bytes(32))).decode()
    assert signatures.verify(key, b"\x30" + bytes([len(der)]) + der, text) and not signatures.verify(key, b"\x30" + bytes([len(der)]) + der, b"other")


def test_verification_order(spark):
    """Nonces count before limits, limits before signatures; real signature checks."""
    key = "ssh-ed25519 AAAA"
    keys = spark.createDataFrame([(key, ["read"], None, ["x"], None, 2)], "public_key string, permissions array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, expires_at timestamp_ntz, max_requests_per_hour int").withColumn("fingerprint", F.lit("f"))
    shown = base64.b64encode(key.encode()).decode()
    row = lambda i, minute, uid="a", nonce=None, action="read", signature="Z29vZA==", public=shown: (i, f"2024-01-01 00:{minute:02d}:00", uid, "c", action, public, signature, f"2024-01-01T00:{minute:02d}:00Z", f"n{i}" if nonce is None else nonce)
    rows = [row(0, 0), row(1, 1, nonce="n0"), row(2, 2, signature="YmFk"), row(3, 3), row(4, 4, public="????"), row(5, 59), row(6, 11, nonce="n0"), row(7, 12, nonce="")]
    requests = spark.createDataFrame(rows, "event_id int, ts string, uid string, created_at string, action string, public_key string, signature string, timestamp string, nonce string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {x["event_id"]: (x["status"], x["http_code"]) for x in access.verify(requests, keys, lambda k, s, t: F.decode(s, "utf-8") == "good").collect()}
    # request 2 takes a slot though its signature is bad; the nonce of 0 is free again after ten minutes; the limit of two holds for an hour
    assert got == {0: ("success", 200), 1: ("invalid_sig", 401), 2: ("invalid_sig", 401), 3: ("rate_limited", 429), 4: ("invalid_sig", 401), 5: ("rate_limited", 429), 6: ("rate_limited", 429), 7: ("missing_headers", 401)}
    assert access.verify(requests.limit(1), keys).first()["status"] == "invalid_sig"
    none = access.verify(requests.where("event_id = 0").withColumn("uid", F.lit("xy")), keys, lambda k, s, t: F.lit(True)).first()
    assert none["status"] == "forbidden"


def test_metrics(spark):
    registry = metrics.Registry(spark)
    files_, took = registry.counter("files", "status", text="Files."), registry.histogram("seconds", bounds=metrics.LONG)
    spark.range(100).foreach(lambda row: (files_.add(status="ok" if row.id % 4 else "bad"), took.observe(float(row.id))))
    frame = {(r["name"], tuple(r["labels"].items())): r["value"] for r in registry.frame().collect()}
    assert frame["files", (("status", "ok"),)] == 75 and frame["seconds_bucket", (("le", "10"),)] == 11 and frame["seconds_count", ()] == 100 and frame["seconds_sum", ()] == 4950
    assert 'files{status="bad"} 25.0' in registry.exposition()
    with pytest.raises(ValueError):
        files_.add(-1, status="ok")
    told = metrics.from_results(spark.range(6).select((F.col("id") % 2).alias("k")), "rows", "k").collect()
    assert sorted((r["labels"]["k"], r["value"]) for r in told) == [("0", 3.0), ("1", 3.0)]


def test_edges_of_days(spark):
    """Counters, changes and holds over midnight, against plain loops."""
    rows = [("m", f"2024-01-0{1 + i // 24} {i % 24:02d}:30:00", i, float([5, 5, 9, 70, 80, 2][i % 6] + (90 if 20 <= i < 50 else 0)), (i * 7) % 40) for i in range(72)]
    samples = spark.createDataFrame(rows, "name string, ts string, event_id long, value double, counter long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    c = [x[4] for x in rows]
    assert monitoring.increase(samples).first()["increase"] == sum(y if y < x else y - x for x, y in zip(c, c[1:], strict=False))
    v = [x[3] for x in rows]
    assert monitoring.changes(samples).first()["changes"] == sum(x != y for x, y in zip(v, v[1:], strict=False))
    held = {(str(x["since"]), x["samples"]) for x in monitoring.held_above(samples, 60, 7200).collect()}
    assert held == {("2024-01-01 20:30:00", 30)} or any(n >= 30 for _, n in held)


def test_stream(spark, tmp_path):
    rows = [(str(i), "2024-01-01 00:00:00", 10, i) for i in range(20)] * 2
    files = spark.createDataFrame(rows, "uid string, created_at string, size_bytes long, ord long").withColumn("created_at", F.col("created_at").cast("timestamp"))
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        pack_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), 8, 25).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_stream_of_payloads(spark, tmp_path):
    """Shards of two micro-batches have names of their own; a repeated row is packed once."""
    rows = lambda k: spark.createDataFrame([(str(256 * i), "2024-01-01 00:00:00", 10, i, bytearray(b"x" * 10)) for i in range(k, k + 6)], "uid string, created_at string, size_bytes long, ord long, payload binary").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows(0).union(rows(0)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows(0).schema).parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    for k in (0, 6):
        pack_stream(stream, out, str(tmp_path / "check"), 8, 25, payloads=True, late=f"{out}-late").awaitTermination()
        rows(k + 6).write.mode("append").parquet(str(tmp_path / "in"))
    made = spark.read.parquet(f"{out}/manifest").collect()
    assert sum(m["file_count"] for m in made) == 12 and len({m["shard_file"] for m in made}) == len(made) == 6
    entries = shards.read_entries(shards.list_shards(spark, f"{out}/batch=*"))
    assert entries.count() == 12


def test_extended_retention(spark, tmp_path):
    """First calls copy, later ones replace the due date, past dates and unknown files are refused."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    payloads = spark.createDataFrame([("a", b"one"), ("b", b"two")], "uid string, payload binary").withColumn("created_at", at("2024-01-01 01:00:00"))
    none = payloads.limit(0).select("uid", "created_at").withColumn("due_date", at("2024-01-01"))
    requests = lambda *rows: spark.createDataFrame(rows, "uid string, due string").select("uid", at("2024-01-01 01:00:00").alias("created_at"), F.col("due").cast("timestamp_ntz").alias("due_date"))
    folder = f"file://{tmp_path}/ext"
    actions, known = retention.extend(none, requests(("a", "2030-01-01"), ("b", "2020-01-01"), ("c", "2030-01-01")), payloads, folder, at("2024-02-01"))
    assert {r["uid"]: r["action"] for r in actions.collect()} == {"a": "moved", "b": "rejected", "c": "missing"}
    assert [(r["uid"], str(r["due_date"])) for r in known.collect()] == [("a", "2030-01-01 00:00:00")]
    assert (tmp_path / "ext/_ext_retention/20240101/a_2024-01-01T01:00:00Z.dat").read_bytes() == b"one"
    actions, after = retention.extend(known, requests(("a", "2029-01-01")), payloads, folder, at("2024-02-01"))
    assert actions.first()["action"] == "updated"


def test_shard_source_options(spark, tmp_path):
    datasource.register(spark)
    for day in (1, 2):
        shard, _ = shard_format.write([("u", b"x" * day, None)])
        (tmp_path / f"2024010{day}_0A_0000.des").write_bytes(shard)
    read = spark.read.format("shard").option("path", f"file://{tmp_path}")
    assert read.load().count() == 2
    one = read.option("date_dir", "20240102").option("includePayload", "false").load().collect()
    assert [(r["shard_file"], r["size"], r["payload"]) for r in one] == [("20240102_0A_0000.des", 2, None)]


def test_tables(spark, tmp_path):
    spark.sql(f"create database if not exists siltbed_test location 'file://{tmp_path}/db'")
    try:
        for _ in range(2):
            tables.create(spark, "siltbed_test")
        rows = spark.createDataFrame([(1, "a", "active")], "id long, uid string, status string")
        tables.append(spark, "siltbed_test", rows)
        assert spark.table("siltbed_test.files").first()["uid"] == "a"
        with pytest.raises(Exception, match="unknown status"):
            tables.append(spark, "siltbed_test", rows.withColumn("status", F.lit("odd")))
        for _ in range(2):
            tables.alter(spark, "siltbed_test", "cases", "owner string, department string")
        assert spark.table("siltbed_test.cases").columns[-1] == "owner"
    finally:
        spark.sql("drop database siltbed_test cascade")


def test_reports(spark):
    row = spark.createDataFrame([(3, 5 << 20, "a", None)], "total_files long, total_size_bytes long, oldest string, newest string")
    assert report.statistics(row) == "files: 3\nsize: 5.00 MiB\noldest: a\nnewest: -"
    assert report.packed(spark.createDataFrame([(2, 10), (1, 5)], "file_count long, total_size long")) == "2 shards, 3 files, 15 B"
