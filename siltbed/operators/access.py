"""Permissions, rate limits, replays and status codes over a request log."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.functions import scalars, signatures

#: Seconds: how far a request's clock may be off, how long a nonce is remembered, the window of a rate limit.
SKEW, NONCE, HOUR = 300, 600, 3600


def allowed(uid: Column, action: Column, permissions: Column, allow: Column, deny: Column) -> Column:
    """The action is permitted, some allowed prefix fits (an empty list allows all), and no excluded one does."""
    fits = lambda arr: F.exists(arr, lambda p: F.startswith(uid, p))
    return F.array_contains(permissions, action) & (F.coalesce(F.size(allow) <= 0, F.lit(True)) | F.coalesce(fits(allow), F.lit(False))) & ~F.coalesce(fits(deny), F.lit(False))


def fold(rows: DataFrame, key: str, start: Callable, step: Callable, flag: str, argument: str | None = None) -> DataFrame:
    """rows with `flag`: those of a key, by (ts, event_id), stream through step(state, micros[, argument]).

    What is accepted depends on what was accepted before, so a key is sequential by meaning; keys are dealt to partitions, where Spark
    sorts (and spills) them, and a worker holds the state of one key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            times = column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            more = column(argument).to_pylist() if argument else None
            out = []
            for i, (k, t) in enumerate(zip(column(key).to_pylist(), times, strict=True)):
                if k != last:
                    last, state = k, start()
                out.append(step(state, t, more[i]) if more else step(state, t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, flag])

    dealt = rows.repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType())]))


def _slot(seconds: int) -> Callable:
    """Takes a slot among the last accepted ones of the window, if fewer than `limit` are taken; null is no limit."""

    def step(held: deque, t: int, limit: int | None) -> bool:
        while held and held[0] < t - seconds * 1_000_000:
            held.popleft()
        if limit is not None and len(held) >= limit:
            return False
        if limit is not None:
            held.append(t)
        return True

    return step


def _seen(seconds: int) -> Callable:
    def step(stored: list, t: int) -> bool:
        if stored and t - stored[0] <= seconds * 1_000_000:
            return True
        stored[:] = [t]
        return False

    return step


def rate_limit(log: DataFrame, limit: int, seconds: int = HOUR) -> DataFrame:
    """(key, ts, event_id, accepted): at most `limit` accepted requests of a key in the trailing window. Only accepted
    ones count, so this is a recursion within a key, not a frame; the fold keeps `limit` times of one key."""
    rows = log.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(limit).alias("most"))
    return fold(rows, "key", deque, _slot(seconds), "accepted", "most").drop("most")


def replays(log: DataFrame, seconds: int = NONCE) -> DataFrame:
    """(nonce, ts, event_id, replay): a nonce seen within the window; a replay does not refresh the stored time."""
    return fold(log.select("nonce", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "nonce", list, _seen(seconds), "replay")


def http_code(status: Column) -> Column:
    codes = {"no_auth": 503, "missing_headers": 401, "rate_limited": 429, "invalid_sig": 401, "expired": 401, "forbidden": 403, "success": 200}
    return F.element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), status)


def canonical(uid: Column, created_at: Column, timestamp: Column, nonce: Column) -> Column:
    """The text that a request's signature covers."""
    return F.concat_ws("|", uid, created_at, timestamp, nonce)


def with_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests with the fields of the key they name (public_key in Base64), null where no such key is authorised."""
    words = F.split(F.trim(F.decode(scalars.try_base64(F.col("public_key")), "utf-8")), r"\s+")
    named = requests.withColumn("_key", F.concat_ws(" ", F.slice(words, 1, 2)))
    own = keys.select(F.col("public_key").alias("_key"), "fingerprint", "permissions", "allowed_prefixes", "excluded_prefixes", "expires_at", "max_requests_per_hour")
    return named.join(own, "_key", "left").withColumnRenamed("_key", "key_text")


def verify(requests: DataFrame, keys: DataFrame, signed: Callable[[Column, Column, Column], Column] = signatures.verified) -> DataFrame:
    """requests (event_id, ts, uid, created_at, action, public_key, signature, timestamp, nonce) with status and http_code.

    Checks go in this order and the first that fails decides: headers, Base64, a known key, expiry, the time's form and skew, nonce,
    rate limit, signature, permission. A nonce is remembered, and a slot of the limit taken, before the signature is checked."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rows = with_key(requests.withColumn("ts", F.col("ts").cast("timestamp")), keys).withColumn("_signature", scalars.try_base64(F.col("signature")))
    at = scalars.try_parse_iso(F.col("timestamp"))
    now = scalars.utc(F.col("ts"))
    early = (
        F.when(blank("public_key") | blank("signature") | blank("timestamp") | blank("nonce"), "missing_headers")
        .when(F.col("_signature").isNull() | F.col("fingerprint").isNull(), "invalid_sig")
        .when(F.col("expires_at") < now, "expired")
        .when(at.isNull() | (F.abs(F.timestamp_diff("MICROSECOND", at, now)) > SKEW * 1_000_000), "invalid_sig")
    )
    rows = rows.withColumn("_early", early)
    done = rows.where("_early is not null").withColumn("status", F.col("_early"))
    seen = fold(rows.where("_early is null"), "nonce", list, _seen(NONCE), "_replay")
    limited = fold(seen.where("not _replay"), "fingerprint", deque, _slot(HOUR), "_slot", "max_requests_per_hour")
    valid = signed(F.col("key_text"), F.col("_signature"), canonical(F.col("uid"), F.col("created_at"), F.col("timestamp"), F.col("nonce")))
    may = allowed(F.col("uid"), F.col("action"), F.col("permissions"), F.col("allowed_prefixes"), F.col("excluded_prefixes"))
    judged = limited.where("_slot").withColumn("_valid", valid).withColumn("status", F.when(~F.col("_valid"), "invalid_sig").when(~may, "forbidden").otherwise("success"))
    parts = [done, seen.where("_replay").withColumn("status", F.lit("invalid_sig")), limited.where("not _slot").withColumn("status", F.lit("rate_limited")), judged]
    columns = [*requests.columns, "fingerprint", "status"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.union(p.select(*columns))
    return out.withColumn("http_code", http_code(F.col("status")))
