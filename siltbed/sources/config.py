"""Configuration from YAML or JSON: placeholders, zones, authorised keys. Read on the driver; what is large becomes a table."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siltbed.functions.routing import check_bits

_OPEN = re.compile(r"\$\{([^}]*)(\}?)")


def substitute(value, env: Mapping[str, str] | None = None):
    """The value with ${NAME} and ${NAME:default} replaced in all its texts."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if not m[2]:
            raise ValueError(f"a placeholder is not closed: {value!r}")
        name, colon, default = m[1].partition(":")
        if name not in env and not colon:
            raise ValueError(f"the environment has no {name}")
        return env.get(name, default)

    return _OPEN.sub(one, value)


def load(path: str | Path) -> dict:
    """A mapping from a .json, .yaml or .yml file, as it stands."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    if path.suffix.lower() == ".json":
        found = json.loads(path.read_text())
    elif path.suffix.lower() in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(path.read_text())
    else:
        raise ValueError("a configuration is .json, .yaml or .yml")
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    return found


def load_migration(path: str | Path, env: Mapping[str, str] | None = None) -> dict:
    return substitute(load(path), env)


def load_zones(spark: SparkSession, path: str | Path) -> tuple[int, DataFrame]:
    """Index bits, and zones (zone, start, end, bucket, prefix, region_name, endpoint_url)."""
    found = load(path)
    n_bits = check_bits(int(found.get("n_bits", 8)))
    if not isinstance(found.get("zones"), list):
        raise ValueError("zones must be a list")
    rows = []
    for z in found["zones"]:
        if not isinstance(z, dict) or not {"name", "range", "s3"} <= z.keys():
            raise ValueError("a zone has a name, a range and an s3 section")
        s3 = z["s3"]
        rows.append((z["name"], int(z["range"]["start"]), int(z["range"]["end"]), s3["bucket"], s3.get("prefix", ""), s3.get("region_name"), s3.get("endpoint_url")))
    return n_bits, spark.createDataFrame(rows, "zone string, start int, end int, bucket string, prefix string, region_name string, endpoint_url string")


KEY = "public_key string, permissions array<string>, allowed_prefixes array<string>, excluded_prefixes array<string>, expires_at string, max_requests_per_hour int, comment string"


def _checked(entry) -> tuple:
    if not isinstance(entry, dict):
        raise ValueError("a key is a mapping")
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    key, permissions, limit = entry.get("public_key"), entry.get("permissions", []), entry.get("max_requests_per_hour")
    if not isinstance(key, str) or len(key.split()) < 2:
        raise ValueError("public_key must be a text: kind and Base64")
    if not texts(permissions):
        raise ValueError("permissions must be a list of texts")
    for c in ("allowed_prefixes", "excluded_prefixes"):
        if entry.get(c) is not None and not texts(entry[c]):
            raise ValueError(f"{c} must be a list of texts")
    for c in ("expires_at", "comment"):
        if entry.get(c) is not None and not isinstance(entry[c], str):
            raise ValueError(f"{c} must be a text")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0):
        raise ValueError("max_requests_per_hour must be a positive whole number")
    # a comment behind the key is not part of it
    return " ".join(key.split()[:2]), permissions, entry.get("allowed_prefixes"), entry.get("excluded_prefixes"), entry.get("expires_at"), limit, entry.get("comment")


def keys(spark: SparkSession, found: dict) -> DataFrame:
    """Authorised keys from a mapping (a file's, or the data of a stored secret): see KEY, and fingerprint."""
    from pyspark.sql import functions as F

    from siltbed.functions import scalars

    entries = found.get("authorized_keys", [])
    if not isinstance(entries, list):
        raise ValueError("authorized_keys must be a list")
    rows = spark.createDataFrame([_checked(e) for e in entries], KEY)
    return rows.withColumns({"expires_at": scalars.parse_iso(F.col("expires_at")), "fingerprint": scalars.fingerprint(F.encode("public_key", "utf-8"))})


def load_keys(spark: SparkSession, path: str | Path) -> DataFrame:
    return keys(spark, load(path))
