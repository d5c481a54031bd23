"""spark.read.format("shard"): a folder of shard files as a table, one partition a file.

Options: path, date_dir and shard_hex to list one key alone, includePayload (true) to read payloads as well.
Rows: shard_file, uid, is_bigfile, bigfile_hash, codec, offset, length, size, meta, payload (null without includePayload).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltbed.sources import files
from siltbed.sources import shard_format as f

SCHEMA = "shard_file string, uid string, is_bigfile boolean, bigfile_hash string, codec string, offset long, length long, size long, meta string, payload binary"


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.names = f"{options.get('date_dir', '*')}_{options.get('shard_hex', '*')}_*.des"
        self.payloads = options.get("includepayload", options.get("includePayload", "true")).lower() == "true"

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, at = files.system_of(self.folder)
        found = [x for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and fnmatch(x.base_name, self.names)]
        return [_File(f"{self.folder}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]

    def read(self, part: _File) -> Iterator[tuple]:
        if part is None:  # an empty folder
            return
        with files.Ranges(part.path, part.size) as ranges:
            for uid, e in f.fetch_index(ranges, part.size).items():
                payload = f.fetch(ranges, e, lambda digest: files.read(f"{self.folder}/{f.BIG}/{digest}")) if self.payloads else None
                yield part.path.rpartition("/")[2], uid, e["is_bigfile"], e.get("bigfile_hash"), e.get("codec"), e.get("offset"), e.get("length"), e["size"], json.dumps(e["meta"]), payload


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shard"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)
