"""What a user may put in place of the engine's own parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Source(Protocol):
    """A table of files to archive."""

    def fetch(self, cutoff: Column, limit: int | None = None) -> DataFrame: ...

    def mark(self, uids: DataFrame) -> DataFrame: ...


class Packer(Protocol):
    """Turns (uid, created_at, size_bytes, source_path, ord) into shards, one row each."""

    def __call__(self, listed: DataFrame, folder: str) -> DataFrame: ...


class Reader(Protocol):
    """Reads a file's bytes by its name."""

    def __call__(self, uri: str) -> bytes: ...


class Signed(Protocol):
    """Whether signatures hold: columns of key text, signature bytes and message."""

    def __call__(self, key: Column, signature: Column, message: Column) -> Column: ...


class WorkerFilter(Protocol):
    """Which files are a worker's; an expression, so that sources can evaluate it."""

    def __call__(self, uid: Column, number: int, of: int) -> Column: ...
