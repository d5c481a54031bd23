"""Byte access to files by URI, with ranges and retries. Pure Python, no Spark."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyarrow import fs

#: Bytes read at once from a stream.
CHUNK = 1 << 20
#: Error codes that a repeated request does not mend, and those that it may.
FINAL = ["AccessDenied", "403", "NoSuchKey", "404"]
PASSING = ["500", "503", "InternalError", "SlowDown"]


def is_s3(uri: str) -> bool:
    return uri.startswith("s3://")


def bucket_and_key(uri: str) -> tuple[str, str]:
    """The parts of s3://bucket/key; no query, no fragment."""
    parts = urlsplit(uri)
    key = parts.path.lstrip("/")
    if parts.scheme != "s3" or not parts.netloc or not key or parts.query or parts.fragment:
        raise ValueError(f"not the URI of an object: {uri!r}")
    return parts.netloc, key


def prefix(text: str) -> str:
    """An object prefix: empty, or with one slash at its end."""
    return text if not text or text.endswith("/") else text + "/"


def system_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri)))


def retried(call: Callable, attempts: int = 3, wait: float = 1.0, most: float = 10.0, passing: Callable[[Exception], bool] | None = None, sleep=time.sleep):
    """call(), again after waits that double, while the error is one that passes."""
    passing = passing or (lambda e: isinstance(e, OSError) and not isinstance(e, FileNotFoundError | PermissionError | IsADirectoryError) and not any(x in str(e) for x in FINAL))
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not passing(e):
                raise
            sleep(min(most, wait * 2**n))


class Ranges:
    """A file read by ranges; `calls` counts them."""

    def __init__(self, uri: str, size: int | None = None):
        self.system, self.path = system_of(uri)
        self.size = self.system.get_file_info(self.path).size if size is None else size
        self.file = self.system.open_input_file(self.path)
        self.calls = 0

    def __call__(self, offset: int, length: int) -> bytes:
        self.calls += 1
        return retried(lambda: self.file.read_at(length, offset))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def chunks(uri: str) -> Iterator[bytes]:
    system, path = system_of(uri)
    with system.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            yield part


def read(uri: str) -> bytes:
    return retried(lambda: b"".join(chunks(uri)))


def delete(uri: str) -> None:
    system, path = system_of(uri)
    system.delete_file(path)
