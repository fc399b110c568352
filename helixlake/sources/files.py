"""Finding and opening files, on this machine or in an object store, from the driver and from workers."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import re
from typing import BinaryIO, NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs

from helixlake.sources.schemas import COMPRESSIONS


class Found(NamedTuple):
    path: str
    size: int
    partitions: tuple[tuple[str, str], ...]


def system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``path``: a plain path, ``file:``, ``s3://``, ``s3a://`` or ``gs://``."""
    scheme = urlparse(path).scheme if "://" in path or path.startswith("file:") else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path) if scheme else path
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def find(path: str, endings: list[str] | None = None) -> list[Found]:
    """Files at ``path``: the file itself, or those of a directory tree that end in one of ``endings`` (compressed or not), with the
    ``key=value`` directories above each."""
    where, base = system(path)
    info = where.get_file_info(base.rstrip("/") or "/")
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [Found(path, info.size, _keys(base, ""))]
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    out = []
    for f in where.get_file_info(fs.FileSelector(base.rstrip("/"), recursive=True)):
        low, name = f.path.lower(), posixpath.basename(f.path)
        if f.type != fs.FileType.File or name.startswith((".", "_")):
            continue
        plain = low[: low.rindex(".")] if any(low.endswith(c) for c in COMPRESSIONS) else low
        if endings is None or any(plain.endswith(e) or low.endswith(e) for e in endings):
            out.append(Found(prefix + f.path, f.size, _keys(f.path, base)))
    return sorted(out)


def _keys(path: str, base: str) -> tuple[tuple[str, str], ...]:
    inner = path[len(base.rstrip("/")) :] if base else ""
    return tuple((k, unquote(v)) for part in inner.split("/")[:-1] if "=" in part for k, v in [part.split("=", 1)])


def exists(path: str) -> bool:
    where, p = system(path)
    return where.get_file_info(p).type == fs.FileType.File


def open_raw(path: str) -> BinaryIO:
    where, p = system(path)
    return where.open_input_file(p)


def read_range(path: str, start: int, end: int | None) -> bytes:
    with open_raw(path) as f:
        f.seek(start)
        return f.read() if end is None else f.read(end - start)


def open_text(path: str, compression: str | None = None) -> BinaryIO:
    """A byte stream of the decompressed content; the compression is told by the name unless given."""
    kind = compression or next((c for e, c in COMPRESSIONS.items() if path.lower().endswith(e)), None)
    raw = open_raw(path)
    if kind in (None, "", "uncompressed", "none"):
        return io.BufferedReader(raw) if not isinstance(raw, pa.NativeFile) else raw
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw)  # reads every member, so BGZF too
    if kind == "bzip2":
        return bz2.BZ2File(raw)
    if kind == "xz":
        return lzma.LZMAFile(raw)
    if kind == "zstd":
        return pa.CompressedInputStream(raw, "zstd")
    raise ValueError(f"compression {kind!r}")


def lines(stream: BinaryIO, size: int = 1 << 20):
    """Lines of a byte stream without their ends."""
    rest = b""
    while chunk := stream.read(size):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield p[:-1] if p.endswith(b"\r") else p
    if rest:
        yield rest[:-1] if rest.endswith(b"\r") else rest
