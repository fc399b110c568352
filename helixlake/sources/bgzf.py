"""Blocked gzip with virtual offsets, and the indexes over it (BAI, CSI, tabix) and over FASTA (FAI)."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO, NamedTuple

from helixlake.plans.region import Interval
from helixlake.sources import files

LAST = (1 << 63) - 1


class Reader:
    """Decompressed bytes of a BGZF file from a virtual offset (compressed block << 16 | offset in block) on."""

    def __init__(self, raw: BinaryIO, voffset: int = 0) -> None:
        self.raw, self.data, self.at, self.block, self.next = raw, b"", 0, 0, 0
        self.seek(voffset)

    def seek(self, voffset: int) -> None:
        self._load(voffset >> 16)
        self.at = voffset & 0xFFFF

    def tell(self) -> int:
        while self.at >= len(self.data) and self._load(self.next):
            pass
        return self.block << 16 | self.at

    def _load(self, offset: int) -> bool:
        self.block, self.at = offset, 0
        self.raw.seek(offset)
        head = self.raw.read(18)
        if len(head) < 18:
            self.data, self.next = b"", offset
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:] + self.raw.read(max(0, extra - 6))
        size, i = None, 0
        while i + 4 <= extra:
            key, n = fields[i : i + 2], struct.unpack_from("<H", fields, i + 2)[0]
            if key == b"BC":
                size = struct.unpack_from("<H", fields, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("not a BGZF block")
        body = self.raw.read(size - 12 - extra) if extra >= 6 else b""
        self.data = zlib.decompress(body[:-8], -15)
        self.next = offset + size
        return True

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.at >= len(self.data):
                before = self.next
                if not self._load(self.next) or self.next == before:
                    break
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def buffers(self, end: int = LAST, size: int = 4 << 20):
        """``(data, begin, stop)``: decompressed stretches from here on; what was left over is passed back in by ``send`` as an offset into
        ``data``.  ``stop`` is the place of the virtual offset ``end`` in ``data``, or its length if that comes later."""
        self.tell()
        data, at = self.data, self.at
        parts, total, stop = [data], len(data), None
        if self.block << 16 >= end >> 16 << 16:
            stop = (end & 0xFFFF) if self.block == end >> 16 else 0
        more = True
        while True:
            while more and total < size:
                before = self.next
                if not self._load(self.next) or (self.next == before and not self.data):
                    more = False
                    break
                if stop is None and self.block >= end >> 16:
                    stop = total + ((end & 0xFFFF) if self.block == end >> 16 else 0)
                parts.append(self.data)
                total += len(self.data)
            data = b"".join(parts)
            left = yield data, at, len(data) if stop is None else stop
            if stop is not None and left >= stop or not more:
                return
            parts, at = [data[left:]], 0
            total = len(parts[0])
            stop = None if stop is None else stop - left
            size = max(size, 2 * total)

    def lines(self, end: int = LAST):
        """Lines that start before the virtual offset ``end``."""
        rest = b""
        while True:
            if not rest and self.tell() >= end:
                return
            stop = self.data.find(b"\n", self.at)
            if stop >= 0:
                yield rest + self.data[self.at : stop]
                rest, self.at = b"", stop + 1
            else:
                rest += self.data[self.at :]
                self.at = len(self.data)
                if not self._load(self.next):
                    if rest:
                        yield rest
                    return


def is_bgzf(path: str) -> bool:
    head = files.read_range(path, 0, 16)
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"BC"


class Index(NamedTuple):
    """Bins of every reference with their chunks; ``names`` of a tabix file, ``linear`` of BAI and tabix."""

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    linear: list[list[int]]
    min_shift: int = 14
    depth: int = 5

    def chunks(self, ref: int, interval: Interval) -> list[tuple[int, int]]:
        """Merged chunks that may hold records of a closed interval."""
        if not 0 <= ref < len(self.bins):
            return []
        top = 1 << (self.min_shift + 3 * self.depth)
        low = (interval.start or 1) - 1
        high = min(top, interval.end if interval.end is not None else top)
        least = 0
        if self.linear and self.linear[ref]:
            least = self.linear[ref][min(low >> 14, len(self.linear[ref]) - 1)]
        found = []
        first, shift = 0, self.min_shift + 3 * self.depth
        for level in range(self.depth + 1):
            a, b = first + (low >> shift), first + ((high - 1) >> shift)
            found += [c for n, cs in self.bins[ref].items() if a <= n <= b for c in cs if c[1] > least]
            first += 1 << (3 * level)
            shift -= 3
        return merge(found)

    def splits(self, size: int) -> list[int]:
        """Virtual offsets of records, about ``size`` compressed bytes apart."""
        out: list[int] = []
        for off in sorted({c[0] for bins in self.bins for cs in bins.values() for c in cs}):
            if not out or (off >> 16) - (out[-1] >> 16) >= size:
                out.append(off)
        return out


def merge(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def read_index(path: str) -> Index:
    """A ``.bai``, ``.csi`` or ``.tbi`` file."""
    data = files.read_range(path, 0, None)
    if data[:2] == b"\x1f\x8b":
        with files.open_text(path, "gzip") as f:
            data = f.read()
    magic, at = data[:4], 4
    names: list[str] = []
    min_shift, depth = 14, 5
    if magic == b"CSI\x01":
        min_shift, depth, n_aux = struct.unpack_from("<3i", data, at)
        aux = data[at + 12 : at + 12 + n_aux]
        at += 12 + n_aux
        if n_aux >= 28:
            names = [x.decode() for x in aux[28 : 28 + struct.unpack_from("<i", aux, 24)[0]].split(b"\0") if x]
        (n_ref,) = struct.unpack_from("<i", data, at)
        at += 4
    elif magic == b"TBI\x01":
        n_ref, *_, n_names = struct.unpack_from("<8i", data, at)
        names = [x.decode() for x in data[at + 32 : at + 32 + n_names].split(b"\0") if x]
        at += 32 + n_names
    elif magic == b"BAI\x01":
        (n_ref,) = struct.unpack_from("<i", data, at)
        at += 4
    else:
        raise ValueError(f"{path}: not an index")
    meta = ((1 << (3 * (depth + 1))) - 1) // 7 + 1
    bins: list[dict[int, list[tuple[int, int]]]] = []
    linear: list[list[int]] = []
    for _ in range(n_ref):
        (n_bin,) = struct.unpack_from("<i", data, at)
        at += 4
        own: dict[int, list[tuple[int, int]]] = {}
        for _ in range(n_bin):
            number = struct.unpack_from("<I", data, at)[0]
            at += 12 if magic == b"CSI\x01" else 4
            (n,) = struct.unpack_from("<i", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 4)
            at += 4 + 16 * n
            if number != meta:
                own[number] = list(zip(flat[::2], flat[1::2], strict=True))
        bins.append(own)
        if magic != b"CSI\x01":
            (n,) = struct.unpack_from("<i", data, at)
            linear.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n
    return Index(names, bins, linear, min_shift, depth)


class FaiEntry(NamedTuple):
    length: int
    offset: int
    line_bases: int
    line_bytes: int

    def span(self, interval: Interval) -> tuple[int, int, int]:
        """Byte range of a closed interval and the number of bases in it."""
        low, high = (interval.start or 1) - 1, min(self.length, interval.end if interval.end is not None else self.length)
        if low >= high:
            return self.offset, self.offset, 0
        at = lambda p: self.offset + p // self.line_bases * self.line_bytes + p % self.line_bases
        return at(low), at(high - 1) + 1, high - low


def read_fai(path: str) -> dict[str, FaiEntry]:
    out = {}
    for line in files.read_range(path, 0, None).decode().splitlines():
        name, *numbers = line.split("\t")
        if numbers:
            out[name] = FaiEntry(*map(int, numbers[:4]))
    return out
