"""BigWig: interval values and zoom summaries, found through the file's R-trees."""

from __future__ import annotations

import struct
import zlib
from typing import BinaryIO, NamedTuple

import numpy as np

from helixlake.plans.region import Region


class Header(NamedTuple):
    order: str
    compressed: bool
    index_offset: int
    zooms: list[tuple[int, int]]  # reduction level, index offset
    chroms: dict[int, tuple[str, int]]


class Block(NamedTuple):
    offset: int
    size: int


def read_header(f: BinaryIO) -> Header:
    f.seek(0)
    head = f.read(64)
    order = next((o for o in "<>" if struct.unpack_from(o + "I", head)[0] == 0x888FFC26), None)
    if order is None:
        raise ValueError("not a BigWig file")
    _, n_zoom, chrom_tree, _, index, _, _, _, _, buffer, _ = struct.unpack_from(order + "HHQQQHHQQIQ", head, 4)
    zooms = []
    for _ in range(n_zoom):
        level, _, _, at = struct.unpack(order + "IIQQ", f.read(24))
        zooms.append((level, at))
    return Header(order, buffer > 0, index, zooms, _chroms(f, chrom_tree, order))


def _chroms(f: BinaryIO, offset: int, order: str) -> dict[int, tuple[str, int]]:
    f.seek(offset)
    _, _, key_size, _, _, _ = struct.unpack(order + "IIIIQQ", f.read(32))
    out: dict[int, tuple[str, int]] = {}

    def node(at: int) -> None:
        f.seek(at)
        leaf, _, n = struct.unpack(order + "BBH", f.read(4))
        data = f.read(n * (key_size + 8))
        for k in range(n):
            name = data[k * (key_size + 8) :][:key_size].rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack_from(order + "II", data, k * (key_size + 8) + key_size)
                out[number] = name, size
            else:
                node(struct.unpack_from(order + "Q", data, k * (key_size + 8) + key_size)[0])

    node(offset + 32)
    return out


def blocks(f: BinaryIO, offset: int, order: str, chrom: int | None = None, start: int = 0, end: int = 1 << 32) -> list[Block]:
    """Data blocks of an R-tree that may hold positions of half-open ``start`` to ``end`` on a chromosome, or all."""
    out: list[Block] = []

    def hit(c1: int, s: int, c2: int, e: int) -> bool:
        return chrom is None or ((c1, s) < (chrom, end) and (c2, e) > (chrom, start))

    stack = [offset + 48]
    while stack:
        f.seek(stack.pop())
        leaf, _, n = struct.unpack(order + "BBH", f.read(4))
        size = 32 if leaf else 24
        data = f.read(n * size)
        for k in range(n):
            c1, s, c2, e, at = struct.unpack_from(order + "IIIIQ", data, k * size)
            if hit(c1, s, c2, e):
                if leaf:
                    out.append(Block(at, struct.unpack_from(order + "Q", data, k * size + 24)[0]))
                else:
                    stack.append(at)
    return sorted(out)


def wanted(header: Header, region: Region | None) -> tuple[int, int, int] | None:
    """Chromosome and half-open range of a region, whose bounds are taken as they are; ``LookupError`` for an unknown name."""
    if region is None:
        return None
    found = next(((k, size) for k, (name, size) in header.chroms.items() if name == region.name), None)
    if found is None:
        raise LookupError(f"no chromosome {region.name!r}")
    start, end = region.interval
    return found[0], start or 0, found[1] if end is None else end


def _data(f: BinaryIO, header: Header, block: Block) -> bytes:
    f.seek(block.offset)
    data = f.read(block.size)
    return zlib.decompress(data) if header.compressed else data


def values(f: BinaryIO, header: Header, block: Block) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome, starts, ends and values of a block."""
    data = _data(f, header, block)
    o = header.order
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(o + "IIIIIBBH", data)
    body = data[24:]
    if kind == 1:
        x = np.frombuffer(body, np.dtype([("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")]), n)
        return chrom, x["s"], x["e"], x["v"]
    if kind == 2:
        x = np.frombuffer(body, np.dtype([("s", o + "u4"), ("v", o + "f4")]), n)
        return chrom, x["s"], x["s"] + span, x["v"]
    v = np.frombuffer(body, o + "f4", n)
    s = start + step * np.arange(n, dtype=np.uint32)
    return chrom, s, s + span, v


def summaries(f: BinaryIO, header: Header, block: Block) -> np.ndarray:
    """Zoom records of a block."""
    o = header.order
    kind = np.dtype([("chrom", o + "u4"), ("start", o + "u4"), ("end", o + "u4"), ("covered", o + "u4"), ("min", o + "f4"), ("max", o + "f4"), ("sum", o + "f4"), ("sq", o + "f4")])
    return np.frombuffer(_data(f, header, block), kind)
