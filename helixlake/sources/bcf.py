"""BCF2 records with typed INFO and FORMAT values."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from helixlake.sources import bgzf
from helixlake.sources.text import header_fields

_INTS = {1: ("b", 1, -128), 2: ("h", 2, -32768), 3: ("i", 4, -(1 << 31))}


class Header:
    def __init__(self, text: str) -> None:
        self.lines = text.rstrip("\0").splitlines()
        self.info, self.format = header_fields(self.lines, "INFO"), header_fields(self.lines, "FORMAT")
        self.strings: dict[int, str] = {0: "PASS"}
        self.contigs: dict[int, str] = {}
        known = {"PASS": 0}
        for line in self.lines:
            section = line[2:].split("=", 1)[0] if line.startswith("##") else ""
            if section not in ("FILTER", "INFO", "FORMAT", "contig"):
                continue
            name = line.split("ID=", 1)[1].split(",", 1)[0].rstrip(">")
            index = int(line.rsplit("IDX=", 1)[1].rstrip(">").split(",")[0]) if "IDX=" in line else None
            if section == "contig":
                self.contigs[len(self.contigs) if index is None else index] = name
            elif name not in known:
                known[name] = len(self.strings) if index is None else index
                self.strings[known[name]] = name


def read_header(reader: bgzf.Reader) -> Header:
    if reader.read(3) != b"BCF":
        raise ValueError("not a BCF file")
    reader.read(2)
    (n,) = struct.unpack("<I", reader.read(4))
    return Header(reader.read(n).decode())


class _Cursor:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def descriptor(self) -> tuple[int, int]:
        byte = self.data[self.at]
        self.at += 1
        kind, n = byte & 15, byte >> 4
        if n == 15:
            n = self.value()[0]
        return kind, n

    def values(self, kind: int, n: int) -> list:
        """``n`` values; missing ones are None and a vector ends where its end mark stands."""
        if kind == 7:
            text = self.data[self.at : self.at + n].rstrip(b"\0").decode("utf-8", "replace")
            self.at += n
            return [text] if text else []
        if kind == 0:
            return []
        if kind == 5:
            raw = struct.unpack_from(f"<{n}I", self.data, self.at)
            floats = struct.unpack_from(f"<{n}f", self.data, self.at)
            self.at += 4 * n
            return [None if r == 0x7F800001 else f for r, f in zip(raw, floats, strict=True) if r != 0x7F800002]
        code, size, least = _INTS[kind]
        raw = struct.unpack_from(f"<{n}{code}", self.data, self.at)
        self.at += size * n
        return [None if x == least else x for x in raw if x != least + 1]

    def value(self) -> list:
        return self.values(*self.descriptor())


def _typed(values: list, number: str, kind: str) -> object:
    if kind == "Flag":
        return True
    if kind in ("String", "Character"):
        text = values[0] if values else None
        if text in (None, "."):
            return None
        return text if number in ("0", "1") else [x if x != "." else None for x in text.split(",")]
    if number in ("0", "1"):
        return values[0] if values else None
    return values or None


def decode(shared: bytes, individual: bytes, header: Header) -> tuple:
    chrom, pos, _, qual, counts, samples = struct.unpack_from("<iiifII", shared)
    n_info, n_allele, n_format, n_sample = counts & 0xFFFF, counts >> 16, samples >> 24, samples & 0xFFFFFF
    c = _Cursor(shared, 24)
    ids = c.value()
    alleles = [(c.value() or [""])[0] for _ in range(n_allele)]
    filters = [header.strings.get(k, str(k)) for k in c.value()]
    found = {}
    for _ in range(n_info):
        name = header.strings.get(c.value()[0], "")
        kind, n = c.descriptor()
        found[name] = c.values(kind, n)
    info = {name: _typed(found[name], number, kind) if name in found else None for name, number, kind in header.info}
    c = _Cursor(individual)
    rows: list[dict] = [dict.fromkeys((n for n, _, _ in header.format)) for _ in range(n_sample)]
    declared = {n: (number, kind) for n, number, kind in header.format}
    for _ in range(n_format):
        name = header.strings.get(c.value()[0], "")
        kind, n = c.descriptor()
        for row in rows:
            values = c.values(kind, n)
            if name == "GT":
                row[name] = genotype(values)
            elif name in declared:
                row[name] = _typed(values, *declared[name])
    missing = struct.unpack_from("<I", shared, 12)[0] == 0x7F800001 or math.isnan(qual)
    return (
        header.contigs.get(chrom, str(chrom)), pos + 1, ids[0].split(";") if ids and ids[0] != "." else [], alleles[0] if alleles else None, alleles[1:] or None,
        None if missing else qual, filters, info, rows,
    )


def genotype(values: list) -> str | None:
    """Allele numbers with their phase signs."""
    out = ""
    for k, v in enumerate(values):
        v = 0 if v is None else v
        out += ("|" if v & 1 else "/") * (k > 0) + ("." if v >> 1 == 0 else str((v >> 1) - 1))
    return out or None


def records(reader: bgzf.Reader, header: Header, end: int = bgzf.LAST) -> Iterator[tuple]:
    while reader.tell() < end:
        sizes = reader.read(8)
        if len(sizes) < 8:
            return
        shared, individual = struct.unpack("<II", sizes)
        yield decode(reader.read(shared), reader.read(individual), header)
