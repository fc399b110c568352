"""CRAM 3.0: containers, codecs and records.

Blocks may be raw or packed by gzip, bzip2, LZMA or rANS 4x8; series may be external, Huffman, beta, gamma, subexponential, Golomb-Rice
or byte arrays.  The codecs that 3.1 added raise ``ValueError``.  Bases come from the slice's embedded reference or from a FASTA file.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

from helixlake.sources import bam, bgzf, files

EOF_START = 4542278


class Bytes:
    """A cursor over bytes with the format's variable-length integers."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise EOFError("block ends early")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def i32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def itf8(self) -> int:
        """Up to 5 bytes: the leading ones of the first tell how many follow; the fifth gives 4 bits."""
        b = self.byte()
        extra = 0
        while extra < 4 and b & (0x80 >> extra):
            extra += 1
        value = b & (0x7F >> extra if extra < 4 else 0x0F)
        for k in range(extra):
            value = value << 4 | self.byte() & 15 if k == 3 else value << 8 | self.byte()
        return value - (1 << 32) if value >= 1 << 31 else value

    def ltf8(self) -> int:
        b = self.byte()
        extra = 0
        while extra < 8 and b & (0x80 >> extra):
            extra += 1
        value = b & (0x7F >> extra) if extra < 7 else 0
        for _ in range(extra):
            value = value << 8 | self.byte()
        return value - (1 << 64) if value >= 1 << 63 else value

    def ints(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


class Bits:
    """Bits of the core block, the highest of a byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def bit(self) -> int:
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value


# ---- rANS 4x8 -----------------------------------------------------------------------------------------------------------------------


def _symbols(src: Bytes) -> Iterator[int]:
    """Symbols of a table in their order, runs of successors shortened; ends at the closing zero."""
    symbol = src.byte()
    run = 0
    while True:
        yield symbol
        if run:
            run -= 1
            symbol += 1
        else:
            last, symbol = symbol, src.byte()
            if symbol == last + 1:
                run = src.byte()
        if symbol == 0:
            return


def _table(src: Bytes) -> tuple[list[int], list[int], bytes]:
    """Frequencies, their running sums, and the symbol of each of 4096 slots."""
    freq, base, slots, total = [0] * 256, [0] * 256, bytearray(), 0
    for symbol in _symbols(src):
        f = src.byte()
        if f >= 128:
            f = (f & 127) << 8 | src.byte()
        freq[symbol], base[symbol] = f, total
        slots += bytes([symbol]) * f
        total += f
    return freq, base, bytes(slots.ljust(4096, b"\0"))


def rans(data: bytes) -> bytes:
    """A rANS 4x8 stream of order 0 or 1, decoded."""
    src = Bytes(data)
    order = src.byte()
    src.i32()
    size = src.i32()
    if size == 0:
        return b""
    out = bytearray(size)
    if order == 0:
        freq, base, slots = _table(src)
        state = list(struct.unpack("<4I", src.take(16)))
        raw, at = data, src.at
        for i in range(size):
            x = state[i & 3]
            low = x & 4095
            s = slots[low]
            out[i] = s
            x = freq[s] * (x >> 12) + low - base[s]
            while x < 1 << 23 and at < len(raw):
                x = x << 8 | raw[at]
                at += 1
            state[i & 3] = x
        return bytes(out)
    tables = {context: _table(src) for context in _symbols(src)}
    state = list(struct.unpack("<4I", src.take(16)))
    raw, at, quarter = data, src.at, size // 4
    last = [0] * 4
    # Four streams fill a quarter each; the fourth goes on to the end.
    for i in range(quarter + size - 4 * quarter):
        for j in range(4) if i < quarter else (3,):
            x = state[j]
            freq, base, slots = tables[last[j]]
            low = x & 4095
            s = slots[low]
            out[i + j * quarter] = s
            x = freq[s] * (x >> 12) + low - base[s]
            while x < 1 << 23 and at < len(raw):
                x = x << 8 | raw[at]
                at += 1
            state[j], last[j] = x, s
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: gzip.decompress, 2: bz2.decompress, 3: lzma.decompress, 4: rans}


class Block(NamedTuple):
    kind: int
    id: int
    data: bytes


def read_block(src: Bytes) -> Block:
    method, kind, number = src.byte(), src.byte(), src.itf8()
    packed, _ = src.itf8(), src.itf8()
    data = src.take(packed)
    src.take(4)
    if method not in _UNPACK:
        raise ValueError(f"block compression {method} isn't of CRAM 3.0")
    return Block(kind, number, _UNPACK[method](data))


class Container(NamedTuple):
    offset: int
    size: int  # of the blocks
    header: int
    ref: int
    start: int
    span: int
    records: int
    landmarks: list[int]


def read_container(raw, offset: int) -> Container | None:
    """Header of the container at ``offset``; None at the end of the file."""
    raw.seek(offset)
    src = Bytes(raw.read(4096))
    if len(src.data) < 4:
        return None
    size = src.i32()
    ref, start, span, n = src.itf8(), src.itf8(), src.itf8(), src.itf8()
    src.ltf8(), src.ltf8(), src.itf8()
    landmarks = src.ints()
    src.take(4)
    return None if ref == -1 and start == EOF_START and n == 0 else Container(offset, size, src.at, ref, start, span, n, landmarks)


class Header(NamedTuple):
    text: str
    names: list[str]
    groups: list[str]
    first: int


def read_header(raw) -> Header:
    raw.seek(0)
    head = raw.read(26)
    if head[:4] != b"CRAM":
        raise ValueError("not a CRAM file")
    if head[4] != 3:
        raise ValueError(f"CRAM {head[4]}.{head[5]} is not supported")
    c = read_container(raw, 26)
    raw.seek(c.offset + c.header)
    data = read_block(Bytes(raw.read(c.size))).data
    text = data[4 : 4 + struct.unpack_from("<i", data)[0]].decode("utf-8", "replace")
    of = lambda kind, field: [f[3:] for line in text.splitlines() if line.startswith(kind + "\t") for f in line.split("\t") if f.startswith(field + ":")]
    return Header(text, of("@SQ", "SN"), of("@RG", "ID"), c.offset + c.header + c.size)


def containers(raw, start: int, end: int | None = None) -> Iterator[Container]:
    while (c := read_container(raw, start)) is not None and (end is None or start < end):
        yield c
        start = c.offset + c.header + c.size


# ---- Encodings ----------------------------------------------------------------------------------------------------------------------


class Slice:
    """The streams of one slice."""

    def __init__(self, core: bytes, external: dict[int, bytes]) -> None:
        self.core = Bits(core)
        self.external = {k: Bytes(v) for k, v in external.items()}

    def stream(self, number: int) -> Bytes:
        return self.external.setdefault(number, Bytes(b""))


def _huffman(symbols: list[int], lengths: list[int]) -> Callable[[Slice], int]:
    pairs = sorted(zip(lengths, symbols, strict=True))
    if len(pairs) == 1 and pairs[0][0] == 0:
        only = pairs[0][1]
        return lambda s: only
    codes: dict[tuple[int, int], int] = {}
    code, before = 0, pairs[0][0]
    for n, symbol in pairs:
        code <<= n - before
        codes[n, code] = symbol
        code, before = code + 1, n

    def decode(s: Slice) -> int:
        value = n = 0
        while True:
            value, n = value << 1 | s.core.bit(), n + 1
            if (n, value) in codes:
                return codes[n, value]
            if n > 64:
                raise ValueError("no such Huffman code")

    return decode


def int_codec(src: Bytes) -> Callable[[Slice], int]:
    """An encoding of integers."""
    codec = src.itf8()
    p = Bytes(src.take(src.itf8()))
    if codec == 0:
        return lambda s: 0
    if codec == 1:
        number = p.itf8()
        return lambda s: s.stream(number).itf8()
    if codec == 3:
        return _huffman(p.ints(), p.ints())
    if codec == 6:
        offset, bits = p.itf8(), p.itf8()
        return lambda s: s.core.bits(bits) - offset
    if codec == 7:
        offset, k = p.itf8(), p.itf8()

        def subexp(s: Slice) -> int:
            n = 0
            while s.core.bit():
                n += 1
            return (s.core.bits(k) if n == 0 else 1 << (n + k - 1) | s.core.bits(n + k - 1)) - offset

        return subexp
    if codec in (2, 8):
        offset, m = p.itf8(), p.itf8()
        bits = m if codec == 8 else max(0, m - 1).bit_length()
        if codec == 2 and m & (m - 1):
            raise ValueError("Golomb parameter isn't a power of two")

        def golomb(s: Slice) -> int:
            n = 0
            while s.core.bit():
                n += 1
            return (n << bits | s.core.bits(bits)) - offset

        return golomb
    if codec == 9:
        offset = p.itf8()

        def gamma(s: Slice) -> int:
            n = 0
            while not s.core.bit():
                n += 1
            return (1 << n | s.core.bits(n)) - offset

        return gamma
    raise ValueError(f"integer encoding {codec}")


def byte_codec(src: Bytes) -> Callable[[Slice], int]:
    """An encoding of single bytes."""
    start = src.at
    codec = src.itf8()
    p = Bytes(src.take(src.itf8()))
    if codec == 1:
        number = p.itf8()
        return lambda s: s.stream(number).byte()
    src.at = start
    return int_codec(src)


def array_codec(src: Bytes) -> Callable[[Slice], bytes]:
    """An encoding of byte arrays."""
    codec = src.itf8()
    p = Bytes(src.take(src.itf8()))
    if codec == 0:
        return lambda s: b""
    if codec == 4:
        length = int_codec(p)
        at = p.at
        inner = p.itf8()
        body = Bytes(p.take(p.itf8()))
        if inner == 1:
            number = body.itf8()
            return lambda s: (lambda n: s.stream(number).take(n))(length(s))
        p.at = at
        value = byte_codec(p)
        return lambda s: bytes(value(s) for _ in range(length(s)))
    if codec == 5:
        stop, number = p.byte(), p.itf8()

        def until(s: Slice) -> bytes:
            stream = s.stream(number)
            end = stream.data.index(stop, stream.at)
            out = stream.data[stream.at : end]
            stream.at = end + 1
            return out

        return until
    raise ValueError(f"byte array encoding {codec}")


_INTS = "BF CF RI RL AP RG MF NS NP TS NF TL FN FP DL RS PD HC MQ".split()
_BYTES = "FC BA QS BS".split()
_ARRAYS = "RN SC IN BB QQ".split()


class Compression:
    """The compression header of a container."""

    def __init__(self, data: bytes) -> None:
        src = Bytes(data)
        self.names = self.delta = self.reference = True
        self.substitutions = b"\x1b" * 5
        self.tag_lists: list[list[bytes]] = [[]]
        src.itf8()
        for _ in range(src.itf8()):
            key = src.take(2)
            if key in (b"RN", b"AP", b"RR"):
                setattr(self, {b"RN": "names", b"AP": "delta", b"RR": "reference"}[key], bool(src.byte()))
            elif key == b"SM":
                self.substitutions = src.take(5)
            elif key == b"TD":
                lists = src.take(src.itf8()).split(b"\0")[:-1]
                self.tag_lists = [[x[i : i + 3] for i in range(0, len(x), 3)] for x in lists]
            else:
                raise ValueError(f"preservation key {key!r}")
        self.series: dict[str, Callable] = {}
        src.itf8()
        for _ in range(src.itf8()):
            key = src.take(2).decode()
            if key in _INTS:
                self.series[key] = int_codec(src)
            elif key in _BYTES:
                self.series[key] = byte_codec(src)
            elif key in _ARRAYS:
                self.series[key] = array_codec(src)
            else:
                src.itf8()
                src.take(src.itf8())
        self.tags: dict[bytes, Callable] = {}
        src.itf8()
        for _ in range(src.itf8()):
            key = src.itf8()
            self.tags[bytes([key >> 16 & 255, key >> 8 & 255, key & 255])] = array_codec(src)
        # The base that a substitution code stands for, by reference base.
        self.change = {}
        for ref, byte in zip("ACGTN", self.substitutions, strict=True):
            others = [b for b in "ACGTN" if b != ref]
            self.change[ref] = {byte >> (6 - 2 * k) & 3: b for k, b in enumerate(others)}


# ---- Records ------------------------------------------------------------------------------------------------------------------------


class Reference:
    """Sequences of a FASTA file, read by name when they are needed; the last few are kept."""

    def __init__(self, path: str | None) -> None:
        self.path, self.kept = path, {}
        self.index = bgzf.read_fai(path + ".fai") if path and files.exists(path + ".fai") else None
        self.whole: dict[str, str] | None = None

    def sequence(self, name: str) -> str:
        if self.path is None:
            raise ValueError(f"the bases of {name} need a reference FASTA")
        if name not in self.kept:
            if len(self.kept) > 3:
                self.kept.clear()
            self.kept[name] = self._read(name)
        return self.kept[name]

    def _read(self, name: str) -> str:
        if self.index is not None:
            if name not in self.index:
                raise ValueError(f"{name} is not in the reference")
            from helixlake.plans.region import Interval

            a, b, _ = self.index[name].span(Interval())
            return files.read_range(self.path, a, b).translate(None, b"\r\n ").decode().upper()
        if self.whole is None:
            self.whole = {}
            with files.open_text(self.path) as f:
                current: list[bytes] = []
                for line in files.lines(f):
                    if line.startswith(b">"):
                        current = []
                        self.whole[line[1:].split()[0].decode()] = current
                    else:
                        current.append(line.strip())
        if name not in self.whole:
            raise ValueError(f"{name} is not in the reference")
        return b"".join(self.whole[name]).decode().upper()


_CODES = {"S": "SC", "I": "IN", "b": "BB", "q": "QQ", "D": "DL", "N": "RS", "P": "PD", "H": "HC", "X": "BS", "i": "BA", "Q": "QS"}


def _features(series: dict[str, Callable], s: Slice) -> list[tuple[int, str, object]]:
    out, at = [], 0
    for _ in range(series["FN"](s)):
        code = chr(series["FC"](s))
        at += series["FP"](s)
        if code == "B":
            out.append((at, code, (series["BA"](s), series["QS"](s))))
        elif code in _CODES:
            out.append((at, code, series[_CODES[code]](s)))
        else:
            raise ValueError(f"read feature {code!r}")
    return out


def _rebuild(length: int, start: int, features: list, fetch: Callable[[int, int], str] | None, compression: Compression, known: bool) -> tuple[str, list[tuple[int, str]], dict[int, int]]:
    """Bases, CIGAR and the qualities that features give, of a placed read."""
    bases: list[str] = []
    cigar: list[tuple[int, str]] = []
    quality: dict[int, int] = {}
    at, ref = 1, start

    def op(n: int, o: str) -> None:
        if n and cigar and cigar[-1][1] == o:
            cigar[-1] = (cigar[-1][0] + n, o)
        elif n:
            cigar.append((n, o))

    def match(n: int) -> None:
        nonlocal at, ref
        if n > 0:
            bases.append(fetch(ref, n) if known else "N" * n)
            op(n, "M")
            at, ref = at + n, ref + n

    for pos, code, value in features:
        if code == "Q":
            quality[pos - 1] = value
            continue
        if code == "q":
            quality |= {pos - 1 + k: q for k, q in enumerate(value)}
            continue
        match(pos - at)
        if code == "X":
            old = fetch(ref, 1) if known else "N"
            bases.append(compression.change.get(old, compression.change["N"]).get(value, "N"))
            op(1, "M")
            at, ref = at + 1, ref + 1
        elif code == "B":
            bases.append(chr(value[0]))
            quality[pos - 1] = value[1]
            op(1, "M")
            at, ref = at + 1, ref + 1
        elif code == "b":
            bases.append(value.decode())
            op(len(value), "M")
            at, ref = at + len(value), ref + len(value)
        elif code in "SI":
            bases.append(value.decode())
            op(len(value), code)
            at += len(value)
        elif code == "i":
            bases.append(chr(value))
            op(1, "I")
            at += 1
        else:
            op(value, code)
            ref += value if code in "DN" else 0
    match(length + 1 - at)
    return "".join(bases), cigar, quality


def slice_records(blocks: list[Block], compression: Compression, header: Header, reference: Reference) -> list[tuple]:
    """The rows of a slice; ``blocks`` begin with its header."""
    src = Bytes(blocks[0].data)
    slice_ref, slice_start, _, n, counter = src.itf8(), src.itf8(), src.itf8(), src.itf8(), src.ltf8()
    src.itf8()
    src.ints()
    embedded = src.itf8()
    core = next((b.data for b in blocks[1:] if b.kind == 5), b"")
    external = {b.id: b.data for b in blocks[1:] if b.kind == 4}
    s, g = Slice(core, external), compression.series
    inner = external.get(embedded, b"").decode().upper() if embedded >= 0 else None
    last = slice_start
    raw: list[dict] = []
    for k in range(n):
        r: dict = {"flag": g["BF"](s), "bits": g["CF"](s)}
        r["ref"] = g["RI"](s) if slice_ref == -2 else slice_ref
        length = g["RL"](s)
        last = last + g["AP"](s) if compression.delta else g["AP"](s)
        r["start"] = last
        group = g["RG"](s)
        r["name"] = g["RN"](s).decode() if compression.names else None
        r["next"], r["mate"] = None, -1
        if r["bits"] & 2:
            mate = g["MF"](s)
            r["flag"] |= 0x20 * (mate & 1) | 0x8 * (mate >> 1 & 1)
            if not compression.names:
                r["name"] = g["RN"](s).decode()
            r["mate"] = g["NS"](s)
            g["NP"](s)
            g["TS"](s)
        elif r["bits"] & 4:
            r["next"] = k + g["NF"](s) + 1
        tags = b"".join(t + compression.tags[t](s) for t in compression.tag_lists[g["TL"](s)])
        r["tags"] = bam.decode_tags(tags, 0)
        if 0 <= group < len(header.groups) and not any(t == "RG" for t, _, _ in r["tags"]):
            r["tags"].append(("RG", "Z", header.groups[group]))
        quality: dict[int, int] = {}
        r["cigar"], r["mapq"], known = [], 255, not r["bits"] & 8
        if not r["flag"] & 4:
            features = _features(g, s)
            r["mapq"] = g["MQ"](s)
            fetch = _fetcher(r["ref"], header, reference, inner, slice_start) if known else None
            bases, r["cigar"], quality = _rebuild(length, r["start"], features, fetch, compression, known)
        else:
            bases = bytes(g["BA"](s) for _ in range(length)).decode() if known else ""
        r["bases"] = bases if known else ""
        if r["bits"] & 1:
            r["quality"] = [g["QS"](s) for _ in range(length)]
        else:
            r["quality"] = [quality.get(i, 255) for i in range(length)] if quality else []
        raw.append(r)
    first: dict[int, int] = {}
    for k, r in enumerate(raw):
        if r["next"] is not None and r["next"] < n:
            first[r["next"]] = first.get(k, k)
    for k, r in enumerate(raw):
        other = raw[r["next"]] if r["next"] is not None and r["next"] < n else raw[first[k]] if k in first else None
        if other is not None:
            r["mate"] = other["ref"]
            r["flag"] |= 0x20 * (other["flag"] >> 4 & 1) | 0x8 * (other["flag"] >> 2 & 1)
        if r["name"] is None:
            r["name"] = str(counter + 1 + first.get(k, k))
    name = lambda i: header.names[i] if 0 <= i < len(header.names) else None
    out = []
    for r in raw:
        span = sum(c for c, o in r["cigar"] if o in "MDN=X")
        start = r["start"] if r["start"] > 0 and r["ref"] >= 0 else None
        mapq = None if r["mapq"] == 255 else str(r["mapq"])
        if all(q == 255 for q in r["quality"]):
            r["quality"] = []
        cigar = "".join(f"{c}{o}" for c, o in r["cigar"])
        out.append((r["name"], r["flag"], name(r["ref"]), start, start + span - 1 if start is not None and span else None, mapq, cigar, name(r["mate"]), r["bases"], r["quality"], r["tags"]))
    return out


def _fetcher(ref: int, header: Header, reference: Reference, inner: str | None, inner_start: int) -> Callable[[int, int], str]:
    if inner is not None:
        return lambda pos, n: inner[pos - inner_start : pos - inner_start + n].ljust(n, "N")
    return lambda pos, n: reference.sequence(header.names[ref])[pos - 1 : pos - 1 + n].ljust(n, "N")


def container_records(raw, c: Container, header: Header, reference: Reference) -> Iterator[tuple]:
    """The rows of a container."""
    raw.seek(c.offset + c.header)
    src = Bytes(raw.read(c.size))
    compression = Compression(read_block(src).data)
    blocks: list[Block] = []
    while src.at < len(src.data):
        b = read_block(src)
        if b.kind == 2 and blocks:
            yield from slice_records(blocks, compression, header, reference)
            blocks = []
        blocks.append(b)
    if blocks:
        yield from slice_records(blocks, compression, header, reference)


def read_crai(path: str) -> list[tuple[int, int, int, int]]:
    """``(reference, start, span, container offset)`` of every slice."""
    data = files.read_range(path, 0, None)
    text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    return [(int(p[0]), int(p[1]), int(p[2]), int(p[3])) for p in (line.split("\t") for line in text.decode().splitlines()) if len(p) >= 4]
