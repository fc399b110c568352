"""Bytes of the binary formats from rows, with their indexes: for round trips; a file is built in the memory of one task."""

import struct
import zlib

import numpy as np

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Bgzf:
    """BGZF writer that knows the virtual offset of every record."""

    def __init__(self, per_block: int = 300) -> None:
        self.blocks: list[bytes] = []
        self.size, self.buffer, self.per_block = 0, bytearray(), per_block

    def tell(self) -> int:
        return self.size << 16 | len(self.buffer)

    def write(self, data: bytes) -> None:
        self.buffer += data
        if len(self.buffer) >= self.per_block:
            self.flush()

    def flush(self) -> None:
        for k in range(0, len(self.buffer), 65_000):
            self.blocks.append(block(bytes(self.buffer[k : k + 65_000])))
            self.size += len(self.blocks[-1])
        self.buffer.clear()

    def done(self) -> bytes:
        self.flush()
        return b"".join(self.blocks) + EOF


def reg2bin(start: int, end: int) -> int:
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return base + (start >> shift)
    return 0


def index_body(spans, n_ref: int) -> bytes:
    """``spans``: (ref, start, end, voffset, voffset after), half-open from 0."""
    out = b""
    own: list[list] = [[] for _ in range(n_ref)]
    for ref, *span in spans:
        own[ref].append(span)
    for ref in range(n_ref):
        bins, linear = {}, {}
        for s, e, a, b in own[ref]:
            chunks = bins.setdefault(reg2bin(s, e), [])
            if chunks and chunks[-1][1] == a and chunks[-1][0] >> 16 == a >> 16:  # within one block
                chunks[-1] = (chunks[-1][0], b)
            else:
                chunks.append((a, b))
            for w in range(s >> 14, (max(e - 1, s) >> 14) + 1):
                linear[w] = min(linear.get(w, a), a)
        out += struct.pack("<i", len(bins))
        for n, cs in bins.items():
            out += struct.pack("<Ii", n, len(cs)) + b"".join(struct.pack("<QQ", *c) for c in cs)
        size = max(linear, default=-1) + 1
        out += struct.pack("<i", size) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(size))
    return out


_CODES = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}


def bam(refs, records, per_block: int = 300):
    """File and index; a record is (name, flag, ref, pos from 0, mapq, [(n, op)], sequence, quality or None, tags bytes)."""
    w = Bgzf(per_block)
    text = b"@HD\tVN:1.6\n"
    w.write(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in refs))
    w.flush()
    spans = []
    for name, flag, ref, pos, mapq, cigar, seq, qual, tags in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = [_CODES[c] for c in seq] + [0]
        packed = bytes([codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2)])
        quality = bytes(qual) if qual else b"\xff" * len(seq)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), ref, -1, 0) + name.encode() + b"\0" + ops + packed + quality + tags
        at = w.tell()
        w.write(struct.pack("<i", len(body)) + body)
        span = sum(n for n, o in cigar if o in "MDN=X") or 1
        if ref >= 0:
            spans.append((ref, pos, pos + span, at, w.tell()))
    return w.done(), b"BAI\x01" + struct.pack("<i", len(refs)) + index_body(spans, len(refs))


def tabix(lines, columns=(1, 2, 0), per_block: int = 200):
    """BGZF text and its index; ``columns`` are the sequence, begin and end columns from 1."""
    w = Bgzf(per_block)
    names, spans = [], []
    for line in lines:
        at = w.tell()
        w.write(line.encode() + b"\n")
        if line.startswith("#"):
            continue
        p = line.split("\t")
        name, start = p[columns[0] - 1], int(p[columns[1] - 1]) - 1
        end = int(p[columns[2] - 1]) if columns[2] else start + 1
        if name not in names:
            names.append(name)
        spans.append((names.index(name), start, end, at, w.tell()))
    joined = b"".join(n.encode() + b"\0" for n in names)
    body = b"TBI\x01" + struct.pack("<8i", len(names), 2, *columns, ord("#"), 0, len(joined)) + joined + index_body(spans, len(names))
    packed = Bgzf(1 << 40)
    packed.write(body)
    return w.done(), packed.done()


def typed_ints(values) -> bytes:
    code, letter, missing = (1, "b", -128) if all(v is None or -120 <= v < 128 for v in values) else (3, "i", -(1 << 31))
    return bytes([len(values) << 4 | code]) + b"".join(struct.pack("<" + letter, missing if v is None else v) for v in values)


def typed_text(text: str) -> bytes:
    data = text.encode()
    return (bytes([len(data) << 4 | 7]) if len(data) < 15 else bytes([0xF7]) + typed_ints([len(data)])) + data


def typed_floats(values) -> bytes:
    return bytes([len(values) << 4 | 5]) + b"".join(struct.pack("<I", 0x7F800001) if v is None else struct.pack("<f", v) for v in values)


def bcf(header: str, records, per_block: int = 300) -> bytes:
    """``records``: (chrom index, pos from 0, qual, id, alleles, filter indexes, info bytes list, format bytes list, samples)."""
    w = Bgzf(per_block)
    text = header.encode() + b"\0"
    w.write(b"BCF\x02\x02" + struct.pack("<I", len(text)) + text)
    w.flush()
    for chrom, pos, qual, name, alleles, filters, info, formats, samples in records:
        q = struct.pack("<I", 0x7F800001) if qual is None else struct.pack("<f", qual)
        shared = struct.pack("<iii", chrom, pos, 1) + q + struct.pack("<II", len(alleles) << 16 | len(info), len(formats) << 24 | samples)
        shared += typed_text(name) + b"".join(map(typed_text, alleles)) + typed_ints(filters) + b"".join(info)
        individual = b"".join(formats)
        w.write(struct.pack("<II", len(shared), len(individual)) + shared + individual)
    return w.done()


def _tree(items, at: int) -> bytes:
    """One R-tree node: (chrom, start, chrom, end, offset, size)."""
    head = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(items), items[0][0], items[0][1], items[-1][2], items[-1][3], at, 1, 0)
    return head + struct.pack("<BBH", 1, 0, len(items)) + b"".join(struct.pack("<IIIIQQ", *i) for i in items)


def bigwig(chroms, values, zoom_level: int, zooms) -> bytes:
    """``values``: {chrom: [(start, end, value)]}; ``zooms``: {chrom: [(start, end, covered, min, max, sum, sumsq)]}."""
    names = sorted(chroms)
    key = max(map(len, names))
    out = bytearray(64 + 24)
    tree = len(out)
    out += struct.pack("<IIIIQQ", 0x78CA8C91, 256, key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    for i, n in enumerate(names):
        out += n.encode().ljust(key, b"\0") + struct.pack("<II", i, chroms[n])

    def section(rows, make):
        items, start = [], len(out)
        nonlocal_out = out
        for n in names:
            for k in range(0, len(rows.get(n, ())), 1024):
                part = rows[n][k : k + 1024]
                data = zlib.compress(make(names.index(n), part))
                items.append((names.index(n), part[0][0], names.index(n), max(r[1] for r in part), len(nonlocal_out), len(data)))
                nonlocal_out.extend(data)
        index = len(nonlocal_out)
        nonlocal_out.extend(_tree(items, index))
        return start, index

    full, index = section(values, lambda c, rs: struct.pack("<IIIIIBBH", c, rs[0][0], rs[-1][1], 0, 0, 1, 0, len(rs)) + b"".join(struct.pack("<IIf", *r) for r in rs))
    zdata, zindex = section(zooms, lambda c, rs: b"".join(struct.pack("<IIIIffff", c, *r) for r in rs))
    out[:64] = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 1, tree, full, index, 0, 0, 0, 0, 32768, 0)
    out[64:88] = struct.pack("<IIQQ", zoom_level, 0, zdata, zindex)
    return bytes(out)


def fcs(columns, rows) -> bytes:
    x = np.array(rows, "<f4")
    pairs = {"$PAR": str(len(columns)), "$TOT": str(len(rows)), "$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L"}
    for k, c in enumerate(columns, 1):
        pairs |= {f"$P{k}N": f"ch{k}", f"$P{k}S": c, f"$P{k}B": "32"}
    text = ("|" + "|".join(f"{k}|{v}" for k, v in pairs.items()) + "|").encode()
    begin = 58
    data = begin + len(text)
    head = b"FCS3.0    " + "".join(f"{v:>8}" for v in (begin, data - 1, data, data + x.nbytes - 1, 0, 0)).encode()
    return head + text + x.tobytes()
