"""CRAM files made by a small writer: every series external, blocks raw, packed or rANS coded."""

import bz2
import gzip
import lzma
import random
import struct
import zlib

import pytest

from helixlake.sources import cram


def itf8(x):
    x &= 0xFFFFFFFF
    if x < 1 << 7:
        return bytes([x])
    if x < 1 << 14:
        return bytes([x >> 8 | 0x80, x & 255])
    if x < 1 << 21:
        return bytes([x >> 16 | 0xC0, x >> 8 & 255, x & 255])
    if x < 1 << 28:
        return bytes([x >> 24 | 0xE0, x >> 16 & 255, x >> 8 & 255, x & 255])
    return bytes([x >> 28 | 0xF0, x >> 20 & 255, x >> 12 & 255, x >> 4 & 255, x & 15])


def ltf8(x):
    return bytes([x]) if x < 128 else b"\xff" + struct.pack(">Q", x)


def frequencies(counts):
    """Counts scaled to 4095 and their table's bytes."""
    total = sum(counts.values())
    freq = {s: max(1, c * 4000 // total) for s, c in counts.items()}
    top = max(freq, key=freq.get)
    freq[top] += 4095 - sum(freq.values())
    return freq


def table(freq, value):
    out, symbols, k = b"", sorted(freq), 0
    while k < len(symbols):
        s = symbols[k]
        run = 0
        if k and symbols[k - 1] + 1 == s:
            while k + run + 1 < len(symbols) and symbols[k + run + 1] == s + run + 1:
                run += 1
            out += bytes([s, run])
        else:
            out += bytes([s])
        for j in range(run + 1):
            out += value(symbols[k + j])
        k += run + 1
    return out + b"\0"


def number(f):
    return bytes([f]) if f < 128 else bytes([f >> 8 | 128, f & 255])


def rans_encode(data, order):
    n = len(data)
    if not n:
        return struct.pack("<Bii", order, 0, 0)
    quarter = n // 4
    if order == 0:
        steps = [(i, i & 3, None) for i in range(n)]
        counts = {None: {b: data.count(b) for b in set(data)}}
    else:
        steps = [(i + j * quarter, j, i > 0) for i in range(quarter + n - 4 * quarter) for j in (range(4) if i < quarter else (3,))]
        counts = {}
        for at, _, inner in steps:
            c = counts.setdefault(data[at - 1] if inner else 0, {})
            c[data[at]] = c.get(data[at], 0) + 1
    freqs = {c: frequencies(k) for c, k in counts.items()}
    bases = {}
    for c, f in freqs.items():
        total, bases[c] = 0, {}
        for s in sorted(f):
            bases[c][s] = total
            total += f[s]
    state, tail = [1 << 23] * 4, bytearray()
    for at, j, inner in reversed(steps):
        c = None if order == 0 else data[at - 1] if inner else 0
        f, x = freqs[c][data[at]], state[j]
        while x >= (1 << 19) * f:
            tail.append(x & 255)
            x >>= 8
        state[j] = (x // f << 12) + x % f + bases[c][data[at]]
    one = lambda c: table(freqs[c], lambda s: number(freqs[c][s]))
    head = one(None) if order == 0 else table(freqs, one)
    body = head + struct.pack("<4I", *state) + bytes(reversed(tail))
    return struct.pack("<Bii", order, len(body), n) + body


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    rng = random.Random(order)
    for n in (0, 1, 3, 4, 5, 100, 4099):
        data = bytes(rng.choice(b"ACGTACGTAAAAZ\x00\x01\x02") for _ in range(n))
        assert cram.rans(rans_encode(data, order)) == data


def test_integers():
    for x in (0, 1, 127, 128, 16383, 16384, 1 << 20, 1 << 27, (1 << 31) - 1, -1, -2, -(1 << 31)):
        assert cram.Bytes(itf8(x)).itf8() == x
    assert cram.Bytes(ltf8(5)).ltf8() == 5 and cram.Bytes(ltf8(1 << 40)).ltf8() == 1 << 40


PACK = {0: bytes, 1: gzip.compress, 2: bz2.compress, 3: lzma.compress, 4: lambda d: rans_encode(d, 1)}


def block(method, kind, number, data):
    packed = PACK[method](data)
    body = bytes([method, kind]) + itf8(number) + itf8(len(packed)) + itf8(len(data)) + packed
    return body + struct.pack("<I", zlib.crc32(body))


def container(ref, start, span, n, blocks, landmarks=()):
    data = b"".join(blocks)
    head = struct.pack("<i", len(data)) + itf8(ref) + itf8(start) + itf8(span) + itf8(n) + ltf8(0) + ltf8(0) + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + data


IDS = {k: i + 1 for i, k in enumerate("BF CF RI RL AP RG MF NS NP TS NF TL FN FP DL RS PD HC MQ FC BA QS BS RN SC IN BB QQ".split())}
REF = "ACGTACGTNNACGTACGTACGTACGTACGTACGTACGTACGT"


def external(n):
    return itf8(1) + itf8(len(itf8(n))) + itf8(n)


def stopped(n):
    p = b"\0" + itf8(n)
    return itf8(5) + itf8(len(p)) + p


def data_container(records, methods, names=True, delta=True, embed=False, multi=False):
    """``records``: dicts of series values, in the order in which a record writes them."""
    streams = {k: b"" for k in IDS}
    tags = b""
    for r in records:
        for key, value in r["series"]:
            streams[key] += value.encode() + b"\0" if key in ("RN", "SC", "IN", "BB", "QQ") else bytes([value]) if key in ("FC", "BA", "QS", "BS") else itf8(value)
        tags += r.get("tag", b"")
    maps = b"RN" + bytes([names]) + b"AP" + bytes([delta]) + b"RR\x01SM\x1b\x1b\x1b\x1b\x1b" + b"TD" + itf8(5) + b"\0PGZ\0"
    preserve = itf8(5) + maps
    series = itf8(len(IDS)) + b"".join(k.encode() + (stopped(n) if k in ("RN", "SC", "IN", "BB", "QQ") else external(n)) for k, n in IDS.items())
    length = external(90)
    inner = length + external(91)
    tagged = itf8(1) + itf8(ord("P") << 16 | ord("G") << 8 | ord("Z")) + itf8(4) + itf8(len(inner)) + inner
    compression = b"".join(itf8(len(x)) + x for x in (preserve, series, tagged))
    streams |= {}
    blocks = [block(methods[0], 5, 0, b"")]
    blocks += [block(methods[n % len(methods)], 4, n, streams[k]) for k, n in IDS.items()]
    sizes = b"".join(itf8(len(r["tag"])) for r in records if r.get("tag"))
    blocks += [block(0, 4, 90, sizes), block(1, 4, 91, tags)]
    if embed:
        blocks.append(block(1, 4, 99, REF.encode()))
    ref = -2 if multi else 0
    head = itf8(ref) + itf8(1) + itf8(len(REF)) + itf8(len(records)) + ltf8(0) + itf8(len(blocks)) + itf8(0) + itf8(99 if embed else -1) + b"\0" * 16
    return container(ref, 1, len(REF), len(records), [block(1, 1, 0, compression), block(0, 2, 0, head), *blocks])


def record(name, flag, pos, length, features, quality=None, tag=None, bits=0, ref=None, mate=None, nf=None, names=True):
    s = [("BF", flag), ("CF", bits | (1 if quality else 0))]
    if ref is not None:
        s.append(("RI", ref))
    s += [("RL", length), ("AP", pos), ("RG", 0 if tag else -1)]
    if names:
        s.append(("RN", name))
    if mate:
        s += [("MF", mate[0]), ("NS", mate[1]), ("NP", 5), ("TS", 0)] if names else [("MF", mate[0]), ("RN", name), ("NS", mate[1]), ("NP", 5), ("TS", 0)]
    if nf is not None:
        s.append(("NF", nf))
    s.append(("TL", 1 if tag else 0))
    if not flag & 4:
        s.append(("FN", len(features)))
        before = 0
        for at, code, extra in features:
            s += [("FC", ord(code)), ("FP", at - before), *extra]
            before = at
        s.append(("MQ", 30))
    elif not bits & 8:
        s += [("BA", ord(b)) for b in features]
    s += [("QS", q) for q in quality or []]
    return {"series": s, "tag": tag.encode() + b"\0" if tag else b""}


RECORDS = [
    lambda **k: record("r0", 0x43, 1, 4, [], [9, 9, 9, 9], "bull", bits=4, nf=0, **k),
    lambda **k: record("r1", 0x93, 4, 10, [(1, "S", [("SC", "GG")]), (4, "X", [("BS", 0)]), (5, "I", [("IN", "TT")]), (7, "D", [("DL", 2)]), (9, "B", [("BA", ord("C")), ("QS", 7)])], **k),
    lambda **k: record("r2", 0, 3, 6, [(1, "H", [("HC", 3)]), (3, "N", [("RS", 4)]), (5, "i", [("BA", ord("A"))])], bits=2, mate=(3, 0), **k),
    lambda **k: record("r3", 4, 0, 3, "ACN", [1, 2, 3], **k),
]


def cram_file(path, containers):
    text = b"@HD\tVN:1.6\n@SQ\tSN:c1\tLN:42\n@SQ\tSN:c2\tLN:42\n@RG\tID:lane\n"
    head = container(0, 0, 0, 0, [block(0, 0, 0, struct.pack("<i", len(text)) + text)])
    offsets, out = [], b"CRAM\x03\x00" + b"x" * 20 + head
    for c in containers:
        offsets.append(len(out))
        out += c
    out += container(-1, cram.EOF_START, 0, 0, [])
    path.write_bytes(out)
    return offsets


@pytest.fixture
def fasta(tmp_path):
    (tmp_path / "ref.fa").write_text(f">c1 x\n{REF}\n>c2\n{REF[::-1]}\n")
    return str(tmp_path / "ref.fa")


def check(rows):
    a, b, c, d = rows
    assert (a.name, a.flag, a.reference, a.start, a.end, a.cigar, a.sequence, a.quality_score, a.mate_reference, a.mapping_quality) == ("r0", 0x43 | 0x20, "c1", 2, 5, "4M", REF[1:5], [9] * 4, "c1", "30")
    assert {t.tag: t.value for t in a.tags} == {"PG": "bull", "RG": "lane"}
    # r1 starts at 6: two clipped, one match, a substitution, two inserted, a deletion of two, two matches around a given base
    changed = cram.Compression.__init__  # noqa: F841
    ref = REF[5:]
    alt = [x for x in "ACGTN" if x != ref[1]][0]
    assert (b.name, b.start, b.cigar, b.mate_reference, b.flag) == ("r1", 6, "2S2M2I2D4M", "c1", 0x93)
    assert b.sequence == "GG" + ref[0] + alt + "TT" + ref[4:6] + "C" + ref[7] and b.end == 6 + 8 - 1
    assert (c.name, c.start, c.cigar, c.flag, c.mate_reference) == ("r2", 9, "3H2M4N2M1I1M", 0x28, "c1")
    assert (d.name, d.flag, d.sequence, d.quality_score, d.cigar, d.mapping_quality) == ("r3", 4, "ACN", [1, 2, 3], "", None)


@pytest.mark.parametrize("methods", [(0,), (1, 2, 3), (4,), (0, 1, 4)])
def test_records(gx, tmp_path, fasta, methods):
    cram_file(tmp_path / "x.cram", [data_container([r() for r in RECORDS], methods)])
    check(gx.read_cram(str(tmp_path / "x.cram"), fasta).orderBy("name").collect())
    tagged = gx.read_cram(str(tmp_path / "x.cram"), fasta, parse_tags=True).select("tags.*").first()
    assert (tagged.PG, tagged.RG) == ("bull", "lane")


def test_reference_kinds(gx, tmp_path, fasta):
    path = str(tmp_path / "x.cram")
    cram_file(tmp_path / "x.cram", [data_container([r() for r in RECORDS], (1,), embed=True)])
    check(gx.read_cram(path).orderBy("name").collect())
    (tmp_path / "ref.fa.fai").write_text(f"c1\t{len(REF)}\t6\t{len(REF)}\t{len(REF) + 1}\nc2\t{len(REF)}\t{6 + len(REF) + 5}\t{len(REF)}\t{len(REF) + 1}\n")
    cram_file(tmp_path / "x.cram", [data_container([r() for r in RECORDS], (1,))])
    check(gx.read_cram(path, fasta).orderBy("name").collect())
    with pytest.raises(Exception, match="need a reference"):
        gx.read_cram(path).collect()


def test_names_and_several_references(gx, tmp_path, fasta):
    path = str(tmp_path / "x.cram")
    cram_file(tmp_path / "x.cram", [data_container([r(names=False) for r in RECORDS], (0,), names=False)])
    assert [r.name for r in gx.read_cram(path, fasta).collect()] == ["1", "1", "r2", "4"]
    cram_file(tmp_path / "x.cram", [data_container([record("a", 0, 1, 3, [], ref=1), record("b", 0, 2, 3, [], ref=0)], (0,), delta=False, multi=True)])
    rows = gx.read_cram(path, fasta).collect()
    assert [(r.name, r.reference, r.start, r.sequence) for r in rows] == [("a", "c2", 1, REF[::-1][:3]), ("b", "c1", 2, REF[1:4])]


def test_region_through_crai(gx, tmp_path, fasta):
    path = str(tmp_path / "x.cram")
    offsets = cram_file(tmp_path / "x.cram", [data_container([record("a", 0, 1, 3, [])], (1,)), data_container([record("b", 0, 20, 3, [])], (1,))])
    (tmp_path / "x.cram.crai").write_bytes(gzip.compress("".join(f"0\t{1 + p}\t3\t{o}\t0\t0\n" for p, o in zip((1, 20), offsets)).encode()))
    df = gx.read_cram(path, fasta)
    assert df.rdd.getNumPartitions() == 2 and df.count() == 2
    df.createOrReplaceTempView("cr")
    assert [r.name for r in gx.sql("SELECT name FROM cr WHERE cram_region_filter('c1:15-30', reference, start, `end`)").collect()] == ["b"]
    assert gx.sql("SELECT name FROM cr WHERE cram_region_filter('c2', reference)").count() == 0


def test_not_cram(tmp_path):
    (tmp_path / "x.cram").write_bytes(b"nope" * 20)
    with open(tmp_path / "x.cram", "rb") as f, pytest.raises(ValueError, match="not a CRAM"):
        cram.read_header(f)
