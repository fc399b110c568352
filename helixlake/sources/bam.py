"""BAM records as rows of the alignment schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from helixlake.sources import bgzf, columnar

_BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_OPS = "MIDNSHP=X"
_FIXED = struct.Struct("<iiBBHHHiiii")
_SCALAR = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def read_header(reader: bgzf.Reader) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the references."""
    if reader.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", reader.read(4))
    text = reader.read(n).rstrip(b"\0").decode()
    (n,) = struct.unpack("<i", reader.read(4))
    refs = []
    for _ in range(n):
        (size,) = struct.unpack("<i", reader.read(4))
        name = reader.read(size)[:-1].decode()
        refs.append((name, struct.unpack("<i", reader.read(4))[0]))
    return text, refs


def decode_tags(data: bytes, at: int) -> list[tuple[str, str, str]]:
    """``(tag, type, text)`` of every auxiliary field; the type of an array is ``B`` with its letter."""
    out = []
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _SCALAR:
            (x,) = struct.unpack_from("<" + _SCALAR[kind], data, at)
            at += struct.calcsize(_SCALAR[kind])
            out.append((tag, "f" if kind == "f" else "i", f"{x:g}" if kind == "f" else str(x)))
        elif kind == "A":
            out.append((tag, "A", chr(data[at])))
            at += 1
        elif kind in "ZH":
            stop = data.index(b"\0", at)
            out.append((tag, kind, data[at:stop].decode("utf-8", "replace")))
            at = stop + 1
        elif kind == "B":
            sub = chr(data[at])
            (n,) = struct.unpack_from("<i", data, at + 1)
            values = struct.unpack_from(f"<{n}{_SCALAR[sub]}", data, at + 5)
            at += 5 + struct.calcsize(_SCALAR[sub]) * n
            out.append((tag, "B" + sub, ", ".join(f"{v:.2f}" for v in values) if sub == "f" else ",".join(map(str, values))))
        else:
            raise ValueError(f"tag type {kind!r}")
    return out


def decode(data: bytes, names: list[str]) -> tuple:
    """A record's columns; the last holds the tags with their types."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, _, _ = _FIXED.unpack_from(data)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    sequence = "".join([_PAIRS[b] for b in packed])[:n_seq]
    quality = data[at : at + n_seq]
    at += n_seq
    tags = decode_tags(data, at)
    if n_cigar == 2 and ops[0] & 15 == 4 and ops[0] >> 4 == n_seq and ops[1] & 15 == 3:
        for k, (tag, kind, text) in enumerate(tags):
            if tag == "CG" and kind == "BI":
                ops = tuple(map(int, text.split(",")))
                del tags[k]
                break
    span = sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8))
    start = pos + 1 if pos >= 0 else None
    return (
        name, flag, names[ref] if ref >= 0 else None, start, start + span - 1 if start is not None and ops else None, None if mapq == 255 else str(mapq),
        "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops), names[mate] if mate >= 0 else None, sequence, [] if quality[:1] == b"\xff" else list(quality), tags,
    )


def records(reader: bgzf.Reader, names: list[str], end: int = bgzf.LAST) -> Iterator[tuple]:
    """Records that start before the virtual offset ``end``."""
    while reader.tell() < end:
        size = reader.read(4)
        if len(size) < 4:
            return
        yield decode(reader.read(struct.unpack("<i", size)[0]), names)


# ---- columns of many records at once -----------------------------------------------------------------------------------------------------

_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")])
_EXPANDED = np.frombuffer("".join(_PAIRS).encode(), np.uint8).reshape(256, 2)
_CONSUMES = np.array([o in (0, 2, 3, 7, 8) for o in range(16)])


def starts_of(data: bytes, at: int, stop: int) -> tuple[list[int], int]:
    """Offsets of the whole records that begin from ``at`` on and before ``stop``, and where the first incomplete one begins."""
    out, n = [], len(data)
    while at < stop and at + 4 <= n:
        size = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + size > n:
            break
        out.append(at)
        at += 4 + size
    return out, at


def columns(data: bytes, starts: list[int], names: list[str], wanted: list[str], typed: list[tuple[str, object]] | None = None, kinds: bool = False) -> list[pa.Array]:
    """The ``wanted`` columns of the records at ``starts``; ``typed`` tags as a struct, else a list of (tag, text), the tag with its type if ``kinds``."""
    buffer = np.frombuffer(data, np.uint8)
    at = np.array(starts, np.int64)
    head = buffer[at[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD).reshape(-1)
    n_name, n_cigar, n_seq = (head[c].astype(np.int64) for c in ("n_name", "n_cigar", "n_seq"))
    name_at = at + _HEAD.itemsize
    cigar_at = name_at + n_name
    seq_at = cigar_at + 4 * n_cigar
    packed = (n_seq + 1) // 2
    quality_at = seq_at + packed
    tags_at = quality_at + n_seq
    ends = at + 4 + head["size"]
    ops = columnar.pieces(buffer, cigar_at, 4 * n_cigar).view("<u4")
    n_ops = n_cigar
    long = _long_cigars(data, n_cigar, n_seq, ops, tags_at, ends) if {"cigar", "end", "tags"} & set(wanted) else {}
    if long:
        own = np.split(ops, np.cumsum(n_cigar)[:-1])
        for i, found in long.items():
            own[i] = found
        ops, n_ops = np.concatenate(own), np.array([len(x) for x in own], np.int64)
    start = head["pos"].astype(np.int64) + 1
    unplaced = start < 1

    def column(c: str) -> pa.Array:
        if c == "name":
            return columnar.strings(columnar.pieces(buffer, name_at, n_name - 1), n_name - 1)
        if c == "flag":
            return pa.array(head["flag"].astype(np.int32))
        if c == "reference":
            return columnar.names_of(head["ref"], names)
        if c == "mate_reference":
            return columnar.names_of(head["mate"], names)
        if c == "start":
            return pa.array(start, mask=unplaced)
        if c == "end":
            span = columnar.sums(np.where(_CONSUMES[ops & 15], ops >> 4, 0).astype(np.int64), n_ops)
            return pa.array(start + span - 1, mask=unplaced | (n_ops == 0))
        if c == "mapping_quality":
            texts = pa.array([*map(str, range(255)), None], pa.string())
            return texts.take(pa.array(head["mapq"]))
        if c == "cigar":
            distinct, inverse = np.unique(ops, return_inverse=True)
            pool = [f"{o >> 4}{_OPS[o & 15]}".encode() for o in distinct.tolist()]
            sizes = np.array([len(x) for x in pool], np.int64)
            text = np.frombuffer(b"".join(pool), np.uint8)
            return columnar.strings(columnar.pieces(text, (columnar.offsets(sizes)[:-1])[inverse], sizes[inverse]), columnar.sums(sizes[inverse], n_ops))
        if c == "sequence":
            pairs = _EXPANDED[columnar.pieces(buffer, seq_at, packed)].reshape(-1)
            return columnar.strings(columnar.pieces(pairs, 2 * columnar.offsets(packed)[:-1], n_seq), n_seq)
        if c == "quality_score":
            first = buffer[np.minimum(quality_at, len(buffer) - 1)]
            sizes = np.where((n_seq > 0) & (first == 255), 0, n_seq)
            return columnar.lists(pa.array(columnar.pieces(buffer, quality_at, sizes).astype(np.int64)), sizes)
        return _tags(data, tags_at.tolist(), ends.tolist(), set(long), typed, kinds)

    return [column(c) for c in wanted]


def _long_cigars(data: bytes, n_cigar: np.ndarray, n_seq: np.ndarray, ops: np.ndarray, tags_at: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """Operations of records whose cigar is too long for its field and stands in the tag CG."""
    first = columnar.offsets(n_cigar)[:-1]
    out = {}
    for i in np.flatnonzero(n_cigar == 2).tolist():
        a, b = int(ops[first[i]]), int(ops[first[i] + 1])
        if a & 15 == 4 and a >> 4 == n_seq[i] and b & 15 == 3:
            for tag, kind, text in decode_tags(data[tags_at[i] : ends[i]], 0):
                if tag == "CG" and kind == "BI":
                    out[i] = np.array(text.split(","), np.uint32)
    return out


def _tags(data: bytes, starts: list[int], ends: list[int], long: set[int], typed: list[tuple[str, object]] | None, kinds: bool) -> pa.Array:
    from helixlake.sources.binary import arrow_struct

    rows = []
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        found = decode_tags(data[a:b], 0)
        rows.append([t for t in found if t[0] != "CG"] if i in long else found)
    if typed is not None:
        return arrow_struct(rows, typed)
    sizes = np.array([len(r) for r in rows], np.int64)
    tag = pa.array([f"{t}:{k}" if kinds else t for r in rows for t, k, _ in r], pa.string())
    value = pa.array([v for r in rows for _, _, v in r], pa.string())
    return columnar.lists(pa.StructArray.from_arrays([tag, value], ["tag", "value"]), sizes)
