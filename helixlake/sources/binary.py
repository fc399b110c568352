"""Formats that need a decoder of their own, as Python data sources.

Files are listed and headers read on the driver; a partition is one file or a byte range of one.  The option ``prune`` (a region) lets
an index leave out blocks that can't hold its rows, ``only`` (``key=value``, separated by ``;``) leaves out partition directories; the
caller applies the exact predicate, as ``GenomicsSession`` does.  Rows leave the decoders as Arrow batches of the wanted columns (option
``columns``).

The sources don't take part in Spark's filter pushdown: in 4.1 a relation keeps the filters that were pushed last, so that a second scan
of the same view, even in the same query, would silently read the first one's rows.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

from helixlake.plans.region import Region
from helixlake.sources import bam, bcf, bgzf, bigwig, columnar, cram, fcs, files, schemas

ROWS = 8192
#: Compressed bytes, or bytes of plain text, of one partition.
SPLIT = 64 << 20


class Part(InputPartition):
    """What one task reads: a file, its ``key=value`` columns, and a range whose meaning is the format's own."""

    def __init__(self, path: str, keys: tuple[tuple[str, str], ...], what: tuple = ()) -> None:
        self.path, self.keys, self.what = path, keys, what


def _lower(options: dict) -> dict:
    return {k.lower(): v for k, v in options.items()}


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def _plain(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    while chunk := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in chunk], f.type) for i, f in enumerate(arrow)], names=arrow.names)


class Format:
    """How one format is planned and read."""

    name = ""
    ddl = ""

    def schema(self, found: list[files.Found], options: dict) -> T.StructType:
        return schemas.struct(self.ddl)

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        return [()]

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        raise NotImplementedError

    def batches(self, part: Part, options: dict, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """Batches of the columns of ``schema``."""
        full = self.full(part, options, schema)
        at = [full.index(f.name) for f in schema]
        yield from _plain((tuple(r[i] for i in at) for r in self.rows(part, options, schema)), schema)

    def full(self, part: Part, options: dict, schema: T.StructType) -> list[str]:
        """Names of the columns that ``rows`` gives."""
        return schemas.struct(self.ddl).names


class Fastq(Format):
    """FASTQ; plain files are split, a split begins at a record whose four lines agree.  Lines may end in carriage returns."""

    name, ddl = "fastq", schemas.FASTQ
    #: Bytes that are parsed at once; a longer record makes its chunk as long as it needs.
    CHUNK = 4 << 20

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        if options.get("compression", "").lower() not in ("", "none", "uncompressed") or any(f.path.lower().endswith(c) for c in schemas.COMPRESSIONS):
            return [()]
        size = int(options.get("split", SPLIT))
        return [(a, min(a + size, f.size)) for a in range(0, max(f.size, 1), size)]

    @staticmethod
    def sync(text: bytes, whole: bool) -> int | None:
        """Offset of the first line that begins a record; None if ``text`` must go on before that can be told, the length if it is ``whole``
        and holds none."""
        at = 0
        while at < len(text):
            stops, k = [], at
            for _ in range(4):
                stop = text.find(b"\n", k)
                if stop < 0 and not whole:
                    return None
                stop = len(text) if stop < 0 else stop
                stops.append((k, stop))
                k = stop + 1
            head, seq, plus, qual = (text[a:b].rstrip(b"\r") for a, b in stops)
            if head[:1] == b"@" and plus[:1] == b"+" and len(seq) == len(qual):
                return at
            at = stops[0][1] + 1
        return len(text) if whole else None

    def begin(self, s, start: int) -> int:
        """Place of the first record that begins at ``start`` or after it."""
        s.seek(start - 1)
        probe, size = b"", 1 << 16
        while True:
            more = s.read(size)
            probe += more
            skip = probe.find(b"\n") + 1
            found = self.sync(probe[skip:], not more) if skip else (len(probe) if not more else None)
            if found is not None:
                return start - 1 + skip + found if skip else start - 1 + found
            size = min(2 * size, 64 << 20)

    def batches(self, part: Part, options: dict, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        if not part.what:
            with files.open_text(part.path, options.get("compression")) as s:
                yield from self._chunks(s, 0, None, schema.names)
            return
        start, end = part.what
        with files.open_raw(part.path) as s:
            if start:
                start = self.begin(s, start)
            s.seek(start)
            if start < end:
                yield from self._chunks(s, start, end, schema.names)

    def _chunks(self, s, at: int, end: int | None, wanted: list[str]) -> Iterator[pa.RecordBatch]:
        """Records that begin before ``end``; ``at`` is the stream's place."""
        held = b""
        while True:
            more = s.read(self.CHUNK)
            text = held + more
            if not more and text and not text.endswith(b"\n"):
                text += b"\n"
            buffer = np.frombuffer(text, np.uint8)
            starts, sizes = self._framed(buffer)
            done = False
            if end is not None and len(starts):
                # Four lines of a record may end beyond; none may begin there.
                heads = starts[::4]
                inside = int(np.searchsorted(heads + at, end))
                done = inside < len(heads)
                starts, sizes = starts[: 4 * inside], sizes[: 4 * inside]
            n = len(starts) // 4
            used = text.index(b"\n", int(starts[4 * n - 1])) + 1 if n else 0
            if n:
                yield from self._table(buffer, starts[: 4 * n], sizes[: 4 * n], wanted)
            if not more and not done and (rest := text[used:].strip()):
                raise ValueError(f"FASTQ ends within a record: {rest[:40]!r}")
            if done or not more:
                return
            held, at = text[used:], at + used

    @staticmethod
    def _framed(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the complete lines, four to a record; blank lines between records are left out."""
        stops = np.flatnonzero(buffer == 10)
        starts = np.concatenate([np.zeros(min(1, len(stops)), np.int64), stops[:-1] + 1])
        sizes = stops - starts
        sizes = sizes - ((sizes > 0) & (buffer[np.maximum(stops - 1, 0)] == 13))
        if not (sizes[::4] == 0).any():
            return starts, sizes
        keep, k = np.ones(len(starts), bool), 0
        blank = (sizes == 0).tolist()
        while k < len(blank):
            if blank[k]:
                keep[k] = False
                k += 1
            else:
                k += 4
        return starts[keep], sizes[keep]

    @staticmethod
    def _table(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: list[str]) -> Iterator[pa.RecordBatch]:
        heads, pluses = starts[::4], starts[2::4]
        bad = np.flatnonzero((buffer[heads] != 64) | (sizes[2::4] == 0) | (buffer[pluses] != 43))
        if len(bad):
            raise ValueError(f"not a FASTQ record: {bytes(buffer[heads[bad[0]] : heads[bad[0]] + 60])!r}")
        text = lambda k: columnar.strings(columnar.pieces(buffer, starts[k::4], sizes[k::4]), sizes[k::4])
        named: dict[str, pa.Array] = {"sequence": text(1), "quality_scores": text(3)} if {"sequence", "quality_scores"} & set(wanted) else {}
        if {"name", "description"} & set(wanted):
            parts = pc.split_pattern(pc.utf8_slice_codeunits(text(0), 1), " ", max_splits=1)
            has = pc.greater(pc.list_value_length(parts), 1)
            named["name"] = pc.list_element(parts, 0)
            flat, first = parts.flatten(), parts.offsets.to_numpy()[:-1]
            after = flat.take(pa.array(np.where(has.to_numpy(zero_copy_only=False), first + 1, first)))
            named["description"] = pc.if_else(pc.and_(has, pc.not_equal(after, "")), after, pa.scalar(None, pa.string()))
        for k in range(0, len(heads), ROWS):
            yield pa.RecordBatch.from_arrays([named[c].slice(k, ROWS) for c in wanted], wanted)


class Alignments(Format):
    """BAM; with a ``.bai`` or ``.csi`` beside it, regions and splits are found through the index."""

    name, ddl = "bam", schemas.ALIGNMENT

    def schema(self, found: list[files.Found], options: dict) -> T.StructType:
        base = schemas.struct(schemas.ALIGNMENT)
        if not _flag(options, "parsetags"):
            return base
        from helixlake.sources.text import infer_tags

        # The session names the tags of all records; without it those of each file's first record count.
        seen = options["seentags"].split(";") if "seentags" in options else [f"{tag}:{kind}" for f in found for tag, kind, _ in self.first_tags(f.path, options)]
        tags = T.StructType([T.StructField(k, schemas.data_type(t)) for k, t in infer_tags([s for s in seen if s])])
        return T.StructType([*base.fields[:-1], T.StructField("tags", tags)])

    def first_tags(self, path: str, options: dict) -> list[tuple[str, str, str]]:
        with files.open_raw(path) as raw:
            reader = bgzf.Reader(raw)
            _, refs = bam.read_header(reader)
            return next((r[-1] for r in bam.records(reader, [n for n, _ in refs])), [])

    @staticmethod
    def index(path: str) -> bgzf.Index | None:
        names = [path + ".bai", path.removesuffix(".bam") + ".bai", path + ".csi"]
        return next((bgzf.read_index(p) for p in names if files.exists(p)), None)

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        index = self.index(f.path)
        if index is None:
            return [(None, None)]
        if region is not None:
            with files.open_raw(f.path) as raw:
                _, refs = bam.read_header(bgzf.Reader(raw))
            ref = next((i for i, (n, _) in enumerate(refs) if n == region.name), -1)
            return index.chunks(ref, region.interval)
        starts = index.splits(int(options.get("split", SPLIT)))
        return list(zip([None, *starts[1:]], [*starts[1:], None], strict=True)) if starts else [(None, None)]

    def batches(self, part: Part, options: dict, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """Columns of a few thousand records at once; those that aren't wanted aren't decoded."""
        start, end = part.what
        tags = schema["tags"].dataType if "tags" in schema.names else None
        typed = [(f.name, f.dataType) for f in tags] if isinstance(tags, T.StructType) else None
        with files.open_raw(part.path) as raw:
            reader = bgzf.Reader(raw)
            _, refs = bam.read_header(reader)
            names = [n for n, _ in refs]
            if start is not None:
                reader.seek(start)
            buffers = reader.buffers(bgzf.LAST if end is None else end)
            with contextlib.suppress(StopIteration):
                data, begin, stop = next(buffers)
                while True:
                    found, left = bam.starts_of(data, begin, stop)
                    for k in range(0, len(found), ROWS):
                        yield pa.RecordBatch.from_arrays(bam.columns(data, found[k : k + ROWS], names, schema.names, typed, _flag(options, "tagkinds")), schema.names)
                    data, begin, stop = buffers.send(left)

    @staticmethod
    def shaped(records: Iterator[tuple], schema: T.StructType, tag_kinds: bool = False) -> Iterator[tuple]:
        tags = schema["tags"].dataType if "tags" in schema.names else None
        if isinstance(tags, T.StructType):
            kinds = [(f.name, f.dataType) for f in tags]
            for r in records:
                found = {t: v for t, _, v in r[-1]}
                yield *r[:-1], {n: _value(found.get(n), k) for n, k in kinds}
        else:
            for r in records:
                yield *r[:-1], [{"tag": f"{t}:{k}" if tag_kinds else t, "value": v} for t, k, v in r[-1]]


def arrow_struct(rows: list[list[tuple[str, str, str]]], typed: list[tuple[str, T.DataType]]) -> pa.Array:
    """Tag lists as a struct of typed fields."""
    from pyspark.sql.pandas.types import to_arrow_type

    found = [{t: v for t, _, v in r} for r in rows]
    return pa.StructArray.from_arrays([pa.array([_value(r.get(n), k) for r in found], to_arrow_type(k)) for n, k in typed], [n for n, _ in typed])


def _value(text: str | None, kind: T.DataType) -> object:
    if text is None:
        return None
    with contextlib.suppress(ValueError):
        if isinstance(kind, T.ArrayType):
            return [_value(x.strip(), kind.elementType) for x in text.split(",")]
        return float(text) if isinstance(kind, (T.FloatType, T.DoubleType)) else text if isinstance(kind, T.StringType) else int(text)
    return None


class IndexedAlignments(Alignments):
    name = "indexed_bam"


class Cram(Alignments):
    """CRAM; with a ``.crai`` beside it containers are split over tasks and chosen by region.  Option ``reference``: a FASTA file."""

    name = "cram"
    batches = Format.batches

    def first_tags(self, path: str, options: dict) -> list[tuple[str, str, str]]:
        with files.open_raw(path) as raw:
            header = cram.read_header(raw)
            reference = cram.Reference(options.get("reference"))
            return next((r[-1] for c in cram.containers(raw, header.first) for r in cram.container_records(raw, c, header, reference)), [])

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        if not files.exists(f.path + ".crai"):
            return [(None,)]
        slices = cram.read_crai(f.path + ".crai")
        if region is not None:
            with files.open_raw(f.path) as raw:
                names = cram.read_header(raw).names
            # Slices of several references (-2) may hold any.
            slices = [x for x in slices if x[0] == -2 or 0 <= x[0] < len(names) and names[x[0]] == region.name and region.interval.overlaps(x[1], x[1] + max(x[2], 1) - 1)]
        return [(offset,) for offset in sorted({x[3] for x in slices})]

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        with files.open_raw(part.path) as raw:
            header, reference = cram.read_header(raw), cram.Reference(options.get("reference"))
            (at,) = part.what
            found = cram.containers(raw, header.first) if at is None else [cram.read_container(raw, at)]
            yield from self.shaped((r for c in found for r in cram.container_records(raw, c, header, reference)), schema, _flag(options, "tagkinds"))


class Variants(Format):
    """BCF; ``info`` and ``formats`` are typed by the headers of all files."""

    name, ddl = "bcf", schemas.VCF

    def header(self, path: str) -> bcf.Header:
        with files.open_raw(path) as raw:
            return bcf.read_header(bgzf.Reader(raw))

    def schema(self, found: list[files.Found], options: dict) -> T.StructType:
        from helixlake.sources.text import united

        with ThreadPoolExecutor(32) as pool:
            headers = list(pool.map(lambda f: self.header(f.path), found))
        base = schemas.struct(schemas.VCF)
        typed = lambda fields: T.StructType([T.StructField(n, _declared(k, t)) for n, k, t in fields])
        info, formats = united([h.info for h in headers]), united([h.format for h in headers])
        return T.StructType([*base.fields[:7], T.StructField("info", typed(info)), T.StructField("formats", T.ArrayType(typed(formats)))])

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        index = next((bgzf.read_index(p) for p in (f.path + ".csi",) if files.exists(p)), None)
        if index is None:
            return [(None, None)]
        if region is not None:
            ref = next((k for k, n in self.header(f.path).contigs.items() if n == region.name), -1)
            return index.chunks(ref, region.interval)
        starts = index.splits(int(options.get("split", SPLIT)))
        return list(zip([None, *starts[1:]], [*starts[1:], None], strict=True)) if starts else [(None, None)]

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        start, end = part.what
        with files.open_raw(part.path) as raw:
            reader = bgzf.Reader(raw)
            header = bcf.read_header(reader)
            if start is not None:
                reader.seek(start)
            rows = bcf.records(reader, header, bgzf.LAST if end is None else end)
            changed = {}
            for column, own in (("info", header.info), ("formats", header.format)):
                if column in schema.names:
                    kind = schema[column].dataType
                    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
                    changed[column] = {n: kind[n].dataType for n, number, k in own if n in kind.names and kind[n].dataType != _declared(number, k)}
            if not any(changed.values()):
                yield from rows
                return
            for r in rows:  # a file whose declarations differ from those of the table
                info = {**r[7], **{n: _widened(r[7].get(n), t) for n, t in changed.get("info", {}).items()}} if r[7] is not None else None
                formats = [{**x, **{n: _widened(x.get(n), t) for n, t in changed.get("formats", {}).items()}} for x in r[8]] if r[8] is not None else None
                yield *r[:7], info, formats


def _widened(value: object, kind: T.DataType) -> object:
    """A value of a narrower declaration as one of the table's type."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_widened(v, kind.elementType) for v in (value if isinstance(value, list) else [value])]
    return float(value) if isinstance(kind, T.FloatType) else str(value).lower() if isinstance(value, bool) else str(value)


def _declared(number: str, kind: str) -> T.DataType:
    base = {"Integer": T.IntegerType(), "Float": T.FloatType(), "Flag": T.BooleanType()}.get(kind, T.StringType())
    return base if number in ("0", "1") else T.ArrayType(base)


class Lines(Format):
    """Lines of BGZF text with a tabix or CSI index, as ``value``; the text parsers make rows of them."""

    ddl = "value string"

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        index = next((bgzf.read_index(f.path + e) for e in (".tbi", ".csi") if files.exists(f.path + e)), None)
        if index is None:
            raise FileNotFoundError(f"{f.path} has no .tbi or .csi beside it")
        region = Region.parse(options["region"]) if options.get("region") else region
        if region is not None:
            return index.chunks(index.names.index(region.name) if region.name in index.names else -1, region.interval)
        starts = index.splits(int(options.get("split", SPLIT)))
        return list(zip([None, *starts[1:]], [*starts[1:], None], strict=True)) if starts else [(None, None)]

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        start, end = part.what
        with files.open_raw(part.path) as raw:
            reader = bgzf.Reader(raw, start or 0)
            for line in reader.lines(bgzf.LAST if end is None else end):
                if line and line[:1] != b"#":
                    yield (line.decode("utf-8", "replace"),)


class IndexedVcf(Lines):
    """Rows of the VCF schema with raw ``info`` and ``formats``."""

    name, ddl = "indexed_vcf", schemas.VCF

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        for (line,) in super().rows(part, options, schema):
            p = line.rstrip("\r").split("\t", 8)
            p += [None] * (9 - len(p))
            there = lambda x: None if x in (None, ".") else x
            listed = lambda x, by: there(x).split(by) if there(x) else []
            yield p[0], int(p[1]), listed(p[2], ";"), p[3], listed(p[4], ",") or None, float(p[5]) if there(p[5]) else None, listed(p[6], ";"), there(p[7]), p[8]


class IndexedGff(Lines):
    name, ddl = "indexed_gff", schemas.GFF

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        from urllib.parse import unquote

        there = lambda x: None if x == "." else x
        for (line,) in super().rows(part, options, schema):
            p = line.rstrip("\r").split("\t")
            attributes: dict[str, list[str]] = {}
            for item in (p[8] if len(p) > 8 else "").split(";"):
                key, eq, value = item.strip().partition("=")
                if eq and key:
                    attributes.setdefault(unquote(key), [unquote(v) for v in value.split(",")])
            yield p[0], there(p[1]), p[2], int(p[3]), int(p[4]), float(p[5]) if there(p[5]) else None, p[6], there(p[7]), list(attributes.items())


class BigwigValue(Format):
    name, ddl = "bigwig_value", schemas.BIGWIG_VALUE
    zoom = False

    def offset(self, header: bigwig.Header, options: dict) -> int:
        return header.index_offset

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        region = Region.parse(options["region"]) if options.get("region") else region
        with files.open_raw(f.path) as raw:
            header = bigwig.read_header(raw)
            try:
                wanted = bigwig.wanted(header, region)
            except LookupError:
                if options.get("region"):
                    raise
                return []
            found = bigwig.blocks(raw, self.offset(header, options), header.order, *(wanted or ()))
        n = int(options.get("blocks", 512))
        return [(tuple(found[k : k + n]), wanted) for k in range(0, len(found), n)]

    def batches(self, part: Part, options: dict, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        found, wanted = part.what
        with files.open_raw(part.path) as raw:
            header = bigwig.read_header(raw)
            for block in found:
                yield from self.block(raw, header, block, wanted)

    def block(self, raw, header: bigwig.Header, block: bigwig.Block, wanted: tuple | None) -> Iterator[pa.RecordBatch]:
        chrom, start, end, value = bigwig.values(raw, header, block)
        keep = np.ones(len(start), bool) if wanted is None else (start < wanted[2]) & (end > wanted[1]) if chrom == wanted[0] else np.zeros(len(start), bool)
        if keep.any():
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([header.chroms[chrom][0]] * n), pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)), pa.array(value[keep].astype(np.float32))],
                ["name", "start", "end", "value"],
            )


class BigwigZoom(BigwigValue):
    name, ddl = "bigwig_zoom", schemas.BIGWIG_ZOOM

    def offset(self, header: bigwig.Header, options: dict) -> int:
        if not options.get("reductionlevel"):
            raise ValueError("bigwig_zoom needs the option reductionLevel")
        level = int(options["reductionlevel"])
        found = dict(header.zooms)
        if level not in found:
            raise ValueError(f"no zoom of level {level}; there are {sorted(found)}")
        return found[level]

    def block(self, raw, header: bigwig.Header, block: bigwig.Block, wanted: tuple | None) -> Iterator[pa.RecordBatch]:
        x = bigwig.summaries(raw, header, block)
        if wanted is not None:
            x = x[(x["chrom"] == wanted[0]) & (x["start"] < wanted[2]) & (x["end"] > wanted[1])]
        if len(x):
            col = lambda f, t: pa.array(x[f].astype(t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([header.chroms[c][0] for c in x["chrom"].tolist()]), col("start", np.int32), col("end", np.int32), pa.array(np.zeros(len(x), np.int32)), col("covered", np.int32),
                    col("max", np.float64), col("min", np.float64), col("sq", np.float64), col("sum", np.float64),
                ],
                ["name", "start", "end", "total_items", "bases_covered", "max_value", "min_value", "sum_squares", "sum"],
            )


class Cytometry(Format):
    name = "fcs"

    def text(self, path: str) -> fcs.Text:
        return fcs.parse_text(files.read_range(path, 0, 58), lambda a, b: files.read_range(path, a, b))

    def schema(self, found: list[files.Found], options: dict) -> T.StructType:
        return T.StructType([T.StructField(c, T.FloatType()) for c in self.text(found[0].path).columns])

    def batches(self, part: Part, options: dict, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        text = self.text(part.path)
        x = fcs.events(text, files.read_range(part.path, text.begin, text.end + 1))
        at = {c: k for k, c in enumerate(text.columns)}
        names = [f.name for f in schema]
        for k in range(0, len(x), ROWS):
            rows = x[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, at[c]])) if c in at else pa.nulls(len(rows), pa.float32()) for c in names], names)


class IndexedFasta(Format):
    """Slices of FASTA records by region (option ``regions``, separated by ``;``) through a ``.fai``."""

    name, ddl = "indexed_fasta", schemas.FASTA
    #: Regions that one task reads.
    REGIONS = 256

    def parts(self, f: files.Found, region: Region | None, options: dict) -> list[tuple]:
        wanted = [r for r in options.get("regions", "").split(";") if r.strip()]
        if not wanted:
            raise ValueError("indexed_fasta needs regions")
        if not files.exists(f.path + ".fai"):
            raise FileNotFoundError(f"{f.path} has no .fai beside it")
        index = bgzf.read_fai(f.path + ".fai")
        out, missing = [], []
        for text in wanted:
            r = Region.parse(text)
            if r.name in index:
                out.append((text.strip(), *index[r.name].span(r.interval)[:2]))
            else:
                missing.append(text.strip())
        if missing and f.path.rstrip("/") == options["path"].rstrip("/"):  # in a folder another file may hold them
            raise LookupError(f"{f.path}.fai doesn't hold {', '.join(missing[:5])}")
        return [tuple(out[k : k + self.REGIONS]) for k in range(0, len(out), self.REGIONS)]

    def rows(self, part: Part, options: dict, schema: T.StructType) -> Iterator[tuple]:
        with files.open_raw(part.path) as f:
            for text, start, end in part.what:
                f.seek(start)
                yield text, None, f.read(end - start).translate(None, b"\r\n ").decode()


FORMATS: list[type[Format]] = [Fastq, Alignments, IndexedAlignments, Cram, Variants, IndexedVcf, IndexedGff, BigwigValue, BigwigZoom, Cytometry, IndexedFasta]


class Reader(DataSourceReader):
    def __init__(self, fmt: Format, options: dict, schema: T.StructType) -> None:
        self.fmt, self.options, self.schema = fmt, options, schema

    def partitions(self):
        region = Region.parse(self.options["prune"]) if self.options.get("prune") else None
        keys = dict(x.split("=", 1) for x in self.options.get("only", "").split(";") if x)
        out = []
        for f in _found(self.fmt, self.options):
            own = dict(f.partitions)
            if all(own.get(k, v) == v for k, v in keys.items()):
                out += [Part(f.path, f.partitions, what) for what in self.fmt.parts(f, region, self.options)]
        return out or [Part("", (), ())]

    def read(self, part: Part):
        if not part.path:
            return
        own = dict(part.keys)
        inner = T.StructType([f for f in self.schema if f.name not in own])
        for batch in self.fmt.batches(part, self.options, inner):
            arrays = [batch.column(batch.schema.get_field_index(f.name)) if f.name not in own else pa.array([own[f.name]] * batch.num_rows, pa.string()) for f in self.schema]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema])


def _found(fmt: Format, options: dict) -> list[files.Found]:
    extension = options.get("extension")
    return files.find(options["path"], [extension] if extension else schemas.EXTENSIONS.get(fmt.name, [".fasta", ".fa", ".fna", ".faa"]))


class Source(DataSource):
    """Base of the registered sources; ``fmt`` is set by ``source_of``."""

    fmt: type[Format] = Format

    @classmethod
    def name(cls) -> str:
        return cls.fmt.name

    def schema(self) -> T.StructType:
        found = _found(self.fmt(), _lower(self.options))
        if not found:
            raise FileNotFoundError(f"no {self.fmt.name} files in {self.options['path']}")
        base = self.fmt().schema(found, _lower(self.options))
        keys = list(dict.fromkeys(k for f in found for k, _ in f.partitions))
        columns = self.options.get("columns")
        if columns:
            wanted = [c.strip() for c in columns.split(",")]
            base = T.StructType([f for f in base if f.name in wanted])
        return T.StructType([*base, *[T.StructField(k, T.StringType()) for k in keys if k not in base.names]])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.fmt(), _lower(self.options), schema)


def source_of(fmt: type[Format]) -> type[Source]:
    return type(fmt.__name__ + "Source", (Source,), {"fmt": fmt, "__module__": __name__})


def register(spark) -> None:
    """Register every source."""
    for f in FORMATS:
        spark.dataSource.register(source_of(f))


