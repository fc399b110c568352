"""Line and record formats, parsed by native column expressions over Spark's text source.

Uncompressed files are split inside the file; compressed ones are one task each.  Directories may be partitioned (``key=value``).
Columns that a query doesn't use are not parsed: Catalyst prunes the expressions.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.functions.sequence import DNA_CODES, PROTEIN_CODES, encode_residues
from helixlake.runtime import ship
from helixlake.sources import files, schemas


def _raw(spark: SparkSession, path: str, separator: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Lines, or records between separators, as ``value`` with the partition columns of ``path``."""
    ship(spark)
    reader = spark.read.format("text")
    if separator is not None:
        reader = reader.option("lineSep", separator)
    if extensions and path.endswith("/"):
        ends = "{" + ",".join(e + c for e in extensions for c in ("", *schemas.COMPRESSIONS)) + "}"
        reader = reader.option("pathGlobFilter", "*" + ends)
    return reader.load(path)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "value"]


def _field(parts: Column, i: int) -> Column:
    """The i-th field; null for ``.`` and for one that isn't there."""
    x = F.get(parts, i)
    return F.when(x != ".", x)


def _lines(df: DataFrame, comment: str) -> DataFrame:
    value = F.regexp_replace("value", r"\r$", "")
    return df.withColumn("value", value).where((F.length("value") > 0) & ~F.startswith("value", F.lit(comment)))


def read_fasta(spark: SparkSession, path: str, sequence_type: str = "utf8", extension: str | None = None) -> DataFrame:
    """``id, description, sequence``; ``sequence_type`` is ``utf8``, ``large_utf8`` (the same here), ``integer_encode_dna`` or
    ``integer_encode_protein``."""
    raw = _raw(spark, path, "\n>", [extension] if extension else schemas.EXTENSIONS["fasta"])
    record = F.regexp_replace(F.regexp_replace("value", r"\A(?:\s*>)?", ""), "\r", "")
    raw = raw.withColumn("value", record).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    description = F.ltrim(F.regexp_replace(head, r"^\S+", ""))
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.substr(F.col("value"), F.instr("value", "\n") + 1), r"\s+", "")).otherwise("")
    sequence: Column = body
    if sequence_type in ("integer_encode_dna", "integer_encode_protein"):
        sequence = encode_residues(body, DNA_CODES if sequence_type.endswith("dna") else PROTEIN_CODES)
    elif sequence_type not in ("utf8", "large_utf8"):
        raise ValueError(f"sequence type {sequence_type!r}")
    return raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("id"), F.when(description != "", description).alias("description"), sequence.alias("sequence"), *_keys(raw))


def _features(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, list[Column], Column]:
    raw = _lines(_raw(spark, path, None, schemas.EXTENSIONS[kind]), "#")
    parts = F.split("value", "\t")
    last = "phase" if kind == "gff" else "frame"
    columns = [
        F.get(parts, 0).alias("seqname"), _field(parts, 1).alias("source"), F.get(parts, 2).alias("type"), F.get(parts, 3).try_cast("bigint").alias("start"),
        F.get(parts, 4).try_cast("bigint").alias("end"), F.get(parts, 5).try_cast("float").alias("score"), F.get(parts, 6).alias("strand"), _field(parts, 7).alias(last),
    ]
    return raw, columns, F.get(parts, 8)


def gff_frame(raw: DataFrame, columns: list[Column], attributes: Column) -> DataFrame:
    pairs = F.filter(F.split(attributes, ";"), lambda x: F.instr(x, "=") > 1)
    decode = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    key = lambda x: decode(F.trim(F.substring_index(x, "=", 1)))
    value = lambda x: F.transform(F.split(F.substr(x, F.instr(x, "=") + 1), ","), decode)
    # The first of repeated keys counts.
    keys = F.array_distinct(F.transform(pairs, key))
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), value(F.get(F.filter(pairs, lambda p: key(p) == k), F.lit(0))).alias("value")))
    return raw.select(*columns, F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:array<string>>>"))).alias("attributes"), *_keys(raw))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3; attribute values are lists, percent-encoding is undone, comments and directives are skipped."""
    return gff_frame(*_features(spark, path, "gff"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF; attributes are ``key "value"`` or ``key value``, the first of repeated keys counts."""
    raw, columns, attributes = _features(spark, path, "gtf")
    pattern = r'([^\s;"]+)\s+("[^"]*"|[^\s;"]+)'
    keys = F.regexp_extract_all(attributes, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(attributes, F.lit(pattern), F.lit(2)), lambda x: F.btrim(x, F.lit('"')))
    distinct = F.array_distinct(keys)
    firsts = F.transform(distinct, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int")))
    return raw.select(*columns, F.coalesce(F.map_from_arrays(distinct, firsts), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"), *_keys(raw))


def read_bed(spark: SparkSession, path: str, n_fields: int = 12) -> DataFrame:
    """BED of 3 to 12 tab-separated fields; starts stay as in the file; ``track``, ``browser`` and ``#`` lines are skipped."""
    if not 3 <= n_fields <= 12:
        raise ValueError("n_fields must be from 3 to 12")
    raw = _lines(_raw(spark, path, None, schemas.EXTENSIONS["bed"]), "#").where(~F.col("value").rlike(r"^(?:track|browser)\b"))
    parts = F.split("value", "\t")
    columns = []
    for i, (name, kind) in enumerate(schemas.BED_COLUMNS[:n_fields]):
        x = F.get(parts, i) if name == "strand" else _field(parts, i)
        columns.append((x if kind == "string" else x.try_cast(kind)).alias(name))
    return raw.select(*columns, *_keys(raw))


def vcf_headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The different headers of the files at ``path``, without their column lines, each read by a task up to its first record."""
    found = [f.path for f in files.find(path, schemas.EXTENSIONS["vcf"])]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                with files.open_text(p) as f:
                    out.append([x.decode("utf-8", "replace") for x in itertools.takewhile(lambda x: x.startswith(b"##"), files.lines(f))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["lines"])

    paths = spark.createDataFrame([(p,) for p in found], "path string").repartition(min(len(found), 512))
    declared = paths.mapInArrow(heads, "lines array<string>").select(F.filter("lines", lambda x: x.rlike("^##(?:INFO|FORMAT)=<")).alias("lines"))
    return [r["lines"] for r in declared.distinct().orderBy("lines").collect()]


def united(declarations: list[list[tuple[str, str, str]]]) -> list[tuple[str, str, str]]:
    """Fields of all headers; where they differ, integers and decimals become decimals, other types text, and numbers a list."""
    out: dict[str, tuple[str, str]] = {}
    for fields in declarations:
        for name, number, kind in fields:
            n, k = out.get(name, (number, kind))
            wide = k if k == kind else "Float" if {k, kind} == {"Integer", "Float"} else "String"
            single = {"0", "1"}
            out[name] = (n if n == number else "1" if {n, number} <= single else "."), wide
    return [(name, *x) for name, x in out.items()]


def header_fields(header: list[str], section: str) -> list[tuple[str, str, str]]:
    """``(id, number, type)`` of the INFO or FORMAT declarations, in order."""
    out = []
    for line in header:
        if line.startswith(f"##{section}=<"):
            found = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,>]*)', line[len(section) + 4 :]))
            if "ID" in found and found["ID"] not in {i for i, _, _ in out}:
                out.append((found["ID"], found.get("Number", "."), found.get("Type", "String")))
    return out


_TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean", "Character": "string", "String": "string"}


def _typed(text: Column, number: str, kind: str) -> Column:
    spark_type = _TYPES.get(kind, "string")
    clean = lambda x: F.when(x != ".", x).try_cast(spark_type)
    return clean(text) if number in ("0", "1") else F.transform(F.split(text, ","), clean)


def vcf_info(info: Column, fields: list[tuple[str, str, str]]) -> Column:
    """Raw INFO text as a struct with a typed field per declaration."""
    items = F.split(info, ";")
    keys = F.transform(items, lambda x: F.substring_index(x, "=", 1))
    columns = []
    for name, number, kind in fields:
        at = F.array_position(keys, F.lit(name))
        item = F.get(items, (at - 1).cast("int"))
        value = F.when((at > 0) & (F.instr(item, "=") > 0), F.substr(item, F.instr(item, "=") + 1))
        columns.append((F.when(at > 0, F.lit(True)) if kind == "Flag" else _typed(value, number, kind)).alias(name))
    return F.when(info.isNotNull(), F.struct(*columns))


def vcf_formats(formats: Column, fields: list[tuple[str, str, str]]) -> Column:
    """Raw FORMAT and sample columns as an array with one struct per sample."""
    parts = F.split(formats, "\t")
    names = F.split(F.get(parts, 0), ":")

    def sample(text: Column) -> Column:
        values = F.split(text, ":")
        out = []
        for name, number, kind in fields:
            value = F.get(values, (F.array_position(names, F.lit(name)) - 1).cast("int"))
            value = F.when((F.array_position(names, F.lit(name)) > 0) & (value != "."), value)
            out.append(_typed(value, number, kind).alias(name))
        return F.struct(*out)

    return F.when(formats.isNotNull(), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), sample))


def vcf_frame(raw: DataFrame, headers: list[list[str]], parse_info: bool, parse_formats: bool) -> DataFrame:
    parts = F.split("value", "\t", 9)
    listed = lambda i, by: F.when(_field(parts, i).isNotNull(), F.split(F.get(parts, i), by))
    info, formats = _field(parts, 7), F.get(parts, 8)
    if parse_info:
        info = vcf_info(info, united([header_fields(h, "INFO") for h in headers]))
    if parse_formats:
        formats = vcf_formats(formats, united([header_fields(h, "FORMAT") for h in headers]))
    return raw.select(
        F.get(parts, 0).alias("chrom"), F.get(parts, 1).try_cast("bigint").alias("pos"), F.coalesce(listed(2, ";"), F.array().cast("array<string>")).alias("id"),
        F.get(parts, 3).alias("ref"), listed(4, ",").alias("alt"), F.get(parts, 5).try_cast("float").alias("qual"),
        F.coalesce(listed(6, ";"), F.array().cast("array<string>")).alias("filter"), info.alias("info"), formats.alias("formats"), *_keys(raw),
    )


def read_vcf(spark: SparkSession, path: str, parse_info: bool = False, parse_formats: bool = False) -> DataFrame:
    """VCF; ``info`` and ``formats`` as raw text, or as typed structs by the declarations of all headers."""
    raw = _lines(_raw(spark, path, None, schemas.EXTENSIONS["vcf"]), "#")
    return vcf_frame(raw, vcf_headers(spark, path) if parse_info or parse_formats else [], parse_info, parse_formats)


def tag_value(kind: str, text: str) -> str:
    """A SAM tag's value as text: float arrays with two decimals, arrays without their type letter."""
    if kind != "B":
        return text
    sub, *values = text.split(",")
    return ", ".join(f"{float(v):.2f}" for v in values) if sub == "f" else ",".join(values)


def _tags(parts: Column) -> Column:
    extra = F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0)))

    def one(t: Column) -> Column:
        kind, text = F.substr(t, F.lit(4), F.lit(1)), F.substr(t, F.lit(6))
        items = F.split(F.substr(text, F.lit(3)), ",")
        floats = F.array_join(F.transform(items, lambda v: F.format_string("%.2f", v.cast("double"))), ", ")
        array = F.when(F.startswith(text, F.lit("f")), floats).otherwise(F.array_join(items, ","))
        return F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("tag"), F.when(kind == "B", array).otherwise(text).alias("value"))

    return F.transform(extra, one)


_TAG_TYPES = {"i": "int", "f": "float", "Z": "string", "A": "string", "H": "string"}
_ARRAY_TYPES = {"c": "tinyint", "C": "smallint", "s": "smallint", "S": "int", "i": "int", "I": "bigint", "f": "float"}


def infer_tags(seen: list[str]) -> list[tuple[str, str]]:
    """``(tag, Spark type)`` by name of tags seen as ``NM:i`` or ``BA:Bs``; one of several types is wide enough for all."""
    out: dict[str, set[str]] = {}
    for t in seen:
        tag, kind = t.split(":", 1)
        out.setdefault(tag, set()).add(f"array<{_ARRAY_TYPES[kind[1]]}>" if kind[0] == "B" else _TAG_TYPES.get(kind, "string"))

    def wide(kinds: set[str]) -> str:
        if len(kinds) == 1:
            return next(iter(kinds))
        if all(k.startswith("array") for k in kinds):
            return "array<double>" if "array<float>" in kinds else "array<bigint>"
        return "double" if kinds == {"int", "float"} else "string"

    return [(tag, wide(kinds)) for tag, kinds in sorted(out.items())]


def seen_tags(tags: Column, df: DataFrame) -> list[str]:
    """The different members of a list of texts, over all records."""
    return [r[0] for r in df.select(F.explode(tags).alias("t")).distinct().orderBy("t").collect()]


def tag_struct(tags: Column, fields: list[tuple[str, str]]) -> Column:
    """A tag list as a struct of typed fields."""
    names = F.transform(tags, lambda t: t["tag"])
    out = []
    for name, kind in fields:
        at = F.array_position(names, F.lit(name))
        text = F.when(at > 0, F.get(tags, (at - 1).cast("int"))["value"])
        typed = F.split(text, r",\s*").try_cast(kind) if kind.startswith("array") else text.try_cast(kind)
        out.append(typed.alias(name))
    return F.struct(*out)


def read_sam(spark: SparkSession, path: str, parse_tags: bool = False) -> DataFrame:
    """SAM; ``tags`` as a list of (tag, text), or as a struct of the tags on any record, which are found by a pass over them."""
    raw = _lines(_raw(spark, path, None, schemas.EXTENSIONS["sam"]), "@")
    parts = F.split("value", "\t")
    star = lambda i: F.when(F.get(parts, i) != "*", F.get(parts, i))
    start = F.nullif(F.get(parts, 3).try_cast("bigint"), F.lit(0))
    cigar = F.get(parts, 5)
    span = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    quality = F.when(F.get(parts, 10) == "*", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.filter(F.split(F.get(parts, 10), ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("bigint"))
    )
    mapq = F.get(parts, 4)
    mate = F.when(F.get(parts, 6) == "=", star(2)).otherwise(star(6))
    tags = _tags(parts)
    if parse_tags:
        extra = F.slice(parts, 12, F.greatest(F.size(parts) - 11, F.lit(0)))
        kinds = F.transform(extra, lambda t: F.when(F.substr(t, F.lit(4), F.lit(1)) == "B", F.concat(F.substr(t, F.lit(1), F.lit(4)), F.substr(t, F.lit(6), F.lit(1)))).otherwise(F.substr(t, F.lit(1), F.lit(4))))
        tags = tag_struct(tags, infer_tags(seen_tags(kinds, raw)))
    return raw.select(
        F.get(parts, 0).alias("name"), F.get(parts, 1).cast("int").alias("flag"), star(2).alias("reference"), start.alias("start"),
        F.when(cigar != "*", start + span - 1).alias("end"), F.when(mapq != "255", mapq).alias("mapping_quality"), F.when(cigar != "*", cigar).otherwise("").alias("cigar"),
        mate.alias("mate_reference"), F.when(F.get(parts, 9) != "*", F.get(parts, 9)).otherwise("").alias("sequence"), quality.alias("quality_score"), tags.alias("tags"), *_keys(raw),
    )


def read_hmmdomtab(spark: SparkSession, path: str) -> DataFrame:
    """HMMER domain table of tab-separated columns."""
    raw = _lines(_raw(spark, path, None, schemas.EXTENSIONS["hmmdomtab"]), "#")
    parts = F.split("value", "\t", 23)
    fields = T.StructType.fromDDL(schemas.HMMDOMTAB)
    columns = [(F.get(parts, i) if f.dataType == T.StringType() else F.get(parts, i).try_cast(f.dataType)).alias(f.name) for i, f in enumerate(fields)]
    return raw.select(*columns, *_keys(raw))


# ---- Records with an inner grammar: split by Spark, parsed in Arrow batches --------------------------------------------------------


def _mapped(raw: DataFrame, schema: str, parse) -> DataFrame:
    """``parse(record)`` of every value, which gives a tuple by ``schema`` or None."""
    keys = _keys(raw)
    target = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in target])
    out_schema = T.StructType([*target, *[raw.schema[k] for k in keys]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(v) for v in b.column(0).to_pylist()]
            keep = pa.array([r is not None for r in rows])
            kept = [r for r in rows if r is not None]
            arrays = [pa.array([r[i] for r in kept], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*arrays, *[b.column(1 + i).filter(keep) for i in range(len(keys))]], [*arrow.names, *keys])

    return raw.select("value", *keys).mapInArrow(run, out_schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def parse_genbank(text: str) -> tuple | None:
    """One GenBank record by the columns of ``schemas.GENBANK``."""
    if "LOCUS" not in text:
        return None
    heads: dict[str, list[str]] = {}
    current: list[str] | None = None
    features: list[dict] = []
    sequence: list[str] = []
    section = ""
    for line in text.replace("\r", "").split("\n"):
        if line[:1].strip():
            section, _, rest = line.partition(" ")
            current = [rest.strip()] if section not in ("FEATURES", "ORIGIN") else None
            if current is not None:
                if section == "COMMENT" and section in heads:
                    heads.setdefault("COMMENTS", []).append("\n".join(heads[section]))
                heads[section] = current
        elif section == "ORIGIN":
            sequence.append(re.sub(r"[\d\s]", "", line))
        elif section == "FEATURES":
            _feature_line(line, features)
        elif current is not None and line.strip():
            if re.match(r"^ {1,3}[A-Z]+ ", line):
                sub, _, rest = line.strip().partition(" ")
                heads.setdefault(sub, []).append(rest.strip())
                current = heads[sub]
            else:
                current.append(line.strip())
    locus = (heads.get("LOCUS") or [""])[0].split()
    date = next((x for x in locus if re.fullmatch(r"\d\d-[A-Z]{3}-\d{4}", x)), None)
    topology = next((x for x in locus if x in ("linear", "circular")), "linear")
    unit = next((i for i, x in enumerate(locus) if x in ("bp", "aa")), None)
    molecule = locus[unit + 1] if unit is not None and unit + 1 < len(locus) and locus[unit + 1] not in ("linear", "circular") else None
    division = locus[locus.index(date) - 1] if date and locus.index(date) > 0 else ""
    joined = lambda k, by=" ": by.join(heads[k]).strip() if heads.get(k) else None
    comments = [*heads.get("COMMENTS", []), *(["\n".join(heads["COMMENT"])] if "COMMENT" in heads else [])]
    for f in features:
        for q in f["qualifiers"]:
            if q["values"] is not None and q["values"].startswith('"'):
                q["values"] = q["values"][1:].removesuffix('"').replace('""', '"')
    return (
        "".join(sequence), joined("ACCESSION"), comments, joined("CONTIG", ""), date, joined("DBLINK"), joined("DEFINITION"), division, joined("KEYWORDS"), molecule,
        locus[0] if locus else None, joined("SOURCE"), joined("VERSION"), topology, features,
    )


def _feature_line(line: str, features: list[dict]) -> None:
    key, rest = line[5:21].strip(), line[21:].strip()
    if key:
        features.append({"kind": key, "location": rest, "qualifiers": []})
    elif features and rest:
        qualifiers = features[-1]["qualifiers"]
        open_quote = bool(qualifiers) and (v := qualifiers[-1]["values"]) is not None and v.startswith('"') and (len(v) == 1 or not v.endswith('"'))
        if rest.startswith("/") and not open_quote:
            name, eq, value = rest[1:].partition("=")
            qualifiers.append({"keys": name, "values": value if eq else None})
        elif qualifiers:
            q = qualifiers[-1]
            q["values"] = (q["values"] or "") + ("" if q["keys"] == "translation" else " ") + rest
        else:
            features[-1]["location"] += rest


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw(spark, path, "\n//", schemas.EXTENSIONS["genbank"])
    return _mapped(raw, schemas.GENBANK, parse_genbank)


def parse_sdf(text: str, keys: list[str]) -> tuple | None:
    """Header, counts and data of a molecule record; a value of several lines is joined without a separator."""
    lines = text.replace("\r", "").lstrip("\n" if text.startswith("\n\n\n\n") else "").split("\n")
    if not "".join(lines).strip():
        return None
    at = next((i for i, x in enumerate(lines) if re.search(r"V[23]000\s*$", x)), 3)
    counts = lines[at] if at < len(lines) else ""
    header = " ".join(x.strip() for x in lines[max(0, at - 3) : at] if x.strip())
    number = lambda x: int(x) if x.strip().isdigit() else None
    data: dict[str, str] = {}
    key = None
    for line in lines[at + 1 :]:
        if m := re.match(r"^>.*<([^>]+)>", line):
            key = m.group(1)
            data[key] = ""
        elif key is not None:
            if line.strip():
                data[key] += line
            else:
                key = None
    return header, number(counts[0:3]), number(counts[3:6]), {k: data.get(k) for k in keys}


def sdf_keys(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"^>.*<([^>]+)>", text, re.M)))


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """SDF; ``data`` is a struct of the first record's keys, later records' other keys are left out."""
    first = files.find(path, schemas.EXTENSIONS["sdf"])[0].path
    head: list[str] = []
    with files.open_text(first) as f:
        for line in files.lines(f):
            if line.startswith(b"$$$$"):
                break
            head.append(line.decode("utf-8", "replace"))
    keys = sdf_keys("\n".join(head))
    fields = ",".join(f"`{k}`:string" for k in keys)
    raw = _raw(spark, path, "$$$$\n", schemas.EXTENSIONS["sdf"])
    raw = raw.withColumn("value", F.regexp_replace("value", r"\$\$\$\$\s*\z", ""))
    return _mapped(raw, f"header string, atom_count int, bond_count int, data struct<{fields}>", lambda t: parse_sdf(t, keys))


# Accessions of the mzML vocabulary.
_ZLIB, _F64, _F32, _I64, _I32 = "MS:1000574", "MS:1000523", "MS:1000521", "MS:1000522", "MS:1000519"
_ARRAYS = {"MS:1000514": "mz", "MS:1000515": "intensity", "MS:1000617": "wavelength"}
_CV = re.compile(r"<cvParam\b([^>]*?)/?>")
_ATTRIBUTE = re.compile(r'(\w+)\s*=\s*"([^"]*)"|(\w+)\s*=\s*\'([^\']*)\'')


def _attributes(text: str) -> dict[str, str]:
    from html import unescape

    return {a or c: unescape(b or d) for a, b, c, d in _ATTRIBUTE.findall(text)}


def decode_array(text: str, accessions: set[str]) -> list[float]:
    """Numbers of a base64 array, packed and typed as its accessions say."""
    raw = base64.b64decode(re.sub(r"\s", "", text))
    if _ZLIB in accessions:
        raw = zlib.decompress(raw)
    kind = "<f8" if _F64 in accessions else "<f4" if _F32 in accessions else "<i8" if _I64 in accessions else "<i4" if _I32 in accessions else "<f8"
    return np.frombuffer(raw, kind).astype(np.float64).tolist()


def parse_spectrum(text: str) -> tuple | None:
    """One ``<spectrum>`` by the columns of ``schemas.MZML``."""
    m = re.search(r"<spectrum\b([^>]*)>", text)
    if not m:
        return None
    body = text[m.end() :]
    arrays: dict[str, list[float]] = {}
    for block in re.findall(r"<binaryDataArray\b.*?</binaryDataArray>", body, re.S):
        found = {_attributes(a).get("accession", "") for a in _CV.findall(block)}
        name = next((n for a, n in _ARRAYS.items() if a in found), None)
        data = re.search(r"<binary>(.*?)</binary>", block, re.S)
        if name:
            arrays[name] = decode_array(data.group(1), found) if data and data.group(1).strip() else []
    own = re.sub(r"<(scanList|precursorList|productList|binaryDataArrayList)\b.*?</\1>", "", body, flags=re.S)
    params = [{"accession": p.get("accession"), "name": p.get("name"), "value": p.get("value")} for p in map(_attributes, _CV.findall(own))]
    mz = charge = None
    if ion := re.search(r"<selectedIon\b.*?</selectedIon>", body, re.S):
        for p in map(_attributes, _CV.findall(ion.group())):
            if p.get("accession") == "MS:1000744":
                mz = float(p["value"])
            elif p.get("accession") == "MS:1000041":
                charge = int(p["value"])
    wrapped = [{n: arrays[n]} if n in arrays else None for n in ("mz", "intensity", "wavelength")]
    return _attributes(m.group(1)).get("id"), *wrapped, params, mz, charge


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """mzML spectra; arrays are decoded from base64, zlib and 32 or 64 bits."""
    raw = _raw(spark, path, "</spectrum>", schemas.EXTENSIONS["mzml"] + [".mzML"])
    return _mapped(raw, schemas.MZML, parse_spectrum)


def read_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Parquet, CSV (with a header) and JSON files, and Delta tables if the session has that source."""
    reader = spark.read.format(fmt)
    return (reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path)


