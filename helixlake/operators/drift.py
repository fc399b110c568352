"""Problem 5: schemas that drift between the files of a feed.

Each file has a schema version: its fields with their types, and a fingerprint of them (SHA-256 of the sorted list).  Successive versions
of a feed whose fingerprints differ get a migration step, a written list of operations: ``added``, ``removed``, ``retyped`` and
``renamed`` fields with their old and new names and types.  The reported changes are these operations, and the router executes them: the
renames chain, so that a field's lineage is the component of (file, field) nodes that steps link and its newest name is the column under
which the consistent table holds it; files are routed through their own rename map, then missing fields default to null, then values
are cast to the narrowest type that holds every file's.  What finds no place, a second value of one field in a record or a value that
the column's type can't hold, is kept in the column ``unplaced``.

Only metadata is compared (files times fields).  Records are scanned once for the types of SAM tags, reduced by a partial aggregate,
so that a file with a third of all records is no hot spot.

Defined cases: null tag lists, null tags and null values carry no field; a tag without a value that is present has type integer, the
narrowest; two files of a feed written at the same time follow their file ids; a field declared twice in a header counts as first
declared; two fields of equal description are paired in the order of their names; a comment that names as many removed as added fields
pairs them in their order, if it names all of one sort before the other (*A, B are now C, D*), else neighbours of two sorts are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.operators.components import connected_components
from helixlake.runtime import broadcast_if_small, stored

#: Types of SAM values from the narrowest on, with the Spark type of their column.
RANKS = ["integer", "decimal", "text"]
CASTS = {"integer": "bigint", "decimal": "double", "text": "string", "Flag": "boolean", "Integer": "bigint", "Float": "double", "Character": "string", "String": "string"}
#: Bound on the columns of a consistent table.
MAX_FIELDS = 5000
#: Words by which a comment says that a field got another name.
CUE = r"(?i)renam|formerly|previously|in place of|instead of|replac|->|=>|→|old name|new name|used to be|was called|became|now (?:called|appear|written|stored)|supersed"


def sam_fields(reads: DataFrame) -> DataFrame:
    """``(file_id, field, kind)``: tags of each file with the narrowest type of all their values."""
    tag = F.explode("tags").alias("t")
    value = F.col("t.value")
    rank = F.when(value.isNull() | value.rlike(r"^[+-]?[0-9]+$"), 0).when(value.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), 1).otherwise(2)
    ranked = reads.where("file_id IS NOT NULL").select("file_id", tag).where("t.tag IS NOT NULL").select("file_id", F.col("t.tag").alias("field"), rank.alias("rank"))
    return ranked.groupBy("file_id", "field").agg(F.max("rank").alias("rank")).select("file_id", "field", F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank") + 1).alias("kind"))


def vcf_fields(headers: DataFrame) -> DataFrame:
    """``(file_id, field, kind, description)``: INFO declarations of each file; description in lower case with single blanks."""
    part = lambda pattern: F.regexp_extract("line", pattern, 1)
    declared = headers.where("file_id IS NOT NULL AND line LIKE '##INFO=<%'").select(
        "file_id",
        "line_no",
        part(r"[<,]ID=([^,>]+)").alias("field"),
        F.concat_ws(" ", part(r"[<,]Number=([^,>]+)"), part(r"[<,]Type=([^,>]+)")).alias("kind"),
        F.lower(F.trim(F.regexp_replace(part(r'[<,]Description="((?:[^"\\]|\\.)*)"'), r"\s+", " "))).alias("description"),
    )
    first = F.min_by(F.struct("kind", "description"), F.struct(F.coalesce("line_no", F.lit(2**31 - 1)), "kind", "description")).alias("d")
    return declared.where("field <> ''").groupBy("file_id", "field").agg(first).select("file_id", "field", "d.kind", "d.description")


def versions(source_files: DataFrame) -> DataFrame:
    """``(file_id, feed, file_format, version, previous)``: files of a feed in the order of writing, from 1."""
    order = Window.partitionBy("feed", "file_format").orderBy("written_at", "file_id")
    files = source_files.where("upper(file_format) IN ('SAM', 'VCF') AND feed IS NOT NULL AND written_at IS NOT NULL AND file_id IS NOT NULL")
    files = files.select("file_id", "feed", F.upper("file_format").alias("file_format"), "written_at")
    return files.select("file_id", "feed", "file_format", F.row_number().over(order).alias("version"), F.lag("file_id").over(order).alias("previous"))


def _fields(reads: DataFrame, headers: DataFrame, files: DataFrame) -> DataFrame:
    sam = sam_fields(reads).withColumn("description", F.lit(None).cast("string"))
    formats = files.select("file_id", "file_format")
    return (
        sam.withColumn("format", F.lit("SAM"))
        .unionByName(vcf_fields(headers).withColumn("format", F.lit("VCF")))
        .join(formats, "file_id")
        .where("format = file_format")
        .select("file_id", "field", "kind", "description")
    )


def _comment_renames(headers: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, old, new)`` that a comment line of the later file states."""
    lines = headers.where("line IS NOT NULL AND file_id IS NOT NULL").where(~F.col("line").rlike(r"^##(?:INFO|FORMAT|FILTER|contig|fileformat)=|^@(?:HD|SQ|RG|PG)\t|^#CHROM\b") & F.col("line").rlike(CUE))
    lines = lines.select("file_id", "line", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no", "line")).alias("at"))
    words = lines.select("file_id", "at", F.posexplode(F.regexp_extract_all("line", F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0))).alias("pos", "field"))
    named = words.join(gone.select("file_id", "field", F.lit(True).alias("gone")).unionByName(new.select("file_id", "field", F.lit(False).alias("gone"))), ["file_id", "field"])
    # The distinct names of a line in their order; with one name of each sort, the common case, this is one pair.
    first = named.groupBy("file_id", "at", "field", "gone").agg(F.min("pos").alias("pos"))
    line = F.sort_array(F.collect_list(F.struct("pos", "field", "gone")))
    lines = first.groupBy("file_id", "at").agg(line.alias("l")).withColumn("olds", F.filter("l", lambda x: x["gone"])).withColumn("news", F.filter("l", lambda x: ~x["gone"]))
    apart = (F.size("olds") == F.size("news")) & ((F.array_max(F.transform("olds", lambda x: x["pos"])) < F.array_min(F.transform("news", lambda x: x["pos"]))) | (F.array_max(F.transform("news", lambda x: x["pos"])) < F.array_min(F.transform("olds", lambda x: x["pos"]))))
    zipped = F.zip_with("olds", "news", lambda o, n: F.struct(o["field"].alias("old"), n["field"].alias("new")))
    pair = lambda i: F.when(F.get("l", i)["gone"] != F.get("l", i + 1)["gone"], F.struct(F.when(F.get("l", i)["gone"], F.get("l", i)["field"]).otherwise(F.get("l", i + 1)["field"]).alias("old"), F.when(F.get("l", i)["gone"], F.get("l", i + 1)["field"]).otherwise(F.get("l", i)["field"]).alias("new")))
    neighbours = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("l") - 2, F.lit(0)), F.lit(2)), pair), lambda x: x.isNotNull())
    return lines.where("size(olds) > 0 AND size(news) > 0").select("file_id", F.explode(F.when(apart, zipped).otherwise(neighbours)).alias("p")).select("file_id", "p.old", "p.new")


def _compare(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with their fingerprints, fields, and the operations of the migration steps: ``(file_id, operation, field, old_name, old_type, new_type)``."""
    files = stored(versions(source_files))
    fields = stored(_fields(reads, headers, files))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "field", "kind"))), "\n")
    schemas = fields.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_fields"), F.sha2(listed, 256).alias("fingerprint"))
    files = stored(files.join(schemas, "file_id", "left").fillna({"n_fields": 0, "fingerprint": ""}))
    before = files.select(F.col("file_id").alias("previous"), F.col("fingerprint").alias("from_fingerprint"))
    steps = files.where("previous IS NOT NULL").join(before, "previous").where("fingerprint <> from_fingerprint").select("file_id", "previous")
    now = steps.join(fields, "file_id").select("file_id", "field", "kind", "description")
    was = steps.join(fields.withColumnRenamed("file_id", "previous"), "previous").select("file_id", "field", F.col("kind").alias("old_kind"), F.col("description").alias("old_description"))
    both = stored(now.join(was, ["file_id", "field"], "full"))
    new = both.where("old_kind IS NULL").select("file_id", "field", "description")
    gone = both.where("kind IS NULL").select("file_id", "field", F.col("old_description").alias("description"))
    nth = Window.partitionBy("file_id", "description").orderBy("field")
    matched = lambda side, name: side.where("description <> ''").withColumn("n", F.row_number().over(nth)).withColumnRenamed("field", name)
    renames = matched(gone, "old").join(matched(new, "new"), ["file_id", "description", "n"]).select("file_id", "old", "new").unionByName(_comment_renames(headers, gone, new))
    # A name takes part in one rename only.
    renames = renames.groupBy("file_id", "old").agg(F.min("new").alias("new")).groupBy("file_id", "new").agg(F.min("old").alias("old"))
    renames = stored(renames.select("file_id", "old", "new"))
    kind = F.when(F.col("old_kind").isNull(), "added").when(F.col("kind").isNull(), "removed").when(F.col("kind") != F.col("old_kind"), "retyped")
    plain = both.select("file_id", "field", kind.alias("operation"), F.col("old_kind").alias("old_type"), F.col("kind").alias("new_type")).where("operation IS NOT NULL")
    used = renames.select("file_id", F.explode(F.array("old", "new")).alias("field"))
    types = both.select("file_id", F.col("field").alias("old"), F.col("old_kind").alias("old_type")), both.select("file_id", F.col("field").alias("new"), F.col("kind").alias("new_type"))
    renamed = renames.join(types[0], ["file_id", "old"]).join(types[1], ["file_id", "new"]).select("file_id", F.col("new").alias("field"), F.lit("renamed").alias("operation"), F.col("old").alias("old_name"), "old_type", "new_type")
    operations = plain.join(used, ["file_id", "field"], "left_anti").withColumn("old_name", F.lit(None).cast("string")).unionByName(renamed)
    return files, fields, stored(operations.select("file_id", "operation", "field", "old_name", "old_type", "new_type"))


def changes(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``(file_id, field_name, change_kind, old_name)``: the operations of all migration steps; ``old_name`` of renames only."""
    return _compare(reads, headers, source_files)[2].select("file_id", F.col("field").alias("field_name"), F.col("operation").alias("change_kind"), "old_name")


def migrations(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``(file_id, feed, version, from_fingerprint, to_fingerprint, operation, field, old_name, old_type, new_type)``: the written migration steps."""
    files, _, operations = _compare(reads, headers, source_files)
    before = files.select(F.col("file_id").alias("previous"), F.col("fingerprint").alias("from_fingerprint"))
    steps = files.join(before, "previous").select("file_id", "feed", "version", "from_fingerprint", F.col("fingerprint").alias("to_fingerprint"))
    return steps.join(operations, "file_id")


def fingerprints(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``(file_id, feed, file_format, version, n_fields, fingerprint, n_changes)`` of every file; equal schemas, and only these, have equal fingerprints."""
    files, _, operations = _compare(reads, headers, source_files)
    n = operations.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return files.drop("previous").join(n, "file_id", "left").fillna({"n_changes": 0})


def lineage(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``(file_id, field, kind, column, file_format)``: the newest name of every file's field."""
    files, fields, diff = _compare(reads, headers, source_files)
    node = lambda file, field: F.concat_ws("\t", F.col(file).cast("string"), F.col(field))
    steps = files.where("previous IS NOT NULL").select("file_id", "previous")
    same = steps.join(fields, "file_id").join(fields.select(F.col("file_id").alias("previous"), "field"), ["previous", "field"])
    moved = diff.where("operation = 'renamed'").join(steps, "file_id")
    edges = same.select(node("previous", "field").alias("a"), node("file_id", "field").alias("b")).unionByName(moved.select(node("previous", "old_name").alias("a"), node("file_id", "field").alias("b")))
    roots = connected_components(edges)
    placed = fields.join(files.select("file_id", "file_format", "version"), "file_id").withColumn("node", node("file_id", "field")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    newest = placed.groupBy("root").agg(F.max_by("field", F.struct("version", "field")).alias("column"))
    return placed.join(newest, "root").select("file_id", "field", "kind", "column", "file_format")


def _routed(records: DataFrame, keys: Column, values: Column, lines: DataFrame, ids: list[str]) -> DataFrame:
    """Records as one wide table: rename by the file's map, default to null, cast to the column's type."""
    catalog = lines.groupBy("column").agg(F.collect_set("kind").alias("kinds")).orderBy("column").limit(MAX_FIELDS + 1).collect()
    if len(catalog) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    renamed = lines.where("field <> column").groupBy("file_id").agg(F.map_from_entries(F.collect_set(F.struct("field", "column"))).alias("names"))
    routed = records.select(*ids, keys.alias("k"), values.alias("v")).join(broadcast_if_small(renamed), "file_id", "left")
    routed = routed.select(*ids, F.when(F.col("names").isNull(), F.col("k")).otherwise(F.transform("k", lambda k: F.coalesce(F.element_at("names", k), k))).alias("k"), "v")
    columns: list[tuple[str, str, str]] = []
    taken = {i.lower() for i in (*ids, "unplaced")}
    for r in catalog:
        kinds = {k.split(" ")[-1] for k in r["kinds"]}
        single = all(k.split(" ")[0] in ("0", "1") or " " not in k for k in r["kinds"])
        order = ["Flag", "Integer", "Float", *RANKS]
        target = CASTS[max(kinds, key=order.index)] if single and kinds <= set(order) and ("Flag" not in kinds or kinds == {"Flag"}) else "string"
        name = r["column"]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append((r["column"], name, target))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in routed.select(*ids).schema] + [f"`{n.replace('`', '``')}` {t}" for _, n, t in columns] + ["unplaced array<string>"])
    return routed.mapInArrow(_router(len(ids), columns), schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _read_as(text: str | None, kind: str) -> int | float | bool | None:
    try:
        if kind == "bigint":
            return x if -(1 << 63) <= (x := int(text)) < 1 << 63 else None
        return float(text) if kind == "double" else {"true": True, "false": False}.get(text.lower())
    except (TypeError, ValueError):
        return None


def _cast(values: pa.Array, kind: str) -> pa.Array:
    """Null where a value can't be read; a batch in which all can is cast as a whole."""
    if kind == "string":
        return values
    try:
        return pc.cast(values, _ARROW[kind])
    except pa.ArrowInvalid:
        return pa.array([_read_as(x, kind) for x in values.to_pylist()], _ARROW[kind])


def _router(n_ids: int, columns: list[tuple[str, str, str]]):
    """Lists of names and values to columns, in time linear in the values: values are sorted by column, a column's are taken at once."""
    number = {field: k for k, (field, _, _) in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, values = b.num_rows, b.column(n_ids), b.column(n_ids + 1)
            keys, flat = names.flatten(), values.flatten()
            parent = pc.list_parent_indices(names).to_numpy(zero_copy_only=False)
            coded = keys.dictionary_encode()
            known = np.array([*(number.get(x, -1) for x in coded.dictionary.to_pylist()), -1], np.int64)
            column = known[pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False)]
            there = np.flatnonzero((column >= 0) & flat.is_valid().to_numpy(zero_copy_only=False))
            _, first = np.unique(parent[there].astype(np.int64) * (len(columns) + 1) + column[there], return_index=True)
            lost = np.ones(len(there), bool)
            lost[first] = False
            lost, held = there[lost].tolist(), there[first]
            held = held[np.argsort(column[held], kind="stable")]
            bounds = np.searchsorted(column[held], np.arange(len(columns) + 1))
            out = [b.column(k) for k in range(n_ids)]
            for k, (_, _, kind) in enumerate(columns):
                own = held[bounds[k] : bounds[k + 1]]
                if not len(own):
                    out.append(pa.nulls(n, _ARROW[kind]))
                    continue
                cells = _cast(flat.take(pa.array(own)), kind)
                if cells.null_count:
                    lost += own[cells.is_null().to_numpy(zero_copy_only=False)].tolist()
                at = np.full(n, -1, np.int64)
                at[parent[own]] = np.arange(len(own))
                out.append(cells.take(pa.array(at, mask=at < 0)))
            unplaced: list[list[str] | None] = [None] * n
            for i in sorted(lost):
                row = int(parent[i])
                unplaced[row] = [*(unplaced[row] or []), f"{keys[i].as_py()}={flat[i].as_py()}"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(unplaced, pa.list_(pa.string()))], [*b.schema.names[:n_ids], *(name for _, name, _ in columns), "unplaced"])

    return run


def sam_table(reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``read_id``, ``file_id`` and one typed column per tag of any file, under its newest name."""
    lines = stored(lineage(reads, headers, source_files).where("file_format = 'SAM'"))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<struct<tag:string,value:string>>"))
    return _routed(reads, F.transform(tags, lambda t: t["tag"]), F.transform(tags, lambda t: t["value"]), lines, ["read_id", "file_id"])


def vcf_table(variants: DataFrame, reads: DataFrame, headers: DataFrame, source_files: DataFrame) -> DataFrame:
    """``variant_id``, ``file_id`` and one typed column per INFO field of any file; a flag that stands without a value is true."""
    lines = stored(lineage(reads, headers, source_files).where("file_format = 'VCF'"))
    items = F.split(F.coalesce(F.col("info"), F.lit("")), ";")
    keys = F.transform(items, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(items, lambda x: F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).otherwise("true"))
    return _routed(variants, keys, values, lines, ["variant_id", "file_id"])
