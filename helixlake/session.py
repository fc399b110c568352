"""A session over Spark with the readers, functions and statements of this package."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.registry import register_all
from helixlake.plans import statements
from helixlake.runtime import ship
from helixlake.sources import binary, files, schemas, text, writers

_SETTINGS = ("vcf_parse_info", "vcf_parse_formats", "sam_parse_tags", "bam_parse_tags", "cram_parse_tags")


class GenomicsSession:
    """Readers as methods, SQL with external tables, scan functions, region filters and COPY."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.settings = dict.fromkeys(_SETTINGS, False)
        self.tables: dict[str, tuple[str, str, dict[str, str]]] = {}
        ship(spark)
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        register_all(spark)
        binary.register(spark)

    # ---- readers --------------------------------------------------------------------------------------------------------------------

    def read_fasta(self, path: str, sequence_type: str = "utf8", extension: str | None = None) -> DataFrame:
        return text.read_fasta(self.spark, path, sequence_type, extension)

    def read_fastq(self, path: str, **options: object) -> DataFrame:
        return self._binary("fastq", path, options)

    def read_vcf(self, path: str, parse_info: bool | None = None, parse_formats: bool | None = None) -> DataFrame:
        info = self.settings["vcf_parse_info"] if parse_info is None else parse_info
        formats = self.settings["vcf_parse_formats"] if parse_formats is None else parse_formats
        return text.read_vcf(self.spark, path, info, formats)

    def read_bcf(self, path: str, **options: object) -> DataFrame:
        return self._binary("bcf", path, options)

    def read_gff(self, path: str) -> DataFrame:
        return text.read_gff(self.spark, path)

    def read_gtf(self, path: str) -> DataFrame:
        return text.read_gtf(self.spark, path)

    def read_bed(self, path: str, n_fields: int = 12) -> DataFrame:
        return text.read_bed(self.spark, path, n_fields)

    def read_sam(self, path: str, parse_tags: bool | None = None) -> DataFrame:
        return text.read_sam(self.spark, path, self.settings["sam_parse_tags"] if parse_tags is None else parse_tags)

    def read_bam(self, path: str, parse_tags: bool | None = None, **options: object) -> DataFrame:
        return self._alignments("bam", path, self.settings["bam_parse_tags"] if parse_tags is None else parse_tags, options)

    def read_cram(self, path: str, fasta_reference: str | None = None, parse_tags: bool | None = None, **options: object) -> DataFrame:
        tags = self.settings["cram_parse_tags"] if parse_tags is None else parse_tags
        return self._alignments("cram", path, tags, {**({"reference": fasta_reference} if fasta_reference else {}), **options})

    def _alignments(self, name: str, path: str, parse_tags: bool, options: dict) -> DataFrame:
        """Typed tags are those of any record: a pass over the tags finds them."""
        if parse_tags and "seentags" not in options:
            every = self._binary(name, path, {**options, "columns": "tags", "tagKinds": True})
            options = {**options, "seentags": ";".join(text.seen_tags(F.transform("tags", lambda t: t["tag"]), every))}
        return self._binary(name, path, {"parseTags": parse_tags, **options})

    def read_bigwig_value(self, path: str, **options: object) -> DataFrame:
        return self._binary("bigwig_value", path, options)

    def read_bigwig_zoom(self, path: str, reduction_level: int, **options: object) -> DataFrame:
        return self._binary("bigwig_zoom", path, {"reductionLevel": reduction_level, **options})

    def read_mzml(self, path: str) -> DataFrame:
        return text.read_mzml(self.spark, path)

    def read_genbank(self, path: str) -> DataFrame:
        return text.read_genbank(self.spark, path)

    def read_hmmdomtab(self, path: str) -> DataFrame:
        return text.read_hmmdomtab(self.spark, path)

    def read_sdf(self, path: str) -> DataFrame:
        return text.read_sdf(self.spark, path)

    def read_fcs(self, path: str, **options: object) -> DataFrame:
        return self._binary("fcs", path, options)

    def read_indexed_vcf(self, path: str, region: str | None = None, **options: object) -> DataFrame:
        return self._indexed("indexed_vcf", path, region, options)

    def read_indexed_gff(self, path: str, region: str | None = None, **options: object) -> DataFrame:
        return self._indexed("indexed_gff", path, region, options)

    def read_indexed_bam(self, path: str, region: str | None = None, **options: object) -> DataFrame:
        return self._indexed("indexed_bam", path, region, options)

    def read_indexed_fasta(self, path: str, regions: str | list[str]) -> DataFrame:
        """``regions``: region texts, or the path of a file with one per line."""
        if isinstance(regions, str):
            regions = files.read_range(regions, 0, None).decode().splitlines() if files.exists(regions) else [regions]
        return self._binary("indexed_fasta", path, {"regions": ";".join(r.strip() for r in regions if r.strip())})

    read_hmm_dom_tab = read_hmmdomtab
    read_bigwig_view = read_bigwig_value

    def read_deltalake(self, path: str) -> DataFrame:
        """A Delta table, if the session has that source."""
        return self.read_table(path, "delta")

    def read_table(self, path: str, fmt: str = "parquet") -> DataFrame:
        return text.read_table(self.spark, path, fmt)

    def read_inferred(self, path: str) -> DataFrame:
        """The reader that the path's extension names."""
        kind, _ = schemas.infer_type(path)
        return self.read(kind, path, {})

    def read(self, kind: str, path: str, options: dict[str, str]) -> DataFrame:
        """The reader of a type's name (``FASTA``, ``INDEXED_VCF``, ...) with textual options."""
        kind = schemas.ALIASES.get(kind.lower(), kind.lower())
        compression = (options.get("compression") or "").lower()
        cut = {k: options[k] for k in ("prune", "only", "columns") if k in options}
        flag = lambda name: options[name].lower() == "true" if name in options else None
        if kind == "fasta":
            return self.read_fasta(path, options.get("sequence_data_type", "utf8"), options.get("file_extension"))
        if kind == "bed":
            return self.read_bed(path, int(options.get("n_fields", 12)))
        if kind == "vcf":
            return self.read_vcf(path)
        if kind == "sam":
            return self.read_sam(path)
        if kind == "bam":
            return self.read_bam(path, **cut)
        if kind == "cram":
            return self.read_cram(path, options.get("fasta_reference"), **cut)
        if kind == "gff" and flag("indexed"):
            kind = "indexed_gff"
        if kind == "bigwig_zoom":
            if "reduction_level" not in options:
                raise ValueError("BIGWIG_ZOOM needs the option reduction_level")
            return self.read_bigwig_zoom(path, int(options["reduction_level"]), **cut)
        if kind == "deltatable":
            return self.read_table(path, "delta")
        if kind in ("parquet", "csv", "json"):
            return self.read_table(path, kind)
        if kind in ("gff", "gtf", "mzml", "genbank", "hmmdomtab", "sdf"):
            return getattr(self, f"read_{kind}")(path)
        if kind in {f.name for f in binary.FORMATS}:
            return self._binary(kind, path, {**({"compression": compression} if compression else {}), **cut})
        raise ValueError(f"unknown file type {kind!r}")

    def _binary(self, name: str, path: str, options: dict) -> DataFrame:
        return self.spark.read.format(name).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None}).option("path", path).load()

    def _indexed(self, name: str, path: str, region: str | None, options: dict) -> DataFrame:
        from helixlake.functions import variant

        df = self._binary(name, path, options if region is None else {**options, "prune": region})
        if region is None:
            return df
        return df.where(variant.overlap_filter(region, "reference", "start", "end") if name == "indexed_bam" else variant.point_filter(region, df.columns[0], "pos" if name == "indexed_vcf" else "start"))

    # ---- SQL ------------------------------------------------------------------------------------------------------------------------

    def register_table(self, name: str, path: str, kind: str | None = None, options: dict[str, str] | None = None) -> None:
        kind = schemas.infer_type(path)[0] if kind is None else kind
        self.read(kind, path, options or {}).createOrReplaceTempView(name)
        self.tables[name] = kind, path, options or {}

    def _pruned(self, query: str) -> str:
        """The query over a relation of its own that leaves out what the query's region and partition values exclude."""
        for name, (kind, path, options) in self.tables.items():
            if not re.search(rf"\bFROM\s+{re.escape(name)}\b", query, re.I):
                continue
            kind = schemas.ALIASES.get(kind.lower(), kind.lower())
            if kind not in {f.name for f in binary.FORMATS}:
                continue  # Spark prunes the text formats itself
            keys = list(dict.fromkeys(k for f in files.find(path, schemas.EXTENSIONS.get(kind)) for k, _ in f.partitions))
            found = statements.prunable(query, name, keys) or (None, {})
            columns = statements.columns_of(query, name, self.spark.table(name).columns)
            if found[0] or found[1] or columns:
                only = ";".join(f"{k}={v}" for k, v in found[1].items())
                cut = {"columns": ",".join(columns)} if columns else {}
                view = f"pruned_{uuid.uuid4().hex}"
                self.read(kind, path, {**options, **cut, **({"prune": found[0]} if found[0] else {}), **({"only": only} if only else {})}).createOrReplaceTempView(view)
                return re.sub(rf"(\bFROM\s+){re.escape(name)}\b", rf"\g<1>{view}", query, count=1, flags=re.I)
        return query

    def register_folder(self, path: str) -> list[str]:
        """A view per file of a folder whose type is known, named like the file."""
        names = []
        for f in files.find(path):
            try:
                kind, _ = schemas.infer_type(f.path)
            except ValueError:
                continue
            name = Path(f.path).name.split(".")[0]
            self.register_table(name, f.path, kind)
            names.append(name)
        return names

    def sql(self, query: str) -> DataFrame:
        s = statements.parse(query)
        if isinstance(s, statements.Create):
            self.register_table(s.name, s.location, s.kind, s.options)
            return self._nothing()
        if isinstance(s, statements.Copy):
            return self._copy(s)
        if s is not None and s[0] == "drop":
            self.tables.pop(s[1], None)
            if not self.spark.catalog.dropTempView(s[1]):
                self.spark.sql(query)
            return self._nothing()
        if s is not None:
            self.settings[s[1]] = s[2] == "true"
            return self._nothing()
        if "information_schema.tables" in query.lower():
            query = self._information_schema(query)
        return self.spark.sql(statements.rewrite(self._pruned(query), self._scan))

    def _information_schema(self, query: str) -> str:
        """``information_schema.tables``, which Spark lacks, as a view of the catalog."""
        rows = [(t.namespace[0] if t.namespace else None, t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in self.spark.catalog.listTables()]
        view = f"tables_{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "table_schema string, table_name string, table_type string").createOrReplaceTempView(view)
        return re.sub(r"\binformation_schema\.tables\b", view, query, flags=re.I)

    def to_arrow(self, query: str):
        """The result of a query as an Arrow table on the driver; for results that fit there."""
        return self.sql(query).toArrow()

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "result string")

    def _scan(self, kind: str, args: list[str]) -> str:
        kind = {"hmm_dom_tab": "hmmdomtab", "vcf_indexed": "indexed_vcf", "gff_indexed": "indexed_gff", "bam_indexed": "indexed_bam", "fasta_indexed": "indexed_fasta"}.get(kind, kind)
        if kind == "indexed_fasta":
            df = self.read_indexed_fasta(args[0], args[1])
        elif kind.startswith("indexed_"):
            df = self._indexed(kind, args[0], args[1] if len(args) > 1 else None, {})
        else:
            df = self.read(kind, args[0], {"compression": args[1]} if len(args) > 1 else {})
        view = f"scan_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return view

    def _copy(self, s: statements.Copy) -> DataFrame:
        df = self.sql(s.source)
        kind = schemas.ALIASES.get(s.kind or "", s.kind) or Path(s.path).suffix.lstrip(".").lower()
        if kind in ("parquet", "csv", "json"):
            seen = Observation()
            (df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("error").option("header", True)).format(kind).save(s.path)
            n = seen.get["n"]
        else:
            n = writers.write_records(df, s.path, kind, s.options.get("compression"))
        return self.spark.createDataFrame([(n,)], "count long")
