"""Scans and sinks over whole tables: each query writes a table in a file format, reads it with this package's reader and gives columns
that the oracle takes from the table itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.runtime import scratch, table
from helixlake.sources import binary, text, writers

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, ending: str = "") -> str:
    return scratch(spark, f"trip-{uuid.uuid4().hex}{ending}")


def _lines(df: DataFrame, columns: list[Column], header: list[str] | None = None) -> str:
    """Tab-separated lines of ``df`` in a new folder, after the lines of a header in a file of its own."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    df.select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    if header:
        spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _or_dot(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("."))


def _clean_contigs(spark: SparkSession, d: str) -> DataFrame:
    letters = F.regexp_replace("sequence", "[^A-Za-z]", "")
    return table(spark, d, "contigs").select(F.concat_ws("_", "id", F.col("contig_id").cast("string")).alias("id"), F.nullif(F.trim("description"), F.lit("")).alias("description"), letters.alias("sequence"))


def scan_fasta(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.write_records(_clean_contigs(spark, d), path, "fasta", single=False)
    return text.read_fasta(spark, path).select("id", "description", F.length("sequence").cast("long").alias("size"), F.md5("sequence").alias("digest"))


def copy_fasta_gzip(spark: SparkSession, d: str) -> DataFrame:
    """One compressed file, as COPY writes it."""
    path = _folder(spark, ".fasta.gz")
    writers.write_records(_clean_contigs(spark, d), path, "fasta", "gzip")
    return text.read_fasta(spark, path).select("id", F.md5("sequence").alias("digest"))


def scan_fasta_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    for kind in ("dna", "protein"):
        part = _clean_contigs(spark, d).join(table(spark, d, "contigs").where(F.col("mol_type") == kind).select(F.concat_ws("_", "id", F.col("contig_id").cast("string")).alias("id")), "id", "left_semi")
        writers.write_records(part, f"{path}/mol_type={kind}", "fasta", single=False)
    return text.read_fasta(spark, path).where("mol_type = 'protein'").select("id", F.col("mol_type").cast("string").alias("mol_type"))


def scan_fastq(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    scores = F.array_join(F.transform("quality_score", lambda q: F.char(q + 33)), "")
    reads = table(spark, d, "reads").withColumn("sequence", F.coalesce("sequence", F.lit(""))).withColumn("quality_score", F.coalesce("quality_score", F.array().cast("array<bigint>")))
    writers.write_records(reads.select(F.concat_ws("_", F.lit("r"), F.col("read_id").cast("string")).alias("name"), F.col("cigar").alias("description"), "sequence", scores.alias("quality_scores")), path, "fastq", single=False)
    binary.register(spark)
    return spark.read.format("fastq").option("path", path + "/").option("extension", ".txt").load()


def scan_gtf(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "gtf_features").where("attributes IS NOT NULL")
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";'))), " ")
    path = _lines(f, [*map(_or_dot, ("seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", "frame")), pairs])
    g = text.read_gtf(spark, path)
    return g.select("seqname", "source", "type", "start", F.col("end").alias("stop"), F.round(F.col("score").cast("double"), 4).alias("score"), "frame", F.size("attributes").alias("n"), F.element_at("attributes", "gene_id").alias("gene_id"))


def scan_gff(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "gtf_features").where("attributes IS NOT NULL")
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), ";")
    path = _lines(f, [*map(_or_dot, ("seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", "frame")), pairs], ["##gff-version 3"])
    g = text.read_gff(spark, path)
    return g.select("seqname", "type", "start", F.col("end").alias("stop"), "phase", F.get(F.element_at("attributes", "transcript_id"), F.lit(0)).alias("transcript_id"))


def scan_bed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "gtf_features")
    path = _lines(f, [F.col("seqname"), _or_dot("start_pos"), _or_dot("end_pos"), F.col("feature_id"), F.lit("0"), F.col("strand")], ["# features"])
    return text.read_bed(spark, path, 6).select("reference_sequence_name", "start", F.col("end").alias("stop"), F.col("name").cast("long").alias("feature_id"), "score", "strand")


_VCF_HEADER = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##INFO=<ID=LOWC,Number=0,Type=Flag,Description="flag">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">']


def _vcf(spark: SparkSession, d: str) -> str:
    v = table(spark, d, "variants")
    listed = lambda c, by: F.when(F.size(c) > 0, F.array_join(c, by)).otherwise(".")
    columns = [_or_dot("chrom"), _or_dot("pos"), listed("id", ";"), _or_dot("ref_allele"), listed("alt_alleles", ","), _or_dot("qual"), listed("filters", ";"), _or_dot("info"), _or_dot("formats")]
    return _lines(v, columns, ["#CHROM\tPOS"])


def scan_vcf(spark: SparkSession, d: str) -> DataFrame:
    v = text.read_vcf(spark, _vcf(spark, d))
    return v.select("chrom", "pos", F.array_join("id", ";").alias("ids"), "ref", F.array_join("alt", ",").alias("alts"), F.round(F.col("qual").cast("double"), 3).alias("qual"), F.array_join("filter", ";").alias("filters"), "info")


def scan_vcf_typed(spark: SparkSession, d: str) -> DataFrame:
    """INFO and FORMAT parsed by a header's declarations."""
    raw = spark.read.text(_vcf(spark, d)).where(~F.startswith("value", F.lit("#")))
    v = text.vcf_frame(raw, [_VCF_HEADER], True, True)
    return v.select("chrom", "pos", F.col("info.DP").alias("dp"), F.coalesce("info.LOWC", F.lit(False)).alias("lowc"), F.col("formats")[0]["GT"].alias("gt"))


def scan_sam(spark: SparkSession, d: str) -> DataFrame:
    star = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("*"))
    quality = star(F.array_join(F.transform("quality_score", lambda q: F.char(q + 33)), ""))
    tags = F.coalesce(F.transform("tags", lambda t: F.concat_ws(":", t["tag"], F.lit("Z"), t["value"])), F.array().cast("array<string>"))
    columns = [
        F.col("read_id"), F.coalesce("flag", F.lit(0)), star(F.col("reference")), F.coalesce("start_pos", F.lit(0)), F.coalesce("mapping_quality", F.lit("255")), star(F.col("cigar")),
        star(F.col("mate_reference")), F.lit("0"), F.lit("0"), star(F.col("sequence")), quality, tags,
    ]
    s = text.read_sam(spark, _lines(table(spark, d, "reads"), columns, ["@HD\tVN:1.6"]))
    return s.select(
        F.col("name").cast("long").alias("read_id"), "flag", "reference", "start", "mapping_quality", "cigar", "mate_reference", F.md5("sequence").alias("digest"),
        F.array_join(F.col("quality_score").cast("array<string>"), ",").alias("scores"), F.size("tags").alias("n_tags"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (scan_fasta, copy_fasta_gzip, scan_fasta_partitioned, scan_fastq, scan_gtf, scan_gff, scan_bed, scan_vcf, scan_vcf_typed, scan_sam)
}

_LETTERS = "regexp_replace(sequence, '[^A-Za-z]', '', 'g')"
SQL: dict[str, str] = {
    "scan_fasta": f"SELECT concat_ws('_', id, contig_id) AS id, nullif(trim(description), '') AS description, length({_LETTERS}) AS size, md5({_LETTERS}) AS digest FROM contigs",
    "copy_fasta_gzip": f"SELECT concat_ws('_', id, contig_id) AS id, md5({_LETTERS}) AS digest FROM contigs",
    "scan_fasta_partitioned": "SELECT concat_ws('_', id, contig_id) AS id, mol_type FROM contigs WHERE mol_type = 'protein'",
    "scan_fastq": """SELECT concat_ws('_', 'r', read_id) AS name, cigar AS description, coalesce(sequence, '') AS sequence, array_to_string(list_transform(coalesce(quality_score, []), lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS quality_scores
        FROM reads""",
    "scan_gtf": """SELECT seqname, source, feature_type AS type, start_pos AS start, end_pos AS stop, round(CAST(score AS DOUBLE), 4) AS score, nullif(frame, '.') AS frame,
        CAST(cardinality(attributes) AS INTEGER) AS n, attributes['gene_id'] AS gene_id FROM gtf_features WHERE attributes IS NOT NULL""",
    "scan_gff": """SELECT seqname, feature_type AS type, start_pos AS start, end_pos AS stop, nullif(frame, '.') AS phase, attributes['transcript_id'] AS transcript_id FROM gtf_features WHERE attributes IS NOT NULL""",
    "scan_bed": "SELECT seqname AS reference_sequence_name, start_pos AS start, end_pos AS stop, feature_id, CAST(0 AS BIGINT) AS score, strand FROM gtf_features",
    "scan_vcf": """SELECT chrom, pos, array_to_string(id, ';') AS ids, ref_allele AS ref, array_to_string(alt_alleles, ',') AS alts, round(CAST(qual AS DOUBLE), 3) AS qual,
        array_to_string(filters, ';') AS filters, info FROM variants""",
    "scan_vcf_typed": """SELECT chrom, pos, TRY_CAST(nullif(regexp_extract(';' || info, ';DP=([^;]*)', 1), '') AS INTEGER) AS dp, contains(';' || info || ';', ';LOWC;') AS lowc,
        regexp_extract(formats, '\\t([^:\\t]*)', 1) AS gt FROM variants""",
    "scan_sam": """SELECT read_id, flag, reference, start_pos AS start, nullif(mapping_quality, '255') AS mapping_quality, CASE WHEN cigar = '*' THEN '' ELSE cigar END AS cigar, mate_reference, md5(coalesce(sequence, '')) AS digest,
        array_to_string(coalesce(quality_score, []), ',') AS scores, CAST(coalesce(len(tags), 0) AS INTEGER) AS n_tags FROM reads""",
}
