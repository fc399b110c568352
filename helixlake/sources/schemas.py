"""Schemas of the file formats, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T

FASTA = "id string, description string, sequence string"
FASTQ = "name string, description string, sequence string, quality_scores string"
GFF = "seqname string, source string, type string, start bigint, `end` bigint, score float, strand string, phase string, attributes map<string,array<string>>"
GTF = "seqname string, source string, type string, start bigint, `end` bigint, score float, strand string, frame string, attributes map<string,string>"
BED_COLUMNS = [
    ("reference_sequence_name", "string"), ("start", "bigint"), ("end", "bigint"), ("name", "string"), ("score", "bigint"), ("strand", "string"), ("thick_start", "bigint"),
    ("thick_end", "bigint"), ("color", "string"), ("block_count", "bigint"), ("block_sizes", "string"), ("block_starts", "string"),
]
VCF = "chrom string, pos bigint, id array<string>, ref string, alt array<string>, qual float, filter array<string>, info string, formats string"
TAGS = "array<struct<tag:string,value:string>>"
ALIGNMENT = (
    "name string, flag int, reference string, start bigint, `end` bigint, mapping_quality string, cigar string, mate_reference string, sequence string, "
    f"quality_score array<bigint>, tags {TAGS}"
)
BIGWIG_VALUE = "name string, start int, `end` int, value float"
BIGWIG_ZOOM = "name string, start int, `end` int, total_items int, bases_covered int, max_value double, min_value double, sum_squares double, sum double"
CV_PARAMS = "array<struct<accession:string,name:string,value:string>>"
MZML = (
    "id string, mz struct<mz:array<double>>, intensity struct<intensity:array<double>>, wavelength struct<wavelength:array<double>>, "
    f"cv_params {CV_PARAMS}, precursor_mz double, precusor_charge bigint"
)
GENBANK = (
    "sequence string, accession string, comments array<string>, contig string, date string, dblink string, definition string, division string, keywords string, "
    "molecule_type string, name string, source string, version string, topology string, "
    "features array<struct<kind:string,location:string,qualifiers:array<struct<keys:string,values:string>>>>"
)
HMMDOMTAB = (
    "target_name string, target_accession string, tlen bigint, query_name string, accession string, qlen bigint, evalue double, sequence_score double, bias double, "
    "domain_number bigint, ndom bigint, conditional_evalue double, independent_evalue double, domain_score double, domain_bias double, hmm_from bigint, hmm_to bigint, "
    "ali_from bigint, ali_to bigint, env_from bigint, env_to bigint, accuracy double, description string"
)

#: File extensions that a directory scan takes, and the name of each type's reader.
EXTENSIONS = {
    "fasta": [".fasta", ".fa", ".fna", ".faa"], "fastq": [".fastq", ".fq"], "vcf": [".vcf"], "bcf": [".bcf"], "gff": [".gff", ".gff3"], "gtf": [".gtf"], "bed": [".bed"],
    "sam": [".sam"], "bam": [".bam"], "cram": [".cram"], "bigwig_value": [".bw", ".bigwig"], "bigwig_zoom": [".bw", ".bigwig"], "mzml": [".mzml"], "genbank": [".gb", ".gbk", ".genbank"],
    "hmmdomtab": [".hmmdomtab"], "sdf": [".sdf"], "fcs": [".fcs"], "indexed_vcf": [".vcf.gz"], "indexed_gff": [".gff.gz"], "indexed_bam": [".bam"],
}
COMPRESSIONS = {".gz": "gzip", ".bgz": "gzip", ".zst": "zstd", ".bz2": "bzip2", ".xz": "xz"}
#: Other names of types.
ALIASES = {"fa": "fasta", "faa": "fasta", "fna": "fasta", "fq": "fastq", "gbk": "genbank", "gb": "genbank"}


def infer_type(path: str) -> tuple[str, str | None]:
    """Type and compression that a file's name tells; ``ValueError`` if it tells none."""
    low = path.lower().rstrip("/")
    compression = next((c for e, c in COMPRESSIONS.items() if low.endswith(e)), None)
    if compression:
        low = low[: low.rindex(".")]
    for kind, endings in EXTENSIONS.items():
        if not kind.startswith("indexed") and any(low.endswith(e) for e in endings):
            return kind, compression
    raise ValueError(f"no file type for {path}")


_ATOMS = {
    "string": T.StringType, "tinyint": T.ByteType, "smallint": T.ShortType, "int": T.IntegerType, "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType, "boolean": T.BooleanType,
}


def _cut(text: str) -> list[str]:
    """Parts between the commas that stand outside of angle brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]]]


def data_type(text: str) -> T.DataType:
    """A type of the DDL above; unlike Spark's parser it works where there is no session, as in a source's worker."""
    text = text.strip()
    kind, inner = text.split("<", 1) if "<" in text else (text, "")
    inner = inner.removesuffix(">")
    if kind == "array":
        return T.ArrayType(data_type(inner))
    if kind == "map":
        return T.MapType(*map(data_type, _cut(inner)))
    if kind == "struct":
        return T.StructType([T.StructField(n.strip().strip("`"), data_type(t)) for n, t in (f.split(":", 1) for f in _cut(inner))])
    return _ATOMS[kind]()


def struct(ddl: str) -> T.StructType:
    """The schema that a list of ``name type`` describes."""
    return T.StructType([T.StructField(n.strip("`"), data_type(t)) for n, t in (f.split(" ", 1) for f in _cut(ddl))])
