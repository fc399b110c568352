"""Round trips of the binary and indexed formats and of the session's SQL over whole tables: tasks write files with this package's
encoders, its readers and SQL names read them, and the oracle takes the columns from the table itself."""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.alignment import FLAGS
from helixlake.plans import relational
from helixlake.plans.round_trips import Query, _clean_contigs, _folder, _lines, _or_dot
from helixlake.runtime import table
from helixlake.session import GenomicsSession
from helixlake.sources import encoders, files

#: Uncompressed bytes of a block of the files written here.
BLOCK = 32_000


def _files(df: DataFrame, encode: Callable[[list[dict]], dict[str, bytes]]) -> str:
    """A folder with the files that ``encode`` makes of the rows of each partition, by ending."""
    folder = _folder(df.sparkSession)
    where, base = files.system(folder)
    if where.type_name == "local":
        where.create_dir(base)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            name = uuid.uuid4().hex
            for ending, data in encode(rows).items():
                fs, path = files.system(folder)
                with fs.open_output_stream(f"{path}/{name}{ending}", compression=None) as out:
                    out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    df.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder + "/"


def _view(spark: SparkSession, folder: str, kind: str, options: dict[str, str] | None = None) -> tuple[GenomicsSession, str]:
    gx, name = GenomicsSession(spark), f"t_{uuid.uuid4().hex}"
    given = f" OPTIONS ({', '.join(f'{k} {v}' for k, v in options.items())})" if options else ""
    gx.sql(f"CREATE EXTERNAL TABLE {name} STORED AS {kind}{given} LOCATION '{folder}'")
    return gx, name


# ---- alignments ------------------------------------------------------------------------------------------------------------------------


def _bam(spark: SparkSession, d: str) -> str:
    refs = [(r["name"], r["seq_length"]) for r in table(spark, d, "reference_seqs").orderBy("name").limit(10_000).collect()]
    at = {n: k for k, (n, _) in enumerate(refs)}
    reads = table(spark, d, "reads").select("read_id", "flag", "reference", "start_pos", "mapping_quality", "cigar", "sequence", "quality_score", "tags")
    known = F.col("reference").isin([n for n, _ in refs])
    reads = reads.withColumn("reference", F.when(known, F.col("reference"))).withColumn("start_pos", F.when(known, F.col("start_pos")))

    def encode(rows: list[dict]) -> dict[str, bytes]:
        records = []
        for r in rows:
            seq = r["sequence"] or ""
            quality = r["quality_score"] if r["quality_score"] and len(r["quality_score"]) == len(seq) else None
            cigar = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"] or "")]
            tags = b"".join(t["tag"].encode() + b"Z" + t["value"].encode() + b"\0" for t in r["tags"] or [] if t and t["value"] is not None)
            records.append((str(r["read_id"]), r["flag"], at.get(r["reference"], -1), (r["start_pos"] or 0) - 1, 255 if r["mapping_quality"] is None else int(r["mapping_quality"]), cigar, seq, quality, tags))
        data, index = encoders.bam(refs, records, BLOCK)
        return {".bam": data, ".bam.bai": index}

    return _files(reads.repartitionByRange("reference", "start_pos").sortWithinPartitions("reference", "start_pos"), encode)


def scan_bam(spark: SparkSession, d: str) -> DataFrame:
    b = GenomicsSession(spark).read_bam(_bam(spark, d))
    return b.select(
        F.col("name").cast("long").alias("read_id"), "flag", "reference", "start", F.col("end").alias("stop"), "mapping_quality", "cigar", F.md5("sequence").alias("digest"),
        F.array_join(F.col("quality_score").cast("array<string>"), ",").alias("scores"), F.size("tags").alias("n_tags"),
    )


def bam_region_sql(spark: SparkSession, d: str) -> DataFrame:
    """A region by the SQL name over indexed files."""
    gx, name = _view(spark, _bam(spark, d), "INDEXED_BAM")
    return gx.sql(f"SELECT CAST(name AS BIGINT) AS read_id, flag FROM {name} WHERE bam_region_filter('chr5:100,000-900,000', reference, start, `end`)")


def bam_typed_tags(spark: SparkSession, d: str) -> DataFrame:
    b = GenomicsSession(spark).read_bam(_bam(spark, d), parse_tags=True)
    return b.select(F.col("name").cast("long").alias("read_id"), F.get_json_object(F.to_json("tags"), "$.NM").alias("nm"), F.get_json_object(F.to_json("tags"), "$.RG").alias("rg"))


# ---- variants --------------------------------------------------------------------------------------------------------------------------


def _contigs_of(spark: SparkSession, d: str) -> list[str]:
    return [r["chrom"] for r in table(spark, d, "variants").select("chrom").where("chrom IS NOT NULL").distinct().orderBy("chrom").limit(100_000).collect()]


def scan_bcf(spark: SparkSession, d: str) -> DataFrame:
    chroms = _contigs_of(spark, d)
    header = '##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="p",IDX=0>\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d",IDX=1>\n##INFO=<ID=AF,Number=A,Type=Float,Description="f",IDX=2>\n'
    header += "".join(f"##contig=<ID={c},IDX={k}>\n" for k, c in enumerate(chroms)) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    at = {c: k for k, c in enumerate(chroms)}
    depth = F.nullif(F.regexp_extract(F.concat(F.lit(";"), "info"), r";DP=(\d+)(?:;|$)", 1), F.lit("")).cast("int")
    v = table(spark, d, "variants").select("variant_id", "chrom", "pos", "ref_allele", "alt_alleles", F.col("qual").cast("float").alias("qual"), depth.alias("depth"))

    def encode(rows: list[dict]) -> dict[str, bytes]:
        key = encoders.typed_ints
        info = lambda r: [] if r["depth"] is None else [key([1]) + key([r["depth"]])]
        return {".bcf": encoders.bcf(header, [(at[r["chrom"]], r["pos"] - 1, r["qual"], str(r["variant_id"]), [r["ref_allele"], *(r["alt_alleles"] or [])], [0], info(r), [], 0) for r in rows if r["chrom"] is not None and r["pos"] is not None], BLOCK)}

    b = GenomicsSession(spark).read_bcf(_files(v, encode))
    return b.select(F.col("id")[0].cast("long").alias("variant_id"), "chrom", "pos", "ref", F.array_join("alt", ",").alias("alts"), F.round(F.col("qual").cast("double"), 3).alias("qual"), F.col("info.DP").alias("depth"))


def _tabix(df: DataFrame, ending: str, keys: tuple[str, str], columns: tuple[int, int, int]) -> str:
    """Sorted, indexed BGZF files of the lines in column ``line``."""

    def encode(rows: list[dict]) -> dict[str, bytes]:
        data, index = encoders.tabix([r["line"] for r in rows], columns, BLOCK)
        return {ending: data, ending + ".tbi": index}

    return _files(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line"), encode)


def vcf_region_sql(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants").where("chrom IS NOT NULL AND pos IS NOT NULL")
    listed = lambda c, by: F.when(F.size(c) > 0, F.array_join(c, by)).otherwise(".")
    line = F.concat_ws("\t", "chrom", "pos", "variant_id", _or_dot("ref_allele"), listed("alt_alleles", ","), _or_dot("qual"), listed("filters", ";"), _or_dot("info"), _or_dot("formats"))
    gx, name = _view(spark, _tabix(v.withColumn("line", line), ".vcf.gz", ("chrom", "pos"), (1, 2, 0)), "INDEXED_VCF")
    return gx.sql(f"SELECT CAST(id[0] AS BIGINT) AS variant_id, chrom, pos, info FROM {name} WHERE vcf_region_filter('chr5:100000-900000', chrom, pos)")


def gff_region_sql(spark: SparkSession, d: str) -> DataFrame:
    """The scan function of indexed GFF files over the most frequent sequence."""
    f = table(spark, d, "gtf_features").where("start_pos <= end_pos AND start_pos > 0")
    hot = f.groupBy("seqname").count().orderBy(F.desc("count"), "seqname").first()["seqname"]
    line = F.concat_ws("\t", "seqname", _or_dot("source"), _or_dot("feature_type"), "start_pos", "end_pos", _or_dot("score"), _or_dot("strand"), _or_dot("frame"), F.concat(F.lit("ID="), F.col("feature_id").cast("string")))
    folder = _tabix(f.withColumn("line", line), ".gff.gz", ("seqname", "start_pos"), (1, 4, 5))
    return GenomicsSession(spark).sql(f"SELECT CAST(attributes['ID'][0] AS BIGINT) AS feature_id, type, start, `end` AS stop FROM gff_indexed_scan('{folder}', '{hot}:1,000-6,000')")


def scan_vcf_two_headers(spark: SparkSession, d: str) -> DataFrame:
    """INFO declared by two files in different ways: no field and no value of either is lost."""
    v, folder = table(spark, d, "variants"), _folder(spark)
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS"]
    other = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Float,Description="d">', '##INFO=<ID=KEY,Number=1,Type=Integer,Description="k">', "#CHROM\tPOS"]
    for part, lines, info in (("a", head, F.lit("DP=7")), ("b", other, F.concat(F.lit("DP=2.5;KEY="), F.col("variant_id").cast("string")))):
        mine = v.where(F.col("pos") % 2 == int(part == "b")).select(F.concat_ws("\t", column("chrom"), column("pos"), "variant_id", F.lit("A"), F.lit("."), F.lit("."), F.lit("."), info).alias("value"))
        # A header and its records in one file each.
        spark.createDataFrame([("\n".join(lines),)], "value string").unionAll(mine).coalesce(1).write.text(f"{folder}/{part}")
    r = _read_vcf_folder(spark, folder)
    return r.select(F.col("id")[0].cast("long").alias("variant_id"), F.col("info.DP").cast("double").alias("dp"), F.col("info.KEY").cast("long").alias("key"))


def _read_vcf_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The two folders' parts under names that the reader takes."""
    where, base = files.system(folder)
    for f in where.get_file_info(FileSelector(base, recursive=True)):
        if f.base_name.startswith("part-"):
            where.move(f.path, f"{base}/{f.path.rsplit('/', 2)[1]}.vcf")
    return GenomicsSession(spark).read_vcf(folder + "/", parse_info=True)


# ---- spectra, signal tracks, cytometry -------------------------------------------------------------------------------------------------


def scan_mzml(spark: SparkSession, d: str) -> DataFrame:
    """Spectra with arrays of 32 and 64 bits, packed or plain."""

    def xml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                packed = r["spectrum_key"] % 2 == 0
                arrays = ""
                for name, accession in (("mz", "MS:1000514"), ("intensity", "MS:1000515")):
                    x = r[name] and r[name][name]
                    if x is not None:
                        raw = np.array([np.nan if v is None else v for v in x], "<f8").tobytes()
                        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
                        arrays += f'<binaryDataArray><cvParam accession="MS:1000523" name="f"/>{"<cvParam accession=%sMS:1000574%s/>" % (chr(34), chr(34)) if packed else ""}<cvParam accession="{accession}"/><binary>{text}</binary></binaryDataArray>'
                params = "".join(f'<cvParam accession="{escape(p["accession"] or "")}" name="{escape(p["name"] or "")}" value="{escape(p["value"] or "")}"/>' for p in r["cv_params"] or [] if p)
                ion = f'<cvParam accession="MS:1000744" value="{r["precursor_mz"]!r}"/>' if r["precursor_mz"] is not None else ""
                ion += f'<cvParam accession="MS:1000041" value="{r["precusor_charge"]}"/>' if r["precusor_charge"] is not None else ""
                out.append(f'<spectrum id="{r["spectrum_key"]}">{params}<precursorList><selectedIon>{ion}</selectedIon></precursorList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    folder = _folder(spark)
    table(spark, d, "spectra").select("spectrum_key", "mz", "intensity", "cv_params", "precursor_mz", "precusor_charge").mapInArrow(xml, "value string").write.text(folder)
    from helixlake.sources import text

    s = text.read_mzml(spark, folder)
    total = lambda c: F.round(F.aggregate(F.col(f"{c}.{c}"), F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x)), 3)
    return s.select(F.col("id").cast("long").alias("spectrum_key"), F.size("mz.mz").alias("n_mz"), total("mz").alias("mz"), F.size("intensity.intensity").alias("n_intensity"), F.size("cv_params").alias("n_params"), "precursor_mz", "precusor_charge")


def scan_fcs(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    folder = _files(table(spark, d, "lineitem").select(*names), lambda rows: {".fcs": encoders.fcs(names, [[r[n] for n in names] for r in rows])})
    f = GenomicsSession(spark).read_fcs(folder)
    return f.groupBy(F.round(F.col("l_quantity").cast("double"), 2).alias("quantity")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("l_discount").cast("double"), 2)), 4).alias("discount"), F.round(F.max(F.col("l_tax").cast("double")), 4).alias("tax"))


def _bigwig(spark: SparkSession, d: str) -> str:
    """Qualities of variants as values, one file a range of chromosomes, with summaries of 100,000 positions."""
    v = table(spark, d, "variants").where("chrom IS NOT NULL AND pos IS NOT NULL AND qual IS NOT NULL").select("chrom", "pos", F.round("qual").cast("float").alias("qual"))

    def encode(rows: list[dict]) -> dict[str, bytes]:
        values: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["chrom"], r["pos"])):
            values.setdefault(r["chrom"], []).append((r["pos"] - 1, r["pos"], r["qual"]))
        zooms: dict[str, list] = {}
        for c, rs in values.items():
            bins: dict[int, list[float]] = {}
            for start, _, x in rs:
                bins.setdefault(start // 100_000, []).append(x)
            zooms[c] = [(k * 100_000, (k + 1) * 100_000, len(xs), min(xs), max(xs), sum(xs), sum(x * x for x in xs)) for k, xs in sorted(bins.items())]
        return {".bw": encoders.bigwig(dict.fromkeys(values, 10**9), values, 100_000, zooms)}

    return _files(v.repartition("chrom"), encode)


def scan_bigwig(spark: SparkSession, d: str) -> DataFrame:
    b = GenomicsSession(spark).read_bigwig_value(_bigwig(spark, d))
    return b.select("name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.col("value").cast("double").alias("value"))


def bigwig_region_sql(spark: SparkSession, d: str) -> DataFrame:
    gx, name = _view(spark, _bigwig(spark, d), "BIGWIG_VALUE")
    return gx.sql(f"SELECT name, CAST(start AS BIGINT) AS start, CAST(value AS DOUBLE) AS value FROM {name} WHERE bigwig_region_filter('chr5:100000-900000', name, start)")


def scan_bigwig_zoom(spark: SparkSession, d: str) -> DataFrame:
    gx, name = _view(spark, _bigwig(spark, d), "BIGWIG_ZOOM", {"reduction_level": "100000"})
    return gx.sql(f"SELECT name, CAST(start AS BIGINT) AS start, CAST(bases_covered AS BIGINT) AS covered, min_value, max_value FROM {name}")


# ---- text records ----------------------------------------------------------------------------------------------------------------------


def scan_hmm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    zero = [F.lit("0")] * 13
    path = _lines(p, [F.col("p_name"), F.lit("-"), F.col("p_size"), F.col("p_brand"), F.lit("PF"), F.lit("7"), F.col("p_retailprice"), F.lit("1.5"), F.lit("0"), *zero, F.col("p_type")], ["# domains"])
    h = GenomicsSession(spark).read_hmmdomtab(path)
    return h.select("target_name", "tlen", "query_name", "evalue", "description")


def scan_sdf(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    mol = F.concat_ws("\n", "p_name", F.lit("  tool"), F.lit(""), F.concat(F.lpad(F.col("p_size").cast("string"), 3, " "), F.lit("  0  0     0  0            999 V2000")), F.lit("M  END"), F.lit(">  <key>"), F.col("p_partkey").cast("string"), F.lit(""), F.lit(">  <brand>"), "p_brand", F.lit(""), F.lit("$$$$"))
    folder = _folder(spark)
    p.select(mol.alias("value")).write.text(folder)
    s = _sdf(spark, folder)
    return s.select(F.col("data.key").cast("long").alias("p_partkey"), F.col("data.brand").alias("brand"), F.col("atom_count").cast("long").alias("atoms"))


def _sdf(spark: SparkSession, folder: str) -> DataFrame:
    where, base = files.system(folder)
    for f in where.get_file_info(FileSelector(base)):
        if f.base_name.startswith("part-"):
            where.move(f.path, f.path.removesuffix(".txt") + ".sdf")
    return GenomicsSession(spark).read_sdf(folder + "/")


def scan_genbank(spark: SparkSession, d: str) -> DataFrame:
    c = _clean_contigs(spark, d)
    record = F.concat_ws(
        "\n", F.concat(F.lit("LOCUS       "), "id", F.lit(" "), F.length("sequence").cast("string"), F.lit(" bp    DNA     linear   BCT 01-JAN-2020")), F.concat(F.lit("ACCESSION   "), "id"),
        F.lit("FEATURES             Location/Qualifiers"), F.lit("     gene            1..6"), F.concat(F.lit('                     /gene="'), "id", F.lit('"')), F.lit("ORIGIN"), F.concat(F.lit("        1 "), "sequence"), F.lit("//"),
    )
    folder = _folder(spark)
    c.select(record.alias("value")).write.text(folder)
    g = GenomicsSession(spark).read_genbank(folder)
    return g.select("name", "accession", F.md5("sequence").alias("digest"), "molecule_type", F.col("features")[0]["qualifiers"][0]["values"].alias("gene"))


def fasta_regions(spark: SparkSession, d: str) -> DataFrame:
    """The residues 5 to 60 of every record, by region through the index."""
    c = _clean_contigs(spark, d).where("length(sequence) > 0")
    names = [r["id"] for r in c.select("id").toLocalIterator()]

    def encode(rows: list[dict]) -> dict[str, bytes]:
        out, index, at = [], [], 0
        for r in rows:
            head = f">{r['id']}\n".encode()
            body = b"".join(r["sequence"][k : k + 60].encode() + b"\n" for k in range(0, len(r["sequence"]), 60))
            index.append(f"{r['id']}\t{len(r['sequence'])}\t{at + len(head)}\t60\t61\n")
            out.append(head + body)
            at += len(head) + len(body)
        return {".fasta": b"".join(out), ".fasta.fai": "".join(index).encode()}

    f = GenomicsSession(spark).read_indexed_fasta(_files(c, encode), [f"{n}:5-60" for n in names])
    return f.select(F.substring_index("id", ":", 1).alias("id"), "sequence")


def scan_fastq_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in carriage returns, read in splits of 64 kB."""
    r = table(spark, d, "reads").select("read_id", F.coalesce("sequence", F.lit("")).alias("sequence"))
    encode = lambda rows: {".fastq": "".join(f"@{x['read_id']} d\r\n{x['sequence']}\r\n+\r\n{'@' * len(x['sequence'])}\r\n" for x in rows).encode()}
    f = GenomicsSession(spark).read_fastq(_files(r, encode), split=1 << 16)
    return f.select(F.col("name").cast("long").alias("read_id"), "description", F.md5("sequence").alias("digest"), F.length("quality_scores").alias("n"))


# ---- the session's SQL -----------------------------------------------------------------------------------------------------------------


def sql_sequence_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions by their SQL names."""
    GenomicsSession(spark)
    letters = F.regexp_replace("sequence", "[^A-Za-z]", "")
    c = table(spark, d, "contigs").select("contig_id", letters.alias("s"))
    return spark.sql("SELECT contig_id, md5(reverse_complement(s)) AS rc, round(CAST(gc_content(s) AS DOUBLE), 6) AS gc, CAST(length(trim_polya(s)) AS BIGINT) AS trimmed FROM {c}", c=c)


def sql_read_functions(spark: SparkSession, d: str) -> DataFrame:
    GenomicsSession(spark)
    flags = ", ".join(f"{n}(flag) AS {n}" for n in FLAGS)
    return spark.sql(f"SELECT read_id, quality_scores_to_string(CAST(quality_score AS ARRAY<INT>)) AS q, {flags} FROM {{r}}", r=table(spark, d, "reads"))


def sql_spectrum_functions(spark: SparkSession, d: str) -> DataFrame:
    GenomicsSession(spark)
    s = table(spark, d, "spectra")
    return spark.sql(
        """SELECT spectrum_key, contains_peak(mz.mz, 500D, 5D) AS has_peak,
        array_join(transform(bin_vectors(mz.mz, intensity.intensity, 100D, 8L, 250D), x -> CAST(CAST(round(x) AS BIGINT) AS STRING)), ',') AS bins FROM {s}""",
        s=s,
    )


def sql_region_functions(spark: SparkSession, d: str) -> DataFrame:
    """Region predicates by their SQL names in plain ``spark.sql``."""
    GenomicsSession(spark)
    v = table(spark, d, "variants")
    return spark.sql(
        """SELECT variant_id, chrom IS NOT NULL AND pos IS NOT NULL AND region_match(chrom, pos, 'chr5:100,000-900,000') AS in_region, interval_match(pos, '1-500000') AS in_interval,
        chrom_match(chrom, 'chr5') AS on_chrom, coalesce(vcf_region_filter('chr5:100000-900000', chrom, pos), false) AS kept FROM {v}""",
        v=v,
    )


def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    """CREATE EXTERNAL TABLE, COPY, a scan function, a table written by CTAS and read, and DROP."""
    gx, source, target, parquet = GenomicsSession(spark), _folder(spark), _folder(spark, ".fasta.gz"), _folder(spark)
    name = f"t_{uuid.uuid4().hex}"
    from helixlake.sources import writers

    writers.write_records(_clean_contigs(spark, d), source, "fasta", single=False)
    gx.sql(f"CREATE EXTERNAL TABLE {name} STORED AS FASTA LOCATION '{source}'")
    gx.sql(f"COPY (SELECT id, description, sequence FROM {name} WHERE length(sequence) > 100) TO '{target}' STORED AS FASTA OPTIONS (compression gzip)")
    gx.sql(f"COPY (SELECT id, length(sequence) AS size FROM fasta_scan('{target}', 'gzip')) TO '{parquet}' STORED AS PARQUET")
    gx.sql(f"DROP TABLE {name}")
    return spark.read.parquet(parquet).select("id", F.col("size").cast("long").alias("size"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_bam, bam_region_sql, bam_typed_tags, scan_bcf, vcf_region_sql, gff_region_sql, scan_vcf_two_headers, scan_mzml, scan_fcs, scan_bigwig, bigwig_region_sql, scan_bigwig_zoom,
        scan_hmm, scan_sdf, scan_genbank, fasta_regions, scan_fastq_split, sql_sequence_functions, sql_read_functions, sql_spectrum_functions, sql_region_functions, sql_statements,
    )
}

_LETTERS = "regexp_replace(sequence, '[^A-Za-z]', '', 'g')"
_SPAN = "list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT)))"
_READS = """(SELECT x.read_id, x.flag, x.mapping_quality, x.sequence, x.quality_score, x.tags, nullif(x.cigar, '*') AS cigar, s.name AS reference, CASE WHEN s.name IS NOT NULL THEN x.start_pos END AS start_pos
    FROM reads x LEFT JOIN reference_seqs s ON s.name = x.reference)"""
SQL: dict[str, str] = {
    "sql_spectrum_functions": relational.SQL["spectrum_peaks"],
    "scan_bam": f"""SELECT read_id, flag, reference, start_pos AS start, CASE WHEN cigar IS NOT NULL THEN start_pos + CAST({_SPAN} AS BIGINT) - 1 END AS stop, mapping_quality, coalesce(cigar, '') AS cigar, md5(coalesce(sequence, '')) AS digest,
        array_to_string(CASE WHEN len(quality_score) = length(sequence) THEN quality_score ELSE [] END, ',') AS scores, CAST(coalesce(len(list_filter(tags, lambda t: t.value IS NOT NULL)), 0) AS INTEGER) AS n_tags FROM {_READS}""",
    "bam_region_sql": f"SELECT read_id, flag FROM {_READS} WHERE reference = 'chr5' AND start_pos <= 900000 AND cigar IS NOT NULL AND start_pos + {_SPAN} - 1 >= 100000",
    "bam_typed_tags": "SELECT read_id, list_filter(tags, lambda t: t.tag = 'NM')[1].value AS nm, list_filter(tags, lambda t: t.tag = 'RG')[1].value AS rg FROM reads",
    "scan_bcf": """SELECT variant_id, chrom, pos, ref_allele AS ref, array_to_string(alt_alleles, ',') AS alts, round(CAST(CAST(qual AS FLOAT) AS DOUBLE), 3) AS qual,
        TRY_CAST(nullif(regexp_extract(';' || info, ';DP=([0-9]+)(;|$)', 1), '') AS INTEGER) AS depth FROM variants WHERE chrom IS NOT NULL AND pos IS NOT NULL""",
    "vcf_region_sql": "SELECT variant_id, chrom, pos, info FROM variants WHERE chrom = 'chr5' AND pos BETWEEN 100000 AND 900000",
    "gff_region_sql": """SELECT feature_id, feature_type AS type, start_pos AS start, end_pos AS stop FROM gtf_features WHERE start_pos <= end_pos AND start_pos BETWEEN 1000 AND 6000
        AND seqname = (SELECT seqname FROM gtf_features WHERE start_pos <= end_pos AND start_pos > 0 GROUP BY seqname ORDER BY count(*) DESC, seqname LIMIT 1)""",
    "scan_vcf_two_headers": "SELECT variant_id, CASE WHEN pos % 2 = 0 THEN 7.0 ELSE 2.5 END::DOUBLE AS dp, CASE WHEN pos % 2 = 1 THEN variant_id END AS key FROM variants",
    "scan_mzml": """SELECT spectrum_key, CAST(len(mz.mz) AS INTEGER) AS n_mz, CASE WHEN mz.mz IS NOT NULL THEN round(coalesce(list_sum(mz.mz), 0), 3) END AS mz, CAST(len(intensity.intensity) AS INTEGER) AS n_intensity,
        CAST(coalesce(len(list_filter(cv_params, lambda p: p IS NOT NULL)), 0) AS INTEGER) AS n_params, precursor_mz, precusor_charge FROM spectra""",
    "scan_fcs": "SELECT round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 2) AS quantity, count(*) AS n, round(sum(round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 2)), 4) AS discount, round(max(CAST(CAST(l_tax AS FLOAT) AS DOUBLE)), 4) AS tax FROM lineitem GROUP BY 1",
    "scan_bigwig": "SELECT chrom AS name, pos - 1 AS start, pos AS stop, CAST(round(qual) AS DOUBLE) AS value FROM variants WHERE chrom IS NOT NULL AND pos IS NOT NULL AND qual IS NOT NULL",
    "bigwig_region_sql": "SELECT chrom AS name, pos - 1 AS start, CAST(round(qual) AS DOUBLE) AS value FROM variants WHERE chrom = 'chr5' AND pos - 1 BETWEEN 100000 AND 900000 AND qual IS NOT NULL",
    "scan_bigwig_zoom": """SELECT chrom AS name, (pos - 1) // 100000 * 100000 AS start, count(*) AS covered, min(CAST(round(qual) AS DOUBLE)) AS min_value, max(CAST(round(qual) AS DOUBLE)) AS max_value
        FROM variants WHERE chrom IS NOT NULL AND pos IS NOT NULL AND qual IS NOT NULL GROUP BY 1, 2""",
    "scan_hmm": "SELECT p_name AS target_name, CAST(p_size AS BIGINT) AS tlen, p_brand AS query_name, CAST(p_retailprice AS DOUBLE) AS evalue, p_type AS description FROM part",
    "scan_sdf": "SELECT p_partkey, p_brand AS brand, CAST(p_size AS BIGINT) AS atoms FROM part",
    "scan_genbank": f"SELECT concat_ws('_', id, contig_id) AS name, concat_ws('_', id, contig_id) AS accession, md5({_LETTERS}) AS digest, 'DNA' AS molecule_type, concat_ws('_', id, contig_id) AS gene FROM contigs",
    "fasta_regions": f"SELECT concat_ws('_', id, contig_id) AS id, substr({_LETTERS}, 5, 56) AS sequence FROM contigs WHERE length({_LETTERS}) > 0",
    "scan_fastq_split": "SELECT read_id, 'd' AS description, md5(coalesce(sequence, '')) AS digest, CAST(length(coalesce(sequence, '')) AS INTEGER) AS n FROM reads",
    "sql_sequence_functions": f"""SELECT contig_id, md5(translate(reverse(s), 'ATCGatcg', 'TAGCtagc')) AS rc, round(CAST(CAST(length(regexp_replace(s, '[^GC]', '', 'g')) / strlen(s) AS FLOAT) AS DOUBLE), 6) AS gc,
        length(regexp_replace(s, '[Aa]+$', '')) AS trimmed FROM (SELECT contig_id, {_LETTERS} AS s FROM contigs)""",
    "sql_read_functions": f"SELECT read_id, array_to_string(list_transform(quality_score, lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS q, {', '.join(f'(flag & {m}) = {m} AS {n}' for n, m in FLAGS.items())} FROM reads",
    "sql_region_functions": """SELECT variant_id, coalesce(chrom = 'chr5' AND pos BETWEEN 100000 AND 900000, false) AS in_region, coalesce(pos BETWEEN 1 AND 500000, false) AS in_interval, chrom = 'chr5' AS on_chrom,
        coalesce(chrom = 'chr5' AND pos BETWEEN 100000 AND 900000, false) AS kept FROM variants""",
    "sql_statements": f"SELECT concat_ws('_', id, contig_id) AS id, length({_LETTERS}) AS size FROM contigs WHERE length({_LETTERS}) > 100",
}
