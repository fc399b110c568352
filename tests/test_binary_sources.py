import struct

import pytest

from helixlake.plans.region import Interval
from helixlake.sources import bam, bgzf
from tests import builders


@pytest.fixture(scope="module")
def bam_file(tmp_path_factory):
    d = tmp_path_factory.mktemp("bam")
    tags = b"NMC\x03" + b"RGZlane\0" + b"ZFf" + struct.pack("<f", 1.5) + b"BABs" + struct.pack("<i2h", 2, -5, 7) + b"BFBf" + struct.pack("<i2f", 2, 2.72, 0)
    rows = [(f"r{i}", 16 if i % 2 else 0, i // 50, 100 * (i % 50), 255 if i == 0 else 60, [(5, "S"), (10, "M"), (3, "D"), (2, "=")], "ACGTNACGTNACGTNAC", [30] * 17 if i % 3 else None, tags) for i in range(100)]
    rows.append(("lost", 4, -1, -1, 0, [], "AC", [1, 2], b""))
    data, index = builders.bam([("chr1", 10_000), ("chr2", 10_000)], rows)
    (d / "x.bam").write_bytes(data)
    (d / "x.bam.bai").write_bytes(index)
    return d / "x.bam"


def test_bam(gx, bam_file):
    df = gx.read_bam(str(bam_file))
    assert df.count() == 101
    first, lost = df.where("name = 'r0'").first(), df.where("name = 'lost'").first()
    assert (first.flag, first.reference, first.start, first.end, first.mapping_quality, first.cigar, first.mate_reference) == (0, "chr1", 1, 15, None, "5S10M3D2=", "chr1")
    assert first.sequence == "ACGTNACGTNACGTNAC" and first.quality_score == []
    assert {t.tag: t.value for t in first.tags} == {"NM": "3", "RG": "lane", "ZF": "1.5", "BA": "-5,7", "BF": "2.72, 0.00"}
    assert (lost.reference, lost.start, lost.end, lost.cigar, lost.quality_score) == (None, None, None, "", [1, 2])
    struct_tags = gx.read_bam(str(bam_file), parse_tags=True).where("name = 'r1'").select("tags.*").first()
    assert (struct_tags.NM, struct_tags.RG, struct_tags.BA) == (3, "lane", [-5, 7])


def test_bam_splits_are_whole(gx, bam_file):
    df = gx.read_bam(str(bam_file), split=500)
    assert df.rdd.getNumPartitions() > 3
    assert df.count() == 101 and df.select("name").distinct().count() == 101


@pytest.mark.parametrize(("region", "n"), [("chr1", 50), ("chr1:1-1000", 10), ("chr2:4901-", 1), ("chr1:15-100", 1), ("chr9", 0), ("chr1:16-100", 0)])
def test_bam_region(gx, bam_file, region, n):
    assert gx.read_indexed_bam(str(bam_file), region).count() == n
    assert gx.sql(f"SELECT * FROM bam_indexed_scan('{bam_file}', '{region}')").count() == n


def test_region_reaches_the_index(gx, bam_file):
    index = bgzf.read_index(str(bam_file) + ".bai")
    some = index.chunks(0, Interval(1, 200))
    every = index.chunks(0, Interval())
    assert some and sum(b - a for a, b in some) <= sum(b - a for a, b in every)
    # A query of its own reads the chunks of the region only; the view itself stays whole.
    gx.register_table("b", str(bam_file), "BAM", {})
    few = gx.sql("SELECT name FROM b WHERE bam_region_filter('chr1:1-200', reference, start, `end`)")
    assert few.rdd.getNumPartitions() == len(some) and few.count() == 2
    assert gx.sql("SELECT * FROM b").count() == 101
    both = "SELECT 'x' AS k, count(*) AS n FROM b WHERE bam_region_filter('chr1:1-200', reference, start, `end`) UNION ALL SELECT 'y', count(*) FROM b WHERE bam_region_filter('chr2', reference)"
    assert sorted(map(tuple, gx.sql(both).collect())) == [("x", 2), ("y", 50)]
    assert gx.sql("SELECT name FROM b WHERE bam_region_filter('chr9', reference)").count() == 0
    assert gx.sql("SELECT name FROM b WHERE bam_region_filter('chr1:1-200', reference, start, `end`) OR name = 'lost'").count() == 3


def test_one_relation_many_filters(gx, bam_file):
    """Scans of one view don't see each other's filters."""
    whole = gx.read_bam(str(bam_file), split=500)
    assert whole.where("reference = 'chr1' AND start <= 200").count() == 2 and whole.count() == 101 and whole.where("reference = 'chr2'").count() == 50


def test_tabix_vcf_and_gff(gx, tmp_path):
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"]
    lines += [f"{c}\t{p}\t.\tA\tC,G\t{p % 7}.5\tPASS\tDP={p}\tGT\t0/1" for c in ("1", "2") for p in range(1, 40_000, 400)]
    data, index = builders.tabix(lines)
    (tmp_path / "x.vcf.gz").write_bytes(data)
    (tmp_path / "x.vcf.gz.tbi").write_bytes(index)
    path = str(tmp_path / "x.vcf.gz")
    assert gx.read_vcf(path).count() == 200  # plain gzip reading of the same file
    assert gx.read_indexed_vcf(path).count() == 200
    assert gx.read_indexed_vcf(path, "1:1-801").select("pos").orderBy("pos").toPandas()["pos"].tolist() == [1, 401, 801]
    assert gx.read_indexed_vcf(path, "7").count() == 0
    gx.sql(f"CREATE EXTERNAL TABLE v STORED AS INDEXED_VCF LOCATION '{path}'")
    assert gx.sql("SELECT * FROM v WHERE vcf_region_filter('2', chrom)").count() == 100
    assert gx.sql("SELECT * FROM v WHERE vcf_region_filter('2:1-500', chrom, pos) AND qual <> 1.5").count() == 1
    assert gx.sql("SELECT * FROM v WHERE vcf_region_filter('2:1-500')").count() == 2
    row = gx.read_indexed_vcf(path, "1:401-401").first()
    assert (row.alt, row.info, row.formats, row["filter"]) == (["C", "G"], "DP=401", "GT\t0/1", ["PASS"])

    data, index = builders.tabix([f"c{k % 2}\tsrc\tCDS\t{s}\t{s + 50}\t.\t+\t.\tID=e{s};Note=a%2Cb,c" for k in range(2) for s in range(1, 30_000, 1000)], (1, 4, 5))
    (tmp_path / "x.gff.gz").write_bytes(data)
    (tmp_path / "x.gff.gz.tbi").write_bytes(index)
    got = gx.sql(f"SELECT * FROM gff_indexed_scan('{tmp_path / 'x.gff.gz'}', 'c1:1001-3001')")
    assert got.count() == 3 and got.first().attributes["Note"] == ["a,b", "c"]


def test_missing_index(gx, tmp_path):
    (tmp_path / "y.vcf.gz").write_bytes(builders.Bgzf().done())
    with pytest.raises(Exception, match="tbi"):
        gx.read_indexed_vcf(str(tmp_path / "y.vcf.gz")).count()


def test_bcf(gx, tmp_path):
    header = "\n".join([
        "##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="p",IDX=0>', '##FILTER=<ID=q10,Description="q",IDX=1>', '##INFO=<ID=DP,Number=1,Type=Integer,Description="d",IDX=2>',
        '##INFO=<ID=AF,Number=A,Type=Float,Description="f",IDX=3>', '##INFO=<ID=DB,Number=0,Type=Flag,Description="b",IDX=4>', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g",IDX=5>',
        '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p",IDX=6>', "##contig=<ID=chr1,length=1000,IDX=0>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
    ])
    key = lambda k: builders.typed_ints([k])
    info = [key(2) + builders.typed_ints([7]), key(3) + builders.typed_floats([0.25, None]), key(4) + b"\x00"]
    formats = [key(5) + b"\x21" + bytes([2, 4, 0, 3]), key(6) + b"\x31" + struct.pack("<6b", 1, 2, 3, -128, -127, -127)]
    (tmp_path / "x.bcf").write_bytes(builders.bcf(header, [(0, 9, 12.5, "rs1", ["A", "C", "GT"], [0], info, formats, 2), (0, 19, None, ".", ["T"], [1], [], [], 2)]))
    a, b = gx.read_bcf(str(tmp_path / "x.bcf")).orderBy("pos").collect()
    assert (a.chrom, a.pos, a.id, a.ref, a.alt, a.qual, a["filter"]) == ("chr1", 10, ["rs1"], "A", ["C", "GT"], 12.5, ["PASS"])
    assert (a.info.DP, a.info.AF, a.info.DB) == (7, [0.25, None], True)
    assert [(f.GT, f.PL) for f in a.formats] == [("0/1", [1, 2, 3]), (".|0", [None])]
    assert (b.id, b.alt, b.qual, b["filter"], b.info.DP) == ([], None, None, ["q10"], None)


def test_bigwig(gx, tmp_path):
    values = {"1": [(0, 1, 0.1), (1, 2, 0.2), (2, 3, 0.3), (100, 150, 1.4), (150, 151, 1.5)], "10": [(200, 300, 2.0)]}
    zooms = {"1": [(0, 400, 54, 0.1, 1.5, 72.1, 100.4)], "10": [(200, 600, 100, 2, 2, 200, 400)]}
    (tmp_path / "x.bw").write_bytes(builders.bigwig({"1": 400, "10": 600}, values, 400, zooms))
    path = str(tmp_path / "x.bw")
    rows = [(r.name, r.start, r.end, round(r.value, 4)) for r in gx.read_bigwig_value(path).orderBy("name", "start").collect()]
    assert rows == [("1", 0, 1, 0.1), ("1", 1, 2, 0.2), ("1", 2, 3, 0.3), ("1", 100, 150, 1.4), ("1", 150, 151, 1.5), ("10", 200, 300, 2.0)]
    assert gx.read_bigwig_value(path, region="1:100-151").count() == 2
    with pytest.raises(Exception, match="no chromosome"):
        gx.read_bigwig_value(path, region="7").count()
    gx.sql(f"CREATE EXTERNAL TABLE z STORED AS BIGWIG_ZOOM OPTIONS (reduction_level 400) LOCATION '{path}'")
    z = gx.sql("SELECT * FROM z ORDER BY name").collect()
    assert [(r.name, r.start, r.end, r.total_items, r.bases_covered) for r in z] == [("1", 0, 400, 0, 54), ("10", 200, 600, 0, 100)]
    assert round(z[0].sum_squares, 1) == 100.4 and z[1].max_value == 2
    with pytest.raises(Exception, match="reduction_level"):
        gx.sql(f"CREATE EXTERNAL TABLE z2 STORED AS BIGWIG_ZOOM LOCATION '{path}'")
    with pytest.raises(Exception, match="no zoom"):
        gx.read_bigwig_zoom(path, 77).count()
    gx.register_table("w", path, "BIGWIG_VALUE")
    assert gx.sql("SELECT * FROM w WHERE bigwig_region_filter('1', name)").count() == 5
    assert gx.sql("SELECT * FROM w WHERE bigwig_region_filter('1:50-120', name)").count() == 1
    assert gx.sql("SELECT * FROM w WHERE bigwig_region_filter('1:50-120', name, start)").count() == 1


def test_fcs(gx, tmp_path):
    (tmp_path / "x.fcs").write_bytes(builders.fcs(["FSC A", "SSC"], [[1.5, 2.5], [3, 4], [5, 6]]))
    df = gx.read_fcs(str(tmp_path / "x.fcs"))
    assert df.columns == ["FSC A", "SSC"] and df.orderBy("SSC").first()[0] == 1.5 and df.count() == 3


def test_fastq_splits(gx, tmp_path):
    text = "".join(f"@r{i} d{i}\nACGT{'A' * (i % 5)}\n+\n@@@@{'@' * (i % 5)}\n" for i in range(500))
    (tmp_path / "x.fastq").write_text(text)
    for size in (64, 1000, 10**6):
        df = gx.read_fastq(str(tmp_path / "x.fastq"), split=size)
        assert df.count() == 500 and df.select("name").distinct().count() == 500
    (tmp_path / "y.fastq.gz").write_bytes(builders.block(text.encode()) + builders.EOF)
    assert gx.read_fastq(str(tmp_path / "y.fastq.gz")).count() == 500


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_line_ends_and_blank_lines(gx, tmp_path, end):
    text = "".join(f"@r{i}{' d' if i % 3 else ''}{end}{'ACGT' * (i % 4)}{end}+r{end}{'@+II' * (i % 4)}{end}{end if i % 7 == 0 else ''}" for i in range(3000))
    (tmp_path / "x.fastq").write_bytes(text.encode())
    for size in (5000, 50_000, 10**7):
        rows = gx.read_fastq(str(tmp_path / "x.fastq"), split=size).collect()
        assert sorted((r.name, r.description, r.sequence, r.quality_scores) for r in rows) == sorted((f"r{i}", "d" if i % 3 else None, "ACGT" * (i % 4), "@+II" * (i % 4)) for i in range(3000))
    (tmp_path / "bad.fastq").write_text("@a\nAC\n+\nII\nxx\nAC\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        gx.read_fastq(str(tmp_path / "bad.fastq")).collect()
    (tmp_path / "cut.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="ends within a record"):
        gx.read_fastq(str(tmp_path / "cut.fastq")).collect()


def test_fastq_long_records(gx, tmp_path):
    """Records longer than a split and than a chunk are read once each."""
    n = 3_000_000
    (tmp_path / "x.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (n // 4)}\n+\n{'@' * n}\n" for i in range(4)))
    rows = gx.read_fastq(str(tmp_path / "x.fastq"), split=5_000_000).selectExpr("name", "length(sequence) AS s", "length(quality_scores) AS q").collect()
    assert sorted(map(tuple, rows)) == [(f"r{i}", n, n) for i in range(4)]


def test_tags_of_any_record(gx, tmp_path):
    nm, md = b"NMC\x03", b"MDZ10\0"
    for k, tags in enumerate(([nm, nm + md], [b"NMf" + struct.pack("<f", 1.5), b""])):
        data, _ = builders.bam([("c", 100)], [(f"x{k}{i}", 0, 0, 1, 9, [(2, "M")], "AC", None, t) for i, t in enumerate(tags)])
        (tmp_path / f"{k}.bam").write_bytes(data)
    df = gx.read_bam(str(tmp_path) + "/", parse_tags=True)
    got = {r.name: (r.NM, r.MD) for r in df.select("name", "tags.*").collect()}
    assert got == {"x00": (3.0, None), "x01": (3.0, "10"), "x10": (1.5, None), "x11": (None, None)}


def test_bam_columns_agree_with_records(gx, tmp_path):
    """The column decoder against the record decoder, long cigars, odd lengths and missing parts included."""
    import io
    import random

    rng = random.Random(6)
    long_cigar = b"CGBI" + struct.pack("<i3I", 3, 4 << 4, 5 << 4 | 2, 3 << 4 | 7)
    rows = []
    for i in range(700):
        n = rng.randrange(0, 40)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        if i % 50 == 7:
            n, seq = 7, "ACGTACG"
            rows.append((f"long{i}", 0, 0, 5, 60, [(7, "S"), (12, "N")], seq, None, b"NMC\x01" + long_cigar))
        else:
            cigar = [(rng.randrange(1, 300), rng.choice("MIDNSHP=X")) for _ in range(rng.randrange(0, 5))]
            rows.append((f"r{i}", rng.randrange(4096), rng.choice([0, 1, -1]), rng.choice([-1, 10, 10**8]), rng.choice([0, 60, 255]), cigar, seq, [rng.randrange(0, 60) for _ in seq] if i % 3 else None, rng.choice([b"", b"NMC\x03", b"RGZ\0"])))
    data, _ = builders.bam([("a", 10**9), ("b", 10**9)], rows)
    (tmp_path / "x.bam").write_bytes(data)
    reader = bgzf.Reader(io.BytesIO(data))
    names = [n for n, _ in bam.read_header(reader)[1]]
    want = [(*r[:-1], [(t, v) for t, _, v in r[-1]]) for r in bam.records(reader, names)]
    got = [(*r[:-1], [tuple(t) for t in r[-1]]) for r in gx.read_bam(str(tmp_path / "x.bam")).collect()]
    assert got == want and len(got) == 700
    gx.register_table("cols", str(tmp_path / "x.bam"), "BAM", {})
    one = gx.sql("SELECT count(*) AS n FROM cols WHERE flag > 100")
    assert one.first().n == sum(r[1] > 100 for r in want)


def test_bcf_with_two_headers(gx, tmp_path):
    head = lambda *info: "##fileformat=VCFv4.2\n" + "".join(f'##INFO=<ID={i},Number={n},Type={t},Description="d",IDX={k}>\n' for k, (i, n, t) in enumerate(info, 1)) + "##contig=<ID=c,IDX=0>\n#CHROM\n"
    one = builders.bcf(head(("DP", "1", "Integer")), [(0, 4, None, "a", ["A"], [0], [builders.typed_ints([1]) + builders.typed_ints([5])], [], 0)])
    two = builders.bcf(head(("DP", "1", "Float"), ("XX", "1", "Integer")), [(0, 5, None, "b", ["A"], [0], [builders.typed_ints([1]) + builders.typed_floats([2.5]), builders.typed_ints([2]) + builders.typed_ints([7])], [], 0)])
    (tmp_path / "1.bcf").write_bytes(one)
    (tmp_path / "2.bcf").write_bytes(two)
    got = sorted(tuple(r) for r in gx.read_bcf(str(tmp_path) + "/").select("pos", "info.DP", "info.XX").collect())
    assert got == [(5, 5.0, None), (6, 2.5, 7)]


def test_indexed_fasta(gx, tmp_path):
    (tmp_path / "x.fasta").write_text(">a d\nATC\nG\n>b\nGGTT\n")
    (tmp_path / "x.fasta.fai").write_text("a\t4\t5\t3\t4\nb\t4\t14\t4\t5\n")
    path = str(tmp_path / "x.fasta")
    q = lambda r: [tuple(x) for x in gx.sql(f"SELECT id, description, sequence FROM fasta_indexed_scan('{path}', '{r}')").collect()]
    assert q("a") == [("a", None, "ATCG")] and q("a:3-4") == [("a:3-4", None, "CG")] and q("a:1-2") == [("a:1-2", None, "AT")]
    with pytest.raises(Exception, match="doesn't hold zz"):
        q("zz")
    (tmp_path / "regions.txt").write_text("a:3-4\nb\n")
    assert sorted(q(tmp_path / "regions.txt")) == [("a:3-4", None, "CG"), ("b", None, "GGTT")]


def test_partitioned_binary(gx, tmp_path):
    data, _ = builders.bam([("c", 100)], [("x", 0, 0, 1, 9, [(2, "M")], "AC", None, b"")])
    for s in ("1", "2"):
        (tmp_path / f"sample={s}").mkdir()
        (tmp_path / f"sample={s}" / "a.bam").write_bytes(data)
    df = gx.read_bam(str(tmp_path) + "/")
    assert df.columns[-1] == "sample" and df.count() == 2 and df.where("sample = '2'").count() == 1 and df.where("sample = '4'").count() == 0
    gx.register_table("parts", str(tmp_path) + "/", "BAM")
    one = gx.sql("SELECT name FROM parts WHERE sample = '2'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1 and gx.sql("SELECT name FROM parts WHERE sample = 1 AND flag = 0").count() == 1


def test_broken_bam():
    with pytest.raises(ValueError, match="not a BAM"):
        import io

        bam.read_header(bgzf.Reader(io.BytesIO(builders.block(b"nope nope"))))
