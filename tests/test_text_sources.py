import base64
import gzip
import struct
import zlib

import pytest

from helixlake.sources import files, schemas, text


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fasta(gx, tmp_path):
    p = write(tmp_path / "a.fasta", ">a description\nAT\nCG\n>b description2\r\nATCG\r\n>c\n\n")
    assert rows(gx.read_fasta(p)) == [("a", "description", "ATCG"), ("b", "description2", "ATCG"), ("c", None, "")]
    assert gx.read_fasta(p, "integer_encode_dna").where("id = 'a'").first().sequence == [1, 4, 2, 3]
    q = write(tmp_path / "p.faa", ">p\nACDEFGHIKLMNPQRSTVWY\n")
    assert gx.read_fasta(q, "integer_encode_protein").first().sequence == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19, 21, 22, 23]
    with pytest.raises(Exception, match="no code"):
        gx.read_fasta(q, "integer_encode_dna").collect()
    with pytest.raises(ValueError, match="sequence type"):
        gx.read_fasta(p, "utf7")
    (tmp_path / "z.fasta.gz").write_bytes(gzip.compress(b">a d\nATCG\n"))
    assert gx.read_inferred(str(tmp_path / "z.fasta.gz")).count() == 1


def test_partitions(gx, tmp_path):
    for s in ("1", "2"):
        write(tmp_path / f"sample={s}" / "x.fasta", ">a d\nATCG\n>b d\nGG\n")
    df = gx.read_fasta(str(tmp_path) + "/")
    assert df.columns == ["id", "description", "sequence", "sample"] and df.count() == 4 and df.where("sample = '4'").count() == 0
    assert dict(df.dtypes)["sample"] == "string"
    assert "PartitionFilters: [isnotnull(sample" in df.where("sample = '2'")._jdf.queryExecution().toString()


def test_gff(gx, tmp_path):
    p = write(tmp_path / "a.gff", "##gff-version 3\n# it's a \"comment\n" + "sq0\tcaat\tgene\t8\t13\t.\t+\t.\tID=g1;Note=a,b%2Cc;Note=z\n" + "sq0\t.\tCDS\t8\t9\t2.5\t?\t0\t.\n\n")
    a, b = gx.read_gff(p).collect()
    assert (a.seqname, a.source, a.type, a.start, a.end, a.score, a.strand, a.phase) == ("sq0", "caat", "gene", 8, 13, None, "+", None)
    assert a.attributes == {"ID": ["g1"], "Note": ["a", "b,c"]}
    assert (b.source, b.score, b.phase, b.attributes) == (None, 2.5, "0", {})


def test_gtf(gx, tmp_path):
    p = write(tmp_path / "a.gtf", '#!x\nchr1\tpt\tCDS\t11869\t12227\t.\t+\t.\tgene_id "G; 1"; part_number 2; tag "a"; tag "b";\n')
    r = gx.read_gtf(p).first()
    assert (r.seqname, r.type, r.start, r.end, r.score, r.frame) == ("chr1", "CDS", 11869, 12227, None, None)
    assert r.attributes == {"gene_id": "G; 1", "part_number": "2", "tag": "a"}


def test_bed(gx, tmp_path):
    p = write(tmp_path / "a.bed", "# c\ntrack name=x\nchr1\t0\t12227\tNR\t0\t+\nchr1\t1\t2\nchr2\t1\t9\tn\t5\t-\t2\t3\t255,0,0\t2\t1,2\t0,4\n")
    a, b, c = gx.read_bed(p).collect()
    assert tuple(a) == ("chr1", 0, 12227, "NR", 0, "+", None, None, None, None, None, None)
    assert b.name is None and (c.thick_start, c.color, c.block_sizes, c.block_starts) == (2, "255,0,0", "1,2", "0,4")
    assert len(gx.read_bed(p, 4).columns) == 4
    with pytest.raises(ValueError, match="n_fields"):
        gx.read_bed(p, 2)


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="d, \\"q\\"">
##INFO=<ID=AF,Number=A,Type=Float,Description="a">
##INFO=<ID=DB,Number=0,Type=Flag,Description="f">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t5\trs1;rs2\tA\tC,G\t9.5\tPASS\tDP=1;AF=0.5,.;DB\tGT:PL\t0/1:0,3,.\t.
1\t6\t.\tA\t.\t.\tq1;q2\t.\tGT\t1|1\t0/0
"""


def test_vcf_of_two_headers(gx, tmp_path):
    head = lambda *xs: "##fileformat=VCFv4.2\n" + "".join(f'##INFO=<ID={i},Number={n},Type={t},Description="d">\n' for i, n, t in xs) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (tmp_path / "a.vcf").write_text(head(("DP", "1", "Integer")) + "c\t1\t.\tA\tC\t.\t.\tDP=5\n")
    (tmp_path / "b.vcf").write_text(head(("DP", "1", "Float"), ("XX", "1", "Integer")) + "c\t2\t.\tA\tC\t.\t.\tDP=2.5;XX=7\n")
    got = sorted(tuple(r) for r in gx.read_vcf(str(tmp_path) + "/", parse_info=True).select("pos", "info.DP", "info.XX").collect())
    assert got == [(1, 5.0, None), (2, 2.5, 7)]


def test_sam_tags_of_any_record(gx, tmp_path):
    line = "{}\t0\tc\t1\t9\t2M\t*\t0\t0\tAC\tII{}\n"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + line.format("x", "\tNM:i:1") + line.format("y", "\tMD:Z:2\tNM:f:1.5"))
    got = {r.name: (r.NM, r.MD) for r in gx.read_sam(str(tmp_path / "a.sam"), parse_tags=True).select("name", "tags.*").collect()}
    assert got == {"x": (1.0, None), "y": (1.5, "2")}


def test_vcf(gx, tmp_path):
    p = write(tmp_path / "a.vcf", VCF)
    a, b = gx.read_vcf(p).collect()
    assert (a.chrom, a.pos, a.id, a.ref, a.alt, a.qual, a["filter"], a.info, a.formats) == ("1", 5, ["rs1", "rs2"], "A", ["C", "G"], 9.5, ["PASS"], "DP=1;AF=0.5,.;DB", "GT:PL\t0/1:0,3,.\t.")
    assert (b.id, b.alt, b.qual, b["filter"], b.info) == ([], None, None, ["q1", "q2"], None)
    gx.sql("SET x.vcf_parse_info = true")
    gx.sql("SET vcf_parse_formats = 'true'")
    a, b = gx.sql(f"SELECT * FROM vcf_scan('{p}')").collect()
    gx.sql("SET vcf_parse_info = false")
    gx.sql("SET vcf_parse_formats = false")
    assert (a.info.DP, a.info.AF, a.info.DB, b.info) == (1, [0.5, None], True, None)
    assert [(f.GT, f.PL) for f in a.formats] == [("0/1", [0, 3, None]), (None, None)]
    assert [f.GT for f in b.formats] == ["1|1", "0/0"]


def test_sam(gx, tmp_path):
    line = "r1\t99\tref1\t1\t255\t10M\t=\t5\t0\tCGAGCTCGGT\t!!!!!!!!!!\tNM:i:3\tba:B:c,-128,0,127\tbg:B:f,2.72,0,2997900032\tzz:Z:a:b\n"
    p = write(tmp_path / "a.sam", "@HD\tVN:1.6\n" + line + "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    a, b = gx.read_sam(p).collect()
    assert (a.name, a.flag, a.reference, a.start, a.end, a.mapping_quality, a.cigar, a.mate_reference, a.quality_score) == ("r1", 99, "ref1", 1, 10, None, "10M", "ref1", [0] * 10)
    assert [tuple(t) for t in a.tags] == [("NM", "3"), ("ba", "-128,0,127"), ("bg", "2.72, 0.00, 2997900032.00"), ("zz", "a:b")]
    assert (b.reference, b.start, b.end, b.cigar, b.sequence, b.quality_score, b.tags) == (None, None, None, "", "", [], [])
    t = gx.read_sam(p, parse_tags=True).select("tags.*").first()
    assert (t.NM, t.ba, t.zz) == (3, [-128, 0, 127], "a:b")


def test_hmmdomtab(gx, tmp_path):
    p = write(tmp_path / "a.hmmdomtab", "# c\n" + "\t".join(["t1", "-", "100", "q", "PF1", "50", "1e-5", "2.5", "0.1", "1", "2", "1e-3", "1e-4", "9.5", "0.0", "1", "2", "3", "4", "5", "6", "0.9", "some text"]) + "\n")
    r = gx.read_hmmdomtab(p).first()
    assert (r.target_name, r.tlen, r.evalue, r.ndom, r.env_to, r.accuracy, r.description) == ("t1", 100, 1e-5, 2, 6, 0.9, "some text")


GENBANK = """LOCUS       AB000001    12 bp    DNA     circular BCT 01-JAN-2020
DEFINITION  first part
            second part.
ACCESSION   AB000001
VERSION     AB000001.1
KEYWORDS    .
SOURCE      some bug
  ORGANISM  Some bug
COMMENT     hello
            world
FEATURES             Location/Qualifiers
     gene            1..6
                     /gene="abc"
                     /note="two
                     lines"
                     /pseudo
     CDS             join(1..2,
                     4..6)
ORIGIN
        1 acgtacgtac gt
//
"""


def test_genbank(gx, tmp_path):
    df = gx.read_genbank(write(tmp_path / "a.gb", GENBANK * 2))
    assert df.count() == 2 and len(df.columns) == 15
    r = df.first()
    assert (r.sequence, r.accession, r.definition, r.division, r.molecule_type, r.name, r.topology, r.date) == ("acgtacgtacgt", "AB000001", "first part second part.", "BCT", "DNA", "AB000001", "circular", "01-JAN-2020")
    assert r.comments == ["hello\nworld"] and r.source == "some bug"
    assert [(f.kind, f.location) for f in r.features] == [("gene", "1..6"), ("CDS", "join(1..2,4..6)")]
    assert [tuple(q) for q in r.features[0].qualifiers] == [("gene", "abc"), ("note", "two lines"), ("pseudo", None)]


def test_sdf(gx, tmp_path):
    mol = "name\n  Tool0206\n\n  2  1  0  0  0  0            999 V2000\n    0.0 0.0 0.0 C\n    0.0 0.0 0.0 O\n  1  2  1\nM  END\n"
    p = write(tmp_path / "a.sdf", mol + ">  <MELTING.POINT>\n12.5\n\n>  <TWO.LINE>\nA\nB\n\n$$$$\n" + mol + ">  <OTHER>\n1\n\n$$$$\n")
    a, b = gx.read_sdf(p).collect()
    assert (a.atom_count, a.bond_count, a.data["MELTING.POINT"], a.data["TWO.LINE"]) == (2, 1, "12.5", "AB")
    assert b.data["MELTING.POINT"] is None


def test_mzml(gx, tmp_path):
    def array(values, accession, fmt, packed):
        raw = struct.pack(f"<{len(values)}{fmt}", *values)
        data = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        kind = "MS:1000523" if fmt == "d" else "MS:1000521"
        zip_ = '<cvParam accession="MS:1000574" name="zlib compression" value=""/>' if packed else ""
        return f'<binaryDataArray><cvParam accession="{kind}" name="f" value=""/>{zip_}<cvParam accession="{accession}" name="a" value=""/><binary>{data}</binary></binaryDataArray>'

    one = (
        '<spectrum index="0" id="scan=1"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="2"/>'
        '<precursorList count="1"><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" name="m" value="445.5"/><cvParam accession="MS:1000041" name="c" value="2"/></selectedIon></selectedIonList></precursor></precursorList>'
        "<binaryDataArrayList count=\"2\">" + array([1.5, 200.25], "MS:1000514", "d", True) + array([3, 4], "MS:1000515", "f", False) + "</binaryDataArrayList></spectrum>"
    )
    p = write(tmp_path / "a.mzml", f'<?xml version="1.0"?><mzML><run><spectrumList count="2">\n{one}\n<spectrum id="scan=2"></spectrum>\n</spectrumList></run></mzML>')
    a, b = gx.read_mzml(p).collect()
    assert (a.id, a.mz.mz, a.intensity.intensity, a.wavelength, a.precursor_mz, a.precusor_charge) == ("scan=1", [1.5, 200.25], [3.0, 4.0], None, 445.5, 2)
    assert [tuple(c) for c in a.cv_params] == [("MS:1000511", "ms level", "2")]
    assert b.id == "scan=2" and b.mz is None and b.cv_params == []


def test_inference():
    assert schemas.infer_type("s3://b/x.vcf.gz") == ("vcf", "gzip") and schemas.infer_type("a.FNA") == ("fasta", None) and schemas.infer_type("a.bw")[0] == "bigwig_value"
    with pytest.raises(ValueError, match="no file type"):
        schemas.infer_type("a.txt")
    assert text.infer_tags(["AA:i", "BB:BC", "AA:Z", "CC:i", "DD:f", "DD:i", "BC:Bf", "BC:Bc"]) == [("AA", "string"), ("BB", "array<smallint>"), ("BC", "array<double>"), ("CC", "int"), ("DD", "double")]


def test_find(tmp_path):
    write(tmp_path / "k=1" / "a.bed", "")
    write(tmp_path / "k=1" / "_b.bed", "")
    write(tmp_path / "c.txt", "")
    assert [(f.path.rsplit("/", 1)[1], f.partitions) for f in files.find(str(tmp_path) + "/", [".bed"])] == [("a.bed", (("k", "1"),))]
    with pytest.raises(FileNotFoundError):
        files.find(str(tmp_path / "no"))
