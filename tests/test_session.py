import gzip

import pytest
from pyspark.sql import functions as F

from helixlake.plans import statements
from helixlake.plans.region import Interval, Region, parse_interval


def test_region():
    assert Region.parse("chr1") == Region("chr1") and Region.parse("chr1:5") == Region("chr1", Interval(5)) and Region.parse("chr1:1,000-2,000").interval == (1000, 2000)
    assert parse_interval("3-9") == (3, 9) and parse_interval("3-") == (3, None)
    for bad in ("", ":1-2", "c:5-4", "c:0-4"):
        with pytest.raises(ValueError):
            Region.parse(bad)
    assert Interval(1, 5).intersect(Interval(3)) == (3, 5) and Interval(1, 2).intersect(Interval(3)) is None
    assert Region("a").intersect(Region("b")) is None and str(Region("a", Interval(2, 5))) == "a:2-5" and str(Region("a")) == "a"
    assert Interval(3, 5).overlaps(5, 9) and not Interval(3, 5).overlaps(6, 9) and Interval().contains(7)


def test_statements():
    c = statements.parse("CREATE EXTERNAL TABLE t STORED AS FASTA OPTIONS (file_extension 'fa', 'format.compression' 'gzip') LOCATION 'it''s.fa'")
    assert c == statements.Create("t", "fasta", "it's.fa", {"file_extension": "fa", "compression": "gzip"})
    c = statements.parse("create external table if not exists t stored as bigwig_zoom location 'x' options (reduction_level 400)")
    assert c.options == {"reduction_level": "400"} and c.location == "x"
    c = statements.parse("COPY (SELECT ')' AS id) TO 'o.fasta' STORED AS FASTA OPTIONS (compression 'gzip')")
    assert (c.source, c.path, c.kind, c.options) == ("SELECT ')' AS id", "o.fasta", "fasta", {"compression": "gzip"})
    assert statements.parse("SELECT 1") is None and statements.parse("DROP TABLE IF EXISTS t;") == ("drop", "t", "quiet")
    with pytest.raises(ValueError, match="LOCATION"):
        statements.parse("CREATE EXTERNAL TABLE t STORED AS FASTA")
    view = lambda kind, args: f"<{kind}:{','.join(args)}>"
    assert statements.rewrite("SELECT 'make_array(1)', make_array(1) FROM fasta_scan('a', 'gzip') x", view) == "SELECT 'make_array(1)', array(1) FROM <fasta:a,gzip> x"
    assert statements.rewrite("vcf_region_filter('1', chrom) AND vcf_region_filter('1')", view) == "vcf_region_filter('1', chrom) AND vcf_region_filter('1', chrom, pos)"
    assert statements.rewrite("bam_region_filter('1:2-3', b.reference) AND x", view) == "bam_region_filter('1:2-3', b.reference, b.start, b.`end`) AND x"


def test_region_functions_in_plain_sql(gx, spark):
    """The registered names work without the session's wrapper and agree with the Column forms."""
    from helixlake.functions import variant

    df = spark.createDataFrame([("chr1", 5), ("chr1", 15_000), ("HLA-A*01:01", 7), (None, 5), ("chr1", None), ("chr2", 5)], "chrom string, pos bigint")
    df.createOrReplaceTempView("sites")
    for region in ("chr1", "chr1:5", "chr1:10,000-20,000", "chr1:1-5", "{HLA-A*01:01}", "{HLA-A*01:01}:1-7", "{HLA-A*01:01}:8-9", "chr9"):
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(spark.sql(f"SELECT * FROM sites WHERE vcf_region_filter('{region}', chrom, pos)"), df.where(variant.point_filter(region, "chrom", "pos"))), region
        assert same(spark.sql(f"SELECT * FROM sites WHERE gff_region_filter('{region}', chrom)"), df.where(variant.point_filter(region, "chrom"))), region
        assert same(spark.sql(f"SELECT * FROM sites WHERE bam_region_filter('{region}', chrom, pos, pos + 2)"), df.where(variant.overlap_filter(region, "chrom", "pos", F.col("pos") + 2))), region
        assert same(spark.sql(f"SELECT * FROM sites WHERE chrom IS NOT NULL AND pos IS NOT NULL AND region_match(chrom, pos, '{region}')"), df.where(variant.point_filter(region, "chrom", "pos")))
    with pytest.raises(Exception, match="not a region"):
        spark.sql("SELECT vcf_region_filter(':1-2', chrom) FROM sites").collect()


def test_columns_of():
    ask = lambda q: statements.columns_of(q, "t", ["flag", "name", "reference", "start", "end"])
    assert ask("SELECT name FROM t WHERE flag = 1") == ["flag", "name"] and ask("SELECT count(*) FROM t") == ["flag"] and ask("SELECT * FROM t") is None
    assert ask("SELECT count(*) FROM t WHERE bam_region_filter('c', reference)") == ["reference", "start", "end"] and ask("SELECT name FROM t JOIN u") is None
    assert ask("SELECT 'name' AS x, flag FROM t") == ["flag"] and ask("SELECT name FROM (SELECT * FROM t)") is None


def test_copy_refuses_and_counts(gx, tmp_path):
    assert gx.sql(f"COPY (SELECT id FROM range(7)) TO '{tmp_path}/x' STORED AS PARQUET").first()["count"] == 7
    with pytest.raises(Exception, match="EXISTS"):
        gx.sql(f"COPY (SELECT id FROM range(7)) TO '{tmp_path}/x' STORED AS PARQUET")


def test_copy_joins_parts(gx, spark, tmp_path):
    """A single file comes from parts that are written in parallel, in the order of the query."""
    df = spark.range(0, 1000, 1, 7).selectExpr("cast(id AS string) AS id", "null AS description", "repeat('AC', cast(id % 5 AS int)) AS sequence")
    df.createOrReplaceTempView("many")
    gx.sql(f"COPY many TO '{tmp_path}/a.fasta' STORED AS FASTA")
    gx.sql(f"COPY many TO '{tmp_path}/a.fasta.gz' STORED AS FASTA OPTIONS (compression gzip)")
    text = "".join(f">{i}\n{'AC' * (i % 5)}\n" for i in range(1000))
    assert (tmp_path / "a.fasta").read_text() == text and gzip.decompress((tmp_path / "a.fasta.gz").read_bytes()).decode() == text


def test_prunable():
    ask = lambda q, keys=("s",): statements.prunable(q, "t", list(keys))
    assert ask("SELECT a FROM t WHERE vcf_region_filter('1:2-3', chrom, pos) = true AND s = '4' AND b > 1 ORDER BY a") == ("1:2-3", {"s": "4"})
    assert ask("SELECT a FROM t AS x WHERE x.s = 7;") == (None, {"s": "7"}) and ask("select count(*) from t where bam_region_filter('c', r)") == ("c", {})
    for q in ("WHERE a = 1 OR vcf_region_filter('1', c)", "JOIN u ON true WHERE vcf_region_filter('1', c)", "WHERE NOT vcf_region_filter('1', c)", "WHERE vcf_region_filter('1', c) UNION SELECT 1 FROM t"):
        assert ask("SELECT a FROM t " + q) is None
    assert ask("SELECT a FROM t WHERE vcf_region_filter('1', c) = false") == (None, {}) and ask("SELECT vcf_region_filter('1', c) FROM t WHERE a = 1") == (None, {})
    assert ask("SELECT a FROM t WHERE b = 'x AND s = 5'") == (None, {}) and ask("SELECT a FROM tt WHERE s = 1") is None and ask("SELECT a FROM t WHERE f(b AND s = 1 AND c)") == (None, {})


def test_tables_and_copy(gx, tmp_path):
    src = tmp_path / "a.fasta"
    src.write_text(">a d1\nATCG\n>b\nGG\n")
    gx.sql(f"CREATE EXTERNAL TABLE fa STORED AS FASTA LOCATION '{src}'")
    assert gx.sql("SELECT count(*) AS n FROM fa").first().n == 2
    assert gx.sql("SELECT array_length(make_array(1, 2)) AS n, array_element(make_array(5), 1) AS e").first() == (2, 5)
    out = tmp_path / "out.fasta"
    assert gx.sql(f"COPY (SELECT id, description, sequence FROM fa ORDER BY id) TO '{out}' STORED AS FASTA").first()["count"] == out.stat().st_size
    assert out.read_text() == ">a d1\nATCG\n>b\nGG\n"
    gz = tmp_path / "out.fasta.gz"
    gx.sql(f"COPY fa TO '{gz}' STORED AS FASTA OPTIONS (compression 'gzip')")
    assert gzip.decompress(gz.read_bytes()).decode() == out.read_text()
    fq = tmp_path / "o.fastq"
    gx.sql(f"COPY (SELECT 'n' AS name, CAST(null AS STRING) AS description, 'AC' AS sequence, '!!' AS quality_scores) TO '{fq}' STORED AS FASTQ")
    assert fq.read_text() == "@n\nAC\n+\n!!\n" and gx.read_fastq(str(fq)).first().description is None
    pq = tmp_path / "o.parquet"
    assert gx.sql(f"COPY fa TO '{pq}'").first()["count"] == 2 and gx.read_table(str(pq)).count() == 2
    with pytest.raises(ValueError, match="cannot write"):
        gx.sql(f"COPY fa TO '{tmp_path / 'x.vcf'}' STORED AS VCF")
    with pytest.raises(ValueError, match="needs the columns"):
        gx.sql(f"COPY (SELECT 1 AS id) TO '{tmp_path / 'x.fa'}' STORED AS FASTA")
    empty = tmp_path / "e.fasta"
    gx.sql(f"COPY (SELECT * FROM fa WHERE id = 'zz') TO '{empty}' STORED AS FASTA")
    assert empty.exists() and empty.read_text() == ""
    gx.sql("DROP TABLE fa")
    with pytest.raises(Exception, match="fa"):
        gx.sql("SELECT * FROM fa").collect()
    with pytest.raises(ValueError, match="unknown file type"):
        gx.sql("CREATE EXTERNAL TABLE q STORED AS NOPE LOCATION 'x'")


def test_register_folder(gx, tmp_path):
    (tmp_path / "one.bed").write_text("chr1\t1\t2\n")
    (tmp_path / "two.fasta").write_text(">a\nA\n")
    (tmp_path / "note.txt").write_text("")
    assert sorted(gx.register_folder(str(tmp_path))) == ["one", "two"]
    assert gx.sql("SELECT count(*) AS n FROM one").first().n == 1


def test_information_schema_and_arrow(gx):
    gx.spark.range(3).createOrReplaceTempView("three")
    assert gx.sql("SELECT table_type FROM information_schema.tables WHERE table_name = 'three'").first()[0] == "VIEW"
    assert gx.to_arrow("SELECT id FROM three").num_rows == 3


def test_sql_functions(gx):
    one = lambda q: gx.sql("SELECT " + q).first()[0]
    assert one("reverse_complement('ATCGn')") == "nCGAT" and one("trim_polya('ATCGAAaa')") == "ATCG" and one("gc_content('ATCG')") == 0.5
    assert [one(f"alignment_score('ATCG', '{b}')") for b in ("ATCG", "AG", "ATCGG")] == [4, 1, 4] and one("alignment_score('AAA', 'ATCG')") == 1
    assert [tuple(m) for m in one("locate_regex('agctggagctacc', 'a[atcg]c')")] == [(1, 4, "agc"), (7, 10, "agc"), (11, 14, "acc")]
    assert one("integer_encoding('ATCG', 'ATCG')") == [0, 1, 2, 3] and one("quality_scores_to_list('###')") == [2, 2, 2] and one("quality_scores_to_string(array(3, 2, 3))") == "$#$"
    assert one("bin_vectors(array(1D, 2D, 3D), array(1D, 2D, 3D), 1D, 3, 1D)") == [1, 2, 3] and one("contains_peak(array(199.5D), 200D, 1D)")
    rows = gx.sql("SELECT region_match(c, p, '1:1-1') AS r, interval_match(p, '1-1') AS i, chrom_match(c, '1') AS m FROM VALUES ('1', 1), ('1', 1), ('1', 2), ('2', 2), ('2', 3) t(c, p)").collect()
    assert [r.r for r in rows] == [True, True, False, False, False] and [r.i for r in rows] == [True, True, False, False, False] and [r.m for r in rows] == [True, True, True, False, False]
    assert one("interval_match(CAST(null AS BIGINT), '1-2')") is False
    with pytest.raises(Exception, match="null chromosome"):
        one("region_match(CAST(null AS STRING), 1, '1')")
