"""The relational surface: one query per capability, as DataFrame code or Spark SQL, each over its whole tables.

``STATEMENTS`` are texts that both Spark and the oracle run; ``{name}`` stands for a table.  ``PAIRS`` hold a builder and the oracle's
text where the two dialects differ or the DataFrame API is what is shown.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions import alignment, massspec, sequence, variant
from helixlake.plans import joins
from helixlake.runtime import broadcast_if_small, scratch, table

Query = Callable[[SparkSession, str], DataFrame]

STATEMENTS: dict[str, str] = {
    "filter_predicates": """SELECT p_partkey, p_name, p_brand, p_size FROM {part}
        WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') OR p_name LIKE '%a%' AND p_type ILIKE 'S%' AND p_retailprice IS NOT NULL""",
    "project_case": """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band,
        coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, CAST(floor(o_totalprice) AS BIGINT) AS whole FROM {orders}""",
    "join_inner": "SELECT c.c_custkey, n.n_name, r.r_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT s.s_suppkey, n.n_nationkey, n.n_name FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey",
    "join_full": "SELECT c.c_custkey, s.s_suppkey, coalesce(c.c_nationkey, s.s_nationkey) AS nationkey FROM {customer} c FULL JOIN {supplier} s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey",
    "join_semi": "SELECT o_orderkey, o_custkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "not_in_with_nulls": "SELECT feature_id FROM {gtf_features} WHERE start_pos NOT IN (SELECT end_pos FROM {gtf_features} WHERE end_pos IS NOT NULL) OR start_pos NOT IN (SELECT end_pos FROM {gtf_features})",
    "try_casts": "SELECT variant_id, TRY_CAST(split_part(ref_allele, 'T', 1) AS BIGINT) AS none, TRY_CAST(CAST(pos AS VARCHAR(20)) AS BIGINT) AS some, TRY_CAST(info AS DOUBLE) AS x FROM {variants}",
    "regexp_matching": "SELECT read_id, regexp_like(cigar, '^[0-9]+M$') AS plain, regexp_like(name, '#[ACGT]+/[12]$') AS decorated FROM {reads}",
    "join_in_subquery": "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 49)",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "aggregate_groups": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_quantity) AS n_quantity, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
        min(l_discount) AS min_discount, max(l_tax) AS max_tax, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 4) AS r,
        round(covar_pop(l_quantity, l_discount), 4) AS cv, bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.05) AS any_discount FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
    "aggregate_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} GROUP BY event_type",
    "aggregate_filter_having": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS n, round(sum(value) FILTER (WHERE value > 0), 4) AS positive FROM {events} GROUP BY user_id HAVING count(*) > 10",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "grouping_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_rollup": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM {orders} GROUP BY ROLLUP (CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT))",
    "median_percentile": "SELECT event_type, round(median(value), 6) AS med FROM {events} GROUP BY event_type",
    "window_ranks": """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS rk,
        CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quartile, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "window_offsets": """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first_id,
        last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, nth_value(event_id, 3) OVER w AS third
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "window_frames": """SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
        round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS moving,
        count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM {lineitem}""",
    "topk_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}) t WHERE rn <= 3",
    "sort_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 100 OFFSET 10",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT l_quantity AS k FROM {lineitem} EXCEPT SELECT CAST(p_size AS DOUBLE) FROM {part} WHERE p_size < 40",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "subquery_scalar": "SELECT p_partkey, p_retailprice FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})",
    "subquery_correlated": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.2 FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "cte": """WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM spent WHERE total > 300000)
        SELECT c.c_custkey, c.c_mktsegment, t.total FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey""",
    "string_functions": """SELECT c_custkey, upper(c_name) AS up, substr(c_name, 1, 4) AS head, lpad(CAST(c_custkey AS VARCHAR(20)), 10, '0') AS padded, replace(c_mktsegment, 'U', 'u') AS repl,
        regexp_replace(c_name, '[0-9]+', '#') AS masked, concat_ws('-', c_mktsegment, c_name) AS joined, reverse(c_name) AS rev, translate(c_name, 'Cust', 'cUST') AS tr, trim(c_name) AS tm,
        CAST(length(c_mktsegment) AS BIGINT) AS len, split_part(c_name, '#', 2) AS part2 FROM {customer}""",
    "text_lengths": "SELECT doc_id, length(text) AS chars, octet_length(encode(text, 'utf-8')) AS bytes, length(text) - length(replace(text, ' ', '')) AS blanks FROM {documents}",
    "date_functions": """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_trunc('month', o_orderdate) AS month_start,
        CAST(o_orderdate AS DATE) AS day_only, o_orderdate + INTERVAL '7' DAY AS week_later FROM {orders}""",
    "math_functions": """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS dist, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_quantity) AS BIGINT) AS ce, round(sqrt(l_quantity), 8) AS root, round(ln(l_quantity + 1), 8) AS logn,
        round(power(l_quantity, 1.5), 6) AS pw, l_orderkey % 7 AS md, greatest(l_quantity, 25.0) AS gr, least(l_quantity, 25.0) AS le, l_orderkey & 15 AS low_bits, CAST(sign(l_discount - 0.05) AS INTEGER) AS sg FROM {lineitem}""",
    "skewed_top_users": "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "values_table": "SELECT a.k, a.v, n.n_name FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) AS a(k, v) JOIN {nation} n ON n.n_nationkey = a.k",
    "gff_containment": """SELECT a.feature_id AS outer_id, b.feature_id AS inner_id, a.seqname, a.start_pos, b.start_pos AS inner_start FROM {gtf_features} a JOIN {gtf_features} b
        ON a.seqname = b.seqname AND a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos WHERE a.feature_type = 'transcript' AND b.feature_type = 'CDS'
        ORDER BY a.seqname NULLS LAST, a.start_pos NULLS LAST, b.start_pos NULLS LAST, a.feature_id, b.feature_id LIMIT 10""",
}


def _statement(text: str) -> Query:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, d, n) for n in names})

    return run


def _bare(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


# ---- DataFrame builders -----------------------------------------------------------------------------------------------------------


def join_strategies(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, n) for n in ("orders", "customer", "nation"))
    merged = orders.hint("merge").join(customer, orders.o_custkey == customer.c_custkey)
    hashed = merged.join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return hashed.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "gtf_features").where("start_pos <= end_pos")
    spans = f.where("feature_type = 'transcript'").select("seqname", "feature_id", "start_pos", "end_pos")
    cds = f.where("feature_type = 'CDS'").select("seqname", F.col("feature_id").alias("cds_id"), F.col("start_pos").alias("cds_start"), F.col("end_pos").alias("cds_end"))
    return joins.interval_join(spans, cds, "seqname", ("start_pos", "end_pos"), ("cds_start", "cds_end")).select("seqname", "feature_id", "cds_id")


def interval_containment_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "gtf_features").where("start_pos <= end_pos")
    outer = f.where("feature_type = 'transcript'").select("seqname", F.col("feature_id").alias("outer_id"), "start_pos", "end_pos")
    inner = f.where("feature_type = 'CDS'").select("seqname", F.col("feature_id").alias("inner_id"), F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    return joins.interval_join(outer, inner, "seqname", ("start_pos", "end_pos"), ("s", "e"), mode="contains").select("seqname", "outer_id", "inner_id")


def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.max("n_nationkey").alias("top"))


def approximations(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximations lie within their bounds of the exact figures: 5 % standard deviation, three of them and three users; one rank in a hundred."""
    e = table(spark, d, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("users"), F.count_distinct("user_id").alias("n"), F.percentile_approx("value", 0.5).alias("median"), F.percentile("value", F.array(F.lit(0.49), F.lit(0.51))).alias("near")
    )
    return e.select("event_type", (F.abs(F.col("users") - F.col("n")) <= 0.15 * F.col("n") + 3).alias("users_near"), F.col("median").between(F.col("near")[0], F.col("near")[1]).alias("median_near"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows to JSON text and back, and single fields by path."""
    s = table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct("s_name", "s_nationkey", F.array("s_nationkey", "s_suppkey").alias("l"))).alias("j"))
    parsed = F.from_json("j", "s_name string, s_nationkey bigint, l array<bigint>")
    return s.select("s_suppkey", parsed["s_name"].alias("name"), parsed["l"][1].alias("second"), F.get_json_object("j", "$.s_nationkey").cast("bigint").alias("nation"), F.get_json_object("j", "$.none").alias("none"))


def unnest_positions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("x"))


def higher_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        "vec_id",
        F.size("embedding").alias("dim"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"),
        F.round(F.aggregate(doubles, F.lit(0.0).cast("double"), lambda a, x: a + x * x), 6).alias("norm2"),
        F.round(F.aggregate(F.zip_with(doubles, F.reverse(doubles), lambda a, b: a * b), F.lit(0.0).cast("double"), lambda a, x: a + x), 6).alias("self_reverse"),
        F.round(F.element_at(doubles, 1), 6).alias("first"),
    )


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.length("props").alias("size"), F.json_object_keys("props").alias("keys")).select("event_id", "size", F.array_join(F.array_sort("keys"), ",").alias("keys"))


def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    from helixlake.streaming.events import tumbling

    return tumbling(table(spark, d, "events"), "1 hour")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events less than 30 minutes apart."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) >= 1_800_000_000).cast("int"), F.lit(1))
    marked = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))


def write_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Nation through Parquet, CSV and JSON files, counted per format."""
    import uuid

    n, base = table(spark, d, "nation"), scratch(spark, f"formats-{uuid.uuid4().hex}")
    n.write.parquet(f"{base}/p")
    n.write.option("header", True).csv(f"{base}/c")
    n.write.json(f"{base}/j")
    schema = n.schema
    frames = [("parquet", spark.read.schema(schema).parquet(f"{base}/p")), ("csv", spark.read.schema(schema).option("header", True).csv(f"{base}/c")), ("json", spark.read.schema(schema).json(f"{base}/j"))]
    out = [f.select(F.lit(name).alias("format"), "n_nationkey", "n_name", "n_regionkey") for name, f in frames]
    return out[0].unionAll(out[1]).unionAll(out[2])


def sequence_functions(spark: SparkSession, d: str) -> DataFrame:
    seq = F.regexp_replace("sequence", "[^A-Za-z]", "")
    c = table(spark, d, "contigs").select("contig_id", seq.alias("s"))
    return c.select("contig_id", F.md5(sequence.reverse_complement("s")).alias("rc"), F.round(sequence.gc_content("s").cast("double"), 6).alias("gc"), F.length(sequence.trim_polya("s")).cast("long").alias("trimmed"))


def quality_round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").select("read_id", sequence.quality_scores_to_string(F.col("quality_score").cast("array<int>")).alias("q"))
    return r.select("read_id", "q", F.array_join(sequence.quality_scores_to_list("q").cast("array<string>"), ",").alias("scores"))


def integer_encodings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.array_join(sequence.integer_encoding("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("array<string>"), ",", "null").alias("codes"))


def sam_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").select("read_id", *[alignment.has_flag("flag", n).alias(n) for n in alignment.FLAGS])


def alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").select("variant_id", sequence.alignment_score("ref_allele", F.array_join("alt_alleles", "")).alias("score"))


def motif_locations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").where("sequence IS NOT NULL")
    return r.select("read_id", F.explode(sequence.locate_regex("sequence", "CC[AT]TGG"))).select("read_id", F.col("col.start").alias("start_at"), F.col("col.end").alias("end_at"), F.col("col.match").alias("motif"))


def region_predicates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "variants").where("chrom IS NOT NULL AND pos IS NOT NULL")
    return v.select(
        "variant_id", variant.region_match("chrom", "pos", "chr5:100000-900000").alias("in_region"), variant.interval_match("pos", "1-500000").alias("in_interval"), variant.chrom_match("chrom", "chr5").alias("on_chrom")
    )


def region_filter_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants").where(variant.point_filter("chr5:100000-900000", "chrom", "pos")).select("variant_id", "chrom", "pos")


def region_filter_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").where(variant.overlap_filter("chr5:100000-900000", "reference", "start_pos", "end_pos")).select("read_id")


def spectrum_peaks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spectra")
    binned = massspec.bin_vectors("mz.mz", "intensity.intensity", 100.0, 8, 250.0)
    return s.select("spectrum_key", massspec.contains_peak("mz.mz", 500.0, 5.0).alias("has_peak"), F.array_join(F.transform(binned, lambda x: F.round(x).cast("long").cast("string")), ",").alias("bins"))


def cigar_ends(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").withColumn("cigar", F.nullif("cigar", F.lit("*")))
    return r.select("read_id", (F.col("start_pos") + alignment.cigar_reference_length("cigar") - 1).alias("last_pos"))


_OVERLAP = """SELECT a.seqname, a.feature_id, b.feature_id AS cds_id FROM gtf_features a JOIN gtf_features b ON a.seqname = b.seqname AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
    WHERE a.feature_type = 'transcript' AND b.feature_type = 'CDS' AND a.start_pos <= a.end_pos AND b.start_pos <= b.end_pos"""
_CONTAIN = """SELECT a.seqname, a.feature_id AS outer_id, b.feature_id AS inner_id FROM gtf_features a JOIN gtf_features b ON a.seqname = b.seqname AND a.start_pos <= b.start_pos AND a.end_pos >= b.end_pos
    WHERE a.feature_type = 'transcript' AND b.feature_type = 'CDS' AND a.start_pos <= a.end_pos AND b.start_pos <= b.end_pos"""
_LETTERS = "regexp_replace(sequence, '[^A-Za-z]', '', 'g')"
_FLAGS = ", ".join(f"(flag & {m}) = {m} AS {n}" for n, m in alignment.FLAGS.items())

PAIRS: dict[str, tuple[Query, str | None]] = {
    "join_strategies": (join_strategies, "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "interval_overlap_join": (interval_overlap_join, _OVERLAP),
    "interval_containment_join": (interval_containment_join, _CONTAIN),
    "ordered_lists": (ordered_lists, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, max(n_nationkey) AS top FROM nation GROUP BY n_regionkey"),
    "approximations": (approximations, "SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY event_type"),
    "json_round_trip": (json_round_trip, "SELECT s_suppkey, s_name AS name, s_suppkey AS second, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS none FROM supplier"),
    "unnest_positions": (unnest_positions, "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"),
    "higher_order": (
        higher_order,
        """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2,
        round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS self_reverse,
        round(CAST(embedding[1] AS DOUBLE), 6) AS "first" FROM embeddings""",
    ),
    "json_fields": (json_fields, "SELECT event_id, CAST(length(props) AS INTEGER) AS size, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events"),
    "pivot_status": (pivot_status, "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY l_returnflag"),
    "tumbling_windows": (tumbling_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "session_windows": (
        session_windows,
        """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
        SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started FROM s GROUP BY user_id, session""",
    ),
    "write_read_back": (write_read_back, "SELECT f.format, n_nationkey, n_name, n_regionkey FROM nation CROSS JOIN (VALUES ('parquet'), ('csv'), ('json')) AS f(format)"),
    "sequence_functions": (
        sequence_functions,
        f"""SELECT contig_id, md5(translate(reverse(s), 'ATCGatcg', 'TAGCtagc')) AS rc, round(CAST(CAST(length(regexp_replace(s, '[^GC]', '', 'g')) / strlen(s) AS FLOAT) AS DOUBLE), 6) AS gc,
        length(regexp_replace(s, '[Aa]+$', '')) AS trimmed FROM (SELECT contig_id, {_LETTERS} AS s FROM contigs)""",
    ),
    "quality_round_trip": (
        quality_round_trip,
        "SELECT read_id, array_to_string(list_transform(quality_score, lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS q, array_to_string(coalesce(quality_score, []), ',') AS scores FROM reads",
    ),
    "integer_encodings": (integer_encodings, "SELECT c_custkey, array_to_string(list_transform(string_split(c_mktsegment, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 65 AS VARCHAR) ELSE 'null' END), ',') AS codes FROM customer"),
    "sam_flags": (sam_flags, f"SELECT read_id, {_FLAGS} FROM reads"),
    "alignment_scores": (alignment_scores, None),
    # The motif can't overlap itself, so every place where it stands is a match.
    "motif_locations": (
        motif_locations,
        """SELECT read_id, CAST(i AS INTEGER) AS start_at, CAST(i + 6 AS INTEGER) AS end_at, substr(sequence, i, 6) AS motif
        FROM (SELECT read_id, sequence, unnest(range(1, length(sequence) - 4)) AS i FROM reads WHERE sequence IS NOT NULL) WHERE regexp_full_match(substr(sequence, i, 6), 'CC[AT]TGG')""",
    ),
    "region_predicates": (region_predicates, "SELECT variant_id, chrom = 'chr5' AND pos BETWEEN 100000 AND 900000 AS in_region, pos BETWEEN 1 AND 500000 AS in_interval, chrom = 'chr5' AS on_chrom FROM variants WHERE chrom IS NOT NULL AND pos IS NOT NULL"),
    "region_filter_points": (region_filter_points, "SELECT variant_id, chrom, pos FROM variants WHERE chrom = 'chr5' AND pos BETWEEN 100000 AND 900000"),
    "region_filter_overlaps": (region_filter_overlaps, "SELECT read_id FROM reads WHERE reference = 'chr5' AND start_pos <= 900000 AND end_pos >= 100000"),
    "spectrum_peaks": (
        spectrum_peaks,
        """SELECT spectrum_key, CASE WHEN mz.mz IS NULL THEN NULL ELSE coalesce(list_bool_or(list_transform(mz.mz, lambda m: coalesce(abs(m - 500.0) < 5.0, false))), false) END AS has_peak,
        CASE WHEN mz.mz IS NULL OR intensity.intensity IS NULL THEN NULL ELSE array_to_string(list_transform(range(8), lambda k: CAST(CAST(round(coalesce(list_sum(list_transform(
        list_filter(list_zip(mz.mz, intensity.intensity), lambda p: floor((p[1] - 100.0) / 250.0) = k AND p[2] IS NOT NULL), lambda p: p[2])), 0)) AS BIGINT) AS VARCHAR)), ',') END AS bins FROM spectra""",
    ),
    "cigar_ends": (
        cigar_ends,
        "SELECT read_id, start_pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) - 1 AS last_pos FROM (SELECT read_id, start_pos, nullif(cigar, '*') AS cigar FROM reads)",
    ),
}

_DUCK_ONLY = {
    "text_lengths": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS blanks FROM documents",
    "regexp_matching": STATEMENTS["regexp_matching"].replace("regexp_like", "regexp_matches"),
    "string_functions": STATEMENTS["string_functions"].replace("'[0-9]+', '#')", "'[0-9]+', '#', 'g')"),
}

QUERIES: dict[str, Query] = {k: _statement(t) for k, t in STATEMENTS.items()} | {k: q for k, (q, _) in PAIRS.items()}
SQL: dict[str, str] = {k: _bare(_DUCK_ONLY.get(k, t)) for k, t in STATEMENTS.items()} | {k: t for k, (_, t) in PAIRS.items() if t}
