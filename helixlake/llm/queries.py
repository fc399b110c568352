"""Registered queries of the llm operators; ``SQL`` holds the oracles that are expressible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import abuse, fusion, leakage, mixing, splitting
from helixlake.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "reads")).select("read_id")


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "reads"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found_gaps(table(spark, d, "contigs"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "contigs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.clean(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _mail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "review_labels"), table(spark, d, "abuse_terms")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(*_mail(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.document_scores(*_mail(spark, d))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(*_mail(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_fused, p3_found, p3_pieces, p8_found, p8_clean, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}
_LETTERS = "regexp_replace(sequence, '[^A-Za-z]', '', 'g')"
_CLIP = "list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '{pattern}'), '[0-9]+'), lambda x: CAST(x AS BIGINT)))"
_LEAD, _TRAIL = _CLIP.format(pattern="^([0-9]+[HS])+"), _CLIP.format(pattern="([0-9]+[HS])+$")
SQL: dict[str, str] = {
    "p2_found": f"""
WITH RECURSIVE k AS (
  SELECT read_id, regexp_replace(trim(name), '(#[A-Za-z0-9+_-]*)?(/[0-9])?([ \\t].*)?$', '') || '|' || (flag & 192) AS nk,
    CASE WHEN reference IS NOT NULL AND start_pos IS NOT NULL AND cigar <> '*' THEN regexp_replace(lower(trim(reference)), '^chr', '') || CASE WHEN flag & 16 = 0 THEN '+' || (start_pos - coalesce({_LEAD}, 0))
      ELSE '-' || (start_pos + list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) - 1 + coalesce({_TRAIL}, 0)) END END AS pk,
    CAST(reference IS NOT NULL AS INTEGER) + CAST(start_pos IS NOT NULL AS INTEGER) + CAST(cigar <> '*' AS INTEGER) + CAST(coalesce(len(quality_score), 0) > 0 AS INTEGER) AS present,
    coalesce(list_sum(quality_score), 0) AS total, ingested_at FROM reads WHERE flag & 2304 = 0),
e AS (SELECT a.read_id AS x, b.read_id AS y FROM k a JOIN k b ON a.nk = b.nk UNION SELECT a.read_id, b.read_id FROM k a JOIN k b ON a.pk = b.pk),
reach AS (SELECT read_id AS a, read_id AS b FROM k UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b),
g AS (SELECT a, min(b) AS grp, count(*) AS n FROM reach GROUP BY a)
SELECT arg_max(read_id, row(present, total, ingested_at, -read_id)) AS read_id FROM k JOIN g ON g.a = k.read_id WHERE n > 1 GROUP BY grp""",
    "p3_found": f"""
WITH s AS (SELECT contig_id, {_LETTERS} AS s, CASE WHEN mol_type = 'protein' THEN '[Xx]{{10,}}' ELSE '[Nn]{{10,}}' END AS run FROM contigs),
l AS (SELECT contig_id, s, string_split_regex(s, run) AS parts, regexp_extract_all(s, run) AS gaps FROM s WHERE length(s) > 6000),
g AS (SELECT contig_id, length(s) AS n, parts, gaps, unnest(range(1, len(gaps) + 1)) AS i FROM l),
f AS (SELECT contig_id, n, 1 + length(array_to_string(parts[1:i], '')) + length(array_to_string(gaps[1:i - 1], '')) AS gap_start, length(gaps[i]) AS size FROM g),
inner_gaps AS (SELECT contig_id, CAST(gap_start AS BIGINT) AS gap_start FROM f WHERE gap_start > 1 AND gap_start + size <= n)
SELECT * FROM inner_gaps UNION ALL SELECT contig_id, CAST(0 AS BIGINT) FROM l WHERE contig_id NOT IN (SELECT contig_id FROM inner_gaps)""",
}
