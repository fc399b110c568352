"""SQL names of the functions.  Native ones are temporary SQL functions, which Catalyst inlines into the plan and pushes down."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.functions.alignment import FLAGS
from helixlake.functions.massspec import bin_udf
from helixlake.plans.region import PATTERN
from helixlake.functions.sequence import MATCHES, find_all, local_score

# Parts of the text ``region`` by the pattern of ``Region``; Catalyst folds them where the text is a literal.
_PART = lambda k: f"regexp_extract(trim(region), r'{PATTERN}', {k})"
_NAME = f"coalesce(nullif({_PART(1)}, ''), nullif({_PART(2)}, ''), cast(raise_error(concat('not a region: ', region)) AS STRING))"
_START = f"coalesce(cast(nullif(replace({_PART(3)}, ',', ''), '') AS BIGINT), 1L)"
_END = f"coalesce(cast(nullif(replace({_PART(4)}, ',', ''), '') AS BIGINT), 9223372036854775807L)"
#: A position that isn't given: filters of names only.
_NONE = "-9223372036854775807L"
_LOW = "cast(split_part(span, '-', 1) AS BIGINT)"
_HIGH = "coalesce(try_cast(split_part(span, '-', 2) AS BIGINT), 9223372036854775807L)"

#: Name, parameters, return type, body.
NATIVE: list[tuple[str, str, str, str]] = [
    ("reverse_complement", "s STRING", "STRING", "translate(reverse(s), 'ATCGatcg', 'TAGCtagc')"),
    ("gc_content", "s STRING", "FLOAT", "if(octet_length(s) = 0, float('NaN'), cast(regexp_count(s, '[GC]') / nullif(octet_length(s), 0) AS FLOAT))"),
    ("trim_polya", "s STRING", "STRING", r"regexp_replace(s, '[Aa]+\\z', '')"),
    ("quality_scores_to_list", "s STRING", "ARRAY<INT>", "transform(filter(split(coalesce(s, ''), ''), c -> c <> ''), c -> ascii(c) - 33)"),
    ("quality_scores_to_string", "a ARRAY<INT>", "STRING", "array_join(transform(a, x -> char(x + 33)), '')"),
    (
        "integer_encoding", "s STRING, alphabet STRING", "ARRAY<SMALLINT>",
        "transform(filter(split(s, ''), c -> c <> ''), c -> if(instr(reverse(alphabet), c) > 0, cast(length(alphabet) - instr(reverse(alphabet), c) AS SMALLINT), null))",
    ),
    ("chrom_match", "chrom STRING, name STRING", "BOOLEAN", "chrom = name"),
    ("interval_match", "pos BIGINT, span STRING", "BOOLEAN", f"coalesce(pos BETWEEN {_LOW} AND {_HIGH}, false)"),
    (
        "region_match", "chrom STRING, pos BIGINT, region STRING", "BOOLEAN",
        f"if(chrom IS NULL OR pos IS NULL, cast(raise_error('region_match: null chromosome or position') AS BOOLEAN), chrom = {_NAME} AND pos BETWEEN {_START} AND {_END})",
    ),
    ("contains_peak", "mz ARRAY<DOUBLE>, peak DOUBLE, tolerance DOUBLE", "BOOLEAN", "exists(mz, m -> coalesce(abs(m - peak) < tolerance, false))"),
    *[(name, "flag INT", "BOOLEAN", f"(flag & {mask}) = {mask}") for name, mask in FLAGS.items()],
    *[
        (f"{kind}_region_filter", f"region STRING, chrom STRING, pos BIGINT DEFAULT {_NONE}", "BOOLEAN", f"chrom = {_NAME} AND (pos = {_NONE} OR pos >= {_START} AND pos <= {_END})")
        for kind in ("vcf", "gff", "bigwig")
    ],
    *[
        (
            f"{kind}_region_filter", f"region STRING, reference STRING, start_pos BIGINT DEFAULT {_NONE}, end_pos BIGINT DEFAULT {_NONE}", "BOOLEAN",
            f"reference = {_NAME} AND (start_pos = {_NONE} OR start_pos <= {_END} AND end_pos >= {_START})",
        )
        for kind in ("bam", "cram")
    ],
]


@lru_cache(maxsize=256)
def _pattern(text: str) -> re.Pattern[str]:
    return re.compile(text)


def register_all(spark: SparkSession) -> None:
    """Make every function callable by name in ``spark.sql``.

    Positions of the region filters have a default that stands for "not given", so that ``vcf_region_filter('chr1', chrom)`` and
    ``vcf_region_filter('chr1:1-9', chrom, pos)`` are one function.
    """
    for name, args, returns, body in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")

    @F.pandas_udf(T.IntegerType())
    def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else local_score(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    @F.udf(MATCHES, useArrow=True)
    def locate_regex(text: str | None, pattern: str) -> list[tuple[int, int, str]] | None:
        return find_all(text, _pattern(pattern))

    spark.udf.register("alignment_score", alignment_score)
    spark.udf.register("bin_vectors", bin_udf)
    spark.udf.register("locate_regex", locate_regex)
