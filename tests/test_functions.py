import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.functions import alignment, massspec, sequence, variant

SEQUENCES = [None, "", "A", "ATCG", "atcgN", "GGGCCC", "AAAA", "ACGTaaAA", "żółć", "x" * 3000, "ATCG"]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(list(enumerate(SEQUENCES)), "i int, s string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_sequence_functions(seqs):
    swap = str.maketrans("ATCGatcg", "TAGCtagc")
    assert values(seqs, sequence.reverse_complement("s")) == [s and s[::-1].translate(swap) if s is not None else None for s in SEQUENCES]
    assert values(seqs, sequence.trim_polya("s")) == [re.sub("[Aa]+$", "", s) if s is not None else None for s in SEQUENCES]
    gc = values(seqs, sequence.gc_content("s"))
    assert gc[0] is None and gc[1] != gc[1] and gc[3] == 0.5 and gc[5] == 1.0
    assert values(seqs, sequence.integer_encoding("s", "ATCGA"))[3] == [4, 1, 2, 3] and values(seqs, sequence.integer_encoding("s", "ATCG"))[4] == [None] * 5
    assert values(seqs, sequence.quality_scores_to_list("s"))[:3] == [[], [], [32]]


def test_locate_regex(seqs):
    got = values(seqs, sequence.locate_regex("s", "ł"))
    assert got[0] is None and got[1] == [] and [tuple(m) for m in got[8]] == [(5, 7, "ł")]
    with pytest.raises(TypeError):
        sequence.locate_regex("s", F.col("p"))


def slow_local(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1))
            best = max([best, *(h[i - k][j] - 1 - k for k in range(1, i + 1)), *(h[i][j - k] - 1 - k for k in range(1, j + 1))])
            h[i][j] = best
    return max(map(max, h))


@settings(max_examples=150, deadline=None)
@given(st.text("ACG", max_size=14), st.text("ACG", max_size=14))
def test_local_score(a, b):
    assert sequence.local_score(a, b) == (slow_local(a, b) if a and b else 0)


def test_alignment_score(spark):
    df = spark.createDataFrame([("ATCG", "AG"), (None, "A"), ("A", None)], "a string, b string")
    assert [r[0] for r in df.select(sequence.alignment_score("a", "b", 3)).collect()] == [1, None, None]
    with pytest.raises(TypeError):
        sequence.alignment_score("a", "b", "c")


def test_flags(spark):
    df = spark.createDataFrame([(0xFFF,), (0,), (4,), (None,)], "f int")
    for name in alignment.FLAGS:
        assert [r[0] for r in df.select(alignment.has_flag("f", name)).collect()][0::3] == [True, None]
    assert [r[0] for r in df.select(alignment.has_flag("f", "is_unmapped")).collect()] == [True, False, True, None]
    c = spark.createDataFrame([("55M13394N21M",), ("*",), ("5S3I",)], "c string")
    assert [r[0] for r in c.select(alignment.cigar_reference_length("c")).collect()] == [13470, 0, 0]


def test_spectra(spark):
    df = spark.createDataFrame([([1.0, None, 5.0, 6.0], [1.0, 2.0, None, 7.0]), ([], []), (None, [1.0])], "m array<double>, i array<double>")
    assert [r[0] for r in df.select(massspec.bin_vectors("m", "i", 0.0, 3, 2.0)).collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], None]
    assert [r[0] for r in df.select(massspec.contains_peak("m", 6.5, 1.0)).collect()] == [True, False, None]
    assert not df.select(massspec.contains_peak("m", 7.0, 1.0)).first()[0]  # strictly closer


def test_region_filters(spark):
    df = spark.createDataFrame([("1", 5, 9), ("1", None, None), ("2", 5, 9), (None, 1, 2)], "c string, s long, e long")
    assert df.where(variant.overlap_filter("1:9-20", "c", "s", "e")).count() == 1 and df.where(variant.overlap_filter("1:10-", "c", "s", "e")).count() == 0
    assert df.where(variant.point_filter("1", "c")).count() == 2 and df.where(variant.point_filter("2:1-5", "c", "s")).count() == 1
