"""Tests of the bits of a SAM flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the SAM specification.
FLAGS = {
    "is_segmented": 0x1,
    "is_properly_aligned": 0x2,
    "is_properly_segmented": 0x2,
    "is_unmapped": 0x4,
    "is_mate_unmapped": 0x8,
    "is_reverse_complemented": 0x10,
    "is_mate_reverse_complemented": 0x20,
    "is_first_segment": 0x40,
    "is_last_segment": 0x80,
    "is_secondary": 0x100,
    "is_qc_fail": 0x200,
    "is_duplicate": 0x400,
    "is_supplementary": 0x800,
}


def has_flag(flag: Column | str, name: str) -> Column:
    """Whether the bits that ``name`` stands for are set; null for null."""
    mask = FLAGS[name]
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(mask) == mask


def cigar_reference_length(cigar: Column | str) -> Column:
    """Reference positions that a CIGAR covers (M, D, N, = and X)."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    return F.aggregate(F.regexp_extract_all(c, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
