"""Sequence and quality functions as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Residue codes of the integer encodings.
DNA_CODES = {"A": 1, "C": 2, "G": 3, "T": 4, "N": 5}
PROTEIN_CODES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "I": 9, "K": 10, "L": 11, "M": 12, "N": 13, "O": 14, "P": 15,
    "Q": 16, "R": 17, "S": 18, "T": 19, "U": 20, "V": 21, "W": 22, "Y": 23, "X": 24, "Z": 25,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Reversed, with A and T, C and G exchanged in either case; other characters stay; null for null."""
    return F.translate(F.reverse(_col(seq)), "ATCGatcg", "TAGCtagc")


def gc_content(seq: Column | str) -> Column:
    """Share of upper-case G and C in the bytes, as a float; NaN for an empty sequence."""
    n = F.octet_length(_col(seq))
    return F.when(n == 0, F.lit(float("nan")).cast("float")).otherwise((F.regexp_count(_col(seq), F.lit("[GC]")) / F.nullif(n, F.lit(0))).cast("float"))


def trim_polya(seq: Column | str) -> Column:
    """Without the A's at the end, in either case."""
    return F.regexp_replace(_col(seq), r"[Aa]+\z", "")


def quality_scores_to_list(quality: Column | str) -> Column:
    """Code point minus 33 of every character; an empty list for null."""
    chars = F.filter(F.split(F.coalesce(_col(quality), F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) - 33)


def quality_scores_to_string(scores: Column | str) -> Column:
    """The character of every score plus 33."""
    return F.array_join(F.transform(_col(scores), lambda x: F.char(x + 33)), "")


def integer_encoding(seq: Column | str, alphabet: str) -> Column:
    """Position of each character in ``alphabet``, the last if it occurs there twice; null for others, null for null."""
    size = len(alphabet)
    at = lambda c: F.instr(F.lit(alphabet[::-1]), c)
    chars = F.filter(F.split(_col(seq), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(at(c) > 0, (size - at(c)).cast("short")))


def encode_residues(seq: Column | str, codes: dict[str, int]) -> Column:
    """Codes of the residues as bytes; a residue without a code is an error."""
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    chars = F.filter(F.split(_col(seq), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), F.raise_error(F.concat(F.lit("no code for residue "), c)).cast("int")).cast("byte"))


def local_score(a: str, b: str) -> int:
    """Best local alignment: match 1, mismatch -1, a gap of k costs 1 + k."""
    if not a or not b:
        return 0
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    j = np.arange(len(y) + 1)
    above = np.zeros(len(y) + 1, np.int64)
    vertical = np.full(len(y) + 1, -(10**6), np.int64)
    best = 0
    for ch in a:
        vertical = np.maximum(vertical - 1, above - 2)
        row = np.maximum(0, vertical)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(y == ord(ch), 1, -1))
        row[0] = 0
        # A horizontal gap that ends at j begins where row + position was largest before j.
        reach = np.maximum.accumulate(row + j)
        row[1:] = np.maximum(row[1:], reach[:-1] - 1 - j[1:])
        best = max(best, int(row.max()))
        above = row
    return best


@F.pandas_udf(T.IntegerType())
def _alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else local_score(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def alignment_score(a: Column | str, b: Column | str, cutoff: Column | int | None = None) -> Column:
    """Smith-Waterman score with affine gaps; null if a side is null.  ``cutoff`` is accepted and has no effect, but must be a number."""
    if isinstance(cutoff, str):
        raise TypeError("the third argument of alignment_score must be a number")
    return _alignment(_col(a), _col(b))


MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType())]))


def find_all(text: str | None, pattern: re.Pattern[str]) -> list[tuple[int, int, str]] | None:
    """Non-overlapping matches with byte offsets from 1, the end excluded."""
    if text is None:
        return None
    if text.isascii():
        return [(m.start() + 1, m.end() + 1, m.group()) for m in pattern.finditer(text)]
    size = lambda k: len(text[:k].encode())
    return [(size(m.start()) + 1, size(m.end()) + 1, m.group()) for m in pattern.finditer(text)]


def locate_regex(seq: Column | str, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of a literal pattern; an empty list without a match, null for null."""
    if not isinstance(pattern, str):
        raise TypeError("the pattern of locate_regex must be a literal")
    compiled = re.compile(pattern)

    @F.udf(MATCHES, useArrow=True)
    def locate(text: str | None) -> list[tuple[int, int, str]] | None:
        return find_all(text, compiled)

    return locate(_col(seq))
