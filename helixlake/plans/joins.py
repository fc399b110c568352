"""Joins on intervals.

An equi-join on the name with the interval condition as residual degenerates when one name holds a third of all rows.  Here positions
are cut into bins of several levels, each level's bins being ``STEP`` times as wide as the last's.  The home of an interval is the lowest
level whose bins are at least as wide as it is long, so that it touches one or two bins there.  Two intervals meet at the higher of
their homes: each stands in the bins of its home and, as a visitor, in those of the higher levels that are the other side's homes,
again one or two a level.  A pair is kept only in the bin of the later of its two starts, so that no pair is made twice and nothing has to
be made distinct.  Bins spread a hot name over as many tasks as it has bins, and an interval as long as a chromosome costs two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a level's bins in those of the level below, and levels; the last one takes every longer interval.
STEP, LEVELS = 16, 14


def interval_join(
    left: DataFrame, right: DataFrame, name: str, left_span: tuple[str, str], right_span: tuple[str, str], mode: str = "overlaps", bin_size: int = 4096
) -> DataFrame:
    """Inner join of rows with equal ``name`` whose closed intervals overlap, or of which the left one ``contains`` the right one.

    The sides share the column ``name`` and no other.  Rows with a null name, a null bound or an end before the start match nothing;
    equal rows match each on their own.  ``bin_size``, the width of the lowest level's bins, should be near the usual length of an
    interval.  The levels in use are found by a pass over both sides.
    """
    if mode not in ("overlaps", "contains"):
        raise ValueError(f"mode {mode!r}")
    (ls, le), (rs, re_) = left_span, right_span
    width = [bin_size * STEP**k for k in range(LEVELS) if bin_size * STEP**k < 1 << 62]

    def homed(df: DataFrame, start: str, end: str) -> DataFrame:
        length = F.col(end) - F.col(start) + 1
        home: Column = F.lit(len(width) - 1)
        for k in range(len(width) - 2, -1, -1):
            home = F.when(length <= width[k], k).otherwise(home)
        return df.where(F.col(name).isNotNull() & (F.col(start) <= F.col(end))).withColumn("__home", home)

    def placed(df: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
        """Rows in the bins of their home and of the other side's higher homes."""
        def cells_at(k: int, w: int) -> Column:
            there = (F.col("__home") == k) | ((F.col("__home") < k) & F.lit(k in others))
            return F.when(there, F.transform(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w)), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"))))

        cells = [cells_at(k, w) for k, w in enumerate(width)]
        none = F.array().cast("array<struct<level:int,bin:bigint>>")
        return df.withColumn("__cell", F.explode(F.flatten(F.array(*[F.coalesce(c, none) for c in cells]))))

    a, b = homed(left, ls, le), homed(right, rs, re_)
    homes = [sorted(r[0] for r in x.select("__home").distinct().collect()) for x in (a, b)]
    a = placed(a, ls, le, homes[1]).withColumnRenamed("__home", "__a")
    b = placed(b, rs, re_, homes[0]).withColumnRenamed("__home", "__b")
    wide = F.element_at(F.array(*[F.lit(w) for w in width]), F.col("__cell.level") + 1)
    first = F.col("__cell.bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / wide)
    at_home = F.col("__cell.level") == F.greatest("__a", "__b")
    keep = (F.col(ls) <= F.col(rs)) & (F.col(le) >= F.col(re_)) if mode == "contains" else (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))
    return a.join(b, [name, "__cell"]).where(keep & first & at_home).drop("__cell", "__a", "__b")
