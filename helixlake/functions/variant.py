"""Predicates on genomic positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.plans.region import Interval, Region, parse_interval


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _within(pos: Column, interval: Interval) -> Column:
    out = F.lit(True)
    if interval.start is not None:
        out = pos >= interval.start
    return out if interval.end is None else (out & (pos <= interval.end) if interval.start is not None else pos <= interval.end)


def chrom_match(chrom: Column | str, name: str) -> Column:
    """Equality; null for null."""
    return _col(chrom) == name


def interval_match(pos: Column | str, interval: str) -> Column:
    """Position in a closed interval; false for null."""
    return F.coalesce(_within(_col(pos), parse_interval(interval)), F.lit(False)) & _col(pos).isNotNull()


def region_match(chrom: Column | str, pos: Column | str, region: str) -> Column:
    """Name equal and position in the closed interval; a null name or position is an error."""
    r = Region.parse(region)
    missing = _col(chrom).isNull() | _col(pos).isNull()
    return F.when(missing, F.raise_error(F.lit("region_match: null chromosome or position")).cast("boolean")).otherwise((_col(chrom) == r.name) & _within(_col(pos), r.interval))


def point_filter(region: str, chrom: Column | str, pos: Column | str | None = None) -> Column:
    """Row predicate of the VCF, GFF and BigWig region filters: name equal, position in the interval; a null position is out if it is asked for."""
    r = Region.parse(region)
    named = _col(chrom) == r.name
    return named if pos is None else named & _col(pos).isNotNull() & _within(_col(pos), r.interval)


def overlap_filter(region: str, reference: Column | str, start: Column | str, end: Column | str) -> Column:
    """Row predicate of the BAM and CRAM region filters: reference equal, ``[start, end]`` overlaps; unplaced rows are out."""
    r = Region.parse(region)
    out = (_col(reference) == r.name) & _col(start).isNotNull() & _col(end).isNotNull()
    if r.interval.start is not None:
        out = out & (_col(end) >= r.interval.start)
    return out if r.interval.end is None else out & (_col(start) <= r.interval.end)
