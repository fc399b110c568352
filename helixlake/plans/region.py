"""Genomic regions: text form, interval algebra, and the predicates that planning needs."""

from __future__ import annotations

import re
from typing import NamedTuple

#: A name may stand in braces, as one that ends like bounds must: ``{HLA-A*01:01}:5-9``.  Also used in SQL, hence no named groups.
PATTERN = r"^(?:\{([^}]*)\}|([^:{].*?))(?::([0-9,]+)(?:-([0-9,]+)?)?)?$"
_REGION = re.compile(PATTERN)
_INTERVAL = re.compile(r"^(?P<start>\d+)?(?:-(?P<end>\d+)?)?$")


class Interval(NamedTuple):
    """Closed interval from 1; ``None`` is unbounded."""

    start: int | None = None
    end: int | None = None

    def contains(self, pos: int) -> bool:
        return (self.start is None or pos >= self.start) and (self.end is None or pos <= self.end)

    def overlaps(self, start: int, end: int) -> bool:
        return (self.end is None or start <= self.end) and (self.start is None or end >= self.start)

    def intersect(self, other: Interval) -> Interval | None:
        """The common part; None if there is none."""
        low = [x for x in (self.start, other.start) if x is not None]
        high = [x for x in (self.end, other.end) if x is not None]
        start, end = max(low, default=None), min(high, default=None)
        return None if start is not None and end is not None and start > end else Interval(start, end)


class Region(NamedTuple):
    name: str
    interval: Interval = Interval()

    @classmethod
    def parse(cls, text: str) -> Region:
        """``chr``, ``chr:start`` (open to the end) or ``chr:start-end``; thousands separators are allowed."""
        m = _REGION.match(text.strip())
        name = m and (m[1] or m[2])
        if not name:
            raise ValueError(f"not a region: {text!r}")
        number = lambda x: int(x.replace(",", "")) if x else None
        return cls(name, parsed(number(m[3]), number(m[4]), text))

    def intersect(self, other: Region) -> Region | None:
        if self.name != other.name:
            return None
        common = self.interval.intersect(other.interval)
        return None if common is None else Region(self.name, common)

    def __str__(self) -> str:
        start, end = self.interval
        if start is None and end is None:
            return self.name
        return f"{self.name}:{start or 1}-{'' if end is None else end}"


def parsed(start: int | None, end: int | None, text: str) -> Interval:
    if start is not None and start < 1 or start is not None and end is not None and end < start:
        raise ValueError(f"not an interval: {text!r}")
    return Interval(start, end)


def parse_interval(text: str) -> Interval:
    """``start-end``, ``start-`` or ``start`` (open to the end)."""
    m = _INTERVAL.match(text.strip())
    if not m or not (m["start"] or m["end"]):
        raise ValueError(f"not an interval: {text!r}")
    return parsed(*(int(m[k]) if m[k] else None for k in ("start", "end")), text)
