"""Problem 6: GTF text to typed records and located syntax errors.

A recursive-descent parser over text of one or more lines:

    text       = { blank | comment | record }
    record     = field TAB field ... (nine fields) line-end
    attributes = pair { ";" pair } [ ";" ]
    pair       = key blanks ( number | '"' text '"' )

An error is typed (``columns``, ``quoting``, ``value``), located by its offset, and ends the record.  After a broken quote what follows
can't be trusted to be what it looks like, so the parser resumes at the next validated anchor: a line start behind which a comment, a
blank line or the head of a record (text, text, text, whole number, whole number) can be parsed.  Every valid record begins with an
anchor; lines before the anchor are remains of the broken record, and each is reported with its own fault, so that no line is lost.

The rows of an Arrow batch are parsed as one text, each row beginning a line, and what is found is traced back to its row by offset.
Null and blank texts hold no records; blanks and carriage returns at a line's end are ignored.  Positions have at most 19 digits after
leading zeros (a long).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
WHOLE = re.compile(r"\d+\Z", re.A)
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?=[ ;]|\Z)", re.A)
KEY = re.compile(r"[^\s\";]+")
ANCHOR = re.compile(r"(?:#|[ \r]*$|[^\t\n]*\t[^\t\n]*\t[^\t\n]*\t\d+\t\d+\t)", re.M)
FRAMES = (".", "0", "1", "2")


class Record(NamedTuple):
    seqname: str
    source: str
    feature_type: str
    start_pos: int
    end_pos: int
    score: float | None
    strand: str
    frame: str | None
    attributes: dict[str, str]


class Fault(NamedTuple):
    reason: str
    at: int
    message: str


class Broken(Exception):
    def __init__(self, reason: str, at: int, message: str) -> None:
        super().__init__(message)
        self.fault = Fault(reason, at, message)


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.pos = text, 0

    def parse(self) -> Iterator[Record | Fault]:
        return (x for _, x in self.located())

    def located(self) -> Iterator[tuple[int, Record | Fault]]:
        """What the text holds, with the offset of its line."""
        text = self.text
        recovering = False
        while self.pos < len(text):
            start, stop = self.pos, text.find("\n", self.pos)
            stop = len(text) if stop < 0 else stop
            self.pos = stop + 1
            line = text[start:stop].rstrip(" \r")
            if recovering and ANCHOR.match(text, start):
                recovering = False
            if not line.strip() or line.startswith("#"):
                continue
            try:
                yield start, self.record(line, start)
            except Broken as b:
                yield start, b.fault._replace(message="remains of a broken record, " + b.fault.message) if recovering else b.fault
                recovering = recovering or b.fault.reason == "quoting"

    def record(self, line: str, base: int) -> Record:
        fields = line.split("\t")
        if len(fields) != 9:
            raise Broken("columns", base, f"{len(fields)} columns")
        seqname, source, feature, start, end, score, strand, frame, rest = fields
        at = [base]
        for f in fields[:-1]:
            at.append(at[-1] + len(f) + 1)
        attributes = self.attributes(rest, at[8])
        low, high = self.position(start, at[3]), self.position(end, at[4])
        if low > high:
            raise Broken("value", at[3], "start after end")
        number = self.score(score, at[5])
        if frame not in FRAMES:
            raise Broken("value", at[7], f"frame {frame!r}")
        return Record(seqname, source, feature, low, high, number, strand, None if frame == "." else frame, attributes)

    def position(self, text: str, at: int) -> int:
        digits = text.lstrip("0")
        if not WHOLE.match(text) or not digits or len(digits) > 19 or int(digits) >= 1 << 63:
            raise Broken("value", at, f"position {text[:40]!r}")
        return int(digits)

    def score(self, text: str, at: int) -> float | None:
        if text == ".":
            return None
        if not DECIMAL.match(text) or not text.isascii() or not math.isfinite(x := float(text)):
            raise Broken("value", at, f"score {text[:40]!r}")
        return x

    def attributes(self, text: str, base: int) -> dict[str, str]:
        out: dict[str, str] = {}
        i, n = 0, len(text)
        while True:
            i = self.blanks(text, i)
            if i == n and out:
                return out
            key, value, i = self.pair(text, i, base)
            out.setdefault(key, value)
            i = self.blanks(text, i)
            if i == n:
                return out
            if text[i] != ";":
                raise Broken("quoting", base + i, "no ; after a value")
            i += 1

    def pair(self, text: str, i: int, base: int) -> tuple[str, str, int]:
        m = KEY.match(text, i)
        if not m:
            raise Broken("quoting", base + i, "no key")
        key, i = m.group(), self.blanks(text, m.end())
        if i == m.end():
            raise Broken("quoting", base + i, "no blank after a key")
        if text[i : i + 1] == '"':
            stop = text.find('"', i + 1)
            if stop < 0:
                raise Broken("quoting", base + i, "quote is not closed")
            return key, text[i + 1 : stop], stop + 1
        if m := NUMBER.match(text, i):
            return key, m.group(), m.end()
        raise Broken("quoting", base + i, "value is neither a number nor quoted")

    @staticmethod
    def blanks(text: str, i: int) -> int:
        while i < len(text) and text[i] == " ":
            i += 1
        return i


_COLUMNS = ["seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", "frame", "attributes"]
SCHEMA = (
    "line_id long, record_no int, reason string, error_at int, message string, seqname string, source string, feature_type string, start_pos long, end_pos long, "
    "score double, strand string, frame string, attributes map<string,string>"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]


def parse(lines: DataFrame) -> DataFrame:
    """Every record and every fault of ``line``, by ``line_id`` and ``record_no``; ``reason`` is null for a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            numbers: list[int] = []
            faults: list[tuple] = []
            records: list[tuple] = []
            lines_ = [t or "" for t in batch.column(1).to_pylist()]
            starts = np.cumsum([0, *(len(t) + 1 for t in lines_)])
            own = batch.column(0).to_pylist()
            row = -1
            for at, x in Parser("\n".join(lines_)).located():
                if row < 0 or at >= starts[row + 1]:
                    row, k = int(np.searchsorted(starts, at, "right")) - 1, 0
                ids.append(own[row])
                numbers.append(k)
                k += 1
                bad = isinstance(x, Fault)
                faults.append((x.reason, x.at - int(starts[row]), x.message) if bad else (None, None, None))
                records.append((None,) * 9 if bad else (*x[:8], list(x.attributes.items())))
            arrays = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())]
            arrays += [pa.array([f[k] for f in faults], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            arrays += [pa.array([r[k] for r in records], t) for k, t in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays(arrays, ["line_id", "record_no", "reason", "error_at", "message", *_COLUMNS])

    return lines.select(F.col("line_id").cast("long"), "line").mapInArrow(run, SCHEMA)


def records(lines: DataFrame) -> DataFrame:
    """The valid records, typed."""
    return parse(lines).where("reason IS NULL").drop("reason", "error_at", "message")


def faults(lines: DataFrame) -> DataFrame:
    """``(line_id, record_no, reason, error_at, message)`` of what doesn't parse; ``error_at`` is an offset in the line's text."""
    return parse(lines).where("reason IS NOT NULL").select("line_id", "record_no", "reason", "error_at", "message")
