"""Problem 1: quantities recorded in different units, converted to the unit that ``unit_targets`` names.

Hidden Markov model per device run and quantity, the unit as hidden state.  Numbers and what a row states about its unit (in the value,
the name, the unit's name or accession) are read by native expressions and small joins; only numbers reach Python.  A unit that a row
states, or that the run's remarks state for the quantity, is an observed state.  The states of the other rows are decoded by Viterbi:

* where the sequence has observed states, they give the smooth level (running median of the values' logarithms) and its spread; a
  silent row costs its distance from the level, in spreads, under each unit; the target unit has a prior weight, and switches cost;
* where nothing is observed, the level is carried from row to row: a step costs the jump of the log value under the two rows' units in
  spreads of the sequence, and the sequence begins in the target unit unless that costs more.

So a silent row has the target unit unless its value, or a stretch of values, jumps by more than the scatter of the level explains.

Sequences of more than ``BLOCK`` rows are cut into blocks, so that a device with a third of all rows is spread over tasks.  Rows are streamed
in sorted order and no group is gathered beyond its block.  A sequence of several blocks is decoded as if it were whole: the nearest
observed values on both sides of each block are carried to it, then the min-plus products of the blocks give the states in which the
cheapest path crosses their edges.  Observed states cut the path, so only the rows between them are walked.

Null or unreadable values give number and converted value null; a quantity without target is left out; a target whose unit is in no
dimension known here gives rows with unit and converted value null and basis ``unsupported``; an unknown stated unit decodes as
``unknown`` and isn't converted.  Repeated rows are decoded alike.  Null run: the row stands for itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.runtime import broadcast_if_small, stored

#: Rows of a sequence that are decoded as one block; longer sequences are cut by scan into blocks of about so many.
BLOCK = 4096
#: Weight of the target unit in a row that says nothing: log odds against any other unit.  It exceeds two switches, so that a silent
#: row among rows in another unit means the target unit unless its value jumps; ``SOFT`` doesn't.
PRIOR, SOFT = 12.0, 1.5
#: Cost of a switch of unit between successive rows.
SWITCH = 3.0
#: Most that a jump costs.
FAR = 30.0
#: Stated values on either side that make up the level.
NEAR = 15
#: Spread of log values that is assumed before values are seen, and the number of values that this counts for; the least spread.
SPREAD, SPREAD_WEIGHT, LEAST_SPREAD = 1.5, 5.0, 0.05
#: Bound on the targets.
MAX_TARGETS = 10_000


class Unit(NamedTuple):
    accession: str
    name: str
    factor: float  # target = value * factor + offset
    offset: float
    spellings: str


# Units of each dimension, the target unit first, with spellings in lower case and without dots.
DIMENSIONS: dict[str, list[Unit]] = {
    "time": [
        Unit("UO:0000010", "second", 1.0, 0.0, "s|sec|secs|second|seconds|sekunde|sekunden"),
        Unit("UO:0000028", "millisecond", 1e-3, 0.0, "ms|msec|msecs|millisecond|milliseconds|millisekunden|thousandths of a second"),
        Unit("UO:0000029", "microsecond", 1e-6, 0.0, "us|µs|usec|µsec|microsecond|microseconds|mikrosekunden"),
        Unit("UO:0000150", "nanosecond", 1e-9, 0.0, "ns|nsec|nanosecond|nanoseconds"),
        Unit("UO:0000031", "minute", 60.0, 0.0, "min|mins|minute|minutes|minuten"),
        Unit("UO:0000032", "hour", 3600.0, 0.0, "h|hr|hrs|hour|hours|stunden"),
    ],
    "energy": [
        Unit("UO:0000266", "electronvolt", 1.0, 0.0, "ev|electronvolt|electronvolts|electron volt|electron volts|electron-volt"),
        Unit("", "kiloelectronvolt", 1e3, 0.0, "kev|kiloelectronvolt|kiloelectronvolts|kilo-electronvolt|kilo-electronvolts|kilo electron volt|kilo electronvolt"),
        Unit("", "millielectronvolt", 1e-3, 0.0, "mev|millielectronvolt|millielectronvolts"),
    ],
    "wavelength": [
        Unit("UO:0000018", "nanometer", 1.0, 0.0, "nm|nanometer|nanometers|nanometre|nanometres"),
        Unit("UO:0000017", "micrometer", 1e3, 0.0, "um|µm|micron|microns|micrometer|micrometers|micrometre|micrometres"),
        Unit("UO:0000019", "angstrom", 0.1, 0.0, "å|angstrom|angstroms|ångström|ångstrom|angström"),
    ],
    "m/z": [Unit("MS:1000040", "m/z", 1.0, 0.0, "m/z|mz|th|thomson")],
    "counts": [
        Unit("MS:1000131", "number of detector counts", 1.0, 0.0, "counts|count|cts|number of detector counts|number of counts|detector counts"),
        Unit("", "thousand counts", 1e3, 0.0, "kcounts|k counts|kcts|k cts|10^3 counts|x 10^3 counts|10³ counts|10e3 counts|thousand counts|thousands of counts|kilocounts"),
        Unit("", "million counts", 1e6, 0.0, "mcounts|m counts|10^6 counts|x 10^6 counts|million counts|millions of counts"),
        Unit("MS:1000814", "counts per second", math.nan, 0.0, "cps|counts per second|counts/s"),
    ],
    "temperature": [
        Unit("UO:0000012", "kelvin", 1.0, 0.0, "k|kelvin|kelvins"),
        Unit("UO:0000027", "degree Celsius", 1.0, 273.15, "°c|c|degc|deg c|degree celsius|degrees celsius|celsius|centigrade|grad celsius"),
        Unit("UO:0000195", "degree Fahrenheit", 5 / 9, 273.15 - 160 / 9, "°f|f|degf|deg f|degree fahrenheit|degrees fahrenheit|fahrenheit"),
    ],
    "pressure": [
        Unit("UO:0000110", "pascal", 1.0, 0.0, "pa|pascal|pascals"),
        Unit("", "hectopascal", 100.0, 0.0, "hpa|hectopascal"),
        Unit("", "kilopascal", 1e3, 0.0, "kpa|kilopascal|kilopascals"),
        Unit("", "millibar", 100.0, 0.0, "mbar|millibar|millibars"),
        Unit("", "bar", 1e5, 0.0, "bar|bars"),
        Unit("", "torr", 101325 / 760, 0.0, "torr|torrs|mmhg|mm hg"),
        Unit("", "millitorr", 101325 / 760e3, 0.0, "mtorr|millitorr"),
        Unit("", "psi", 6894.757293168, 0.0, "psi"),
    ],
    "voltage": [
        Unit("UO:0000218", "volt", 1.0, 0.0, "v|volt|volts"),
        Unit("UO:0000248", "kilovolt", 1e3, 0.0, "kv|kilovolt|kilovolts"),
        Unit("UO:0000247", "millivolt", 1e-3, 0.0, "mv|millivolt|millivolts"),
    ],
}
# How remarks name the quantities.
QUANTITIES = {
    "scan start time": r"scan start\w*|scan times?|start times? of (?:the )?scans?|retention times?|startzeit\w*(?: der scans?)?|\brt\b",
    "ion injection time": r"(?:ion )?injection(?: times?)?|injektionszeit\w*",
    "collision energy": r"collision energ\w*|\bce\b|kollisionsenergie\w*",
    "lowest observed wavelength": r"(?:lowest |observed |lower )*wavelengths?|wellenlängen?",
    "highest observed wavelength": r"(?:highest |observed |upper )*wavelengths?|wellenlängen?",
    "base peak m/z": r"base peak m/z",
    "base peak intensity": r"base peak intensit\w*|peak intensit\w*|intensit\w*",
    "source temperature": r"source temp\w*|temp\w* of the (?:ion )?source|quellentemperatur\w*",
    "collision cell pressure": r"(?:collision )?cell pressures?|pressures? (?:of|in) the (?:collision )?cell|zellendruck\w*",
    "spray voltage": r"spray voltages?|sprühspannung\w*",
}
_NUMBER = re.compile(r"^\s*([+\-−]?\d[\d.,]*(?:[eE][+-]?\d+)?|[+\-−]?[.,]\d+(?:[eE][+-]?\d+)?)\s*(.*?)\s*$", re.S)
_DURATION = re.compile(r"^\s*P(?:T)(?:([\d.,]+)H)?(?:([\d.,]+)M)?(?:([\d.,]+)S)?\s*$", re.I)
_SUFFIX = re.compile(r"[\[(]([^\[\]()]*)[\])]\s*$")


def spelling(text: str) -> str:
    return " ".join(text.lower().replace("μ", "µ").replace(".", " ").split())


_INDEX = {d: {s: k for k, u in enumerate(us) for s in u.spellings.split("|")} for d, us in DIMENSIONS.items()}
_ACCESSIONS = {d: {u.accession: k for k, u in enumerate(us) if u.accession} for d, us in DIMENSIONS.items()}


def _float(text: str) -> float | None:
    text = text.replace("−", "-")
    if "," in text and "." in text:
        text = text.replace("," if text.rfind(",") < text.rfind(".") else ".", "")
    text = text.replace(",", ".")
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def dimension_of(target_accession: str | None) -> str | None:
    return next((d for d, a in _ACCESSIONS.items() if target_accession in a), None)


def number_and_unit(value: str | None, dimension: str | None) -> tuple[float | None, str]:
    """The number that a value holds and the text behind it; ISO durations give their one part, or seconds."""
    if value is None:
        return None, ""
    if m := _DURATION.match(value):
        parts = [(u, _float(g)) for u, g in zip(("h", "min", "s"), m.groups(), strict=True) if g]
        if parts and all(x is not None for _, x in parts):
            if len(parts) == 1:
                return parts[0][1], parts[0][0]
            return sum(x * {"h": 3600, "min": 60, "s": 1}[u] for u, x in parts), "s"
    m = _NUMBER.match(value)
    if not m:
        return None, ""
    return _float(m.group(1)), m.group(2)


def stated_unit(dimension: str, tail: str, name: str | None, unit_name: str | None, unit_accession: str | None) -> int | None:
    """Index of the unit that a row states, -1 for one that is unknown, None if it states none."""
    index = _INDEX[dimension]
    if unit_accession and unit_accession.strip() in _ACCESSIONS[dimension]:
        return _ACCESSIONS[dimension][unit_accession.strip()]
    texts = [unit_name or "", tail]
    if m := _SUFFIX.search(name or ""):
        texts.append(m.group(1))
    for t in texts:
        if (k := index.get(spelling(t))) is not None:
            return k
    return -1 if (unit_accession or "").strip() or (unit_name or "").strip() else None


def remark_units(remarks: str | None, names: dict[str, tuple[str, str]]) -> dict[str, int]:
    """Units that free text states, by accession; ``names`` maps accessions to (name, dimension).

    A unit belongs to a quantity if it follows within eight words, in the same sentence, before another quantity is named, and isn't
    the unit of a number.
    """
    text = " ".join((remarks or "").lower().replace("μ", "µ").split())
    if not text:
        return {}
    spots = sorted((m.start(), m.end(), a) for a, (name, _) in names.items() if name in QUANTITIES for m in re.finditer(QUANTITIES[name], text))
    out: dict[str, int] = {}
    for start, end, accession in spots:
        nxt = min((s for s, e, a in spots if s >= end), default=len(text))
        clause = re.split(r"[.;](?=\s|$)", text[end:nxt] if nxt > end else text[end:], maxsplit=1)[0]
        words = re.findall(r"[^\s,:()]+", clause)[:8]
        index = _INDEX[names[accession][1]]
        for i in range(len(words)):
            hit = next((index[w] for n in (4, 3, 2, 1) if (w := spelling(" ".join(words[i : i + n]))) in index and i + n <= len(words)), None)
            if hit is not None and not (i and re.fullmatch(r"[\d.,]+", words[i - 1])) and not (len(words[i]) == 1 and words[i] in "cfkhs"):
                out.setdefault(accession, hit)
                break
    return out


FREE = -1


class Seen(NamedTuple):
    """A block: log of each row's value in the target unit, by unit (nan: none; the last column is the unknown unit), its observed state or ``FREE``, and the target."""

    logs: np.ndarray
    pinned: np.ndarray
    target: int


class Carried(NamedTuple):
    """What a block knows of the others: the state before its first row and of its last (-1: free), whether it begins the sequence, whether any
    row of the sequence is observed, the sequence's spread, the number before it, and the observed log values before and after."""

    entry: int = -1
    last: int = -1
    first: bool = True
    anchored: bool | None = None
    spread: float = math.nan
    previous: np.ndarray | None = None
    before: list[float] = []
    after: list[float] = []


def observed_values(seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """Rows with an observed unit and a value, and the log of that value."""
    known = np.flatnonzero(seen.pinned >= 0)
    x = seen.logs[known, seen.pinned[known]]
    good = ~np.isnan(x)
    return known[good], x[good]


def steps_of(seen: Seen) -> np.ndarray:
    """Sizes, at most 1, of the steps between successive log values read in the target unit."""
    x = seen.logs[:, seen.target]
    return np.minimum(np.abs(np.diff(x[~np.isnan(x)])), 1.0)


def spread_of(total: float, n: float) -> float:
    return max(LEAST_SPREAD, total / n) if n else SPREAD


def costs(seen: Seen, at: Carried, silent: float) -> tuple[np.ndarray, float]:
    """Cost of each state in each free row, and the spread of jumps between rows (nan: rows are judged by the level)."""
    n, k = seen.logs.shape
    emit = np.zeros((n, k))
    emit[:, k - 1] = 10 * FAR
    known, x = observed_values(seen)
    anchored = len(x) > 0 if at.anchored is None else at.anchored
    if not anchored:
        d = steps_of(seen)
        return emit, spread_of(d.sum(), len(d)) if math.isnan(at.spread) else at.spread
    free = np.flatnonzero(seen.pinned == FREE)
    emit[free, seen.target] -= silent
    known = np.concatenate([np.full(len(at.before), -1), known, np.full(len(at.after), n)])
    x = np.concatenate([np.array(at.before, float), x, np.array(at.after, float)])
    if len(x) and len(free):
        level, spread = np.zeros(len(free)), np.ones(len(free))
        places = np.clip(np.searchsorted(known, free), 0, len(x) - 1)
        windows: dict[int, tuple[float, float]] = {}
        for i, c in enumerate(places.tolist()):
            if c not in windows:
                w = x[max(0, c - NEAR) : c + NEAR + 1]
                mid = float(np.median(w))
                windows[c] = mid, max(LEAST_SPREAD, (float(np.abs(w - mid).sum()) + SPREAD * SPREAD_WEIGHT) / (len(w) + SPREAD_WEIGHT))
            level[i], spread[i] = windows[c]
        distance = np.abs(seen.logs[free] - level[:, None]) / spread[:, None]
        emit[free] += np.minimum(np.nan_to_num(distance, nan=0.0), FAR)
    return emit, math.nan


class Walk:
    """Min-plus steps over the rows of a block."""

    def __init__(self, seen: Seen, at: Carried, silent: float) -> None:
        self.seen, self.at = seen, at
        self.emit, self.spread = costs(seen, at, silent)
        self.k = self.emit.shape[1]
        self.switch = np.where(np.eye(self.k, dtype=bool), 0.0, SWITCH)
        self.start = np.where(np.arange(self.k) == seen.target, 0.0, 0.0 if math.isnan(self.spread) else silent)

    def step(self, i: int, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Transition costs into row ``i`` and the last values so far (``x``: those before it)."""
        if math.isnan(self.spread):
            return self.switch, None
        now = self.seen.logs[i]
        if np.isnan(now).all():
            return self.switch, x
        if x is None:
            return self.switch, now
        return self.switch + np.minimum(np.nan_to_num(np.abs(now[None, :] - x[:, None]) / self.spread, nan=FAR), FAR), now

    def path(self) -> np.ndarray:
        """States of the cheapest path."""
        pinned, n = self.seen.pinned, len(self.seen.pinned)
        out = pinned.copy()
        free = np.flatnonzero(pinned == FREE)
        if not len(free):
            return out
        breaks = np.flatnonzero(np.diff(free) > 1)
        for a, b in zip(free[np.r_[0, breaks + 1]].tolist(), free[np.r_[breaks, len(free) - 1]].tolist(), strict=True):
            before = int(pinned[a - 1]) if a else self.at.entry
            after = int(pinned[b + 1]) if b + 1 < n else -1
            last = self.at.last if b + 1 == n else -1
            out[a : b + 1] = self._segment(a, b, before, after, last, bool(a))
        return out

    def _segment(self, a: int, b: int, before: int, after: int, last: int, inner: bool) -> list[int]:
        x = None if inner else self.at.previous
        move, x = self.step(a, x)
        cost = self.emit[a] + (self.start if before < 0 else move[before])
        back = []
        for i in range(a + 1, b + 1):
            move, x = self.step(i, x)
            total = cost[:, None] + move
            best = total.argmin(axis=0)
            stay = total.diagonal() <= total.min(axis=0)
            back.append(np.where(stay, np.arange(self.k), best))
            cost = total.min(axis=0) + self.emit[i]
        if after >= 0:
            cost = cost + self.switch[:, after]
        state = last if last >= 0 else int(cost.argmin())
        path = [state]
        for f in reversed(back):
            state = int(f[state])
            path.append(state)
        return path[::-1]

    def product(self) -> np.ndarray:
        """The cheapest path's cost from each state before the block to each state of its last row."""
        pinned, n = self.seen.pinned, len(self.seen.pinned)
        cost = np.full((self.k, self.k), np.inf)
        np.fill_diagonal(cost, 0.0)
        known = np.flatnonzero(pinned >= 0)
        if not len(known):
            return self._over(cost, 0, n, self.at.previous)
        lead = self._over(cost, 0, int(known[0]), self.at.previous)
        lead = (lead + self.switch[:, pinned[known[0]]]).min(axis=1)
        begin = np.full((1, self.k), np.inf)
        begin[0, pinned[known[-1]]] = 0.0
        return lead[:, None] + self._over(begin, int(known[-1]) + 1, n, None)

    def _over(self, cost: np.ndarray, a: int, b: int, x: np.ndarray | None) -> np.ndarray:
        for i in range(a, b):
            move, x = self.step(i, x)
            if i == 0 and self.at.first:
                cost = np.where(np.eye(self.k, dtype=bool), self.start, np.inf) + self.emit[0]
            else:
                cost = (cost[:, :, None] + move[None]).min(axis=1) + self.emit[i]
        return cost


def edges(products: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each block of a sequence the state before it (-1: the sequence begins) and the state of its last row on the cheapest path."""
    best = [products[0].min(axis=0)]  # any state may come before the first row
    for m in products[1:]:
        c = (best[-1][:, None] + m).min(axis=0)
        best.append(c - c.min())
    out = []
    last = int(best[-1].argmin())
    for b in range(len(products) - 1, 0, -1):
        entry = int((best[b - 1] + products[b][:, last]).argmin())
        out.append((entry, last))
        last = entry
    return [(-1, last), *reversed(out)]


# ---- native reading of numbers and units -----------------------------------------------------------------------------------------------


def _spelt(text: Column) -> Column:
    """As ``spelling``; the regular expression is for texts with other blanks than single spaces only."""
    low = F.trim(F.translate(F.lower(text), "μ.\u00a0\u2009\u202f\t\n\r", "µ       "))
    return F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, " {2,}", " ")).otherwise(low)


def _number(text: Column) -> Column:
    """As ``_float``."""
    text = F.translate(text, "−", "-")
    comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    comma_last = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
    plain = F.when(~comma, text).when(dot & comma_last, F.translate(text, ",.", ".")).when(dot, F.translate(text, ",", "")).otherwise(F.translate(text, ",", "."))
    x = plain.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _literal(spark: SparkSession, rows: list[tuple[str, str, int]], names: str) -> DataFrame:
    """A small fixed table as a local relation."""
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({names})"))


def _scan() -> Column:
    """The last number of a spectrum's id, else the parameter's id."""
    return F.coalesce(F.regexp_extract("spectrum_id", r"(\d+)\D*$", 1).try_cast("long"), F.col("param_id").cast("long"))


def observations(cv_params: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``param_id, run_id, accession, dimension, scan, number, stated``: what each row says; ``stated`` is the unit's index in its dimension, -1 for
    an unknown one, null if the row states none.  ``dimensions``: ``(accession, dimension)`` of the targets."""
    spark = cv_params.sparkSession
    spellings = sorted({(d, spelling(x), k) for d, us in DIMENSIONS.items() for k, u in enumerate(us) for x in u.spellings.split("|")})
    accessions = sorted((d, a, k) for d, own in _ACCESSIONS.items() for a, k in own.items())
    value = F.coalesce(F.col("value"), F.lit(""))
    duration = r"(?i)^\s*PT(?:([\d.,]+)H)?(?:([\d.,]+)M)?(?:([\d.,]+)S)?\s*$"
    number = r"^\s*[+\-−]?(?:\d[\d.,]*|[.,]\d+)(?:[eE][+-]?\d+)?"
    name = F.coalesce("name", F.lit(""))
    bracketed = F.contains(name, F.lit("(")) | F.contains(name, F.lit("["))
    is_duration = F.lower(F.substring(F.ltrim(value), 1, 1)) == "p"
    rows = cv_params.select(
        F.col("param_id").cast("long").alias("param_id"), F.col("run_id").cast("long").alias("run_id"), "accession", _scan().alias("scan"),
        *[F.when(is_duration, F.regexp_extract(value, duration, k)).otherwise("").alias(x) for k, x in ((1, "h"), (2, "m"), (3, "s"))],
        value.alias("value"), F.regexp_extract(value, number, 0).alias("digits"),
        _spelt(F.coalesce("unit_name", F.lit(""))).alias("unit_name"), F.trim(F.coalesce("unit_accession", F.lit(""))).alias("unit_accession"),
        F.when(bracketed, _spelt(F.regexp_extract(name, r"[\[(]([^\[\]()]*)[\])]\s*$", 1))).otherwise("").alias("suffix"),
    ).join(F.broadcast(dimensions), "accession")
    parts = [_number(F.col(x)) for x in ("h", "m", "s")]
    broken = F.greatest(*[((F.col(x) != "") & p.isNull()).cast("int") for x, p in zip(("h", "m", "s"), parts, strict=True)]) > 0
    n = sum(((F.col(x) != "").cast("int") for x in ("h", "m", "s")), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) * f for p, f in zip(parts, (3600, 60, 1), strict=True)), F.lit(0.0))
    rows = rows.withColumns({
        "number": F.when(broken, F.lit(None).cast("double")).when(n == 1, F.coalesce(*parts)).when(n > 1, total).otherwise(_number(F.trim(F.col("digits")))),
        "tail": F.when(broken, "").when(n > 1, "s").when(F.col("h") != "", "h").when(F.col("m") != "", "min").when(F.col("s") != "", "s").when(F.col("digits") == "", "").otherwise(_spelt(F.expr("substring(value, length(digits) + 1)"))),
    })
    rows = rows.join(_literal(spark, accessions, "dimension, unit_accession, by_accession"), ["dimension", "unit_accession"], "left")
    for text in ("unit_name", "tail", "suffix"):
        rows = rows.join(_literal(spark, spellings, f"dimension, {text}, by_{text}"), ["dimension", text], "left")
    unknown = F.when((F.col("unit_accession") != "") | (F.col("unit_name") != ""), -1)
    return rows.select("param_id", "run_id", "accession", "dimension", "scan", "number", F.coalesce("by_accession", "by_unit_name", "by_tail", "by_suffix", unknown).alias("stated"))


# ---- decoding --------------------------------------------------------------------------------------------------------------------------

_OUT = "param_id long, run_id long, accession string, scan long, number double, unit string, target_unit string, target_value double, basis string"
_DOUBLES = pa.list_(pa.float64())
_KEYS = ["run_id", "accession", "block"]
_BLOCK_KEY = [("run_id", pa.int64()), ("accession", pa.string()), ("block", pa.int64())]


Bounds = list[tuple[int, int]]


def by_run(n_keys: int, solve: Callable[[pa.Table, Bounds], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``solve`` for tables of whole runs of rows that are equal in their first columns, with the runs' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.combine_chunks()
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, bool)
            for c in t.columns[:n_keys]:
                codes = pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = np.flatnonzero(new).tolist()
            held = t.slice(cuts[-1] if cuts else 0)
            if cuts:
                yield from solve(t.slice(0, cuts[-1]), list(zip([0, *cuts], cuts, strict=False))).to_batches()
        if held is not None:
            yield from solve(held, [(0, held.num_rows)]).to_batches()

    return run


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, math.nan).to_numpy()


def _ints(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy()


def decode(cv_params: DataFrame, runs: DataFrame, targets: DataFrame, silent: float = PRIOR) -> DataFrame:
    """One row per cv_param whose accession has a target: number, decoded unit, value in the target unit and what the unit rests on
    (``row``, ``remark``, ``silent``, ``unsupported``)."""
    spark = cv_params.sparkSession
    rows = targets.select("accession", "name", "target_unit_accession").where("accession IS NOT NULL").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = {r["accession"]: (r["name"], d) for r in rows if (d := dimension_of(r["target_unit_accession"]))}
    #: The target's position among the units of its dimension.
    goal = {r["accession"]: _ACCESSIONS[names[r["accession"]][1]][r["target_unit_accession"]] for r in rows if r["accession"] in names}
    table = {a: _conversion(d, goal[a]) for a, (_, d) in names.items()}

    def remarks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(run, a, u) for run, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, u in remark_units(text, names).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["run_id", "accession", "remarked"])

    said = runs.select(F.col("run_id").cast("long"), "remarks").where("remarks IS NOT NULL").mapInArrow(remarks, "run_id long, accession string, remarked int")
    said = said.groupBy("run_id", "accession").agg(F.min("remarked").alias("remarked"))
    wanted = spark.createDataFrame([(r["accession"], names.get(r["accession"], (None, None))[1]) for r in {r["accession"]: r for r in rows}.values()], "accession string, dimension string")
    seen = observations(cv_params, wanted)
    known = seen.where("dimension IS NOT NULL")
    counted = cv_params.select(F.col("run_id").cast("long").alias("run_id"), "accession", _scan().alias("scan")).where("run_id IS NOT NULL").join(F.broadcast(wanted.where("dimension IS NOT NULL")), "accession")
    scans = counted.groupBy("run_id", "accession").agg(F.count(F.lit(1)).alias("n"), F.min("scan").alias("lo"), F.max("scan").alias("hi"))
    several = stored(scans.where(F.col("n") > BLOCK).select("run_id", "accession", "lo", F.ceil((F.col("hi") - F.col("lo") + 1) * BLOCK / F.col("n")).alias("width")))
    cut = not several.isEmpty()
    if cut:
        known = known.join(broadcast_if_small(several), ["run_id", "accession"], "left")
    place = F.coalesce(F.floor((F.col("scan") - F.col("lo")) / F.col("width")), F.lit(0)) if cut else F.lit(0)
    ordered = known.join(broadcast_if_small(said), ["run_id", "accession"], "left").withColumn("block", F.when(F.col("run_id").isNull(), F.col("param_id")).otherwise(place).cast("long"))
    ordered = ordered.select(*_KEYS, "param_id", "scan", "number", "stated", "remarked", F.lit(None).cast("array<double>").alias("carried"))

    def sequenced(df: DataFrame) -> DataFrame:
        return df.repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.col("carried").isNull(), F.col("scan").asc_nulls_first(), "param_id")

    def solve(t: pa.Table, bounds: Bounds) -> pa.Table:
        v = View(t, table)
        states = v.states.copy()
        for a, z in bounds:
            a, seen, at = v.block(a, z)
            if a < z and (seen.pinned == FREE).any():
                states[a:z] = Walk(seen, at, silent).path()
        rows = np.flatnonzero(~v.carries)
        t, states, codes = t.take(rows), states[rows], v.codes[rows]
        labels = [[*(u.name for u in DIMENSIONS[names[a][1]]), "unknown"] for a in v.accessions]
        flat = pa.array([x for own in labels for x in own], pa.string())
        base = np.cumsum([0, *map(len, labels)])[:-1] if labels else np.zeros(0, int)
        goals = np.array([table[a][2] for a in v.accessions], int)
        basis = pa.array(["silent", "remark", "row"]).take(pa.array(np.where(t.column("stated").is_valid(), 2, np.where(t.column("remarked").is_valid(), 1, 0))))
        value = pa.array(v.converted[rows, states], pa.float64(), from_pandas=True)
        keep = [t.column(c) for c in ("param_id", "run_id", "accession", "scan", "number")]
        return pa.table([*keep, flat.take(pa.array(base[codes] + states)), flat.take(pa.array(base[codes] + goals[codes])), value, basis], names=[x.split()[0] for x in _OUT.split(", ")])

    if cut:
        ordered = ordered.unionByName(_carried(sequenced, ordered.join(several, ["run_id", "accession"], "left_semi"), table, silent), allowMissingColumns=True)
    done = sequenced(ordered).mapInArrow(by_run(3, solve), _OUT)
    if len(names) == len({r["accession"] for r in rows}):
        return done
    null = F.lit(None).cast("string")
    rest = seen.where("dimension IS NULL").select("param_id", "run_id", "accession", "scan", "number", null.alias("unit"), null.alias("target_unit"), F.lit(None).cast("double").alias("target_value"), F.lit("unsupported").alias("basis"))
    return done.unionByName(rest)


def _conversion(dimension: str, target: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Factors and offsets from each unit, and from an unknown one, to the target."""
    units = DIMENSIONS[dimension]
    to = units[target]
    return np.array([*(u.factor / to.factor for u in units), math.nan]), np.array([*((u.offset - to.offset) / to.factor for u in units), math.nan]), target


def _logs(converted: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(converted > 0, np.log(np.where(converted > 0, converted, 1.0)), np.nan)


class View:
    """A table's rows as arrays: values in the target unit under each unit and under an unknown one, and observed states."""

    def __init__(self, t: pa.Table, table: dict[str, tuple[np.ndarray, np.ndarray, int]]) -> None:
        self.t, self.table = t, table
        coded = t.column("accession").combine_chunks().dictionary_encode()
        self.accessions = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy()
        width = max((len(table[a][0]) for a in self.accessions), default=1)
        pad = lambda x: np.concatenate([x, np.full(width - len(x), math.nan)])
        factor = np.array([pad(table[a][0]) for a in self.accessions]).reshape(-1, width)
        offset = np.array([pad(table[a][1]) for a in self.accessions]).reshape(-1, width)
        self.x = _floats(t.column("number"))
        self.converted = self.x[:, None] * factor[self.codes] + offset[self.codes]
        self.logs = _logs(self.converted)
        unknown = np.array([len(table[a][0]) - 1 for a in self.accessions], int)[self.codes]
        stated = _ints(t.column("stated"), -2)
        self.states = np.where(stated == -2, _ints(t.column("remarked"), FREE), np.where(stated == -1, unknown, stated))
        #: Rows that hold what is carried to a block; such a row comes first in its block.
        self.carries = t.column("carried").is_valid().to_numpy()

    def block(self, a: int, z: int) -> tuple[int, Seen, Carried]:
        """The first row of a block that isn't its carrier, its rows, and what is carried to it."""
        factor, offset, target = self.table[self.accessions[self.codes[a]]]
        at = Carried()
        if self.carries[a]:
            at = _unpacked(self.t.column("carried")[a].as_py(), factor, offset)
            a += 1
        return a, Seen(self.logs[a:z, : len(factor)], self.states[a:z], target), at


def _unpacked(x: list[float], factor: np.ndarray, offset: np.ndarray) -> Carried:
    entry, last, first, anchored, spread, previous, n = x[:7]
    n = 7 + int(n)
    before = None if math.isnan(previous) else _logs(previous * factor + offset)
    return Carried(int(entry), int(last), bool(first), bool(anchored), spread, before, x[7:n], x[n:])


def _carried(sequenced: Callable, rows: DataFrame, table: dict[str, tuple[np.ndarray, np.ndarray, int]], silent: float) -> DataFrame:
    """``(run_id, accession, block, carried)``: for each block of sequences of several blocks what ``Carried`` holds."""
    reach = NEAR + 1

    def key_of(t: pa.Table, a: int) -> tuple:
        return tuple(t.column(c)[a].as_py() for c in _KEYS)

    def as_table(out: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    sums_schema = pa.schema([*_BLOCK_KEY, ("head", _DOUBLES), ("tail", _DOUBLES), ("steps", _DOUBLES)])
    carried_schema = pa.schema([*_BLOCK_KEY, ("carried", _DOUBLES)])
    product_schema = pa.schema([*carried_schema, ("product", _DOUBLES)])

    def summary(t: pa.Table, bounds: Bounds) -> pa.Table:
        v, out = View(t, table), []
        for a, z in bounds:
            _, seen, _ = v.block(a, z)
            values, d = observed_values(seen)[1].tolist(), steps_of(seen)
            logs = seen.logs[:, seen.target]
            there = ~np.isnan(logs)
            ends = [float(logs[there][0]), float(logs[there][-1]), float(v.x[a:z][there][-1])] if there.any() else [math.nan] * 3
            out.append((*key_of(t, a), values[:reach], values[-reach:], [float(d.sum()), float(len(d)), *ends]))
        return as_table(out, sums_schema)

    def levels(t: pa.Table, bounds: Bounds) -> pa.Table:
        done: list[tuple] = []
        for a, z in bounds:
            blocks = t.slice(a, z - a).to_pylist()
            total = n = 0.0
            near, last, previous = [], math.nan, []
            before: list[float] = []
            number = math.nan
            for b in blocks:
                s, m, first_log, last_log, last_number = b["steps"]
                total, n = total + s, n + m
                if not math.isnan(first_log):
                    if not math.isnan(last):
                        total, n = total + min(1.0, abs(first_log - last)), n + 1
                near.append(before)
                previous.append(number)
                if not math.isnan(first_log):
                    last, number = last_log, last_number
                before = (before + b["tail"])[-reach:]
            after: list[float] = []
            anchored = float(any(b["head"] for b in blocks))
            for i in range(len(blocks) - 1, -1, -1):
                b = blocks[i]
                done.append((b["run_id"], b["accession"], b["block"], [-1.0, -1.0, float(i == 0), anchored, spread_of(total, n), previous[i], float(len(near[i])), *near[i], *after]))
                after = (b["head"] + after)[:reach]
        return as_table(done, carried_schema)

    def product(t: pa.Table, bounds: Bounds) -> pa.Table:
        v, out = View(t, table), []
        for a, z in bounds:
            _, seen, at = v.block(a, z)
            out.append((*key_of(t, a), t.column("carried")[a].as_py(), Walk(seen, at, silent).product().ravel().tolist()))
        return as_table(out, product_schema)

    def joined(t: pa.Table, bounds: Bounds) -> pa.Table:
        out = []
        for a, z in bounds:
            blocks = t.slice(a, z - a).to_pylist()
            k = math.isqrt(len(blocks[0]["product"]))
            states = edges([np.array(b["product"]).reshape(k, k) for b in blocks])
            out += [(b["run_id"], b["accession"], b["block"], [float(entry), float(last), *b["carried"][2:]]) for b, (entry, last) in zip(blocks, states, strict=True)]
        return as_table(out, carried_schema)

    def by_sequence(df: DataFrame) -> DataFrame:
        return df.repartition("run_id", "accession").sortWithinPartitions("run_id", "accession", "block")

    key = "run_id long, accession string, block long, "
    sums = sequenced(rows).mapInArrow(by_run(3, summary), key + "head array<double>, tail array<double>, steps array<double>")
    near = by_sequence(sums).mapInArrow(by_run(2, levels), key + "carried array<double>")
    products = sequenced(rows.unionByName(near, allowMissingColumns=True)).mapInArrow(by_run(3, product), key + "carried array<double>, product array<double>")
    return stored(by_sequence(products).mapInArrow(by_run(2, joined), key + "carried array<double>"))


def found(cv_params: DataFrame, runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``param_id`` of the rows that hold a number in another unit than the target's."""
    return decode(cv_params, runs, targets).where("number IS NOT NULL AND unit <> target_unit").select("param_id")


def switches(cv_params: DataFrame, runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(run_id, accession, unit, basis, n, n_converted)``: what each run used, with little weight on the target unit where nothing is said."""
    return decode(cv_params, runs, targets, silent=SOFT).groupBy("run_id", "accession", "unit", "basis").agg(F.count(F.lit(1)).alias("n"), F.count("target_value").alias("n_converted"))
