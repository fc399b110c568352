"""Problem 4: nested spectra as flat related tables.

Arrow-buffer flattening.  A level of nesting is a list array; its value lengths give, by ``repeat`` and a running sum, each child's
parent row and position, and the parent's keys follow by a vectorised take.  Struct levels cost nothing.  No row of the nested column
is turned into Python objects; only ``precursor_json``, which is text, is parsed and becomes the same Arrow type first.  Each table
reads the columns that it needs and nothing is shuffled.

Null lists and empty lists give no children.  Null members keep their position and give no row.  An object in place of a list is a
list of one; so is ``precursor_list`` with its ``precursors``.  If both forms are present the nested column counts.  Text that isn't
JSON, or holds no objects, gives no rows.  Peak arrays of unequal length give peaks up to the longer, null where one has ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CV = pa.struct([("accession", pa.string()), ("name", pa.string()), ("value", pa.string())])
ION = pa.struct([("cv_params", pa.list_(CV))])
PRECURSOR = pa.struct([("spectrum_ref", pa.string()), ("isolation_window", pa.list_(CV)), ("selected_ions", pa.list_(ION)), ("activation", pa.list_(CV))])
PRECURSORS = pa.list_(PRECURSOR)


class Level:
    """A column of values with the keys of each: the row it comes from and its positions in the lists above."""

    def __init__(self, values: pa.Array, row: np.ndarray, at: list[np.ndarray]) -> None:
        self.values, self.row, self.at = values, row, at

    def field(self, name: str) -> Level:
        return Level(pc.struct_field(self.values, name), self.row, self.at)

    def explode(self) -> Level:
        """One entry per list member, members that are null left out."""
        n = pc.fill_null(pc.list_value_length(self.values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parent = np.repeat(np.arange(len(n)), n)
        ix = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        values = pc.list_flatten(self.values)
        there = pc.is_valid(values).to_numpy(zero_copy_only=False)
        return Level(values.filter(pa.array(there)), self.row[parent][there], [*(a[parent][there] for a in self.at), ix[there]])


def _listed(x: object) -> list | None:
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else None


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def _cv(x: object) -> list[dict | None] | None:
    members = _listed(x)
    return members and [{k: _text(m.get(k)) for k in ("accession", "name", "value")} if isinstance(m, dict) else None for m in members]


def from_json(text: str | None) -> list[dict | None] | None:
    """Precursors of a JSON text in the shape of ``PRECURSORS``; None if there are none."""
    try:
        x = json.loads(text) if text else None
    except ValueError:
        return None
    for key in ("precursor_list", "precursors"):
        if isinstance(x, dict) and key in x:
            x = x[key]
    members = _listed(x)
    if members is None:
        return None
    out: list[dict | None] = []
    for p in members:
        if not isinstance(p, dict):
            out.append(None)
            continue
        ions = _listed(p.get("selected_ions"))
        out.append({
            "spectrum_ref": _text(p.get("spectrum_ref")),
            "isolation_window": _cv(p.get("isolation_window")),
            "selected_ions": ions and [{"cv_params": _cv(i.get("cv_params"))} if isinstance(i, dict) else None for i in ions],
            "activation": _cv(p.get("activation")),
        })
    return out


def _precursors(batch: pa.RecordBatch) -> Level:
    nested, text = batch.column("precursors").cast(PRECURSORS), batch.column("precursor_json")
    use = pc.and_(pc.is_null(nested), pc.is_valid(text))
    if pc.any(use).as_py():
        parsed = pa.array([from_json(t) if u else None for t, u in zip(text.to_pylist(), use.to_pylist(), strict=True)], PRECURSORS)
        nested = pa.concat_arrays([nested, parsed]).take(pc.if_else(use, pa.array(np.arange(len(use)) + len(use)), pa.array(np.arange(len(use)))))
    return Level(nested, np.arange(batch.num_rows), [])


def _table(spectra: DataFrame, columns: list[str], schema: str, build: Callable[[pa.RecordBatch], tuple[Level, list[pa.Array]]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, values = build(batch)
            keys = [batch.column(0).take(pa.array(level.row))] + [pa.array(a.astype(np.int32)) for a in level.at]
            yield pa.RecordBatch.from_arrays([*keys, *values], names)

    return spectra.select(F.col("spectrum_key").cast("long"), *columns).mapInArrow(run, schema)


def _cv_columns(level: Level) -> tuple[Level, list[pa.Array]]:
    return level, [pc.struct_field(level.values, k) for k in ("accession", "name", "value")]


_PARAM = "accession string, name string, value string"


def ion_params(spectra: DataFrame) -> DataFrame:
    """``spectrum_key, precursor_ix, ion_ix, param_ix, accession, name, value``: parameters of selected ions."""
    build = lambda b: _cv_columns(_precursors(b).explode().field("selected_ions").explode().field("cv_params").explode())
    return _table(spectra, ["precursors", "precursor_json"], f"spectrum_key long, precursor_ix int, ion_ix int, param_ix int, {_PARAM}", build)


def ions(spectra: DataFrame) -> DataFrame:
    """``spectrum_key, precursor_ix, ion_ix, n_params``: selected ions."""

    def build(b: pa.RecordBatch) -> tuple[Level, list[pa.Array]]:
        level = _precursors(b).explode().field("selected_ions").explode()
        return level, [pc.fill_null(pc.list_value_length(pc.struct_field(level.values, "cv_params")), 0)]

    return _table(spectra, ["precursors", "precursor_json"], "spectrum_key long, precursor_ix int, ion_ix int, n_params int", build)


def precursors(spectra: DataFrame) -> DataFrame:
    """``spectrum_key, precursor_ix, spectrum_ref, n_ions``."""

    def build(b: pa.RecordBatch) -> tuple[Level, list[pa.Array]]:
        level = _precursors(b).explode()
        return level, [pc.struct_field(level.values, "spectrum_ref"), pc.fill_null(pc.list_value_length(pc.struct_field(level.values, "selected_ions")), 0)]

    return _table(spectra, ["precursors", "precursor_json"], "spectrum_key long, precursor_ix int, spectrum_ref string, n_ions int", build)


def precursor_params(spectra: DataFrame, part: str) -> DataFrame:
    """``spectrum_key, precursor_ix, param_ix, accession, name, value`` of ``isolation_window`` or ``activation``."""
    build = lambda b: _cv_columns(_precursors(b).explode().field(part).explode())
    return _table(spectra, ["precursors", "precursor_json"], f"spectrum_key long, precursor_ix int, param_ix int, {_PARAM}", build)


def params(spectra: DataFrame) -> DataFrame:
    """``spectrum_key, param_ix, accession, name, value``: parameters of the spectrum itself."""
    build = lambda b: _cv_columns(Level(b.column(1).cast(pa.list_(CV)), np.arange(b.num_rows), []).explode())
    return _table(spectra, ["cv_params"], f"spectrum_key long, param_ix int, {_PARAM}", build)


def peaks(spectra: DataFrame) -> DataFrame:
    """``spectrum_key, peak_ix, mz, intensity``."""

    def build(b: pa.RecordBatch) -> tuple[Level, list[pa.Array]]:
        lists = [pc.struct_field(b.column("mz"), "mz"), pc.struct_field(b.column("intensity"), "intensity")]
        n = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        longest = np.maximum(*n)
        row = np.repeat(np.arange(b.num_rows), longest)
        ix = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest)
        values = []
        for x, k in zip(lists, n, strict=True):
            at = (np.cumsum(k) - k)[row] + ix
            values.append(pc.list_flatten(x).take(pa.array(at, mask=ix >= k[row])))
        return Level(None, row, [ix]), values

    return _table(spectra, ["mz", "intensity"], "spectrum_key long, peak_ix int, mz double, intensity double", build)


def spectra_table(spectra: DataFrame) -> DataFrame:
    """The scalar columns of every spectrum, with the count of its peaks."""
    n = lambda c: F.coalesce(F.size(F.col(f"{c}.{c}")), F.lit(0))
    return spectra.select("spectrum_key", "run_id", "id", "precursor_mz", "precusor_charge", F.greatest(n("mz"), n("intensity"), F.lit(0)).alias("n_peaks"), "loaded_at")
