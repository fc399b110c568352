import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import drift, gtf_grammar, intervals, nested, units
from helixlake.operators.components import connected_components
from helixlake.operators.gtf_grammar import Fault, Parser
from helixlake.plans.joins import interval_join
from helixlake.runtime import empty


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- components ----------------------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, *edges[:50], (None, 3), (7, 7)], "a int, b int")
    got = connected_components(df).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    assert connected_components(df.where("false")).count() == 0


# ---- p7 ------------------------------------------------------------------------------------------------------------------------------


def brute_gaps(data):
    out = set()
    for name in {r[0] for r in data if r[0] is not None}:
        covered = set()
        for n, a, b in data:
            if n == name and a is not None and b is not None:
                covered |= set(range(min(a, b), max(a, b) + 1))
        if covered:
            free = [p for p in range(min(covered), max(covered) + 1) if p not in covered]
            for p in free:
                if p - 1 not in free:
                    q = p
                    while q + 1 in free:
                        q += 1
                    out.add((name, p, q))
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_gaps(spark, block):
    rng = random.Random(block)
    data = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}", a := rng.randrange(-50, 600), a + rng.randrange(-6, 9)) for _ in range(160)]
    data += [("s1", None, 4), ("s1", 4, None), (None, 1, 2), *data[:20], ("one", 5, 5), ("long", 1, 400), ("long", 3, 4), ("touch", 1, 2), ("touch", 3, 4)]
    df = spark.createDataFrame(data, "seqname string, start_pos long, end_pos long").withColumns({c: F.lit(0) for c in ("entity", "lo", "hi", "block", "n", "carry")})
    got = rows(intervals.gaps(df, block=block))
    assert len(got) == len(set(got)) and set(got) == brute_gaps(data)
    islands = intervals.islands(df, block=block).collect()
    valid = [r for r in data if None not in r]
    assert sum(r.n for r in islands) == len(valid)
    for name in {r[0] for r in valid}:
        own = sorted((r for r in islands if r.seqname == name), key=lambda r: r.island)
        assert [r.island for r in own] == list(range(1, len(own) + 1))
        assert [(a["end"] + 1, b.start - 1) for a, b in zip(own, own[1:])] == sorted(g[1:] for g in got if g[0] == name)
    assert intervals.gaps(df.where("false")).count() == 0


@pytest.mark.parametrize("mode", ["overlaps", "contains"])
def test_interval_join(spark, mode):
    rng = random.Random(3)
    make = lambda n: [("hot" if rng.random() < 0.6 else "x", i, s := rng.randrange(200), s + rng.randrange(40)) for i in range(n)]
    a, b = make(60), [*make(60), (None, 99, 1, 2), ("hot", 98, 5, None), ("hot", 97, 9, 3)]
    left, right = spark.createDataFrame(a, "k string, i int, s int, e int"), spark.createDataFrame(b, "k string, j int, u int, v int")
    hit = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if mode == "overlaps" else (lambda x, y: x[2] <= y[2] and x[3] >= y[3])
    want = sorted((x[1], y[1]) for x in a for y in b if y[0] == x[0] and y[3] is not None and y[2] <= y[3] and hit(x, y))
    assert sorted(map(tuple, interval_join(left, right, "k", ("s", "e"), ("u", "v"), mode, 16).select("i", "j").collect())) == want
    # Lengths of every level, one as long as all positions.
    a = [("hot", i, s := rng.randrange(10**6), s + int(10 ** rng.uniform(0, 7))) for i in range(80)] + [("hot", 80, 0, 10**9)]
    b = [("hot", i, s := rng.randrange(10**6), s + int(10 ** rng.uniform(0, 7))) for i in range(80)] + [("hot", 80, 5, 5), ("hot", 81, -9, 10**9)]
    left, right = spark.createDataFrame(a, "k string, i int, s long, e long"), spark.createDataFrame(b, "k string, j int, u long, v long")
    want = sorted((x[1], y[1]) for x in a for y in b if hit(x, y))
    assert sorted(map(tuple, interval_join(left, right, "k", ("s", "e"), ("u", "v"), mode, 16).select("i", "j").collect())) == want
    with pytest.raises(ValueError, match="mode"):
        interval_join(left, right, "k", ("s", "e"), ("u", "v"), "near")


# ---- p6 ------------------------------------------------------------------------------------------------------------------------------

HEAD = "chr1\tsrc\tCDS\t5\t9\t.\t+\t.\t"


def first(line):
    out = list(Parser(line).parse())
    return (out[0].reason if isinstance(out[0], Fault) else "ok") if out else None


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("", None), ("   ", None), ("# c", None), ("#!x \"y", None), (HEAD + 'a "b"', "ok"), (HEAD + 'a "b";', "ok"), (HEAD + 'a "x;y"; n 5; e ""; ', "ok"), (HEAD + 'a "b";  \r', "ok"),
        (HEAD + 'a "b";c "d";', "ok"), (HEAD + "a -1.5e3", "ok"), ("a\tb", "columns"), ("a b c", "columns"), (HEAD + 'a "b"\t', "columns"), (HEAD + "a\t\"b\"", "columns"),
        (HEAD, "quoting"), (HEAD + "a", "quoting"), (HEAD + "a b", "quoting"), (HEAD + 'a "b', "quoting"), (HEAD + 'a b"', "quoting"), (HEAD + 'a ""b"', "quoting"), (HEAD + 'a "b" "c"', "quoting"),
        (HEAD + 'a "b";; c "d"', "quoting"), (HEAD + "a 'b'", "quoting"), (HEAD + 'a"b"', "quoting"), (HEAD + ".", "quoting"), (HEAD + "a 5x", "quoting"),
        (HEAD.replace("\t.\t+", "\tNaN\t+") + 'a "b"', "value"), (HEAD.replace("\t.\t+", "\t1e999\t+") + 'a "b"', "value"), (HEAD.replace("\t.\t+", "\t-1.5E-3\t+") + 'a "b"', "ok"),
        (HEAD.replace("\t.\t+", "\t\t+") + 'a "b"', "value"), (HEAD.replace("+\t.", "+\t3") + 'a "b"', "value"), (HEAD.replace("+\t.", "+\t01") + 'a "b"', "value"),
        (HEAD.replace("5\t9", "9\t5") + 'a "b"', "value"), (HEAD.replace("5\t9", "0\t9") + 'a "b"', "value"), (HEAD.replace("5\t9", "-5\t9") + 'a "b"', "value"), (HEAD.replace("5\t9", "5.0\t9") + 'a "b"', "value"),
        (HEAD.replace("5\t9", "x\t9") + 'a "b', "quoting"), (HEAD.replace("5\t9", "9\t5") + "\t", "columns"), (HEAD.replace("5\t9", "1\t" + "9" * 40) + 'a "b"', "value"), (HEAD.replace("5\t9", "٣\t9") + 'a "b"', "value"),
    ],
)
def test_grammar(line, want):
    assert first(line) == want


def test_grammar_recovers():
    good = HEAD + 'a "b";'
    text = "\n".join([good, HEAD + 'a "broken; b "c', "rest of it", 'still"; x', good.replace("chr1", "chr2"), "# c", "x\ty", good])
    out = list(Parser(text).parse())
    assert [type(x).__name__ if not isinstance(x, Fault) else x.reason for x in out] == ["Record", "quoting", "columns", "columns", "Record", "columns", "Record"]
    assert out[2].message.startswith("remains") and not out[5].message.startswith("remains")
    assert out[4].seqname == "chr2" and text[out[1].at :].startswith("c\nrest of it")


def test_parse_lines(spark):
    long = HEAD + 'note "' + "x" * 200_000 + '";'
    df = spark.createDataFrame([(1, HEAD + 'a "b"; a "c";'), (2, None), (3, "x"), (3, "x"), (4, long), (None, "y")], "line_id long, line string").withColumn("reason", F.lit("clash"))
    r = gtf_grammar.records(df).orderBy("line_id").collect()
    assert [x.line_id for x in r] == [1, 4] and r[0].attributes == {"a": "b"} and r[0].score is None and len(r[1].attributes["note"]) == 200_000
    assert sorted((x.line_id or 0, x.reason) for x in gtf_grammar.faults(df).collect()) == [(0, "columns"), (3, "columns"), (3, "columns")]
    assert gtf_grammar.parse(df.where("false")).count() == 0
    # A broken quote in one row doesn't reach the next, and what is found is traced to its row and the place in it.
    bad = HEAD + 'a "b; c'
    df = spark.createDataFrame([(1, bad), (2, "rest"), (3, HEAD + 'a "b"'), (4, bad + "\nmore\n" + HEAD + 'c "d"'), (5, "\t0\t" + HEAD), (6, HEAD.replace("5\t9", "0000000000000000001\t1000000000000000005") + 'a "b"')], "line_id long, line string").coalesce(1)
    got = [(r.line_id, r.record_no, r.reason, r.error_at) for r in gtf_grammar.parse(df).collect()]
    assert got == [(1, 0, "quoting", bad.index('"')), (2, 0, "columns", 0), (3, 0, None, None), (4, 0, "quoting", bad.index('"')), (4, 1, "columns", len(bad) + 1), (4, 2, None, None), (5, 0, "columns", 0), (6, 0, None, None)]


# ---- p4 ------------------------------------------------------------------------------------------------------------------------------

CV = [("A", "a", "1"), None, ("B", "b", None)]


def spectra(spark):
    ion = lambda *cv: (list(cv),)
    prec = lambda ions, ref="r": (ref, [("W", "w", "2")], ions, None)
    as_json = {"precursor_list": {"count": 1, "precursors": {"spectrum_ref": "j", "selected_ions": {"cv_params": {"accession": "A", "name": "a", "value": 5}}, "activation": []}}}
    listed = [None, {"selected_ions": [None, {"cv_params": [None, {"accession": "Z"}]}, {}]}]
    data = [
        (1, [prec([ion(*CV), None, (None,), ion()]), None, prec(None), prec([ion(("C", "c", "3"))], None)], None, [1.0, 2.0], [5.0], CV),
        (2, None, json.dumps(as_json), None, None, None),
        (3, None, json.dumps(listed), [], [7.0], []),
        (4, None, "not json", None, None, None),
        (5, None, None, None, None, None),
        (6, [], json.dumps(as_json), None, None, None),
        (7, None, "[]", None, None, None),
        (7, None, json.dumps(listed), None, None, None),
    ]
    cv = "array<struct<accession:string,name:string,value:string>>"
    schema = (
        f"spectrum_key long, precursors array<struct<spectrum_ref:string,isolation_window:{cv},selected_ions:array<struct<cv_params:{cv}>>,activation:{cv}>>, precursor_json string, "
        f"m array<double>, i array<double>, cv_params {cv}"
    )
    df = spark.createDataFrame(data, schema)
    wrap = lambda c, n: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias(n))).alias(n)
    return df.select("spectrum_key", "precursors", "precursor_json", wrap("m", "mz"), wrap("i", "intensity"), "cv_params", F.lit(0).alias("precursor_ix"), F.lit(0).alias("ion_ix"))


def test_nested(spark):
    df = spectra(spark)
    assert rows(nested.ion_params(df).select("spectrum_key", "precursor_ix", "ion_ix", "param_ix", "accession", "value")) == sorted(
        [(1, 0, 0, 0, "A", "1"), (1, 0, 0, 2, "B", None), (1, 3, 0, 0, "C", "3"), (2, 0, 0, 0, "A", "5"), (3, 1, 1, 1, "Z", None), (7, 1, 1, 1, "Z", None)], key=repr
    )
    assert rows(nested.ions(df)) == sorted([(1, 0, 0, 3), (1, 0, 2, 0), (1, 0, 3, 0), (1, 3, 0, 1), (2, 0, 0, 1), (3, 1, 1, 2), (3, 1, 2, 0), (7, 1, 1, 2), (7, 1, 2, 0)], key=repr)
    assert [r[:3] for r in rows(nested.precursors(df))] == sorted([(1, 0, "r"), (1, 2, "r"), (1, 3, None), (2, 0, "j"), (3, 1, None), (7, 1, None)], key=repr)
    assert rows(nested.precursor_params(df, "isolation_window").select("spectrum_key", "precursor_ix", "param_ix")) == [(1, 0, 0), (1, 2, 0), (1, 3, 0)]
    assert rows(nested.params(df).select("spectrum_key", "param_ix", "accession")) == [(1, 0, "A"), (1, 2, "B")]
    assert rows(nested.peaks(df)) == [(1, 0, 1.0, 5.0), (1, 1, 2.0, None), (3, 0, None, 7.0)]
    assert nested.ion_params(df.where("false")).count() == 0


# ---- p1 ------------------------------------------------------------------------------------------------------------------------------

NAMES = {"MS:1000016": ("scan start time", "time"), "MS:9900101": ("source temperature", "temperature"), "MS:1000045": ("collision energy", "energy"), "MS:1000505": ("base peak intensity", "counts")}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, (None, "")), ("", (None, "")), ("n/a", (None, "")), ("12", (12.0, "")), ("1,5 min", (1.5, "min")), ("1.234,5x", (1234.5, "x")), ("1,234.5", (1234.5, "")), ("-3e2eV", (-300.0, "eV")),
        ("PT2.5M", (2.5, "min")), ("PT1H30M", (5400.0, "s")), ("7 x 10^3 counts", (7.0, "x 10^3 counts")), ("−4 °C", (-4.0, "°C")), ("P", (None, "")),
    ],
)
def test_numbers(value, want):
    assert units.number_and_unit(value, "time") == want


def test_stated_units():
    time = lambda *a: units.stated_unit("time", *a)
    assert time("MS", None, None, None) == 1 and time("", "scan start time [hrs]", None, None) == 5 and time("", "x", " Sec. ", None) == 0 and time("", "x", None, "UO:0000031") == 4
    assert time("", "x (odd)", None, None) is None and time("", "x", None, "UO:1234567") == -1 and time("", "x", "parsecs", None) == -1


def test_remarks():
    say = lambda t: {NAMES[a][0]: units.DIMENSIONS[NAMES[a][1]][u].name for a, u in units.remark_units(t, NAMES).items()}
    assert say("Scan times given in minutes throughout. temps of the source in °F") == {"scan start time": "minute", "source temperature": "degree Fahrenheit"}
    assert say("Pump purge 5 min before start. Column oven kept at 40 °C, not logged.") == {} and say(None) == {} and say("Source temperature steady. Column in celsius") == {}
    assert say("Collision energy raised by 20 eV; peak intensities are kcounts") == {"base peak intensity": "thousand counts"}


def unit_tables(spark, params, remarks):
    cv = spark.createDataFrame(params, "param_id long, run_id long, spectrum_id string, accession string, name string, value string, unit_accession string, unit_name string")
    runs = spark.createDataFrame(remarks, "run_id long, remarks string")
    targets = spark.createDataFrame([("MS:1000016", "scan start time", "UO:0000010"), ("MS:9900101", "source temperature", "UO:0000012")], "accession string, name string, target_unit_accession string")
    return cv.withColumns({"block": F.lit(1), "scan": F.lit(1), "remarked": F.lit(1)}), runs, targets


def test_units(spark):
    t, k = "MS:1000016", "MS:9900101"
    params = [
        (1, 1, "run=1 scan=1", t, "scan start time", "2 min", None, None), (2, 1, "run=1 scan=2", t, "scan start time", "3", None, None), (3, 1, "run=1 scan=3", t, "scan start time", "4", "UO:0000010", "second"),
        (4, 1, "run=1 scan=4", t, "scan start time", "n/a", None, "hour"), (5, 2, "run=2 scan=1", t, "scan start time", "5", None, None), (6, 2, "run=2 scan=2", k, "source temperature", "25", None, "°C"),
        (7, 2, "run=2 scan=2", k, "source temperature", "77", None, None), (8, None, None, k, "source temperature [degF]", "32", None, None), (9, 2, "x", "MS:0", "other", "1 min", None, None),
        (10, 1, "run=1 scan=1", t, "scan start time", "2 min", None, None), (11, 2, "run=2 scan=9", t, "scan start time", "1", "UO:9999999", None), (12, 2, "run=2 scan=9", t, "scan start time", None, None, None),
    ]
    tables = unit_tables(spark, params, [(1, "Retention times in this export are minutes."), (2, "temps of the source in °F"), (3, None)])
    got = {r.param_id: r for r in units.decode(*tables).collect()}
    assert set(got) == set(range(1, 13)) - {9}
    assert (got[1].target_value, got[2].target_value, got[3].target_value, got[5].target_value) == (120, 180, 4, 5)
    assert round(got[6].target_value, 2) == 298.15 and round(got[7].target_value, 2) == 298.15 and round(got[8].target_value, 2) == 273.15
    assert (got[4].number, got[4].unit, got[11].unit, got[11].target_value, got[12].number) == (None, "hour", "unknown", None, None)
    assert [got[i].basis for i in (1, 2, 5, 7)] == ["row", "remark", "silent", "remark"]
    assert sorted(r[0] for r in units.found(*tables).collect()) == [1, 2, 6, 7, 8, 10, 11]
    assert units.found(tables[0].where("false"), *tables[1:]).count() == 0 and units.found(tables[0], tables[1], tables[2].where("false")).count() == 0


def test_soft_decoding_follows_jumps(spark):
    """Where nothing is stated the level of the stated rows decides, in stretches."""
    said = [(i, 1, f"scan={i}", "MS:1000016", "t", str(600 + i % 5), "UO:0000010", None) for i in range(0, 60, 3) if not 20 <= i < 40]
    silent = [(i, 1, f"scan={i}", "MS:1000016", "t", str((600 + i % 5) / (60 if 20 <= i < 40 else 1)), None, None) for i in range(60) if i % 3 or 20 <= i < 40]
    got = {r.param_id: r.unit for r in units.decode(*unit_tables(spark, said + silent, [(1, None)]), silent=units.SOFT).collect()}
    assert {i for i, u in got.items() if u == "minute"} == set(range(20, 40))


def test_blocks_decode_like_whole_sequences(spark, monkeypatch):
    rng, params = random.Random(3), []
    for run in (1, 2, 3):
        minutes = False
        for i in range(250):
            minutes ^= rng.random() < 0.03
            stated = i < 5 if run == 1 else rng.random() < 0.02
            value = str(rng.uniform(500, 700) / (60 if minutes and not stated else 1))
            params.append((len(params), run, f"scan={i}", "MS:1000016", "t", value, "UO:0000010" if stated else None, None))
    params.append((len(params), None, "scan=1", "MS:1000016", "t", "3", None, None))
    tables = unit_tables(spark, params, [(1, None)])
    whole = {r.param_id: r for r in units.decode(*tables, silent=units.SOFT).collect()}
    assert {r.unit for r in whole.values()} == {"second", "minute"} and len(whole) == len(params)
    monkeypatch.setattr(units, "BLOCK", 7)
    assert {r.param_id: r for r in units.decode(*tables, silent=units.SOFT).collect()} == whole


def silent_jump(n=399, at=200):
    """Silent scan times that rise slowly and jump by a factor of 60 at row ``at``."""
    return [(i, 1, f"scan={i}", "MS:1000016", "t", str((600 + i / 10 + i % 3) / (60 if i >= at else 1)), None, None) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 50])
def test_a_silent_jump_is_a_switch(spark, monkeypatch, block):
    monkeypatch.setattr(units, "BLOCK", block)
    got = {r.param_id: (r.unit, r.basis) for r in units.decode(*unit_tables(spark, silent_jump(), [(1, None)])).collect()}
    assert {i for i, (u, _) in got.items() if u == "minute"} == set(range(200, 399)) and {b for _, b in got.values()} == {"silent"}


def test_without_viterbi_the_jump_is_lost():
    """Ablation: the cheapest state of each row by itself is the target unit everywhere."""
    factor, offset, target = units._conversion("time", 0)
    x = np.array([float(r[5]) for r in silent_jump()])
    seen = units.Seen(units._logs(x[:, None] * factor + offset), np.full(len(x), units.FREE), target)
    emit, _ = units.costs(seen, units.Carried(), units.PRIOR)
    assert set(emit.argmin(axis=1).tolist()) == {target} and len(set(units.Walk(seen, units.Carried(), units.PRIOR).path().tolist())) == 2


def test_noisy_silence_means_the_target(spark):
    """Values that scatter as widely as the units differ aren't decoded as switches."""
    rng = random.Random(4)
    rows_ = [(i, 1, f"scan={i}", "MS:1000016", "t", str(math.exp(rng.uniform(1.6, 8.8))), "UO:0000031" if i % 20 == 5 else "UO:0000010" if i % 3 else None, None) for i in range(600)]
    got = {r.param_id: r.unit for r in units.decode(*unit_tables(spark, rows_, [(1, None)])).collect()}
    assert {got[i] for i in range(600) if rows_[i][6] is None} == {"second"}


def test_native_reading_agrees_with_python(spark):
    values = [None, "", "n/a", "12", "1,5 min", "1.234,5x", "1,234.5", "-3e2eV", "PT2.5M", "PT1H30M", "pt5s", "7 x 10^3 counts", "−4 °C", "P", "PT", "PT1.2.3H", " 5  S ", "1.2.3", "3 Micro sec", ".5h", "1e999", "5 μs"]
    cells = [(v, n, u, a) for v in values for n in (None, "scan [hrs]", "scan (odd)") for u in (None, " Sec. ", "parsecs", "") for a in (None, "UO:0000031 ", "UO:9")]
    df = spark.createDataFrame([(i, 1, None, "MS:1", n, v, a, u) for i, (v, n, u, a) in enumerate(cells)], "param_id long, run_id long, spectrum_id string, accession string, name string, value string, unit_accession string, unit_name string")
    got = {r.param_id: (r.number, r.stated) for r in units.observations(df, spark.createDataFrame([("MS:1", "time")], "accession string, dimension string")).collect()}
    for i, (v, n, u, a) in enumerate(cells):
        x, tail = units.number_and_unit(v, "time")
        assert got[i] == (x, units.stated_unit("time", tail, n, u, a)), cells[i]


def test_an_unsupported_target_keeps_its_rows(spark):
    cv, runs, targets = unit_tables(spark, [(1, 1, "scan=1", "MS:7", "flow", "3 ul/min", None, None)], [(1, None)])
    targets = targets.unionByName(spark.createDataFrame([("MS:7", "flow", "UO:0000271")], targets.schema))
    assert [(r.number, r.unit, r.target_value, r.basis) for r in units.decode(cv, runs, targets).collect()] == [(3.0, None, None, "unsupported")]
    assert units.found(cv, runs, targets).count() == 0


# ---- p5 ------------------------------------------------------------------------------------------------------------------------------


def drift_tables(spark):
    at = lambda d: datetime(2024, 1, d)
    files = [(1, "SAM", "f", at(1)), (2, "SAM", "f", at(3)), (3, "SAM", "f", at(2)), (4, "VCF", "g", at(1)), (5, "VCF", "g", at(2)), (6, "SAM", "f", at(4)), (7, "GTF", "h", at(1)), (8, "SAM", None, at(1)), (9, "SAM", "f", None)]
    info = lambda i, n, t, d: f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">'
    headers = [
        (4, 1, info("DP", "1", "Integer", "Raw  depth")), (4, 2, info("AF", "A", "Float", "freq")), (4, 3, info("OLD", ".", "String", "x")), (4, 4, info("DP", "1", "Float", "again")),
        (5, 1, info("COV", "1", "Integer", "raw DEPTH ")), (5, 2, info("AF", "1", "Float", "freq")), (5, 3, info("NEW", ".", "String", "y, \\\"z\\\"")),
        (2, 1, "@CO\tno tags were renamed, see NM"), (6, 1, "@CO\tYY (formerly XX)"), (6, 2, "@CO\tlane re-run, NM kept in place of nothing"), (None, 1, None), (3, 1, None),
    ]
    tags = lambda **t: [{"tag": k, "value": v} for k, v in t.items()]
    reads = [
        (1, 1, tags(NM="1", XX="a")), (2, 1, tags(NM="+2", XX="b")), (3, 3, tags(NM="1.5", XX="b", RG="r")), (4, 2, tags(NM="2", XX="z")), (5, 6, tags(NM="1", YY="q", BC="5")),
        (6, 1, None), (7, 1, []), (8, None, tags(NM="1")), (9, 8, tags(NM="x")), (10, 1, [None, {"tag": None, "value": "1"}, {"tag": "NM", "value": None}]), (4, 2, tags(NM="2", XX="z")),
    ]
    s = spark.createDataFrame
    return (
        s(reads, "read_id long, file_id long, tags array<struct<tag:string,value:string>>").withColumns({"names": F.lit(1), "field": F.lit("c"), "k": F.lit(0)}),
        s(headers, "file_id long, line_no int, line string"),
        s(files, "file_id long, file_format string, feed string, written_at timestamp_ntz"),
    )


def test_drift(spark):
    reads, headers, files = drift_tables(spark)
    got = rows(drift.changes(reads, headers, files))
    assert got == sorted(
        [
            (3, "NM", "retyped", None), (3, "RG", "added", None), (2, "NM", "retyped", None), (2, "RG", "removed", None), (6, "YY", "renamed", "XX"), (6, "BC", "added", None),
            (5, "COV", "renamed", "DP"), (5, "AF", "retyped", None), (5, "NEW", "added", None), (5, "OLD", "removed", None),
        ], key=repr,
    )
    versions = {r.file_id: r for r in drift.fingerprints(reads, headers, files).collect()}
    assert [versions[i].version for i in (1, 3, 2, 6)] == [1, 2, 3, 4] and versions[1].fingerprint == versions[2].fingerprint != versions[3].fingerprint and versions[5].n_changes == 4
    table = drift.sam_table(reads, headers, files)
    assert set(table.columns) == {"read_id", "file_id", "NM", "YY", "RG", "BC", "unplaced"} and table.count() == reads.count()
    first = table.where("read_id = 1").first()
    assert (first.NM, first.YY, first.RG, dict(table.dtypes)["NM"], dict(table.dtypes)["BC"]) == (1.0, "a", None, "double", "bigint")
    variants = spark.createDataFrame([(1, 4, "DP=5;AF=0.5,0.1;OLD=q"), (2, 5, "COV=x;NEW"), (3, 5, None), (3, 5, None)], "variant_id long, file_id long, info string")
    v = drift.vcf_table(variants, reads, headers, files).orderBy("variant_id").collect()
    assert len(v) == 4 and (v[0].COV, v[0].AF, v[0].OLD, v[1].COV, v[1].NEW, v[2].COV) == (5, "0.5,0.1", "q", None, "true", None)
    assert [r.unplaced for r in v] == [None, ["COV=x"], None, None]
    steps = {(r.file_id, r.field): r for r in drift.migrations(reads, headers, files).collect()}
    assert len(steps) == len(got) and (steps[6, "YY"].operation, steps[6, "YY"].old_name, steps[3, "NM"].old_type, steps[3, "NM"].new_type) == ("renamed", "XX", "integer", "decimal")
    assert all(r.from_fingerprint != r.to_fingerprint for r in steps.values())


def test_surplus_values_are_kept(spark):
    """Old and new name together, a repeated tag and a number beyond a long find no column."""
    reads, headers, files = drift_tables(spark)
    more = spark.createDataFrame([(20, 6, [("XX", "a"), ("YY", "b"), ("NM", "1"), ("NM", "2"), ("BC", "9" * 30)])], "read_id long, file_id long, tags array<struct<tag:string,value:string>>")
    r = drift.sam_table(reads.unionByName(more, allowMissingColumns=True), headers, files).where("read_id = 20").first()
    assert (r.NM, r.BC) == (1.0, None) and {"NM=2", "BC=" + "9" * 30} <= set(r.unplaced)


def test_comments_that_rename_several(spark):
    s, at = spark.createDataFrame, lambda d: datetime(2024, 1, d)
    files = s([(1, "SAM", "f", at(1)), (2, "SAM", "f", at(2))], "file_id long, file_format string, feed string, written_at timestamp_ntz")
    tags = lambda *t: [(x, "1") for x in t]
    reads = s([(1, 1, tags("AA", "BB", "EE")), (2, 2, tags("CC", "DD", "FF"))], "read_id long, file_id long, tags array<struct<tag:string,value:string>>")
    for line, want in [("@CO\tAA, BB are now called CC, DD", {("CC", "AA"), ("DD", "BB")}), ("@CO\tCC replaces AA; DD replaces BB", {("CC", "AA"), ("DD", "BB")}), ("@CO\tCC: CC replaces AA", {("CC", "AA")})]:
        headers = s([(2, 1, line)], "file_id long, line_no int, line string")
        assert {(r.field_name, r.old_name) for r in drift.changes(reads, headers, files).collect() if r.change_kind == "renamed"} == want


def test_drift_empty(spark):
    reads, headers, files = (x.where("false") for x in drift_tables(spark))
    assert drift.changes(reads, headers, files).count() == 0 and drift.sam_table(reads, headers, files).columns == ["read_id", "file_id", "unplaced"]
    assert empty(spark, "a int").count() == 0
