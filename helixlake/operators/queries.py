"""Queries of the general data-cleaning operators and the SQL that states the same results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators import drift, gtf_grammar, intervals, nested, units
from helixlake.runtime import table


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "cv_params"), table(spark, d, "ms_runs"), table(spark, d, "unit_targets")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found(*_units(spark, d))


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    return units.decode(*_units(spark, d))


def p1_switches(spark: SparkSession, d: str) -> DataFrame:
    return units.switches(*_units(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.ion_params(table(spark, d, "spectra")).select("spectrum_key", "precursor_ix", "ion_ix", "param_ix")


def p4_ion_params(spark: SparkSession, d: str) -> DataFrame:
    return nested.ion_params(table(spark, d, "spectra"))


def p4_ions(spark: SparkSession, d: str) -> DataFrame:
    return nested.ions(table(spark, d, "spectra"))


def p4_precursors(spark: SparkSession, d: str) -> DataFrame:
    return nested.precursors(table(spark, d, "spectra"))


def p4_isolation_windows(spark: SparkSession, d: str) -> DataFrame:
    return nested.precursor_params(table(spark, d, "spectra"), "isolation_window")


def p4_activations(spark: SparkSession, d: str) -> DataFrame:
    return nested.precursor_params(table(spark, d, "spectra"), "activation")


def p4_params(spark: SparkSession, d: str) -> DataFrame:
    return nested.params(table(spark, d, "spectra"))


def p4_peaks(spark: SparkSession, d: str) -> DataFrame:
    return nested.peaks(table(spark, d, "spectra"))


def p4_spectra(spark: SparkSession, d: str) -> DataFrame:
    return nested.spectra_table(table(spark, d, "spectra"))


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "reads"), table(spark, d, "file_headers"), table(spark, d, "source_files")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(*_drift(spark, d)).select("file_id", "field_name", "change_kind")


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(*_drift(spark, d))


def p5_migrations(spark: SparkSession, d: str) -> DataFrame:
    return drift.migrations(*_drift(spark, d)).drop("old_name", "old_type", "new_type")


def p5_sam_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.sam_table(*_drift(spark, d))


def p5_vcf_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.vcf_table(table(spark, d, "variants"), *_drift(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    first = gtf_grammar.faults(table(spark, d, "gtf_lines")).groupBy("line_id").agg(F.min_by("reason", "record_no").alias("reason"))
    return first


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return gtf_grammar.records(table(spark, d, "gtf_lines")).withColumn("n_attributes", F.size("attributes")).drop("record_no", "attributes")


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    return gtf_grammar.faults(table(spark, d, "gtf_lines")).select("line_id", "record_no", "reason")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(table(spark, d, "gtf_features"))


def p7_islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(table(spark, d, "gtf_features"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_converted, p1_switches, p4_found, p4_ion_params, p4_ions, p4_precursors, p4_isolation_windows, p4_activations, p4_params, p4_peaks, p4_spectra,
        p5_found, p5_versions, p5_migrations, p5_sam_table, p5_vcf_table, p6_found, p6_records, p6_faults, p7_found, p7_islands,
    )
}

_SWEEP = """
WITH s AS (
  SELECT seqname, least(start_pos, end_pos) AS lo, greatest(start_pos, end_pos) AS hi
  FROM gtf_features WHERE seqname IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL
), w AS (
  SELECT *, max(hi) OVER (PARTITION BY seqname ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s
)"""
_LIST = "CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END"
_LEVELS = f"""
WITH j AS (SELECT spectrum_key, CASE WHEN precursors IS NOT NULL THEN to_json(precursors) ELSE TRY_CAST(precursor_json AS JSON) END AS x FROM spectra),
k AS (SELECT spectrum_key, CASE WHEN json_exists(x, '$.precursor_list') THEN json_extract(x, '$.precursor_list.precursors') ELSE x END AS x FROM j),
pl AS (SELECT spectrum_key, {_LIST.format(x='x')} AS l FROM k),
p AS (SELECT spectrum_key, generate_subscripts(l, 1) - 1 AS precursor_ix, unnest(l) AS p FROM pl),
il AS (SELECT spectrum_key, precursor_ix, {_LIST.format(x="json_extract(p, '$.selected_ions')")} AS l FROM p WHERE json_type(p) = 'OBJECT'),
i AS (SELECT spectrum_key, precursor_ix, generate_subscripts(l, 1) - 1 AS ion_ix, unnest(l) AS i FROM il),
cl AS (SELECT spectrum_key, precursor_ix, ion_ix, {_LIST.format(x="json_extract(i, '$.cv_params')")} AS l FROM i WHERE json_type(i) = 'OBJECT'),
c AS (SELECT spectrum_key, precursor_ix, ion_ix, generate_subscripts(l, 1) - 1 AS param_ix, unnest(l) AS c FROM cl)"""
_KEYS = "spectrum_key, CAST(precursor_ix AS INTEGER) AS precursor_ix, CAST(ion_ix AS INTEGER) AS ion_ix, CAST(param_ix AS INTEGER) AS param_ix"
_PAIR = r'[^ ";]+ +("[^"]*"|[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?) *'
_GTF = f"""
WITH l AS (SELECT line_id, string_split(regexp_replace(line, '[ \\r]+$', ''), chr(9)) AS f FROM gtf_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND line NOT LIKE '#%'),
r AS (SELECT line_id, CASE WHEN len(f) <> 9 THEN 'columns'
  WHEN NOT regexp_full_match(f[9], ' *{_PAIR}(; *{_PAIR})*(; *)?') THEN 'quoting'
  WHEN NOT (f[6] = '.' OR regexp_full_match(f[6], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(f[6] AS DOUBLE)), false)) OR f[8] NOT IN ('.', '0', '1', '2')
    OR NOT regexp_full_match(f[4], '[0-9]+') OR NOT regexp_full_match(f[5], '[0-9]+') OR CAST(f[4] AS BIGINT) < 1 OR CAST(f[4] AS BIGINT) > CAST(f[5] AS BIGINT) THEN 'value' END AS reason FROM l)"""
_DRIFT = r"""
WITH f AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed, file_format ORDER BY written_at, file_id) AS prev FROM source_files WHERE file_format IN ('SAM', 'VCF')),
t AS (SELECT file_id, unnest(tags) AS t FROM reads),
a AS (SELECT file_id, t.tag AS field, CAST(max(CASE WHEN regexp_full_match(t.value, '[+-]?[0-9]+') THEN 0 WHEN regexp_full_match(t.value, '[+-]?[0-9]+[.][0-9]+') THEN 1 ELSE 2 END) AS VARCHAR) AS kind, NULL AS d
    FROM t GROUP BY file_id, t.tag
  UNION ALL SELECT file_id, regexp_extract(line, '[<,]ID=([^,>]+)', 1), regexp_extract(line, 'Number=([^,>]+)', 1) || ' ' || regexp_extract(line, 'Type=([^,>]+)', 1),
    lower(trim(regexp_replace(regexp_extract(line, 'Description="([^"]*)"', 1), '\s+', ' ', 'g'))) FROM file_headers WHERE line LIKE '##INFO=<%'),
n AS (SELECT f.file_id, field, kind, d FROM f JOIN a ON a.file_id = f.file_id WHERE prev IS NOT NULL),
o AS (SELECT f.file_id, field, kind, d FROM f JOIN a ON a.file_id = f.prev),
gone AS (SELECT o.* FROM o ANTI JOIN n ON n.file_id = o.file_id AND n.field = o.field),
new AS (SELECT n.* FROM n ANTI JOIN o ON n.file_id = o.file_id AND n.field = o.field),
said AS (SELECT file_id, line, string_split_regex(line, '[^A-Za-z0-9_]+') AS w FROM file_headers WHERE line LIKE '@CO%' AND regexp_matches(line, 'renamed|formerly|previously|in place of|->|old name')),
r AS (SELECT gone.file_id, gone.field AS old, new.field AS new FROM gone JOIN new ON gone.file_id = new.file_id AND gone.d = new.d AND gone.d <> ''
  UNION SELECT gone.file_id, gone.field, new.field FROM said JOIN gone ON gone.file_id = said.file_id AND list_contains(w, gone.field) JOIN new ON new.file_id = said.file_id AND list_contains(w, new.field))
SELECT file_id, field AS field_name, 'added' AS change_kind FROM new ANTI JOIN r ON r.file_id = new.file_id AND r.new = new.field
UNION ALL SELECT file_id, field, 'removed' FROM gone ANTI JOIN r ON r.file_id = gone.file_id AND r.old = gone.field
UNION ALL SELECT n.file_id, n.field, 'retyped' FROM n JOIN o ON n.file_id = o.file_id AND n.field = o.field WHERE n.kind <> o.kind
UNION ALL SELECT file_id, new, 'renamed' FROM r"""
_FIELDS = r"""
WITH v AS (SELECT file_id, feed, file_format, CAST(row_number() OVER w AS INTEGER) AS version, lag(file_id) OVER w AS previous FROM source_files WHERE file_format IN ('SAM', 'VCF') WINDOW w AS (PARTITION BY feed, file_format ORDER BY written_at, file_id)),
t AS (SELECT file_id, unnest(tags) AS t FROM reads),
a AS (SELECT file_id, t.tag AS field, CASE max(CASE WHEN regexp_full_match(t.value, '[+-]?[0-9]+') THEN 0 WHEN regexp_full_match(t.value, '[+-]?[0-9]+[.][0-9]+') THEN 1 ELSE 2 END) WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' ELSE 'text' END AS kind
    FROM t GROUP BY file_id, t.tag
  UNION ALL SELECT DISTINCT file_id, regexp_extract(line, '[<,]ID=([^,>]+)', 1), regexp_extract(line, 'Number=([^,>]+)', 1) || ' ' || regexp_extract(line, 'Type=([^,>]+)', 1) FROM file_headers WHERE line LIKE '##INFO=<%'),
s AS (SELECT file_id, count(*) AS n_fields, sha256(string_agg(field || chr(9) || kind, chr(10) ORDER BY field || chr(9) || kind)) AS fingerprint FROM a GROUP BY file_id)"""
_PART = (
    _LEVELS
    + ", wl AS (SELECT spectrum_key, precursor_ix, "
    + _LIST.replace("{x}", "json_extract(p, '$.<part>')")
    + """ AS l FROM p WHERE json_type(p) = 'OBJECT'),
w AS (SELECT spectrum_key, precursor_ix, generate_subscripts(l, 1) - 1 AS param_ix, unnest(l) AS c FROM wl)
SELECT spectrum_key, CAST(precursor_ix AS INTEGER) AS precursor_ix, CAST(param_ix AS INTEGER) AS param_ix, json_extract_string(c, '$.accession') AS accession, json_extract_string(c, '$.name') AS name, json_extract_string(c, '$.value') AS "value"
FROM w WHERE json_type(c) = 'OBJECT'"""
)


def _units_sql() -> str:
    """Problem 1 by its definition: the unit is what the row states, else what the remarks state, else the target."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    spelt = lambda x: f"trim(regexp_replace(replace(replace(lower(coalesce({x}, '')), 'μ', 'µ'), '.', ' '), '\\s+', ' ', 'g'))"
    names = ", ".join(f"({quoted(d)}, {quoted(x)}, {k})" for d, us in units.DIMENSIONS.items() for k, u in enumerate(us) for x in u.spellings.split("|"))
    accessions = ", ".join(f"({quoted(d)}, {quoted(u.accession)}, {k})" for d, us in units.DIMENSIONS.items() for k, u in enumerate(us) if u.accession)
    # A unit counts within eight words of the quantity, none of them a number, in the same sentence.
    near = r"(?:[ ,:()]+[^\s\d,:().;][^\s,:();]*?){0,7}?[ ,:()]+"
    said = []
    for name, quantity in units.QUANTITIES.items():
        for d, us in units.DIMENSIONS.items():
            spellings = sorted((x for u in us for x in u.spellings.split("|") if not (len(x) == 1 and x in "cfkhs")), key=lambda x: (-len(x), x))
            pattern = f"(?:{quantity}){near}({'|'.join(map(re.escape, spellings))})(?:[\\s,;:)]|\\.(?:\\s|$)|$)"
            said.append(f"WHEN name = {quoted(name)} AND dim = {quoted(d)} THEN {quoted(pattern)}")
    number = r"^\s*([+\-−]?\d[\d.,]*(?:[eE][+-]?\d+)?|[+\-−]?[.,]\d+(?:[eE][+-]?\d+)?)\s*"
    duration = r"(?i)^\s*PT(?:([\d.,]+)H)?(?:([\d.,]+)M)?(?:([\d.,]+)S)?\s*$"
    return f"""
WITH names(dim, spelled, ix) AS (VALUES {names}), acc(dim, accession, ix) AS (VALUES {accessions}),
t AS (SELECT u.accession, u.name, acc.dim, acc.ix AS goal FROM unit_targets u JOIN acc ON acc.accession = u.target_unit_accession),
r AS (SELECT run_id, t.accession, t.dim, regexp_extract(regexp_replace(replace(lower(remarks), 'μ', 'µ'), '\\s+', ' ', 'g'), CASE {' '.join(said)} ELSE '^$' END, 1) AS spelled FROM ms_runs CROSS JOIN t WHERE remarks IS NOT NULL),
s AS (SELECT r.run_id, r.accession, min(names.ix) AS ix FROM r JOIN names ON names.dim = r.dim AND names.spelled = r.spelled GROUP BY r.run_id, r.accession),
p AS (SELECT c.param_id, c.run_id, c.accession, t.dim, t.goal, trim(coalesce(unit_accession, '')) AS ua, {spelt('unit_name')} AS un, {spelt("regexp_extract(coalesce(c.name, ''), '[\[(]([^\[\]()]*)[\])]\s*$', 1)")} AS suffix,
  regexp_extract(coalesce("value", ''), '{duration}', 1) AS h, regexp_extract(coalesce("value", ''), '{duration}', 2) AS m, regexp_extract(coalesce("value", ''), '{duration}', 3) AS sec,
  replace(regexp_extract(coalesce("value", ''), '{number}', 1), '−', '-') AS digits, regexp_extract(coalesce("value", ''), '(?s){number}(.*?)\\s*$', 2) AS behind FROM cv_params c JOIN t ON t.accession = c.accession),
q AS (SELECT *, CASE WHEN h || m || sec <> '' THEN 1.0 ELSE TRY_CAST(CASE WHEN contains(digits, ',') AND contains(digits, '.') THEN CASE WHEN strpos(reverse(digits), '.') < strpos(reverse(digits), ',') THEN replace(digits, ',', '')
    ELSE replace(replace(digits, '.', ''), ',', '.') END ELSE replace(digits, ',', '.') END AS DOUBLE) END AS number,
  CASE WHEN h <> '' AND m || sec = '' THEN 'h' WHEN m <> '' AND h || sec = '' THEN 'min' WHEN h || m || sec <> '' THEN 's' ELSE {spelt('behind')} END AS tail FROM p)
SELECT param_id FROM q LEFT JOIN acc ON acc.dim = q.dim AND acc.accession = ua LEFT JOIN names a ON a.dim = q.dim AND a.spelled = un LEFT JOIN names b ON b.dim = q.dim AND b.spelled = tail LEFT JOIN names c ON c.dim = q.dim AND c.spelled = suffix
LEFT JOIN s ON s.run_id = q.run_id AND s.accession = q.accession
WHERE isfinite(number) AND coalesce(acc.ix, a.ix, b.ix, c.ix, CASE WHEN ua || un <> '' THEN -1 END, s.ix, goal) <> goal"""


SQL: dict[str, str] = {
    "p1_found": _units_sql(),
    "p5_found": _DRIFT,
    "p5_versions": f"""{_FIELDS} SELECT v.file_id, v.feed, v.file_format, v.version, coalesce(n_fields, 0) AS n_fields, coalesce(fingerprint, '') AS fingerprint, coalesce(c.n, 0) AS n_changes
        FROM v LEFT JOIN s ON s.file_id = v.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM ({_DRIFT}) GROUP BY file_id) c ON c.file_id = v.file_id""",
    "p5_migrations": f"""{_FIELDS} SELECT v.file_id, v.feed, v.version, coalesce(b.fingerprint, '') AS from_fingerprint, coalesce(s.fingerprint, '') AS to_fingerprint, d.change_kind AS operation, d.field_name AS field
        FROM ({_DRIFT}) d JOIN v ON v.file_id = d.file_id LEFT JOIN s ON s.file_id = v.file_id LEFT JOIN s b ON b.file_id = v.previous""",
    "p4_isolation_windows": _PART.replace("<part>", "isolation_window"),
    "p4_activations": _PART.replace("<part>", "activation"),
    "p6_records": f"""{_GTF} SELECT r.line_id, f[1] AS seqname, f[2] AS source, f[3] AS feature_type, CAST(f[4] AS BIGINT) AS start_pos, CAST(f[5] AS BIGINT) AS end_pos, TRY_CAST(nullif(f[6], '.') AS DOUBLE) AS score, f[7] AS strand,
        nullif(f[8], '.') AS frame, CAST(len(list_distinct(regexp_extract_all(f[9], '([^ ";]+) +("[^"]*"|[0-9.eE+-]+)', 1))) AS INTEGER) AS n_attributes FROM r JOIN l ON l.line_id = r.line_id WHERE reason IS NULL""",
    "p6_faults": f"{_GTF} SELECT line_id, CAST(0 AS INTEGER) AS record_no, reason FROM r WHERE reason IS NOT NULL",
    "p4_found": f"{_LEVELS} SELECT {_KEYS} FROM c WHERE json_type(c) = 'OBJECT'",
    "p4_ion_params": f"{_LEVELS} SELECT {_KEYS}, json_extract_string(c, '$.accession') AS accession, json_extract_string(c, '$.name') AS name, json_extract_string(c, '$.value') AS \"value\" FROM c WHERE json_type(c) = 'OBJECT'",
    "p4_ions": f"{_LEVELS} SELECT spectrum_key, CAST(precursor_ix AS INTEGER) AS precursor_ix, CAST(ion_ix AS INTEGER) AS ion_ix, CAST(len(l) AS INTEGER) AS n_params FROM cl",
    "p4_precursors": f"""{_LEVELS} SELECT p.spectrum_key, CAST(p.precursor_ix AS INTEGER) AS precursor_ix, json_extract_string(p, '$.spectrum_ref') AS spectrum_ref, CAST(len(il.l) AS INTEGER) AS n_ions
        FROM p JOIN il ON p.spectrum_key = il.spectrum_key AND p.precursor_ix = il.precursor_ix WHERE json_type(p) = 'OBJECT'""",
    "p4_params": """SELECT spectrum_key, CAST(ix AS INTEGER) AS param_ix, c.accession AS accession, c.name AS name, c.value AS "value"
        FROM (SELECT spectrum_key, generate_subscripts(cv_params, 1) - 1 AS ix, unnest(cv_params) AS c FROM spectra) WHERE c IS NOT NULL""",
    "p4_peaks": """SELECT spectrum_key, CAST(ix AS INTEGER) AS peak_ix, m[ix + 1] AS mz, i[ix + 1] AS intensity FROM (SELECT spectrum_key, mz.mz AS m, intensity.intensity AS i,
        unnest(range(greatest(coalesce(len(mz.mz), 0), coalesce(len(intensity.intensity), 0)))) AS ix FROM spectra)""",
    "p4_spectra": """SELECT spectrum_key, run_id, id, precursor_mz, precusor_charge, CAST(greatest(coalesce(len(mz.mz), 0), coalesce(len(intensity.intensity), 0)) AS INTEGER) AS n_peaks, loaded_at FROM spectra""",
    "p6_found": f"{_GTF} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p7_found": _SWEEP + " SELECT seqname, prev + 1 AS gap_start, lo - 1 AS gap_end FROM w WHERE lo > prev + 1",
    "p7_islands": _SWEEP
    + """, l AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT seqname, CAST(island AS BIGINT) AS island, min(lo) AS start, max(hi) AS "end", count(*) AS n FROM l GROUP BY seqname, island""",
}
