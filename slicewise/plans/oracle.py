"""DuckDB SQL that computes the registered queries from the same tables."""

from __future__ import annotations

from slicewise import constants as K
from slicewise.plans.inputs import MIX, SEGMENT_PHRASES

SQL: dict[str, str] = {}
CLASSES = K.CLASSES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(col: str, mapping: dict, op: str = "=") -> str:
    if op == "contains":
        return " ".join(f"WHEN contains({col}, {_q(k)}) THEN {_q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in mapping.items())


def _title(s: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i > 1 AND "
            f"regexp_matches(substr({s}, i - 1, 1), '^\\p{{L}}$') THEN lower(substr({s}, i, 1)) "
            f"ELSE upper(substr({s}, i, 1)) END), '')")


def _location(raw: str) -> str:
    key = f"lower(trim({raw}))"
    return (f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN 'Unknown' {_cases(key, K.DEPARTMENTS)} "
            f"{_cases(key, K.DEPARTMENTS, 'contains')} ELSE {_title(f'trim({raw})')} END")


def _fixed(x: str, d: int) -> str:
    return f"printf('%.{d}f', ({x})::DOUBLE)"


def _prior(c: str) -> str:
    return f"CASE {_cases(f'lower({c})', K.INDICATION_PRIORS, 'contains')} ELSE {K.DEFAULT_PRIOR} END::DOUBLE"


# ---- input mappings --------------------------------------------------------------------------

RESULTS = f"""results AS (
  SELECT *, {_location('raw_department')} AS location FROM (
    SELECT CAST(event_id AS VARCHAR) AS study_uid, CAST(user_id AS VARCHAR) AS patient_id, CAST(ts AS DATE) AS exam_date,
      CASE event_type WHEN 'click' THEN 'Emergency Dept 2' WHEN 'view' THEN 'Neuro ICU' WHEN 'purchase' THEN 'Medical Ward'
        WHEN 'signup' THEN '' WHEN 'error' THEN 'o''neil annex 3rd' END AS raw_department,
      CAST(value >= 100 AS INT) AS ai_positive, value / 5e2 AS prob_any FROM events))"""


def _u(c: str) -> str:
    a, b = MIX[c]
    return f"(((l_partkey * {a} + l_suppkey * {b} + l_linenumber * 29) % 1000) / 1e3)"


_NOISE = "((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1e3"
SLICES = "slices AS (SELECT CAST(l_orderkey AS VARCHAR) AS study_uid, l_quantity AS z_mm, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"{_u(c)} * {_u(c)} * {_u(c)} AS p_{c}, ({_u(c)} - 5e-1) * 8 AS x_{c}, CAST({_u(c)} + {_NOISE} > 15e-1 AS INT) AS y_{c}"
    for c in CLASSES) + " FROM lineitem)"
INDEXED = """indexed AS (SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY z_mm DESC, l_linenumber, l_partkey, l_suppkey) - 1
  AS slice_index FROM slices)"""

LABELS = """labels_long AS (
  SELECT 'ID_' || doc_id AS image_id, c AS cls, l AS label, o AS ord FROM (
    SELECT doc_id, 'epidural' AS c, quality * toxic AS l, 0 AS o FROM labels
    UNION ALL SELECT doc_id, 'subdural', toxic, 0 FROM labels
    UNION ALL SELECT doc_id, 'subarachnoid', 1 - quality, 0 FROM labels
    UNION ALL SELECT doc_id, 'any', greatest(toxic, 1 - quality), 0 FROM labels
    UNION ALL SELECT doc_id, 'subdural', 1 - toxic, 1 FROM labels WHERE quality = 0))"""


def _wide(fn: str, zero: bool) -> str:
    cols = ", ".join(
        (f"coalesce({fn}(label, ord) FILTER (WHERE cls = '{c}'), 0)" if zero else f"{fn}(label, ord) FILTER (WHERE cls = '{c}')")
        + f"::INT AS \"{c}\"" for c in CLASSES)
    return f"wide AS (SELECT image_id, {cols} FROM labels_long GROUP BY image_id)"


WIDE = LABELS + ", " + _wide("arg_min", True)

HEADERS = """headers AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS study_uid, l_orderkey || '.' || p_type AS series_uid,
    l_orderkey || '/' || p_type || '/' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.dcm' AS path,
    l_orderkey || '/' || p_type AS dir, CAST(l_orderkey AS VARCHAR) AS parent, p_type,
    CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'MR' ELSE 'CT' END AS modality,
    CASE p_type WHEN 'SMALL' THEN 'AXIAL HEAD W/O' WHEN 'LARGE' THEN 'CTA HEAD' WHEN 'PROMO' THEN 'Brain noncontrast thin'
      WHEN 'STANDARD' THEN 'BONE RECON' WHEN 'ECONOMY' THEN '' ELSE 'CHEST' END AS series_description,
    CASE WHEN p_size % 9 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS slice_thickness,
    CASE WHEN p_size % 7 = 0 THEN 'OMNIPAQUE' WHEN p_size % 5 = 0 THEN 'None' ELSE '' END AS contrast_bolus_agent,
    CASE WHEN p_size % 11 = 0 THEN 'DERIVED' ELSE 'ORIGINAL' END AS image_type_0,
    CASE WHEN l_linenumber = 5 THEN strftime(l_shipdate, '%Y') ELSE strftime(l_shipdate, '%Y%m%d') END AS study_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PROCESSED = "processed AS (SELECT CAST(o_orderkey AS VARCHAR) AS study_uid FROM orders WHERE o_orderstatus = 'F')"


def _hits(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({c}), {_q(w)}) AS INT)" for w in words) + ")"


def _score(c: str) -> str:
    return f"({_hits(c, K.WANTED_SERIES_WORDS)} - 2 * {_hits(c, K.UNWANTED_SERIES_WORDS)})"


SERIES = """series AS (
  SELECT study_uid, series_uid, min(path) AS first_path, arg_min(modality, path) AS modality,
    arg_min(series_description, path) AS series_description, arg_min(slice_thickness, path) AS slice_thickness,
    arg_min(contrast_bolus_agent, path) AS contrast_bolus_agent, arg_min(image_type_0, path) AS image_type_0,
    count(*) AS slice_count FROM headers GROUP BY ALL)"""
CHOSEN = f"""chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY score DESC, thickness, first_path) AS rn FROM (
    SELECT *, {_score('series_description')} AS score, coalesce(TRY_CAST(slice_thickness AS DOUBLE), 99e0) AS thickness FROM series
    WHERE modality = 'CT' AND lower(contrast_bolus_agent) IN ('', 'none') AND image_type_0 <> 'DERIVED' AND slice_count >= 2)
  WHERE score > 0 OR series_description = '') WHERE rn = 1)"""
_NON_HEAD = " OR ".join(f"contains(lower(series_description), {_q(w)})" for w in K.NON_HEAD_WORDS)
ROUTED = f"""firsts AS (
  SELECT study_uid, count(*) AS n_files, arg_min(modality, path) AS modality,
    arg_min(series_description, path) AS series_description, arg_min(study_date, path) AS raw FROM headers GROUP BY study_uid),
checked AS (
  SELECT study_uid, n_files, CASE WHEN length(raw) = 8 THEN substr(raw, 1, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2)
    ELSE '' END AS exam_date, CASE WHEN modality <> 'CT' THEN 'wrong_modality_' || modality WHEN {_NON_HEAD} THEN 'non_head_desc'
    ELSE '' END AS reason FROM firsts),
early AS (
  SELECT c.*, CASE WHEN reason <> '' THEN 'not_head_ct'
    WHEN exam_date <> '' AND exam_date < CAST(DATE '2001-12-31' - 2000 AS VARCHAR) THEN 'date_filtered'
    WHEN p.study_uid IS NOT NULL THEN 'already_processed' END AS early FROM checked c LEFT JOIN processed p USING (study_uid)),
routed AS (
  SELECT e.study_uid, coalesce(early, CASE WHEN s.series_uid IS NULL THEN 'no_ncct_series' ELSE 'ready' END) AS status, reason,
    exam_date, n_files, CASE WHEN early IS NULL THEN s.series_uid END AS series_uid,
    CASE WHEN early IS NULL THEN regexp_extract(s.first_path, '^(.*)/[^/]*$', 1) END AS series_folder,
    CASE WHEN early IS NULL THEN s.slice_count END AS slice_count FROM early e LEFT JOIN chosen s USING (study_uid))"""
ALL_ROUTED = ", ".join([HEADERS, PROCESSED, SERIES, CHOSEN, ROUTED])

_CODES = ["SDH", "EDH", "IPH", "IVH", "SAH", "ICH"]
READS = "reads AS (SELECT o_orderkey AS ord, 'CASE-CT-' || o_orderkey AS name, " + ", ".join(
    f"CAST((o_custkey * {i + 3} + o_orderkey * {j + 2}) % {11 + 4 * i} < 4 AS INT) AS r{j + 1}_{c.lower()}"
    for i, c in enumerate(_CODES) for j in range(3)) + " FROM orders)"
MAJORITY = "majority AS (SELECT name, ord, " + ", ".join(
    f"CAST(r1_{code.lower()} + r2_{code.lower()} + r3_{code.lower()} >= 2 AS INT) AS {cls}" for cls, code in K.VOTE_CODES.items()) + " FROM reads)"

BLOCKS = """blocks AS (SELECT 'ID_' || vec_id AS image_id, label,
  list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 4e2) AS hu FROM embeddings)"""
RAW = """raw_blocks AS (SELECT image_id, label % 4 AS four, list_transform(hu, lambda v: CASE label % 4 WHEN 0 THEN v * 2e0
  WHEN 1 THEN v WHEN 2 THEN v - 1024e0 ELSE v - 1024e0 END) AS hu FROM blocks)"""

_PHRASE = "CASE " + _cases("c_mktsegment", SEGMENT_PHRASES) + " END"
WORKLIST = f"""worklist AS (SELECT CAST(o_orderkey AS VARCHAR) AS study_uid, c_name AS patient_id, '' AS patient_name,
  {_PHRASE} AS indication, o_orderpriority = '1-URGENT' AS physician_stat, o_orderpriority = '2-HIGH' AS ai_positive,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' THEN 'subdural hematoma' ELSE '' END AS dominant_class,
  o_totalprice % 1000 / 1e3 AS prob_any, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS exam_time
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
LEDGER = """ledger AS (SELECT CAST(conv_id AS VARCHAR) AS study_id, role AS stage,
  CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END AS input_tokens,
  CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS output_tokens,
  CASE WHEN turn = 0 THEN 10 ELSE 0 END AS cache_creation_input_tokens,
  CASE WHEN turn > 0 THEN turn ELSE 0 END AS cache_read_input_tokens FROM conversations)"""
DOCS = "docs AS (SELECT 'ID_' || doc_id AS image_id FROM documents)"


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def _rate(n: str, p: str, k: int) -> str:
    return f"CASE WHEN {n} >= {k} AND {n} > 0 THEN printf('%.6f', ({p} / {n})::DOUBLE)::DOUBLE END"


# ---- prevalence ------------------------------------------------------------------------------

_PREV = """SELECT count(*) AS n_total, coalesce(sum(ai_positive), 0)::BIGINT AS n_positive,
  CASE WHEN count(*) >= 10 THEN printf('%.6f', (sum(ai_positive) / count(*))::DOUBLE)::DOUBLE END AS prevalence FROM results"""
SQL["prevalence_overall"] = _with(RESULTS, body=_PREV)
SQL["prevalence_filtered"] = _with(RESULTS, body=_PREV + " WHERE location = 'ER' AND exam_date >= DATE '2024-01-31' - 14")


def _by_location(days: int | None) -> str:
    where = f"WHERE exam_date >= DATE '2024-01-31' - {days}" if days else ""
    return f"""by_loc AS (
  SELECT location, 0 AS is_total, count(*) AS n_total, sum(ai_positive)::BIGINT AS n_positive FROM results {where} GROUP BY location
  UNION ALL SELECT 'TOTAL', 1, count(*), sum(ai_positive)::BIGINT FROM results {where}),
rated AS (SELECT *, CASE WHEN n_total >= CASE WHEN is_total = 1 THEN 1 ELSE 10 END THEN printf('%.6f', (n_positive / n_total)::DOUBLE)::DOUBLE END AS prevalence FROM by_loc)"""


SQL["prevalence_by_location"] = _with(RESULTS, _by_location(20), body=f"""SELECT location, is_total, n_total, n_positive, prevalence,
  coalesce({_fixed('prevalence * 100', 2)} || '%', CASE WHEN is_total = 1 THEN '<1 studies' ELSE '<10 studies' END) AS shown FROM rated""")


def _trend(period: str, n: int, where: str = "TRUE", min_n: int = 10) -> str:
    t = "DATE '2024-01-31'"
    if period.startswith("week"):
        end = f"({t} - 7 * i::INT)"
        rows = f"{end} - {7 if period == 'week' else 6} AS start_date, {end} AS end_date, printf('W%02d %d', weekofyear({end}), year({end})) AS period_label"
    elif period == "year":
        y = f"year({t}) - i"
        rows = f"make_date({y}, 1, 1) AS start_date, make_date({y}, 12, 31) AS end_date, CAST({y} AS VARCHAR) AS period_label"
    else:
        s = f"CAST(date_trunc('month', {t}) - to_months(i::INT) AS DATE)"
        rows = f"{s} AS start_date, last_day({s}) AS end_date, strftime({s}, '%Y-%m') AS period_label"
    return _with(RESULTS, f"buckets AS (SELECT {rows} FROM range({n}) t(i))", body=f"""
SELECT period_label, start_date, end_date, count(study_uid) AS n_total, coalesce(sum(ai_positive), 0)::BIGINT AS n_positive,
  CASE WHEN count(study_uid) >= {min_n} THEN printf('%.6f', (sum(ai_positive) / count(study_uid))::DOUBLE)::DOUBLE END AS prevalence
FROM buckets LEFT JOIN (SELECT * FROM results WHERE {where}) r ON exam_date BETWEEN start_date AND end_date GROUP BY ALL""")


SQL["prevalence_trend_month"] = _trend("month", 12)
SQL["prevalence_trend_week"] = _trend("week", 6)
SQL["prevalence_trend_week_exclusive"] = _trend("week_exclusive", 6)
SQL["prevalence_trend_year"] = _trend("year", 3)
SQL["prevalence_trend_location"] = _trend("week", 8, "location = 'Neuro ICU'", 300)

SQL["prevalence_fallback"] = _with(RESULTS, """per AS (
  SELECT location, count(*) FILTER (WHERE exam_date >= DATE '2024-01-31' - 3) AS nr,
    coalesce(sum(ai_positive) FILTER (WHERE exam_date >= DATE '2024-01-31' - 3), 0)::BIGINT AS pr,
    count(*) AS na, sum(ai_positive)::BIGINT AS pa FROM results GROUP BY location),
tot AS (SELECT sum(nr)::BIGINT AS nr, sum(pr)::BIGINT AS pr, sum(na)::BIGINT AS na, sum(pa)::BIGINT AS pa FROM per)""", body="""
SELECT p.location, CASE WHEN p.nr >= 160 THEN printf('%.6f', (p.pr / p.nr)::DOUBLE)::DOUBLE WHEN p.na >= 160 THEN printf('%.6f', (p.pa / p.na)::DOUBLE)::DOUBLE
    WHEN t.na >= 160 THEN printf('%.6f', (t.pa / t.na)::DOUBLE)::DOUBLE ELSE 0.05 END::DOUBLE AS prevalence,
  CASE WHEN p.nr >= 160 THEN 'observed (local ' || p.location || ', last 3d, n=' || p.nr || ', ' || p.pr || ' positive)'
    WHEN p.na >= 160 THEN 'observed (local ' || p.location || ', all time, n=' || p.na || ', ' || p.pa || ' positive)'
    WHEN t.na >= 160 THEN 'observed (all locations, all time, n=' || t.na || ', ' || t.pa || ' positive)'
    ELSE 'indication default (insufficient local data)' END AS source FROM per p CROSS JOIN tot t
UNION ALL SELECT NULL, CASE WHEN nr >= 160 THEN printf('%.6f', (pr / nr)::DOUBLE)::DOUBLE WHEN na >= 160 THEN printf('%.6f', (pa / na)::DOUBLE)::DOUBLE ELSE 0.05 END::DOUBLE,
  CASE WHEN nr >= 160 THEN 'observed (all locations, last 3d, n=' || nr || ', ' || pr || ' positive)'
    WHEN na >= 160 THEN 'observed (all locations, all time, n=' || na || ', ' || pa || ' positive)'
    ELSE 'indication default (insufficient local data)' END FROM tot""")

SQL["study_upsert"] = _with(RESULTS, body="""
SELECT study_uid, patient_id, exam_date, raw_department, location,
  CASE WHEN exam_date >= DATE '2024-01-11' THEN 1 - ai_positive ELSE ai_positive END AS ai_positive,
  CASE WHEN exam_date >= DATE '2024-01-11' THEN 1e0 - prob_any ELSE prob_any END AS prob_any,
  exam_date >= DATE '2024-01-20' AS is_new FROM results""")
SQL["known_studies"] = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS study_uid FROM lineitem"

# ---- triage ----------------------------------------------------------------------------------

SQL["study_triage"] = f"WITH {ALL_ROUTED} SELECT * FROM routed"
SQL["scan_counters"] = f"""WITH {ALL_ROUTED} SELECT status, count(*) AS n_studies, coalesce(sum(slice_count), 0)::BIGINT AS n_slices,
  round(count(*) / (SELECT count(*) FROM routed), 6) AS share FROM routed GROUP BY status"""
SQL["run_counters"] = f"""WITH {ALL_ROUTED} SELECT CASE WHEN exam_date < '1998' THEN 'early' ELSE 'late' END AS "group",
  count(*) FILTER (WHERE status = 'already_processed') AS skipped, count(*) FILTER (WHERE status = 'no_ncct_series') AS errors,
  count(*) FILTER (WHERE status NOT IN ('already_processed', 'no_ncct_series')) AS processed FROM routed GROUP BY 1"""
FOLDERS = """dirs AS (SELECT dir, parent, study_uid, count(*) AS n_files FROM headers GROUP BY ALL),
folders AS (SELECT CASE WHEN n >= 2 THEN parent ELSE dir END AS study_folder, sum(n_files)::BIGINT AS n_files
  FROM (SELECT *, count(*) OVER (PARTITION BY parent) AS n FROM dirs) GROUP BY 1)"""
SQL["folder_grouping"] = _with(HEADERS, FOLDERS, body="SELECT * FROM folders")
SQL["series_rollup"] = _with(HEADERS, SERIES, body="SELECT *, regexp_extract(first_path, '^(.*)/[^/]*$', 1) AS series_folder FROM series")
SQL["series_select"] = _with(HEADERS, SERIES, CHOSEN, body="SELECT study_uid, series_uid, score, thickness, first_path, slice_count FROM chosen")
SQL["series_select_simple"] = _with(HEADERS, SERIES, body="""
SELECT study_uid, series_uid, thickness, slice_count FROM (
  SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY CAST(image_type_0 = 'DERIVED' AS INT), thickness, first_path) AS rn FROM (
    SELECT *, coalesce(TRY_CAST(slice_thickness AS DOUBLE), 99e0) AS thickness FROM series WHERE modality = 'CT')) WHERE rn = 1""")
SQL["resume_pending"] = _with(HEADERS, PROCESSED, FOLDERS, body="""
SELECT * FROM folders WHERE regexp_extract(study_folder, '^[^/]*') NOT IN (SELECT study_uid FROM processed)""")
SQL["store_done"] = _with(HEADERS, body="""SELECT study_uid AS image_id FROM headers WHERE p_type IN ('LARGE', 'SMALL', 'PROMO')
GROUP BY 1 HAVING count(DISTINCT p_type) = 3""")
SQL["best_file_group"] = _with(HEADERS, body="""
SELECT archive, folder, n_files FROM (
  SELECT *, row_number() OVER (PARTITION BY archive ORDER BY contains(lower(folder), 'thin') DESC, n_files DESC, first) AS rn FROM (
    SELECT study_uid AS archive, replace(dir, 'PROMO', 'THIN PROMO') AS folder, count(*) AS n_files, min(path) AS first
    FROM headers GROUP BY ALL)) WHERE rn = 1""")

# ---- scores and evaluation -------------------------------------------------------------------

SQL["slice_index"] = _with(SLICES, INDEXED, body="SELECT study_uid, z_mm, l_linenumber, l_partkey, l_suppkey, slice_index FROM indexed")

_subs = K.SUBTYPES
STUDY = "top AS (SELECT study_uid, count(*) AS slice_count, " + ", ".join(
    f"printf('%.4f', (max(p_{c}))::DOUBLE)::DOUBLE AS prob_{c}, max(p_{c}) >= 0.5 AS positive_{c}" for c in CLASSES) + " FROM slices GROUP BY study_uid)," + \
    "best AS (SELECT *, greatest(" + ", ".join(f"CASE WHEN positive_{c} THEN prob_{c} END" for c in _subs) + ") AS b FROM top)," + \
    "keyed AS (SELECT *, positive_any AS overall_positive, CASE " + " ".join(
        f"WHEN positive_{c} AND prob_{c} = b THEN '{c}'" for c in _subs) + " ELSE '' END AS dominant_key FROM best)," + \
    f"scored AS (SELECT * EXCLUDE (b), CASE {_cases('dominant_key', {c: K.CLASS_DISPLAY[c] for c in _subs})} WHEN positive_any THEN {_q(K.UNDETERMINED)} ELSE '' END AS dominant_class FROM keyed)"
SQL["study_scores"] = _with(SLICES, STUDY, body="SELECT * FROM scored")
SQL["study_documents"] = _with(SLICES, STUDY, body=" UNION ALL ".join(
    f"SELECT study_uid, slice_count AS valid_slices, '{c}' AS class, prob_{c} AS prob, positive_{c} AS positive, {_q(K.CLASS_DISPLAY[c])} AS display FROM scored"
    for c in CLASSES))

HOT = "cand AS (" + " UNION ALL ".join(
    f"SELECT study_uid, slice_index, z_mm, {i} AS ord, '{c}' AS cls, p_{c} AS p FROM indexed WHERE p_{c} >= 0.5"
    for i, c in enumerate(CLASSES)) + f"""),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_uid, cls ORDER BY p DESC, slice_index) AS rn FROM cand) WHERE rn <= 3),
hot AS (SELECT study_uid, slice_index, printf('%.1f', (z_mm)::DOUBLE)::DOUBLE AS slice_z_mm, '' AS sop_uid, cls AS dominant_class,
  CASE {_cases('cls', K.CLASS_DISPLAY)} END AS display_class, printf('%.4f', (p)::DOUBLE)::DOUBLE AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY study_uid, slice_index ORDER BY p DESC, ord) AS r2 FROM top3) WHERE r2 = 1)"""
SQL["hot_slices"] = _with(SLICES, INDEXED, HOT, body="SELECT * FROM hot")
SQL["slice_lookup"] = _with(SLICES, INDEXED, HOT, body="""
SELECT h.study_uid, h.slice_index, CASE WHEN dominant_class = 'any' THEN 'lost' ELSE '' END AS sop_uid, path FROM hot h LEFT JOIN (
  SELECT study_uid, path, row_number() OVER (PARTITION BY study_uid ORDER BY path) - 1 AS file_index FROM (
    SELECT study_uid, lpad(l_linenumber::VARCHAR, 9, '0') || '_' || lpad(l_partkey::VARCHAR, 9, '0') || '_' || lpad(l_suppkey::VARCHAR, 9, '0') AS path
    FROM slices)) f ON f.study_uid = h.study_uid AND f.file_index = h.slice_index""")

LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, p_{c} AS p, y_{c} AS y FROM slices" for c in CLASSES) + ")"
ROC = """pts AS (SELECT class, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM long GROUP BY ALL),
roc AS (SELECT class, p AS threshold, pos, neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
  (sum(pos) OVER (PARTITION BY class))::BIGINT AS n_pos, (sum(neg) OVER (PARTITION BY class))::BIGINT AS n_neg FROM pts
  WINDOW w AS (PARTITION BY class ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""
SQL["roc_curve"] = _with(SLICES, LONG, ROC, body="""SELECT class, round(threshold, 6) AS threshold, tp, fp,
  round(tp / n_pos, 6) AS tpr, round(fp / n_neg, 6) AS fpr FROM roc""")
OPS = """youden AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY tp / n_pos - fp / n_neg DESC, threshold DESC) AS rn FROM roc) WHERE rn = 1),
auc AS (SELECT class, sum(neg * (tp - pos + pos / 2)) / (max(n_pos) * max(n_neg)::DOUBLE) AS auc FROM roc GROUP BY class),
rates AS (SELECT class, auc, threshold, n_pos, n_neg, n_pos / (n_pos + n_neg) AS prevalence, tp / (n_pos + 1e-10) AS sens,
  (n_neg - fp) / (n_neg + 1e-10) AS spec, tp / (tp + fp + 1e-10) AS ppv, (n_neg - fp) / (n_neg - fp + n_pos - tp + 1e-10) AS npv
  FROM youden JOIN auc USING (class)),
full_rates AS (SELECT *, sens / (1e0 - spec + 1e-10) AS lrp, (1e0 - sens) / (spec + 1e-10) AS lrn, 1e0 - spec AS fpr FROM rates)"""
METRICS = f"""metrics AS (SELECT class, round(auc, 6) AS auc, round(prevalence, 6) AS prevalence, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity,
  round(ppv, 6) AS ppv, round(npv, 6) AS npv, CASE WHEN fpr > 1e-10 AND lrp < 1e6 THEN round(lrp, 4) ELSE 'inf'::DOUBLE END AS lr_positive,
  round(lrn, 6) AS lr_negative, round(threshold, 6) AS threshold, n_pos AS n_positive, n_pos + n_neg AS n_total FROM full_rates)"""
EVAL = (SLICES, LONG, ROC, OPS, METRICS)
SQL["class_metrics"] = _with(*EVAL, body="SELECT * FROM metrics")
SQL["class_metrics_training"] = _with(*EVAL, body="""SELECT class, round(auc, 6) AS auc, round(prevalence, 6) AS prevalence, round(sens, 6) AS sensitivity,
  round(spec, 6) AS specificity, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(CASE WHEN fpr > 0 THEN lrp ELSE 'inf'::DOUBLE END, 6) AS lr_positive,
  round(lrn, 6) AS lr_negative, round(threshold, 6) AS threshold, n_pos AS n_positive, n_pos + n_neg AS n_total FROM full_rates""")
SQL["mean_auc"] = _with(*EVAL, body="SELECT round(avg(auc), 6) AS mean_auc, count(*) AS n_classes FROM metrics")
SQL["metrics_document"] = _with(*EVAL, body="""SELECT *, (SELECT max(n_total) FROM metrics) AS n_test,
  (SELECT round(avg(auc), 6) FROM metrics) AS mean_auc FROM metrics""")
SQL["confusion_at_half"] = _with(SLICES, LONG, body="""SELECT class, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM long GROUP BY class""")
_clip = "greatest(1e-15, least(1e0 - 1e-15, p))"
_W = " ".join(f"WHEN '{c}' THEN {w}" for c, w in zip(CLASSES, K.LOSS_WEIGHTS))
LOSS = f"""per_class AS (SELECT class, avg(-(y * ln({_clip}) + (1 - y) * ln(1 - {_clip}))) AS loss FROM long GROUP BY class),
losses AS (SELECT class, loss FROM per_class UNION ALL
  SELECT 'weighted', sum(loss * (CASE class {_W} END)::DOUBLE) / sum((CASE class {_W} END)::DOUBLE) FROM per_class)"""
SQL["log_loss"] = _with(SLICES, LONG, LOSS, body="SELECT class, round(loss, 6) AS loss FROM losses")
SQL["evaluation_run"] = _with(*EVAL, LOSS, body="""SELECT class, auc, sensitivity, specificity, threshold, n_positive, n_total,
  (SELECT round(avg(auc), 6) FROM metrics) AS mean_auc, (SELECT round(loss, 6) FROM losses WHERE class = 'weighted') AS weighted_log_loss FROM metrics""")
SQL["focal_loss"] = _with(SLICES, "logits AS (" + " UNION ALL ".join(
    f"SELECT x_{c} AS x, y_{c} * (1 - 5e-2) + 5e-1 * 5e-2 AS t, {0.5 + i / 20}::DOUBLE AS a FROM slices" for i, c in enumerate(CLASSES)) + ")",
    "terms AS (SELECT *, 1e0 / (1e0 + exp(-x)) AS p, greatest(x, 0) - x * t + ln(1e0 + exp(-abs(x))) AS bce FROM logits)",
    body="""SELECT round(avg(pow(1 - (p * t + (1 - p) * (1 - t)), 2) * (a * t + (1 - a) * (1 - t)) * bce), 6) AS focal_loss FROM terms""")
SQL["logit_scores"] = _with(SLICES, body="SELECT study_uid, l_linenumber, l_partkey, l_suppkey, round(1e0 / (1e0 + exp(-x_any)), 6) AS p_any FROM slices")
SQL["class_balance"] = _with(WIDE, body=" UNION ALL ".join(
    f"""SELECT '{c}' AS class, sum("{c}")::BIGINT AS positives, count(*) AS n_total, round(100 * sum("{c}") / count(*), 2) AS percent,
    round((count(*) - sum("{c}")) / count(*), 6) AS alpha FROM wide""" for c in CLASSES))
SQL["best_epochs"] = """WITH e AS (SELECT o_custkey AS run, o_orderkey AS epoch, (o_orderkey * 7 % 19 + 80) / 1e2 AS mean_auc FROM orders),
b AS (SELECT *, coalesce(max(mean_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS best_before FROM e)
SELECT *, mean_auc > best_before AS is_best FROM b"""


def _bayes(prev: str, src: str) -> str:
    return f"""b1 AS (SELECT *, round_even(1e3 * {prev}, 0) AS n_pos FROM {src}),
b2 AS (SELECT *, round_even(n_pos * 94e-2, 0) AS tpd, round_even((1e3 - n_pos) * (1e0 - 9453e-4), 0) AS fpd FROM b1),
bayes AS (SELECT *, tpd::BIGINT AS tp, (n_pos - tpd)::BIGINT AS fn, fpd::BIGINT AS fp, (1e3 - n_pos - fpd)::BIGINT AS tn,
  printf('%.4f', (CASE WHEN tpd + fpd > 0 THEN tpd / (tpd + fpd) ELSE 0 END)::DOUBLE)::DOUBLE AS ppv,
  printf('%.4f', (CASE WHEN 1e3 - tpd - fpd > 0 THEN (1e3 - n_pos - fpd) / (1e3 - fpd - tpd) ELSE 0 END)::DOUBLE)::DOUBLE AS npv,
  CASE WHEN tpd > 0 THEN printf('%.2f', (fpd / tpd)::DOUBLE)::DOUBLE ELSE 'inf'::DOUBLE END AS pain_index,
  printf('%.2f', (94e-2 / (1e0 - 9453e-4))::DOUBLE)::DOUBLE AS lr_positive, printf('%.4f', ((1e0 - 94e-2) / 9453e-4)::DOUBLE)::DOUBLE AS lr_negative FROM b2)"""


SQL["bayes_metrics"] = _with(RESULTS, _by_location(None), "known AS (SELECT location, prevalence FROM rated WHERE prevalence IS NOT NULL)",
                             _bayes("prevalence", "known"), body="""
SELECT location, prevalence, tp, fn, fp, tn, ppv, npv, pain_index, lr_positive, lr_negative FROM bayes""")

# ---- labels, splits, cohorts -----------------------------------------------------------------

SQL["labels_wide_first"] = _with(WIDE, body="SELECT * FROM wide")
SQL["labels_wide_first_non_null"] = _with(LABELS, _wide("arg_min", False), body="SELECT * FROM wide")
SQL["labels_wide_last"] = _with(LABELS, _wide("arg_max", False), body="SELECT * FROM wide")
SQL["labels_available"] = _with(WIDE, DOCS, body='SELECT image_id FROM wide WHERE "any" = 1 AND image_id IN (SELECT image_id FROM docs)')
SQL["labels_inner"] = _with(WIDE, DOCS, body='SELECT image_id, "any", "subdural" FROM docs JOIN wide USING (image_id)')
SQL["label_file"] = _with(LABELS, body="SELECT image_id || '_' || cls AS ID, label::INT AS Label FROM labels_long")
SQL["vote_file"] = _with(READS, body="SELECT name, " + ", ".join(
    f"CASE WHEN r{j + 1}_{c.lower()} = 1 THEN '1' ELSE '{'0' if j else ''}' END AS {r}_{c}"
    for j, r in enumerate(K.READERS) for c in ("ICH", "SDH")) + " FROM reads")
SQL["labels_pending"] = _with(WIDE, DOCS, body='SELECT image_id, "any", "any" IS NULL AS unlabelled FROM docs LEFT JOIN wide USING (image_id)')
_DOM = "CASE " + " ".join(f"WHEN \"{c}\" = 1 THEN '{c}'" for c in K.DOMINANT_ORDER) + " ELSE '' END"
STUDY_LABELS = "rolled AS (SELECT study_uid, count(*) AS n_slices, count(*) AS n_labelled, " + ", ".join(
    f'max(y_{c})::INT AS "{c}"' for c in CLASSES) + f""" FROM slices GROUP BY study_uid),
study_labels AS (SELECT *, "any" = 1 AS study_positive, {_DOM} AS dominant_class FROM rolled)"""
SQL["study_labels"] = _with(SLICES, STUDY_LABELS, body="SELECT * FROM study_labels")
_RANK = "CASE dominant_class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(K.DOMINANT_ORDER)) + " END"
COHORT = f"""able AS (SELECT * FROM study_labels WHERE n_labelled >= 3),
lead AS (SELECT * FROM (SELECT *, {_RANK} AS tier, row_number() OVER (PARTITION BY dominant_class ORDER BY n_labelled DESC, study_uid) AS rn
  FROM able WHERE study_positive AND dominant_class <> '') WHERE rn = 1 ORDER BY tier LIMIT 12),
fill AS (SELECT * FROM able WHERE study_positive AND study_uid NOT IN (SELECT study_uid FROM lead) ORDER BY n_labelled DESC, study_uid
  LIMIT (SELECT 12 - count(*) FROM lead)),
neg AS (SELECT * FROM able WHERE NOT study_positive ORDER BY n_labelled DESC, study_uid LIMIT 7),
cohort AS (SELECT study_uid, dominant_class, n_slices, n_labelled, 'positive' AS grp FROM lead
  UNION ALL SELECT study_uid, dominant_class, n_slices, n_labelled, 'positive' FROM fill
  UNION ALL SELECT study_uid, dominant_class, n_slices, n_labelled, 'negative' FROM neg)"""
SQL["cohort_pick"] = _with(SLICES, STUDY_LABELS, COHORT, body='SELECT study_uid, dominant_class, n_slices, n_labelled, grp AS "group" FROM cohort')
SQL["manifest"] = _with(SLICES, STUDY_LABELS, COHORT, body="""
SELECT study_uid, CASE WHEN grp = 'negative' THEN 'negative' ELSE dominant_class END AS dominant_class, n_slices, n_labelled,
  CASE WHEN grp = 'negative' THEN 'negative/negative__' || study_uid
    ELSE 'positive/' || CASE WHEN dominant_class = '' THEN 'positive' ELSE dominant_class END || '__' || study_uid END AS folder,
  grp AS "group" FROM cohort""")
_SIG = " || ".join(f'"{c}"::VARCHAR' for c in CLASSES)


def _split_two(src: str, out: str) -> str:
    return f"""{out}_o AS (SELECT image_id, {_SIG} AS signature, md5(image_id || '42') AS h FROM {src}),
{out}_p AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY h, image_id) - 1 AS pos, count(*) OVER (PARTITION BY signature) AS n FROM {out}_o),
{out} AS (SELECT image_id, signature, CASE WHEN n >= 2 AND pos < greatest(1, round_even(n * 15e-2, 0)) THEN 'val' ELSE 'train' END AS split FROM {out}_p)"""


SQL["split_two"] = _with(WIDE, _split_two("wide", "two"), body="SELECT * FROM two")
SPLIT3 = f"""base AS (SELECT *, {_SIG} AS signature, md5(image_id || '42') AS h42, md5(image_id || '43') AS h43 FROM wide),
pos AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY h42, image_id) - 1 AS pos, count(*) OVER (PARTITION BY signature) AS n,
  25e0 / count(*) OVER () AS frac FROM base),
taken AS (SELECT *, pos < greatest(0, least(round_even(n * frac, 0), n - 1)) AS take FROM pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY h43, image_id) - 1 AS r, count(*) FILTER (WHERE take) OVER () AS s FROM taken),
decided AS (SELECT *, CASE WHEN s >= 25 THEN take AND r < 25 ELSE take OR r < 25 - s END AS is_test FROM ranked),
rest AS (SELECT * FROM decided WHERE NOT is_test)"""
_THREE = "three AS (SELECT image_id, signature, 'test' AS split FROM decided WHERE is_test UNION ALL SELECT * FROM two)"
SQL["split_three"] = _with(WIDE, SPLIT3, _split_two("rest", "two"), _THREE, body="SELECT * FROM three")
SQL["split_document"] = _with(WIDE, SPLIT3, _split_two("rest", "two"), _THREE, body="SELECT image_id, split FROM three")
SQL["train_val_union"] = _with(WIDE, body="SELECT DISTINCT image_id FROM wide")
SQL["sample_ids"] = _with(WIDE, body="SELECT image_id FROM wide ORDER BY md5(image_id || '42'), image_id LIMIT 40")
SQL["first_ids"] = _with(WIDE, body="SELECT image_id FROM wide ORDER BY image_id LIMIT 40")
SQL["sample_weights"] = _with(WIDE, body="""SELECT image_id, "any", round(1e0 / (count(*) OVER (PARTITION BY "any") + 1), 6) AS weight FROM wide""")


def _unit(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296e0)"


SQL["sample_draws"] = _with(WIDE, f"""num AS (SELECT image_id, "any" AS c, row_number() OVER (PARTITION BY "any" ORDER BY md5(image_id || '42'), image_id) - 1 AS pos FROM wide),
tot AS (SELECT count(*) FILTER (WHERE "any" = 1) AS n1, count(*) FILTER (WHERE "any" = 0) AS n0 FROM wide),
drawn AS (SELECT image_id AS draw_id, n1, n0, CASE WHEN {_unit("image_id || 'c42'")} * (n0 / (n0 + 1e0) + n1 / (n1 + 1e0)) < n1 / (n1 + 1e0) THEN 1 ELSE 0 END AS c,
  {_unit("image_id || 'r42'")} AS u FROM wide CROSS JOIN tot)""", body="""
SELECT draw_id, num.image_id, drawn.c AS "any" FROM drawn JOIN num ON num.c = drawn.c AND num.pos = floor(u * CASE WHEN drawn.c = 1 THEN n1 ELSE n0 END)""")
SQL["even_subsample"] = _with(SLICES, """placed AS (SELECT study_uid, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY study_uid ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, count(*) OVER (PARTITION BY study_uid) AS n FROM slices)""",
    body="""SELECT * EXCLUDE (n) FROM placed WHERE n <= 3 OR position IN (0, floor(n / 3e0)::BIGINT, floor(2 * (n / 3e0))::BIGINT)""")
SQL["spaced_picks"] = _with(SLICES, INDEXED, """counts AS (SELECT study_uid, count(*) AS n FROM slices GROUP BY study_uid),
bounds AS (SELECT *, floor(n / 5) AS a, floor(4 * n / 5) AS b FROM counts),
picks AS (SELECT study_uid, pick::INT AS pick, floor(CASE WHEN pick = 5 THEN b ELSE pick * ((b - a) / 5e0) + a END)::BIGINT AS slice_index FROM bounds, range(6) t(pick))""",
    body="SELECT study_uid, slice_index, pick, z_mm FROM picks JOIN indexed USING (study_uid, slice_index)")
_five = ", ".join(K.VOTE_CODES)
SQL["votes_majority"] = _with(READS, MAJORITY, body=f'SELECT *, greatest({_five}) AS "any" FROM majority')
SQL["votes_negative"] = _with(READS, body="SELECT name, ord FROM reads WHERE r1_ich + r2_ich + r3_ich = 0 ORDER BY ord LIMIT 5")


def _greedy() -> str:
    order = list(K.VOTE_CODES)
    ctes, used = [], []
    for k in range(5):
        def open_(c: str) -> str:
            return f"{c} = 1" + "".join(f" AND '{c}' <> coalesce((SELECT class FROM pick{j}), '')" for j in range(k))
        names = "".join(f" AND name <> coalesce((SELECT name FROM pick{j}), '')" for j in range(k))
        cls = "CASE " + " ".join(f"WHEN {open_(c)} THEN '{c}'" for c in order) + " END"
        ctes.append(f"pick{k} AS (SELECT * FROM (SELECT {cls} AS class, name, ord FROM majority WHERE TRUE{names}) "
                    "WHERE class IS NOT NULL ORDER BY ord LIMIT 1)")
        used.append(f"SELECT class, name, ord FROM pick{k}")
    return _with(READS, MAJORITY, *ctes, body=" UNION ALL ".join(used))


SQL["votes_greedy"] = _greedy()

# ---- pixels ----------------------------------------------------------------------------------


def _digest(col: str, prefix: str) -> str:
    return (f"round(list_sum({col}), 5) AS {prefix}_sum, round(list_min({col}), 6) AS {prefix}_min, "
            f"round(list_max({col}), 6) AS {prefix}_max, round({col}[8], 6) AS {prefix}_7")


def _win(lo: float, hi: float) -> str:
    return f"list_transform(hu, lambda v: greatest(0e0, least(1e0, (v - {lo}::DOUBLE) / {hi - lo}::DOUBLE)))"


SQL["window_encode"] = _with(BLOCKS, "enc AS (SELECT image_id, " + ", ".join(f"{_win(*w)} AS {n}" for n, w in K.WINDOWS.items()) + " FROM blocks)",
                             body="SELECT image_id, " + ", ".join(_digest(n, n) for n in K.WINDOWS) + " FROM enc")
SQL["window_encode_arrow"] = _with(BLOCKS, body="""SELECT image_id, round(greatest(0, least(1, (list_max(list_transform(hu, lambda v: v::FLOAT))::FLOAT - (-200)::FLOAT) / 400::FLOAT))::DOUBLE, 4) AS top,
  len(hu) AS n FROM blocks""")
SQL["hu_convert"] = _with(BLOCKS, RAW, body="SELECT image_id, " + _digest("hu", "hu") + " FROM raw_blocks")
SQL["pixel_check"] = _with(BLOCKS, RAW, body="""SELECT image_id, CASE WHEN list_min(hu) > 200 THEN 'all_above_200'
  WHEN list_min(hu) >= 0 AND list_max(hu) <= 400 THEN 'unconverted_range' WHEN list_max(hu) > 4096 AND list_min(hu) >= 0 THEN 'intercept_not_applied'
  WHEN list_max(hu) < 0 THEN 'no_tissue' END AS reject_rule FROM raw_blocks""")


def _within(lo: float, hi: float, h: str = "hu") -> str:
    return f"len(list_filter({h}, lambda v: v >= {lo} AND v <= {hi}))"


SQL["tissue_fraction"] = _with(BLOCKS, body=f"""SELECT image_id, {_within(*K.GRAY_HU)} AS gray, {_within(*K.BLOOD_HU)} AS blood,
  round({_within(*K.OVERLAY_HU)} / len(hu), 6) AS overlay_share FROM blocks""")
SQL["stored_roundtrip"] = _with(BLOCKS, f"""st AS (SELECT image_id, {_win(-300.0, 180.0)} AS stored,
  list_transform(hu, lambda v: (v - list_min(hu)) / (list_max(hu) - list_min(hu))) AS own FROM blocks),
bk AS (SELECT image_id, own, list_transform(stored, lambda v: v * 480e0 - 300e0) AS back FROM st)""",
    body="SELECT image_id, " + _digest("back", "back") + ", " + _digest("own", "own") + " FROM bk")


def _half(v: str) -> str:
    unit = f"pow(2e0, greatest(floor(log2({v})), -14) - 10)"
    return f"CASE WHEN {v} <= 0 THEN 0e0 ELSE round_even({v} / {unit}, 0) * {unit} END"


def _enc(lo: float, hi: float) -> str:
    return f"greatest(0e0, least(1e0, (v - {lo}::DOUBLE) / {hi - lo}::DOUBLE))"


COUNTS = f"""usable AS (SELECT * FROM blocks WHERE {_within(*K.GRAY_HU)} >= 2 AND {_within(*K.BLOOD_HU)} >= 2),
px AS (SELECT unnest(hu) AS v, list_min(hu) AS lo, list_max(hu) AS hi FROM usable),
tissue AS (SELECT *, CASE WHEN v BETWEEN 28 AND 42 THEN 'gray' WHEN v BETWEEN 50 AND 80 THEN 'blood' END AS tissue FROM px),
raw_vals AS (SELECT tissue, 'per_image' AS scheme, (v - lo) / (hi - lo) AS x FROM tissue WHERE tissue IS NOT NULL AND hi - lo >= 1
  UNION ALL SELECT tissue, 'medium', {_enc(*K.WINDOWS['medium'])} FROM tissue WHERE tissue IS NOT NULL
  UNION ALL SELECT tissue, 'narrow', {_enc(*K.WINDOWS['narrow'])} FROM tissue WHERE tissue IS NOT NULL),
vals AS (SELECT tissue, scheme, {_half('x')} AS value FROM raw_vals)"""
OVERLAP = """rng AS (SELECT scheme, min(value) AS lo, max(value) AS hi FROM vals GROUP BY scheme),
tot AS (SELECT scheme, tissue, count(*) AS total FROM vals GROUP BY ALL),
bins AS (SELECT v.scheme, v.tissue, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 3e2)), 299) ELSE 0 END AS bin, count(*) / any_value(total) AS share
  FROM vals v JOIN rng USING (scheme) JOIN tot t ON t.scheme = v.scheme AND t.tissue = v.tissue GROUP BY ALL),
overlap AS (SELECT b.scheme, CASE WHEN any_value(hi) > any_value(lo) THEN sum(least(g, bl)) ELSE 1e0 END AS overlap FROM (
  SELECT scheme, bin, coalesce(sum(share) FILTER (WHERE tissue = 'gray'), 0) AS g, coalesce(sum(share) FILTER (WHERE tissue = 'blood'), 0) AS bl
  FROM bins GROUP BY ALL) b JOIN rng USING (scheme) GROUP BY b.scheme)"""
SQL["encoding_stats"] = _with(BLOCKS, COUNTS, body="""SELECT scheme, tissue, count(*) AS n_pixels, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median FROM vals GROUP BY ALL""")
SQL["encoding_overlap"] = _with(BLOCKS, COUNTS, OVERLAP, body="SELECT scheme, round(overlap, 6) AS overlap FROM overlap")
SQL["tissue_separation"] = _with(BLOCKS, COUNTS, OVERLAP, body="""SELECT scheme,
  round(abs(avg(value) FILTER (WHERE tissue = 'blood') - avg(value) FILTER (WHERE tissue = 'gray')), 6) AS delta_mean,
  round(any_value(overlap), 6) AS overlap, count(*) FILTER (WHERE tissue = 'gray') AS gray_n_pixels, count(*) FILTER (WHERE tissue = 'blood') AS blood_n_pixels
  FROM vals JOIN overlap USING (scheme) GROUP BY scheme""")
SQL["score_batch"] = _with(BLOCKS, "t AS (SELECT image_id, list_transform(hu, lambda v: v / 4e2) AS b FROM blocks)", body="SELECT image_id, " + ", ".join(
    f"round(1e0 / (1e0 + exp(-(list_sum(list_transform(range(64), lambda k: b[k + 1] * (((k * 7 + {i * 11}) % 13 - 6) / 1e2))) + {i} / 1e1 - 3e-1))), 6) AS p_{c}"
    for i, c in enumerate(CLASSES)) + " FROM t")
SQL["resize_half_pixel"] = _with(BLOCKS, body="""SELECT image_id, round((hu[1] + hu[2] + hu[9] + hu[10]) / 4, 6) AS first,
  round((hu[21] + hu[22] + hu[29] + hu[30]) / 4, 6) AS seventh, 16::BIGINT AS n FROM blocks""")
SQL["resize_corner"] = _with(BLOCKS, body="""SELECT image_id, round(hu[1], 6) AS first,
  round((hu[1] + hu[2] + hu[9] + hu[10]) / 4, 6) AS inner, round(hu[64], 6) AS last FROM blocks""")
_key = "image_id || '|' || copy || '|42'"
SQL["augment"] = _with(BLOCKS, f"""enc AS (SELECT image_id, {_win(*K.WINDOWS['medium'])} AS b FROM blocks),
drawn AS (SELECT *, {_unit(_key + " || 'f'")} > 0.5 AS flip, floor({_unit(_key + " || 't'")} * 4)::INT AS turns,
  ({_unit(_key + " || 'j'")} * 2 - 1) * 4e-2 AS shift FROM (SELECT *, unnest([0, 1]) AS copy FROM enc))""", body="""
SELECT image_id, copy::INT AS copy, flip, turns, round(shift, 6) AS shift,
  round(greatest(0, least(1, b[CASE turns WHEN 0 THEN CASE WHEN flip THEN 8 ELSE 1 END WHEN 1 THEN CASE WHEN flip THEN 1 ELSE 8 END
    WHEN 2 THEN CASE WHEN flip THEN 57 ELSE 64 END ELSE CASE WHEN flip THEN 64 ELSE 57 END END] + shift)), 6) AS first,
  round(list_sum(list_transform(b, lambda v: greatest(0, least(1, v + shift)))), 5) AS total FROM drawn""")
SQL["quarantine"] = _with(BLOCKS, body="""SELECT image_id, CASE WHEN list_max(hu) < 100 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN list_max(hu) < 100 THEN 'no bright pixel' END AS message, CASE WHEN list_max(hu) >= 100 THEN round(hu[1], 6) END AS first FROM blocks""")
SQL["quarantine_log"] = _with(BLOCKS, body="""SELECT image_id, CASE WHEN list_max(hu) < 100 THEN 'no bright pixel' END AS reason,
  CASE WHEN list_max(hu) >= 100 THEN round(hu[2], 6) END AS second FROM blocks""")
SQL["windows_three"] = _with(BLOCKS, "enc AS (SELECT image_id, " + ", ".join(
    f"list_transform(hu, lambda v: {_half(f'greatest(0, least(1, (v::FLOAT - ({lo})::FLOAT) / ({hi - lo})::FLOAT))::DOUBLE')}) AS {n}"
    for n, (lo, hi) in K.WINDOWS.items() if n != "balanced") + " FROM blocks)",
    body="SELECT image_id, " + ", ".join(_digest(n, n) for n in ("wide", "medium", "narrow")) + " FROM enc")
_PACKED = f"""enc AS (SELECT *, {_win(*K.WINDOWS['medium'])} AS b FROM blocks),
halves AS (SELECT image_id, label, list_transform(b, lambda v: {_half('v')}) AS v FROM enc)"""
SQL["tensor_store"] = _with(BLOCKS, _PACKED, body="""SELECT 'medium' AS "window", CASE WHEN label < 5 THEN 'train' ELSE 'val' END AS split, count(*) AS n,
  count(DISTINCT image_id) AS ids, sum(64)::BIGINT AS cells, sum(128)::BIGINT AS bytes,
  sum(list_sum(list_transform(v, lambda x: (x * 16777216)::BIGINT)))::BIGINT AS units FROM halves GROUP BY ALL""")
_mean = "(v[{0}] + v[{0} + 1] + v[{0} + 8] + v[{0} + 9]) / 4"
SQL["packed_resize"] = _with(BLOCKS, _PACKED, f"means AS (SELECT image_id, {_mean.format(1)} AS a, {_mean.format(21)} AS b FROM halves)", body=f"""
SELECT image_id, 32::BIGINT AS bytes, true AS fits, {_half('a')} AS first,
  {_half('b')} AS seventh FROM means""")
SQL["packed_augment"] = _with(BLOCKS, _PACKED, f"""drawn AS (SELECT *, {_unit(_key + " || 'f'")} > 0.5 AS flip, floor({_unit(_key + " || 't'")} * 4)::INT AS turns,
  ({_unit(_key + " || 'j'")} * 2 - 1) * 4e-2 AS shift FROM (SELECT *, unnest([0, 1]) AS copy FROM halves)),
moved AS (SELECT *, greatest(0, least(1, v[CASE turns WHEN 0 THEN CASE WHEN flip THEN 8 ELSE 1 END WHEN 1 THEN CASE WHEN flip THEN 1 ELSE 8 END
  WHEN 2 THEN CASE WHEN flip THEN 57 ELSE 64 END ELSE CASE WHEN flip THEN 64 ELSE 57 END END] + shift)) AS x FROM drawn)""", body=f"""
SELECT image_id, copy::INT AS copy, flip, turns, 128::BIGINT AS bytes,
  round({_half('x')}, 2) AS first FROM moved""")

# ---- text ------------------------------------------------------------------------------------

_NAMES = """names AS (SELECT CASE l_linenumber WHEN 1 THEN 'a.b/ID_' || l_partkey || '.dcm' WHEN 2 THEN 'in/1.2.840.' || l_partkey || '.dcm'
  WHEN 3 THEN 'x/y/ct-' || l_suppkey || '-' || l_partkey || '.DCM' WHEN 4 THEN 'scan ' || l_partkey || '(x).dcm'
  WHEN 5 THEN 'd/x.y_' || l_partkey || '.z!.dcm' ELSE 'd/im_' || l_partkey || '_' || l_suppkey END AS path FROM lineitem),
stems AS (SELECT DISTINCT path, CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+\\.[^.]+$')
  THEN regexp_extract(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]+$', 1) ELSE regexp_extract(path, '[^/]*$') END AS stem FROM names)"""


def _tail(sep: str) -> str:
    last = f"split_part(stem, '{sep}', -1)"
    return f"CASE WHEN contains(stem, '{sep}') AND regexp_full_match({last}, '[\\p{{L}}\\p{{N}}]+') THEN 'ID_' || {last} END"


SQL["image_ids"] = _with(_NAMES, body=f"""SELECT path, CASE WHEN starts_with(stem, 'ID_') THEN stem ELSE
  coalesce({_tail('.')}, {_tail('_')}, {_tail('-')}, regexp_replace(stem, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')) END AS image_id FROM stems""")
SQL["study_numbers"] = "SELECT 'CASE-CT-' || o_orderkey AS name, o_orderkey::INT AS number FROM orders"
SQL["locations"] = f"""SELECT raw, n, {_location('raw')} AS location FROM (
  SELECT source || ' ' || lang || ' o''hara-2nd wing' AS raw, count(*) AS n FROM documents GROUP BY 1)"""
SQL["description_scores"] = f"""SELECT p_partkey, {_score("w")}::BIGINT AS score, CASE WHEN p_size % 3 = 2 THEN p_size::DOUBLE ELSE 99e0 END AS thickness
  FROM (SELECT *, p_name || ' ' || p_type || ' ' || CASE WHEN p_size > 25 THEN 'Brain CTA w/o' ELSE 'head 3D' END AS w FROM part)"""
SQL["exam_times"] = """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS exam_date,
  CASE WHEN event_type IN ('error', 'signup') THEN '' WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS exam_datetime,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN ts::DATE END AS typed FROM events"""
SQL["display_formats"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_fixed('l_tax * 100', 1)} || '%' AS pct,
  printf('%+.1f mm', (l_quantity - 25.25)::DOUBLE) AS z,
  printf('%d:%02d:%02d', floor(l_extendedprice)::BIGINT // 3600, floor(l_extendedprice)::BIGINT % 3600 // 60, floor(l_extendedprice)::BIGINT % 60) AS elapsed,
  CASE WHEN l_quantity > 10 THEN {_fixed('l_tax * 100', 2)} || '%' ELSE '<10 studies' END AS rate FROM lineitem"""
SQL["indication_prior"] = _with(WORKLIST, body=f"SELECT study_uid, indication, {_prior('indication')} AS prior FROM worklist")
SQL["class_indications"] = _with(SLICES, STUDY_LABELS, body=f"""SELECT study_uid, CASE {_cases('k', K.CLASS_INDICATIONS)} ELSE {_q(K.DEFAULT_INDICATION)} END AS indication
  FROM (SELECT *, CASE WHEN dominant_class <> '' THEN dominant_class WHEN study_positive THEN 'other' ELSE 'negative' END AS k FROM study_labels)""")

SQL["sql_functions"] = _with(WORKLIST, "loc AS (SELECT *, indication || ' o''hara wing' AS raw FROM worklist)", body=f"""
SELECT study_uid, {_prior('indication')} AS prior, CASE WHEN physician_stat THEN 0 WHEN ai_positive THEN 1 ELSE 2 END AS tier,
  {_location('raw')} AS location, {_title('patient_id')} AS patient, substr(exam_time, 1, 10) AS day,
  round(greatest(0e0, least(1e0, (prob_any * 100 - 48) / 42)), 6) AS enc, round(1e0 / (1e0 + exp(-prob_any)), 6) AS p, study_uid::INT AS number,
  {_score('indication')} AS score, 'ID_' || study_uid AS image, 'any' AS cls FROM loc""")

# ---- worklist, report, ledger ----------------------------------------------------------------

SQL["worklist_view"] = _with(WORKLIST, f"wp AS (SELECT *, {_prior('indication')} AS prevalence FROM worklist)", _bayes("prevalence", "wp"), body=f"""
SELECT study_uid, CASE WHEN physician_stat THEN 0 WHEN ai_positive THEN 1 ELSE 2 END AS tier,
  CASE WHEN physician_stat THEN 'STAT' WHEN ai_positive THEN 'AI△ICH' ELSE 'AI neg' END AS badge, patient_id AS patient, indication,
  CASE WHEN ai_positive THEN CASE WHEN dominant_class = '' THEN 'ICH detected' ELSE dominant_class END ELSE 'No ICH' END AS finding,
  {_fixed('prob_any', 3)} AS score, {_fixed('ppv * 100', 1)} || '% @' || {_fixed('prevalence * 100', 0)} || '%' AS ppv_at,
  {_fixed('pain_index', 2)} AS pain, exam_time FROM bayes""")
SQL["worklist_flags"] = _with(WORKLIST, body="""SELECT study_uid, ai_positive AS ai_priority_flag,
  CASE WHEN ai_positive THEN 'AI_ICH_DETECTED' ELSE 'AI_ICH_NEGATIVE' END AS flag_type,
  CASE WHEN ai_positive THEN 'AI-detected ' || dominant_class ELSE 'AI screening negative — routine read' END AS flag_reason FROM worklist""")
SQL["worklist_upsert"] = _with(WORKLIST, body="""
SELECT study_uid, patient_id, CASE WHEN exam_time < '1999' THEN patient_name END AS patient_name,
  CASE WHEN exam_time >= '1997' AND NOT physician_stat THEN 'seen again' WHEN exam_time < '1999' THEN indication END AS indication,
  CASE WHEN exam_time < '1999' THEN physician_stat ELSE FALSE END AS physician_stat,
  CASE WHEN exam_time >= '1997' THEN TRUE ELSE ai_positive END AS ai_positive,
  CASE WHEN exam_time < '1999' THEN dominant_class END AS dominant_class,
  CASE WHEN exam_time < '1999' THEN exam_time ELSE '2024-01-31T12:00:00' END AS exam_time,
  CASE WHEN exam_time >= '1997' THEN '2024-01-31T12:00:00' ELSE '2024-01-01T00:00:00' END AS processed_time,
  exam_time >= '1999' AS is_new FROM worklist""")
SQL["worklist_lookup"] = _with(WORKLIST, body="SELECT study_uid, patient_id, exam_time FROM worklist WHERE study_uid = '77'")

SCREENED = f"""span AS (SELECT study_uid, min(slice_index) AS first_hot, max(slice_index) AS last_hot FROM hot GROUP BY study_uid),
joined AS (SELECT s.*, w.indication, {_prior('w.indication')} AS prevalence, first_hot, last_hot FROM scored s JOIN worklist w USING (study_uid)
  LEFT JOIN span USING (study_uid)), {_bayes('prevalence', 'joined')}"""
_listed = "coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN positive_{c} THEN {_q(K.CLASS_DISPLAY[c])} END" for c in _subs) + "), ''), dominant_class)"
_sc = "CASE dominant_key " + " ".join(f"WHEN '{c}' THEN prob_{c}" for c in _subs) + " ELSE prob_any END"


def _p0(x: str) -> str:
    return f"{_fixed(f'({x}) * 100', 0)} || '%'"


def _p1(x: str) -> str:
    return f"printf('%.1f', (({x}) * 100)::DOUBLE) || '%'"


_lead = ("'AI-assisted screening for intracranial hemorrhage (ICH) was performed on the submitted axial noncontrast CT head series (' "
         "|| slice_count || ' slices) using a slice classifier (mean AUC 0.986). '")
_note = K.SCREENING_NOTE
SQL["report_text"] = _with(SLICES, INDEXED, HOT, STUDY, WORKLIST, SCREENED, body=f"""
SELECT study_uid, CASE WHEN overall_positive THEN {_lead} || 'The study is POSITIVE for suspected ' || {_listed} || ' (model probability ' || {_p0(_sc)}
    || '; Sens 94%, Spec 95%; PPV ' || {_p1('ppv')} || ' at ' || {_p0('prevalence')} || ' local prevalence).'
    || CASE WHEN first_hot IS NULL THEN '' ELSE ' Most prominent finding at slice ' || (first_hot + 1)
      || CASE WHEN last_hot <> first_hot THEN '–' || (last_hot + 1) ELSE '' END || '.' END
    || ' This study has been flagged for priority radiologist review. {_note}'
  ELSE {_lead} || 'The study is NEGATIVE for ICH (model probability ' || {_p0('prob_any')} || '; Sens 94%, Spec 95%; NPV ' || {_p1('npv')}
    || ' at ' || {_p0('prevalence')} || ' local prevalence). Routine radiologist read is appropriate. {_note}' END AS paragraph,
  CASE WHEN overall_positive THEN '• Suspected ' || dominant_class || ' identified by AI screening (model score ' || {_p0(_sc)} || ', PPV ' || {_p1('ppv')}
    || ' at ' || {_p0('prevalence')} || ' prevalence). Study flagged for priority AI-detected review. {_note}'
  ELSE '• No ICH detected by AI screening (NPV ' || {_p1('npv')} || ' at ' || {_p0('prevalence')} || ' prevalence). Routine read appropriate. {_note}' END AS bullet
FROM bayes""")

def _items() -> str:
    """Report content as ordered (section, code, scheme, meaning, type, text, number) rows per study."""
    rows = []

    def add(ord_: str, section: str, code: str, scheme: str, meaning: str, kind: str, text: str, number: str = "NULL", src: str = "r",
            unit: str = "NULL") -> None:
        rows.append(f"SELECT study_uid, ({ord_})::INT AS ord, {_q(section)} AS section, {_q(code)} AS code, {_q(scheme)} AS scheme, {meaning} AS meaning, "
                    f"{_q(kind)} AS type, {text} AS text, ({number})::DOUBLE AS number, {unit}::VARCHAR AS unit FROM {src}")

    add("0", "method", "111001", "DCM", "'Algorithm Name'", "TEXT", "'slice classifier'")
    add("1", "method", "111003", "DCM", "'Algorithm Version'", "TEXT", "'Mean AUC 0.9864 — defaults'")
    add("2", "method", "111526", "DCM", "'Image Library'", "TEXT", "''")
    add("3", "method", "121106", "DCM", "'Key Images'", "TEXT", "'Evaluated ' || slice_count || ' axial NCCT slices'")
    add("4", "finding", "121071", "DCM", "'Finding'", "TEXT", "CASE WHEN overall_positive THEN 'POSITIVE — ' || dominant_class ELSE 'NEGATIVE' END")
    for i, c in enumerate(CLASSES):
        shown = K.CLASS_DISPLAY[c].capitalize()
        add(str(5 + i), "finding", "121071", "DCM", _q(shown), "TEXT",
            f"'{shown}: score ' || {_fixed(f'prob_{c} * 100', 1)} || '% (' || CASE WHEN positive_{c} THEN 'POSITIVE' ELSE 'negative' END || ')'")
    add("11", "key_images", "121106", "DCM", "'Key Images'", "TEXT",
        "'Slices with highest AI activation for detected ICH class. Spatial localization is approximate (slice-level model).'",
        src="(SELECT * FROM r WHERE n_hot > 0)")
    name = f"CASE {_cases('dominant_class', {c: d.capitalize() for c, d in K.CLASS_DISPLAY.items()})} END"
    add("11 + place", "key_images", "112039", "DCM", "'Tracking Identifier'", "TEXT",
        f"'Slice ' || slice_index || ' | z=' || printf('%+.1f mm', slice_z_mm::DOUBLE) || ' | ' || {name} || ' | score ' || {_fixed('prob * 100', 1)} || '%'",
        src="(SELECT h.*, row_number() OVER (PARTITION BY study_uid ORDER BY slice_index) AS place FROM hot h JOIN (SELECT study_uid FROM r) USING (study_uid))")
    at = _p0("prevalence")
    base = "11 + CASE WHEN n_hot > 0 THEN n_hot + 1 ELSE 0 END + "
    perf = [
        ("C25429", "NCIt", "Assumed Prevalence", "TEXT", f"{at} || ' (' || indication || ')'", "NULL", "NULL"),
        ("C0242960", "UMLS", "Metrics Source", "TEXT", "'defaults'", "NULL", "NULL"),
        ("C41189", "NCIt", "Sensitivity", "NUM", "NULL::VARCHAR", "94e-2", "'%'"),
        ("C41190", "NCIt", "Specificity", "NUM", "NULL::VARCHAR", "9453e-4", "'%'"),
        ("C25651", "NCIt", "Mean AUC", "NUM", "NULL::VARCHAR", "9864e-4", "'{1}'"),
        ("C41192", "NCIt", "Positive Predictive Value", "NUM", "NULL::VARCHAR", "ppv", "'%'"),
        ("C41194", "NCIt", "Negative Predictive Value", "NUM", "NULL::VARCHAR", "npv", "'%'"),
        ("C0392762", "UMLS", "Positive Likelihood Ratio", "TEXT", f"'LR+ = ' || {_fixed('lr_positive', 2)}", "NULL", "NULL"),
        ("C0392762", "UMLS", "Negative Likelihood Ratio", "TEXT", f"'LR- = ' || {_fixed('lr_negative', 4)}", "NULL", "NULL"),
        ("C0009401", "UMLS", "Confusion Matrix", "TEXT",
         f"'At assumed prevalence ' || {at} || ', per 1,000 cases:' || chr(10) || chr(10) || '              AI Positive   AI Negative' || chr(10) "
         "|| '  True ICH    ' || lpad(tp::VARCHAR, 11, ' ') || '   ' || lpad(fn::VARCHAR, 11, ' ') || '   (TP=' || tp || ', FN=' || fn || ')' || chr(10) "
         "|| '  No ICH      ' || lpad(fp::VARCHAR, 11, ' ') || '   ' || lpad(tn::VARCHAR, 11, ' ') || '   (FP=' || fp || ', TN=' || tn || ')' || chr(10)", "NULL", "NULL"),
        ("C0030705", "UMLS", "Pain Index", "TEXT",
         f"'Pain Index (FP:TP ratio) = ' || {_fixed('pain_index', 2)} || ' at ' || {at} || ' prevalence: for every ' || tp || ' true ICH detections, the radiologist must "
         "review and override ' || fp || ' false positive AI flags. Each override represents additional review time and cognitive load required to reject an incorrect AI positive call.'",
         "NULL", "NULL")]
    for i, (code, scheme, meaning, kind, text, number, unit) in enumerate(perf):
        add(base + str(i), "performance", code, scheme, _q(meaning), kind, text, number, unit=unit)
    add(base + "11", "disclaimer", "121106", "DCM", "'Key Images'", "TEXT", _q(K.DISCLAIMER))
    return " UNION ALL ".join(rows)


SQL["report_items"] = _with(SLICES, INDEXED, HOT, STUDY, WORKLIST, SCREENED,
                            "r AS (SELECT b.*, coalesce(n, 0) AS n_hot FROM bayes b LEFT JOIN (SELECT study_uid, count(*) AS n FROM hot GROUP BY study_uid) USING (study_uid))",
                            body=_items())
_ws = "E' \\t\\n\\r\\x0b\\x0c'"
SQL["report_sections"] = f"""WITH t AS (
  SELECT conv_id || '/' || turn || '/' || role AS study_uid, CASE turn % 4
    WHEN 0 THEN 'x report body paragraph: ' || text || chr(10) || 'Impression Bullet Point:' || chr(10) || role || ' '
    WHEN 1 THEN ' report body paragraph: ' || text WHEN 2 THEN text || chr(10) || 'Impression Bullet Point:' || chr(10) || role || ' report body paragraph: late'
    ELSE text END AS r FROM conversations),
m AS (SELECT *, strpos(upper(r), '{K.BODY_MARKER}') AS b, strpos(upper(r), '{K.BULLET_MARKER}') AS i FROM t)
SELECT study_uid, CASE WHEN b = 0 THEN '' WHEN i > b THEN trim(substr(r, b + {len(K.BODY_MARKER)}, i - b - {len(K.BODY_MARKER)}), {_ws})
    ELSE trim(substr(r, b + {len(K.BODY_MARKER)}), {_ws}) END AS paragraph,
  CASE WHEN i > 0 THEN trim(substr(r, i + {len(K.BULLET_MARKER)}), {_ws}) ELSE '' END AS bullet FROM m"""
_nums = [*K.LEDGER_NUMBERS, "total_tokens"]
TOTALS = "totals AS (SELECT study_id, count(*) AS calls, " + ", ".join(
    f"sum({c})::BIGINT AS {c}" for c in K.LEDGER_NUMBERS) + ", sum(" + " + ".join(K.LEDGER_NUMBERS) + ")::BIGINT AS total_tokens FROM ledger GROUP BY study_id)"
SQL["ledger_totals"] = _with(LEDGER, TOTALS, body="SELECT * FROM totals")
SQL["ledger_file"] = SQL["ledger_totals"]
SQL["ledger_average"] = _with(LEDGER, TOTALS, body="""SELECT count(*) AS studies, round(avg(input_tokens), 1) AS avg_input_tokens,
  round(avg(output_tokens), 1) AS avg_output_tokens, round(avg(total_tokens), 1) AS avg_total_tokens FROM totals""")
SQL["ledger_count_only"] = """SELECT role || ' [count_only]' AS stage, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens
  FROM conversations WHERE role <> 'assistant' GROUP BY 1"""

# ---- geometry --------------------------------------------------------------------------------

_two = """geo AS (SELECT CAST(l_orderkey AS VARCHAR) AS study_uid, l_partkey * 0.5::DOUBLE AS x, l_suppkey * 0.25::DOUBLE AS y, l_quantity AS z,
  l_returnflag <> 'N' AS oriented, l_linenumber * 0.25::DOUBLE AS ps1, CASE WHEN l_linestatus = 'F' THEN 2.5 ELSE 5.0 END::DOUBLE AS thick,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
pair AS (SELECT a.*, b.x AS x2, b.y AS y2, b.z AS z2 FROM geo a LEFT JOIN geo b ON b.study_uid = a.study_uid AND b.rn = 2 WHERE a.rn = 1)"""
SQL["series_geometry"] = _with(_two, body="""
SELECT study_uid, CASE WHEN oriented THEN -0.5 ELSE 0 END::DOUBLE AS a00, CASE WHEN oriented THEN 0 ELSE ps1 END AS a01, round(coalesce(x2 - x, 0), 6) AS a02, round(x, 6) AS a03,
  CASE WHEN oriented THEN 0 ELSE 0.5 END::DOUBLE AS a04, CASE WHEN oriented THEN ps1 ELSE 0 END AS a05, round(coalesce(y2 - y, 0), 6) AS a06, round(y, 6) AS a07,
  0e0 AS a08, 0e0 AS a09, round(coalesce(z2 - z, thick), 6) AS a10, round(z, 6) AS a11 FROM pair""")

# ---- tables, flows and streams ---------------------------------------------------------------

SQL["results_table"] = _with(RESULTS, body="""
SELECT study_uid, patient_id, exam_date, NULL::VARCHAR AS exam_datetime, location, raw_department,
  CASE WHEN exam_date >= DATE '2024-01-11' THEN 1 - ai_positive ELSE ai_positive END AS ai_positive, NULL::VARCHAR AS dominant_class, prob_any,
  NULL::DOUBLE AS prob_epidural, NULL::DOUBLE AS prob_intraparenchymal, NULL::DOUBLE AS prob_intraventricular, NULL::DOUBLE AS prob_subarachnoid,
  NULL::DOUBLE AS prob_subdural, NULL::VARCHAR AS series_folder, NULL::VARCHAR AS checkpoint, NULL::VARCHAR AS processed_datetime FROM results""")
_SCAN_SLICES = SLICES.replace("slices AS (SELECT", "all_slices AS (SELECT")
SQL["result_export"] = _with(RESULTS, body="SELECT study_uid, exam_date, location, ai_positive, prob_any FROM results")
def _archive(routed: str, sound: str = "TRUE") -> str:
    return f"""WITH {routed}, {_SCAN_SLICES},
slices AS (SELECT a.* FROM all_slices a JOIN part ON l_partkey = p_partkey
  JOIN routed r ON r.status = 'ready' AND r.study_uid = a.study_uid AND r.series_uid = a.study_uid || '.' || p_type), {STUDY},
about AS (SELECT CAST(l_orderkey AS VARCHAR) AS study_uid, arg_min('P' || l_suppkey, path) AS patient_id,
  arg_min(CASE WHEN l_linenumber = 3 THEN '' ELSE lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') || ':30:15' END, path) AS clock,
  arg_min(CASE p_size % 4 WHEN 0 THEN 'Emergency Dept 2' WHEN 1 THEN 'Neuro ICU' WHEN 2 THEN 'o''neil annex 3rd' ELSE '' END, path) AS raw_department
  FROM (SELECT *, l_orderkey || '/' || p_type || '/' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.dcm' AS path
    FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1)
SELECT study_uid, patient_id, TRY_CAST(exam_date AS DATE) AS exam_date,
  TRY_CAST(exam_date AS DATE)::VARCHAR || CASE WHEN clock = '' THEN '' ELSE 'T' || clock END AS exam_datetime,
  {_location('raw_department')} AS location, raw_department, overall_positive::INT AS ai_positive, dominant_class,
  {', '.join(f'prob_{c}' for c in CLASSES)}, series_folder, '' AS checkpoint, NULL::VARCHAR AS processed_datetime
  FROM scored JOIN (SELECT * FROM routed WHERE status = 'ready' AND TRY_CAST(exam_date AS DATE) IS NOT NULL) USING (study_uid)
  JOIN about USING (study_uid) WHERE {sound}"""

SQL["archive_scan"] = SQL["stream_scan"] = _archive(ALL_ROUTED)
# the archive with planted failures: unreadable headers, blocks that the scorer refuses
_BROKEN = ", ".join([
    HEADERS.replace("CASE WHEN l_linenumber = 5", "CASE WHEN l_suppkey % 13 = 0 AND l_linenumber < 3 THEN 'x' ELSE '' END AS error, CASE WHEN l_linenumber = 5"),
    PROCESSED, SERIES.replace("FROM headers GROUP", "FROM headers WHERE error = '' GROUP"), CHOSEN,
    ROUTED.replace("count(*) AS n_files,", "count(*) AS n_files, arg_min(error, path) AS error,")
    .replace("CASE WHEN modality <> 'CT'", "CASE WHEN error <> '' THEN 'header_read_error' WHEN modality <> 'CT'"),
    """failed AS (SELECT DISTINCT r.study_uid FROM routed r JOIN lineitem ON r.study_uid = CAST(l_orderkey AS VARCHAR) JOIN part ON l_partkey = p_partkey
  WHERE r.status = 'ready' AND r.series_uid = r.study_uid || '.' || p_type AND l_partkey % 41 = 0 AND l_linenumber = 2),
outcomes AS (SELECT r.* REPLACE (CASE WHEN f.study_uid IS NULL THEN status ELSE 'error' END AS status,
  CASE WHEN f.study_uid IS NULL THEN reason ELSE 'block out of range' END AS reason) FROM routed r LEFT JOIN failed f USING (study_uid))"""])
SQL["archive_scored"] = _archive(_BROKEN, "study_uid NOT IN (SELECT study_uid FROM failed)")
SQL["archive_outcomes"] = f"WITH {_BROKEN} SELECT study_uid, status, reason, exam_date, n_files, series_uid, slice_count FROM outcomes"
SQL["archive_outcome_counters"] = SQL["scan_counters"].replace(ALL_ROUTED, _BROKEN).replace("FROM routed GROUP", "FROM outcomes GROUP")
# image files written out of orders
_FILES = f"""sized AS (SELECT *, o_orderkey % 40 AS size, 's' || substr(o_orderpriority, 1, 1) AS series FROM orders),
listed AS (SELECT *, CASE WHEN count(DISTINCT series) OVER (PARTITION BY o_custkey) >= 2 THEN CAST(o_custkey AS VARCHAR)
    ELSE o_custkey || '/' || series END AS study_folder, o_custkey || '/' || series || '/' || o_orderkey || '.dcm' AS path,
  o_orderkey % 29 = 0 AS broken, CASE WHEN size = 7 THEN 'MR' ELSE 'CT' END AS modality,
  CASE size % 4 WHEN 0 THEN 'AXIAL HEAD W/O' WHEN 1 THEN 'Brain noncontrast thin' WHEN 2 THEN 'CTA HEAD' ELSE '' END AS series_description,
  size::DOUBLE AS thickness, size % 11 = 0 AS derived FROM sized),
placed AS (SELECT *, row_number() OVER (PARTITION BY study_folder ORDER BY path) AS rn, count(*) OVER (PARTITION BY study_folder) AS n_files FROM listed),
firsts AS (SELECT study_folder, n_files, CASE WHEN NOT broken THEN CAST(o_custkey AS VARCHAR) END AS study_uid,
  CASE WHEN broken THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS exam_date,
  CASE WHEN broken THEN 'header_read_error' WHEN modality <> 'CT' THEN 'wrong_modality_' || modality
    WHEN o_custkey % 9 = 0 THEN 'non_head_desc' ELSE '' END AS reason FROM placed WHERE rn = 1),
early AS (SELECT *, CASE WHEN reason <> '' THEN 'not_head_ct' WHEN exam_date < CAST(DATE '2001-12-31' - 2000 AS VARCHAR) THEN 'date_filtered'
  WHEN study_uid IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0) THEN 'already_processed' END AS early FROM firsts),
groups AS (SELECT study_folder, series AS series_uid, count(*) AS slice_count, min(path) AS first_path, arg_min(modality, path) AS modality,
  arg_min(series_description, path) AS series_description, arg_min(thickness, path) AS thickness, arg_min(derived, path) AS derived
  FROM placed WHERE NOT broken GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY study_folder ORDER BY score DESC, thickness, first_path) AS pick FROM (
  SELECT *, {_score('series_description')} AS score FROM groups WHERE modality = 'CT' AND NOT derived AND slice_count >= 2)
  WHERE score > 0 OR series_description = ''),
staged AS (SELECT e.*, coalesce(early, CASE WHEN c.study_folder IS NULL THEN 'no_ncct_series' ELSE 'ready' END) AS status,
  CASE WHEN early IS NULL THEN c.series_uid END AS series_uid, CASE WHEN early IS NULL THEN c.slice_count END AS slice_count
  FROM early e LEFT JOIN (SELECT * FROM chosen WHERE pick = 1) c USING (study_folder))"""
SQL["staged_scan"] = f"WITH {_FILES} SELECT study_folder, study_uid, status, reason, exam_date, n_files, series_uid, slice_count FROM staged"
SQL["staged_headers"] = f"""WITH {_FILES} SELECT path, CASE WHEN rn = 1 THEN 1 ELSE 2 END::INT AS stage, CASE WHEN NOT broken THEN CAST(o_custkey AS VARCHAR) END AS study_uid,
  CASE WHEN NOT broken THEN modality END AS modality, CASE WHEN NOT broken THEN strftime(o_orderdate, '%Y%m%d') END AS study_date, broken AS unreadable
  FROM placed JOIN early USING (study_folder) WHERE rn = 1 OR early IS NULL"""
# a file is its header, a zero byte and 5000 bytes
SQL["file_listing"] = f"""WITH {_FILES} SELECT study_folder, count(*) AS n_files, sum(5001 + CASE WHEN broken THEN 14 ELSE length(
  '{{"study_uid":"' || o_custkey || '","series_uid":"' || series || '","modality":"' || modality || '","series_description":"' || series_description
  || '","study_description":"' || CASE WHEN o_custkey % 9 = 0 THEN 'CT CHEST' ELSE '' END || '","slice_thickness":"' || size || '","image_type":["'
  || CASE WHEN derived THEN 'DERIVED' ELSE 'ORIGINAL' END || '"],"study_date":"' || strftime(o_orderdate, '%Y%m%d') || '"}}') END)::BIGINT AS n_bytes
  FROM placed GROUP BY study_folder"""
BATCH = f"""manifest AS (SELECT study_uid, CASE WHEN study_positive THEN 'positive' ELSE 'negative' END AS grp,
  CASE WHEN dominant_class <> '' THEN dominant_class WHEN study_positive THEN 'positive' ELSE 'negative' END AS k FROM study_labels),
wanted AS (SELECT study_uid, grp, CASE {_cases('k', K.CLASS_INDICATIONS)} ELSE {_q(K.DEFAULT_INDICATION)} END AS indication,
  'DEMO^' || upper(k) AS patient_name, p.study_uid IS NOT NULL AS seen FROM manifest LEFT JOIN processed p USING (study_uid)),
kept AS (SELECT CASE WHEN count(*) >= 30 THEN round(sum(ai_positive) / count(*), 6) END AS stored FROM results),
span AS (SELECT study_uid, min(slice_index) AS first_hot, max(slice_index) AS last_hot FROM hot GROUP BY study_uid),
joined AS (SELECT s.*, w.grp, w.indication, w.patient_name, w.seen, coalesce(stored, {_prior('w.indication')}) AS prevalence FROM wanted w JOIN scored s USING (study_uid) CROSS JOIN kept),
{_bayes('prevalence', 'joined')}"""
_score_text = "CASE dominant_key " + " ".join(f"WHEN '{c}' THEN prob_{c}" for c in K.SUBTYPES) + " ELSE prob_any END"
BATCH_ROWS = f"""SELECT study_uid, grp AS "group", indication, patient_name,
  CASE WHEN seen THEN NULL ELSE overall_positive END AS ai_positive,
  CASE WHEN NOT seen THEN CASE WHEN overall_positive THEN dominant_class ELSE '' END END AS dominant_class,
  CASE WHEN NOT seen THEN prob_any END AS prob_any, CASE WHEN NOT seen THEN prevalence END AS prevalence,
  CASE WHEN NOT seen THEN ppv END AS ppv, CASE WHEN NOT seen THEN npv END AS npv, CASE WHEN NOT seen THEN pain_index END AS pain_index,
  CASE WHEN NOT seen THEN CASE WHEN overall_positive THEN '• Suspected ' || dominant_class || ' identified by AI screening (model score ' || {_p0(_score_text)} || ', PPV ' || {_p1('ppv')}
    || ' at ' || {_p0('prevalence')} || ' prevalence). Study flagged for priority AI-detected review. {_note}'
  ELSE '• No ICH detected by AI screening (NPV ' || {_p1('npv')} || ' at ' || {_p0('prevalence')} || ' prevalence). Routine read appropriate. {_note}' END END AS bullet,
  CASE WHEN seen THEN 'skipped' WHEN overall_positive THEN 'OK — POSITIVE' ELSE 'OK — negative' END AS status FROM bayes"""
_batch = (SLICES, INDEXED, HOT, STUDY, STUDY_LABELS, PROCESSED, RESULTS, BATCH)
SQL["batch_run"] = _with(*_batch, body=BATCH_ROWS)
SQL["batch_counters"] = _with(*_batch, body="""SELECT grp AS "group", count(*) FILTER (WHERE seen) AS skipped, 0::BIGINT AS errors,
  count(*) FILTER (WHERE NOT seen) AS processed FROM bayes GROUP BY grp""")
SQL["stream_results"] = _with(RESULTS, body="SELECT study_uid, exam_date, location, ai_positive, prob_any FROM results")
SQL["stream_prevalence"] = _with(RESULTS, body="""SELECT DATE '1970-01-01' + (datediff('day', DATE '1970-01-01', exam_date) // 7 * 7)::INT AS start, location,
  count(*) AS n_total, sum(ai_positive)::BIGINT AS n_positive, round(sum(ai_positive) / count(*), 6) AS prevalence FROM results GROUP BY 1, 2""")
SQL["stream_new_studies"] = "SELECT CAST(event_id AS VARCHAR) AS study_uid, ts AS arrived FROM events"
SQL["stream_triage"] = f"WITH {ALL_ROUTED} SELECT study_uid AS study_folder, status FROM routed"
SQL["stream_worklist"] = _with(WORKLIST, body="SELECT study_uid, CASE WHEN physician_stat THEN 0 WHEN ai_positive THEN 1 ELSE 2 END AS tier, exam_time FROM worklist")
