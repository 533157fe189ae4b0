"""SQL of the choice between readings and of line picking: the check of the operators."""

from __future__ import annotations

from fieldloom.plans.label_sql import CONFIDENCE_CTES, ISO, LABEL_CTES, clean_ctes, label_ctes, strip_ctes

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def long_name(c: str) -> str:
    return f"CASE {c} WHEN 'id' THEN 'id_number' WHEN 'name' THEN 'full_name' WHEN 'birth' THEN 'date_of_birth' WHEN 'origin' THEN 'place_of_origin' WHEN 'address' THEN 'place_of_residence' ELSE {c} END"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WHITE}', ' ', 'g'))"


def form(t: str) -> str:
    """The form of collapsed text ``t`` of field f in which values are compared."""
    return f"CASE f WHEN 'id_number' THEN regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g') WHEN 'date_of_birth' THEN coalesce(strftime({ISO.format(t=t)}, '%Y-%m-%d'), {t}) ELSE {t} END"


def judged(rows: str, name: str) -> str:
    """CTE ``name``: rows (with f, t0 collapsed, c) with t (clean), suspicious, estimated and calibrated."""
    return f"""
    {name} AS (
      WITH raw AS ({rows}), {clean_ctes('raw', 't0', 'cl')}, tx AS (SELECT *, cl_t AS t, {ISO.format(t='cl_t')} AS iso FROM cl), {LABEL_CTES}, {CONFIDENCE_CTES}
      SELECT * FROM ca)"""


def _side(k: str, engine: str, field: str) -> str:
    return judged(f"SELECT row_id, {long_name(field)} AS f, {collapsed(f'text_{engine}')} AS t0, text_{engine} AS stored, conf_{engine} AS c FROM reviewed_sample", k)


def chosen(field: str, cleaned: bool) -> str:
    """CTEs up to ``ch``: the choice between both readings, from clean texts and calibrated scores or from stored ones."""
    text, score = ("t", "calibrated") if cleaned else ("stored", "coalesce(c, 0)")
    part = lambda k: f"SELECT row_id, f, {form('t' if cleaned else 't0')} AS form, {score} AS s, suspicious AS bad, {text} AS txt FROM {k}"
    ok = lambda x: f"(CASE WHEN f = 'id_number' THEN length(regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')) = 12 ELSE ({ISO.format(t=x)}) IS NOT NULL END)"
    return f"""
    {_side('sv', 'vietocr', field)}, {_side('sp', 'paddle', field)}, pv AS ({part('sv')}), pp AS ({part('sp')}),
    bo AS (SELECT a.row_id, a.f, a.form AS vt, b.form AS pt, a.s AS v, b.s AS p, a.bad AS vb, b.bad AS pb, a.txt AS vx, b.txt AS px FROM pv a JOIN pp b ON a.row_id = b.row_id),
    ok AS (SELECT *, {ok('vt')} AS vok, {ok('pt')} AS pok FROM bo),
    en AS (
      SELECT *, CASE WHEN vt <> '' AND vt = pt THEN 'agree'
        WHEN f IN ('id_number', 'date_of_birth') THEN CASE WHEN vok AND NOT pok THEN 'vietocr' WHEN pok AND NOT vok THEN 'paddleocr' WHEN p > v THEN 'paddleocr' ELSE 'vietocr' END
        WHEN f IN ('place_of_origin', 'place_of_residence') THEN CASE WHEN pt <> '' AND vt = '' THEN 'paddleocr' WHEN vt <> '' AND pt = '' THEN 'vietocr' WHEN vb AND NOT pb THEN 'paddleocr' WHEN pb AND NOT vb THEN 'vietocr'
          WHEN p >= v - 0.12::DOUBLE THEN 'paddleocr' WHEN v > p + 0.35::DOUBLE THEN 'vietocr' ELSE 'paddleocr' END
        WHEN f = 'full_name' THEN CASE WHEN vt <> '' AND pt = '' THEN 'vietocr' WHEN pt <> '' AND vt = '' THEN 'paddleocr' WHEN pb AND NOT vb THEN 'vietocr' WHEN vb AND NOT pb THEN 'paddleocr'
          WHEN v >= p - 0.08::DOUBLE THEN 'vietocr' WHEN length(vt) >= length(pt) AND v >= p - 0.12::DOUBLE THEN 'vietocr' WHEN p > v + 0.08::DOUBLE THEN 'paddleocr' ELSE 'vietocr' END
        WHEN p > v THEN 'paddleocr' ELSE 'vietocr' END AS engine FROM ok),
    fp AS (SELECT *, CASE WHEN engine = 'agree' THEN p > v ELSE engine = 'paddleocr' END AS from_p FROM en),
    ch AS (
      SELECT *, CASE WHEN from_p THEN p ELSE v END AS score, CASE WHEN from_p THEN px ELSE vx END AS txt, CASE WHEN from_p THEN pt ELSE vt END AS form,
             CASE WHEN engine = 'agree' THEN false ELSE (CASE WHEN from_p THEN p < 0.5 OR pt = '' OR pb ELSE v < 0.5 OR vt = '' OR vb END) OR (vt <> pt AND abs(v - p) < 0.08::DOUBLE) END AS review FROM fp)"""


PICK = f"""
    WITH {chosen('class', False)}
    SELECT row_id, engine, CASE WHEN engine = 'agree' THEN 'same_text'
        WHEN f IN ('id_number', 'date_of_birth') THEN CASE WHEN vok <> pok THEN 'pattern_match' ELSE 'higher_confidence' END
        WHEN f IN ('place_of_origin', 'place_of_residence') THEN CASE WHEN (pt <> '') <> (vt <> '') THEN 'long_text_nonempty' WHEN vb AND NOT pb THEN 'viet_suspicious_long_text' WHEN pb AND NOT vb THEN 'paddle_suspicious_long_text'
          WHEN engine = 'vietocr' THEN 'viet_long_text_confidence' ELSE 'paddle_long_text_default' END
        WHEN f = 'full_name' THEN CASE WHEN (pt <> '') <> (vt <> '') THEN 'name_nonempty' WHEN pb AND NOT vb THEN 'paddle_suspicious_name' WHEN vb AND NOT pb THEN 'viet_suspicious_name'
          WHEN v >= p - 0.08::DOUBLE THEN 'viet_name_bias' WHEN length(vt) >= length(pt) AND v >= p - 0.12::DOUBLE THEN 'viet_name_length_bias' WHEN engine = 'paddleocr' THEN 'paddle_name_confidence' ELSE 'viet_name_bias' END
        ELSE 'higher_confidence' END AS reason, round(abs(v - p) + 1e-8, 5) AS margin, round(score, 6) AS score, review, pt AS other FROM ch
"""
PSEUDO = f"""
    WITH {chosen('field_name', True)}
    SELECT r.row_id, r.crop_path, r.field_name, r.split, r.ann_id, r.ground_truth_text, vx AS text_vietocr, round(v + 1e-8, 5) AS conf_vietocr, px AS text_paddle, round(p + 1e-8, 5) AS conf_paddle,
           txt AS best_text, round(score + 1e-8, 5) AS best_conf, engine AS best_source, form AS best_normalized_text, review AS needs_review,
           CASE WHEN score >= 0.9 THEN 'accept' WHEN score >= 0.5 THEN 'review' ELSE 'reject' END AS review_bucket
    FROM ch JOIN reviewed_sample r ON r.row_id = ch.row_id
"""

_BOTH = f"""
    {judged(f"SELECT row_id, {long_name('class')} AS f, {collapsed('text_paddle')} AS t0, text_paddle AS stored, conf_paddle AS c FROM reviewed_sample", 'ba')},
    {judged(f"SELECT row_id, {long_name('class')} AS f, {collapsed('best_text')} AS t0, best_text AS stored, best_conf AS c FROM reviewed_sample", 'ot')}
"""
SAFER = f"""
    WITH {_BOTH},
    j AS (SELECT a.row_id, a.f, length(trim(coalesce(a.stored, ''))) AS nb, length(trim(coalesce(b.stored, ''))) AS no, coalesce(a.c, 0) AS b, coalesce(b.c, 0) AS o, a.suspicious AS bb, b.suspicious AS bo, a.place AS place FROM ba a JOIN ot b ON a.row_id = b.row_id)
    SELECT row_id, CASE WHEN no = 0 THEN 'base' WHEN nb = 0 THEN 'other' WHEN bb AND NOT bo THEN 'other' WHEN bo AND NOT bb THEN 'base'
        WHEN no < greatest(4, round_even(nb * 0.60::DOUBLE, 0)) AND o < b + 0.10::DOUBLE THEN 'base'
        WHEN place AND ((o > b + 0.06::DOUBLE AND no >= greatest(4, round_even(nb * 0.70::DOUBLE, 0))) OR (no > nb + 6 AND o >= b - 0.02::DOUBLE)) THEN 'other'
        WHEN place THEN 'base' WHEN o > b + 0.05::DOUBLE THEN 'other' ELSE 'base' END AS pick FROM j
"""

_THREE = f"SELECT row_id, {long_name('class')} AS f, {collapsed('text_vietocr')} AS w, {collapsed('text_paddle')} AS p, {collapsed('best_text')} AS g, coalesce(conf_vietocr, 0) AS wc, coalesce(conf_paddle, 0) AS pc FROM reviewed_sample"
PART = f"""
    WITH three AS ({_THREE}), {label_ctes('three', 'w', 'lw')}, {label_ctes('lw', 'p', 'lp')},
    fo AS (SELECT *, {form('g')} AS goal, {form('w')} AS fw, {form('p')} AS fp FROM lp)
    SELECT row_id, CASE WHEN p = '' THEN 'whole' WHEN w = '' THEN 'part' WHEN lw_like AND NOT lp_like THEN 'part' WHEN lp_like AND NOT lw_like THEN 'whole'
        WHEN goal <> '' AND fp = goal AND fw <> goal THEN 'part' WHEN pc > wc + 0.05::DOUBLE THEN 'part' WHEN length(p) > length(w) + 6 AND pc >= wc - 0.03::DOUBLE THEN 'part'
        WHEN wc >= pc THEN 'whole' ELSE 'part' END AS pick FROM fo
"""
VALID = f"""
    WITH x AS (SELECT row_id, {long_name('class')} AS f, {collapsed("coalesce(nullif(ground_truth_text, ''), best_text)")} AS t FROM reviewed_sample), y AS (SELECT *, {ISO.format(t='t')} AS iso FROM x)
    SELECT row_id, array_to_string(list_filter([
        CASE WHEN t = '' THEN 'empty' END, CASE WHEN f = 'id_number' AND length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) <> 12 THEN 'id_not_12_digits' END,
        CASE WHEN f = 'id_number' AND length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) = 12 AND NOT list_contains(list_transform(range(1, 97), lambda i: printf('%03d', i)), substr(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g'), 1, 3)) THEN 'unknown_prefix' END, CASE WHEN f = 'date_of_birth' AND iso IS NULL THEN 'no_date' END,
        CASE WHEN f = 'date_of_birth' AND (year(iso) < 1900 OR year(iso) > 2025) THEN 'year_out_of_range' END, CASE WHEN f = 'full_name' AND regexp_matches(t, '\\p{{Nd}}') THEN 'digits_in_name' END,
        CASE WHEN f = 'full_name' AND len(list_filter(string_split(t, ' '), lambda w: w <> '')) < 2 THEN 'single_name' END], lambda r: r IS NOT NULL), ',') AS reasons FROM y
"""

# ---- lines

_LABEL = "CASE f WHEN 'full_name' THEN 'Họ và tên:' WHEN 'place_of_origin' THEN 'Quê quán:' WHEN 'place_of_residence' THEN 'Nơi thường trú:' END"
LINES = f"""
    bx AS (SELECT DISTINCT annotation_id, bbox[1]::DOUBLE AS x1, bbox[2]::DOUBLE AS y1, bbox[3]::DOUBLE AS x2, bbox[4]::DOUBLE AS y2 FROM crop_manifest WHERE len(bbox) = 4),
    rd AS (SELECT ann_id, arg_max({{'t': best_text, 'c': best_conf}}, row_id) AS m FROM reviewed_sample GROUP BY ann_id),
    l0 AS (SELECT annotation_id // 4 AS crop_id, annotation_id, m.t AS text, m.c AS confidence, x1, y1, x2, y2 FROM bx JOIN rd ON ann_id = annotation_id),
    l1 AS (SELECT *, ['full_name', 'place_of_origin', 'place_of_residence', 'title'][(crop_id % 4 + 1)::INT] AS f, row_number() OVER (PARTITION BY crop_id ORDER BY annotation_id, x1, y1, x2, y2) AS idx FROM l0),
    lines AS (
      SELECT crop_id, f, idx, CASE WHEN idx = 1 AND crop_id % 2 = 1 AND {_LABEL} IS NOT NULL THEN concat_ws(' ', {_LABEL}, text) ELSE text END AS text, confidence, x1, y1, x2, y2 FROM l1
      UNION ALL SELECT crop_id, f, 0, {_LABEL}, confidence, x1, y1 - 25, x2, y1 - 5 FROM l1 WHERE idx = 1 AND crop_id % 2 = 0 AND {_LABEL} IS NOT NULL)
"""
_WORDS = "len(list_filter(string_split(trim({c}), ' '), lambda w: w <> ''))"


def _merges(a: str, b: str) -> str:
    w, h = (lambda k: f"greatest(1, {k}x2 - {k}x1)"), (lambda k: f"greatest(1, {k}y2 - {k}y1)")
    return f"""(({b}y1 - {a}y2 <= greatest(18, greatest({h(a)}, {h(b)}) * 1.2::DOUBLE)) AND (greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) / least({w(a)}, {w(b)}) >= 0.10
      OR abs({a}x1 - {b}x1) <= greatest({w(a)}, {w(b)}) * 0.40::DOUBLE))"""


ORDERED = f"""
    {LINES},
    o0 AS (SELECT crop_id, f, idx, {collapsed('text')} AS text, coalesce(confidence, 0) AS confidence, x1, y1, x2, y2 FROM lines),
    o1 AS (SELECT * FROM o0 WHERE text <> '' AND x1 IS NOT NULL), {label_ctes('o1', 'text', 'ol')},
    ord AS (SELECT crop_id, f, idx, text, confidence, x1, y1, x2, y2, ol_like AS is_label, row_number() OVER (PARTITION BY crop_id ORDER BY (y1 + y2) / 2, x1, idx) - 1 AS line_no FROM ol)
"""
_START = f"""greatest(0.18, least(0.92, CASE WHEN contains(text, ':') THEN (strpos(text, ':') - 1) / greatest(1, length(text)) - 0.03
      ELSE greatest(0, {_WORDS.format(c='text')} - {_WORDS.format(c='inline')}) / greatest(1, {_WORDS.format(c='text')}) - 0.02 END))"""
_INLINE_X = f"least(x2 - 4, x1 + greatest(1, x2 - x1) * {_START})"
_FOUND = f"""
    {clean_ctes('ord', 'text', 'cv')},
    va AS (SELECT crop_id, f, idx, text, confidence, x1, y1, x2, y2, is_label, line_no, cv_v AS inline FROM cv),
    same AS (SELECT crop_id, f, 'same_line' AS kind, inline AS raw, confidence AS conf, 1 AS pieces, {_INLINE_X} AS x1, y1, x2, y2, line_no AS seq FROM va WHERE inline <> '' AND inline <> text AND (contains(text, ':') OR is_label)),
    ld AS (
      SELECT *, {', '.join(f'lead({c}, {k}) OVER w AS n{k}_{c}' for k in (1, 2) for c in ('text', 'confidence', 'is_label', 'x1', 'y1', 'x2', 'y2'))} FROM va WINDOW w AS (PARTITION BY crop_id ORDER BY line_no)),
    us AS (SELECT *, inline <> '' AND inline <> text AS has, coalesce(NOT n1_is_label AND {_merges('', 'n1_')}, false) AS use1, coalesce(NOT n2_is_label AND {_merges('n1_', 'n2_')}, false) AS use2 FROM ld WHERE is_label),
    pa AS (
      SELECT *, list_filter([CASE WHEN has THEN {{'t': inline, 'c': confidence, 'x1': {_INLINE_X}, 'y1': y1, 'x2': x2, 'y2': y2}} END, CASE WHEN use1 THEN {{'t': n1_text, 'c': n1_confidence, 'x1': n1_x1, 'y1': n1_y1, 'x2': n1_x2, 'y2': n1_y2}} END,
        CASE WHEN use1 AND use2 THEN {{'t': n2_text, 'c': n2_confidence, 'x1': n2_x1, 'y1': n2_y1, 'x2': n2_x2, 'y2': n2_y2}} END], lambda p: p IS NOT NULL) AS parts FROM us),
    below AS (
      SELECT crop_id, f, 'below_label' AS kind, array_to_string(list_transform(parts, lambda p: p.t), ' ') AS raw, list_sum(list_transform(parts, lambda p: p.c)) / len(parts) AS conf, len(parts) AS pieces,
             list_min(list_transform(parts, lambda p: p.x1)) AS x1, list_min(list_transform(parts, lambda p: p.y1)) AS y1, list_max(list_transform(parts, lambda p: p.x2)) AS x2, list_max(list_transform(parts, lambda p: p.y2)) AS y2, line_no + 1000 AS seq
      FROM pa WHERE len(parts) > 0),
    pv0 AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in ('is_label', 'x1', 'y1', 'x2', 'y2'))} FROM ord WINDOW w AS (PARTITION BY crop_id ORDER BY line_no)),
    bk AS (SELECT *, sum(CASE WHEN p_x1 IS NULL OR p_is_label OR NOT {_merges('p_', '')} THEN 1 ELSE 0 END) OVER (PARTITION BY crop_id ORDER BY line_no) AS block FROM pv0),
    blk AS (
      SELECT crop_id, f, 'block' AS kind, string_agg(text, ' ' ORDER BY line_no) AS raw, avg(confidence) AS conf, count(*) AS pieces, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(line_no) + 2000 AS seq
      FROM bk WHERE NOT is_label GROUP BY crop_id, f, block)
"""


def _scored(rows: str) -> str:
    add = lambda cond, v: f"CASE WHEN {cond} THEN {v} ELSE 0.0::DOUBLE END"
    total = f"""calibrated * 0.55::DOUBLE + estimated * 0.45::DOUBLE - {add('clw_like', '0.25::DOUBLE')} + {add('len(w) >= 2', '0.03::DOUBLE')} + ({add('place AND pieces > 1', '0.04::DOUBLE')} - {add("f = 'full_name' AND pieces > 1", '0.04::DOUBLE')})
      - {add('nd / n > 0.30', 'least(0.18::DOUBLE, nd / n * 0.30::DOUBLE)')} + CASE kind WHEN 'same_line' THEN 0.06::DOUBLE WHEN 'below_label' THEN 0.04 ELSE 0.02 END"""
    return f"""{judged(f"SELECT *, {collapsed('raw')} AS t0, conf AS c FROM ({rows})", 'jd')},
    sc AS (SELECT crop_id, f, kind, raw, t AS value, greatest(0, least(0.99, {total})) AS score, pieces, x1, y1, x2, y2, seq FROM jd WHERE t <> '')"""


READING_ORDER = f"WITH {ORDERED} SELECT crop_id, idx, line_no, text, is_label FROM ord"
SAME_LINE = f"WITH {ORDERED}, {_FOUND}, {_scored('SELECT * FROM same')} SELECT crop_id, value, round(score + 1e-8, 5) AS score, round(x1 + 1e-8, 5) AS x1 FROM sc"
BELOW_LABEL = f"WITH {ORDERED}, {_FOUND}, {_scored('SELECT * FROM below')} SELECT crop_id, value, round(score + 1e-8, 5) AS score, pieces FROM sc"
BLOCKS = f"WITH {ORDERED}, {_FOUND}, {_scored('SELECT * FROM blk')} SELECT crop_id, value, round(score + 1e-8, 5) AS score, pieces, seq FROM sc"
_ALL = "SELECT * FROM same UNION ALL SELECT * FROM below UNION ALL SELECT * FROM blk"
_RANKED = f"""
    {ORDERED}, {_FOUND}, {_scored(_ALL)},
    un AS (SELECT *, row_number() OVER (PARTITION BY crop_id, value ORDER BY round(score, 9) DESC, seq) AS n, min(seq) OVER (PARTITION BY crop_id, value) AS first FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY round(score, 9) DESC, length(value) DESC, first) AS rank FROM un WHERE n = 1)
"""
CANDIDATES = f"WITH {_RANKED} SELECT crop_id, rank, kind, value, round(score + 1e-8, 5) AS score FROM rk"
LINE_PICK = f"""
    WITH {_RANKED},
    rl AS (SELECT crop_id, f, avg(confidence) AS conf, string_agg(text, ' ' ORDER BY (y1 + y2) / 2, x1, idx, text) AS text FROM lines GROUP BY crop_id, f),
    hv AS (SELECT crop_id, bool_or(is_label) AS heavy FROM ord GROUP BY crop_id),
    tp AS (SELECT crop_id, kind, value, score FROM rk WHERE rank = 1 AND f <> 'title'),
    rj AS (SELECT rl.crop_id, rl.f, rl.text, rl.conf, {collapsed('rl.text')} AS base, coalesce(rl.conf, 0) AS b, coalesce(heavy, false) AS heavy, kind, coalesce(value, '') AS value, score AS c FROM rl LEFT JOIN hv ON hv.crop_id = rl.crop_id LEFT JOIN tp ON tp.crop_id = rl.crop_id),
    {label_ctes('rj', 'base', 'lb0')}, {label_ctes('lb0', 'value', 'lv')},
    tk AS (SELECT *, value <> '' AND (base = '' OR (lb0_like AND NOT lv_like) OR (heavy AND c >= b - 0.02::DOUBLE) OR c >= b + 0.03::DOUBLE OR (length(value) > length(base) + 6 AND c >= b - 0.02::DOUBLE) OR (b < 0.55 AND c >= b - 0.05::DOUBLE)) AS take FROM lv)
    SELECT crop_id, CASE WHEN take THEN value ELSE text END AS new_text, round((CASE WHEN take THEN c ELSE conf END) + 1e-8, 5) AS new_conf, coalesce(take, false) AS replaced, kind FROM tk
"""
_HYPOTHESES = f"""
    {LINES},
    h0 AS (SELECT crop_id, f, idx, {collapsed('text')} AS text, coalesce(confidence, 0) AS score, (y1 + y2) / 2 AS y, x1 AS x FROM lines),
    h1 AS (SELECT *, lead(text) OVER w AS nt, lead(score) OVER w AS ns, row_number() OVER w AS no, count(*) OVER (PARTITION BY crop_id) AS k FROM h0 WHERE text <> '' WINDOW w AS (PARTITION BY crop_id ORDER BY y, x, idx)),
    hy AS (
      SELECT crop_id, f, text, score, no AS ord FROM h1 UNION ALL
      SELECT crop_id, f, text || ' ' || nt, (score + ns) / 2 + 0.02::DOUBLE, no + 20000 FROM h1 WHERE nt IS NOT NULL UNION ALL
      SELECT crop_id, f, string_agg(text, ' ' ORDER BY no), avg(score) + 0.02::DOUBLE, 10000 FROM h1 WHERE k > 1 GROUP BY crop_id, f UNION ALL
      SELECT crop_id, f, text, score + 0.03::DOUBLE, 30000 FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY length(text) DESC, score DESC, no) AS r FROM h1 WHERE f <> 'title') WHERE r = 1),
    hg AS (SELECT crop_id, f, text, max(score) AS score, min(ord) AS ord FROM hy GROUP BY crop_id, f, text)
"""
HYPOTHESES = f"WITH {_HYPOTHESES} SELECT crop_id, f AS field_name, text, round(score + 1e-8, 5) AS score FROM hg"
BEST_HYPOTHESIS = f"""
    WITH {_HYPOTHESES}, {judged(f"SELECT crop_id, f, {collapsed('text')} AS t0, score AS c, ord FROM hg", 'jd')},
    bh AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY round(calibrated, 9) DESC, length(t) DESC, ord) AS best FROM jd WHERE t <> '')
    SELECT crop_id, t AS text, round(calibrated + 1e-8, 5) AS score FROM bh WHERE best = 1
"""
JOINED = f"WITH {LINES} SELECT crop_id, string_agg(text, chr(10) ORDER BY (y1 + y2) / 2, x1, idx, text) AS text FROM lines GROUP BY crop_id"

_RAW = f"SELECT row_id, {long_name('class')} AS f, best_conf AS c, " + collapsed("['Họ và tên: ', 'Quê quán ', 'Nơi thường trú: ', 'Full name ', ''][(row_id % 5 + 1)::INT] || best_text") + " AS t0 FROM reviewed_sample"
LABEL_TEXT = f"""
    WITH raw AS ({_RAW}), {label_ctes('raw', 't0', 'q')}, {strip_ctes('q', 't0', 'st')}, {clean_ctes('st', 't0', 'cl')}
    SELECT row_id, q_words AS label_words, q_like AS label_like, st_x AS stripped, cl_v AS value, cl_t AS clean FROM cl
"""
CONFIDENCE = f"WITH {judged(_RAW, 'jd')} SELECT row_id, suspicious, round(estimated + 1e-8, 5) AS estimated, round(calibrated + 1e-8, 5) AS calibrated FROM jd"
FINISHED = f"""
    WITH {judged(f"SELECT row_id, {long_name('class')} AS f, {collapsed('text_vietocr')} AS t0, conf_vietocr AS c FROM reviewed_sample WHERE conf_vietocr IS NOT NULL", 'jd')}, fo AS (SELECT row_id, t, calibrated, {form('t')} AS form FROM jd)
    SELECT row_id, t AS clean, round(calibrated + 1e-8, 5) AS conf, form, calibrated < 0.5 OR form = '' AS needs_review FROM fo
"""
