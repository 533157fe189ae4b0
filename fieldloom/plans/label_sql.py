"""SQL of the label and confidence rules, over ``tx`` (row_id, f, t, c): the check of the column functions."""

from __future__ import annotations

from fieldloom.functions.text import EDGE, HINTS, LABELS, LINE_FIELDS


def _labels(name: str) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in label.split()) + "]" for label in sorted(LABELS[name], key=lambda v: -len(v.split()))) + "]"


def _case(kind) -> str:
    return "CASE f " + " ".join(f"WHEN '{k}' THEN {kind(k)}" for k in LABELS) + " END"


FOLD = "regexp_replace(strip_accents(replace(lower({t}), 'đ', 'd')), '[^a-z0-9/: ]+', ' ', 'g')"



def label_ctes(src: str, col: str, out: str) -> str:
    """CTE ``out``: ``src`` with {out}_words and {out}_like, what its column ``col`` (white space collapsed) is as a label."""
    hints = _case(lambda k: "[" + ", ".join(f"'{h}'" for h in HINTS[k]) + "]")
    return f"""
    {out}_0 AS (SELECT *, {FOLD.format(t=col)} AS {out}_f FROM {src}),
    {out}_1 AS (SELECT *, list_filter(string_split({out}_f, ' '), lambda w: w <> '') AS {out}_t, {_case(_labels)} AS {out}_l, {hints} AS {out}_h FROM {out}_0),
    {out}_2 AS (
      SELECT *, coalesce(len(list_filter({out}_l, lambda lab: len({out}_t) >= len(lab) AND len(list_filter(range(1, len(lab) + 1), lambda i:
        {out}_t[i] = lab[i] OR (length({out}_t[i]) >= 3 AND length(lab[i]) >= 3 AND (starts_with({out}_t[i], lab[i]) OR starts_with(lab[i], {out}_t[i]))))) = len(lab))[1]), 0) AS {out}_words,
        coalesce(len(list_filter({out}_h, lambda h: contains({out}_f, h))), 0) AS {out}_hits FROM {out}_1),
    {out} AS (
      SELECT * EXCLUDE ({out}_f, {out}_l, {out}_h, {out}_t, {out}_hits), {col} <> '' AND {out}_l IS NOT NULL AND (
        ({out}_words > 0 AND len({out}_t) <= 10) OR (ends_with({col}, ':') AND {out}_hits >= 1) OR ({out}_hits >= 3 AND len({out}_t) <= 10) OR ({out}_hits >= 2 AND len({out}_t) <= 6)) AS {out}_like
      FROM {out}_2)"""


LABEL_CTES = f"{label_ctes('tx', 't', 'lab')}, lb AS (SELECT *, lab_words AS label_words, lab_like AS label_like FROM lab)"
_LINE = "(" + ", ".join(f"'{f}'" for f in LINE_FIELDS) + ")"


def _colon(src: str, col: str, out: str) -> str:
    """CTE ``out``: ``src`` with what stands before and behind the first colon of ``col``."""
    at = f"strpos({col}, ':')"
    return f"{out} AS (SELECT *, trim(CASE WHEN {at} > 1 THEN substr({col}, 1, {at} - 1) ELSE '' END) AS {out}_left, ltrim(trim(substr({col}, {at} + 1)), '{EDGE}') AS {out}_right FROM {src})"


def strip_ctes(src: str, col: str, out: str, rounds: int = 4) -> str:
    """CTE ``out``: ``src`` with {out}_x, ``col`` without the labels before its value."""
    parts, at, x = [], src, col
    for k in range(rounds):
        n = f"{out}_r{k}"
        parts += [_colon(at, x, f"{n}c"), label_ctes(f"{n}c", f"{n}c_left", f"{n}l"), label_ctes(f"{n}l", x, f"{n}w")]
        words = f"string_split({x}, ' ')"
        rest = f"CASE WHEN len({words}) <= {n}w_words THEN '' ELSE ltrim(array_to_string({words}[{n}w_words + 1:], ' '), '{EDGE}') END"
        parts.append(f"{n} AS (SELECT *, CASE WHEN contains({x}, ':') AND {n}l_like AND {n}c_right <> '' THEN {n}c_right WHEN {n}w_words > 0 THEN {rest} ELSE {x} END AS {n}_x FROM {n}w)")
        at, x = n, f"{n}_x"
    parts.append(f"{out} AS (SELECT *, CASE WHEN {col} = '' OR coalesce(f NOT IN {_LINE}, true) THEN {col} ELSE trim({x}) END AS {out}_x FROM {at})")
    return ", ".join(parts)


ID_RUN = r"(?:[0-9][\s\-./]?){9,14}[0-9]"
ISO = r"""coalesce(
      CASE WHEN regexp_matches({t}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN try_strptime({t}, '%d/%m/%Y') END, CASE WHEN regexp_matches({t}, '^\d{{1,2}}-\d{{1,2}}-\d{{4}}$') THEN try_strptime({t}, '%d-%m-%Y') END,
      CASE WHEN regexp_matches({t}, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}$') THEN try_strptime({t}, '%d.%m.%Y') END, CASE WHEN regexp_matches({t}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_strptime({t}, '%Y-%m-%d') END,
      CASE WHEN regexp_matches({t}, '^\d{{8}}$') THEN try_strptime({t}, '%d%m%Y') END)"""


def picked_id(x: str) -> str:
    runs = f"list_filter(list_transform(regexp_extract_all({x}, '{ID_RUN}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: length(d) <= 15)"
    return f"coalesce(list_filter({runs}, lambda d: length(d) = 12)[1], list_filter({runs}, lambda d: length(d) <= 14 AND length(d) = list_max(list_transform(list_filter({runs}, lambda q: length(q) <= 14), lambda q: length(q))))[1])"


def picked_date(x: str) -> str:
    """Date-like runs by where they start: no digit before, none behind; a date first, then the longer, then the first."""
    run = f"regexp_extract(substr({x}, i), '^([0-9]{{1,2}}[/\\-.][0-9]{{1,2}}[/\\-.][0-9]{{2,4}})(?:[^0-9]|$)', 1)"
    hits = f"list_filter(list_transform(range(1, length({x}) + 1), lambda i: {{'i': i, 'm': CASE WHEN i > 1 AND regexp_matches(substr({x}, i - 1, 1), '[0-9]') THEN '' ELSE {run} END}}), lambda h: h.m <> '')"
    ranked = f"list_sort(list_transform({hits}, lambda h: {{'a': ({ISO.format(t='h.m')}) IS NULL, 'b': -length(h.m), 'i': h.i, 'm': h.m}}))"
    return f"{ranked}[1].m"


def clean_ctes(src: str, col: str, out: str) -> str:
    """CTE ``out``: ``src`` with the label value ({out}_v) and the clean value ({out}_t) of ``col`` (white space collapsed)."""
    return ", ".join([
        _colon(src, col, f"{out}c"), label_ctes(f"{out}c", f"{out}c_left", f"{out}l"),
        f"{out}y AS (SELECT *, CASE WHEN contains({col}, ':') AND {out}l_like THEN {out}c_right ELSE {col} END AS {out}_y FROM {out}l)",
        strip_ctes(f"{out}y", f"{out}_y", f"{out}s"), label_ctes(f"{out}s", col, f"{out}w"),
        f"{out}v AS (SELECT *, CASE WHEN {col} = '' OR coalesce(f NOT IN {_LINE}, true) THEN {col} ELSE {out}s_x END AS {out}_v FROM {out}w)",
        f"""{out} AS (SELECT *, CASE WHEN {col} = '' THEN '' WHEN f = 'id_number' THEN coalesce({picked_id(col)}, {col}) WHEN f = 'date_of_birth' THEN coalesce({picked_date(col)}, {col})
             WHEN {out}_v = {col} AND {out}w_like AND ends_with({col}, ':') THEN '' ELSE trim({out}_v) END AS {out}_t FROM {out}v)""",
    ])


_REP = "(len(w) >= {n} AND (len(list_distinct(w))::DOUBLE / len(w) <= 0.65 OR len(list_distinct(pairs)) < len(w) - 1))"
_HEAVY = "coalesce(nd::DOUBLE / nullif(nan, 0) >= {x}, false)"

CONFIDENCE_CTES = f"""
    ch AS (
      SELECT *, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w, length(t)::DOUBLE AS n, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS nl, length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) AS nd,
             length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS nan, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS np FROM lb),
    cp AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs, len(string_split(t, ' ')) AS k FROM ch),
    su AS (
      SELECT *, f IN ('place_of_origin', 'place_of_residence') AS place, {_REP.format(n=6)} AS rep6, {_REP.format(n=4)} AS rep4, {_HEAVY.format(x=0.35)} AS heavy35, {_HEAVY.format(x=0.20)} AS heavy20 FROM cp),
    sp AS (
      SELECT *, CASE WHEN t = '' THEN true WHEN place THEN k = 1 OR (k <= 2 AND NOT contains(t, ',') AND n < 12) OR heavy35 OR rep6 OR (n >= 48 AND k <= 3) WHEN f = 'full_name' THEN heavy20 OR rep4 ELSE false END AS suspicious FROM su),
    es AS (
      SELECT *, CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(0.95, CASE
          WHEN f = 'id_number' THEN 0.45 + least(nd / 12.0::DOUBLE, 1) * 0.25 + CASE WHEN nd = 12 THEN 0.25 ELSE 0 END
          WHEN f = 'date_of_birth' THEN 0.45 + least(n / 10.0::DOUBLE, 1) * 0.10 + CASE WHEN iso IS NOT NULL THEN 0.25 ELSE 0 END
          ELSE 0.45 + least(nl / n, 1) * 0.25 + least(k / 4.0::DOUBLE, 1) * 0.10 + least(n / 24.0::DOUBLE, 1) * 0.10 - least(nd / n * 0.20, 0.10) - least(np / n * 0.20, 0.10)
            - CASE WHEN label_like THEN 0.25 ELSE 0 END + CASE WHEN nl >= greatest(1, length(t) // 3) THEN 0.05 ELSE 0 END
            - CASE WHEN place THEN (CASE WHEN heavy35 THEN 0.35 ELSE 0 END) + (CASE WHEN rep6 THEN 0.25 ELSE 0 END) + (CASE WHEN n >= 48 AND k <= 3 THEN 0.15 ELSE 0 END)
                   WHEN f = 'full_name' THEN (CASE WHEN heavy20 THEN 0.25 ELSE 0 END) + (CASE WHEN rep4 THEN 0.20 ELSE 0 END) ELSE 0 END END)) END AS estimated,
        greatest(0, least(1, coalesce(c, 0))) AS r FROM sp),
    ca AS (
      SELECT *, CASE WHEN t = '' THEN 0.0
        WHEN f = 'id_number' THEN CASE WHEN nd = 12 THEN greatest(r, 0.88) WHEN nd >= 10 THEN least(r * 0.75, 0.84) WHEN nd >= 8 THEN least(r * 0.55, 0.72) ELSE r * 0.25 END
        WHEN f = 'date_of_birth' THEN CASE WHEN iso IS NOT NULL THEN greatest(r, 0.8) WHEN nd >= 6 THEN least(r * 0.65, 0.74) ELSE r * 0.30 END
        ELSE greatest(0, least(0.98, 0.7 * r * CASE WHEN label_like THEN 0.5 ELSE 1 END * CASE WHEN place AND suspicious THEN 0.45 WHEN f = 'full_name' AND suspicious THEN 0.6 ELSE 1 END + 0.3 * estimated)) END AS calibrated FROM es)
"""
