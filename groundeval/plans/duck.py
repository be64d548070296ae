"""DuckDB expression text for the oracle queries.

These mirror the definitions in ``groundeval.functions`` but are written independently in
DuckDB's dialect (1-based lists, RE2 regexes, ``\\1`` back-references, ``'g'`` flag for
replace-all), so a match is evidence for both.
"""

from __future__ import annotations

from groundeval.functions.bleu import PRE_13A, TOKENIZE_13A

WS = r"[ \t\n\r\f\x0B]+"
PUNCT = r"[!-/:-@\[-`{-~]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda t: t <> '')"


def norm_tokens(x: str) -> str:
    cleaned = f"regexp_replace(lower({x}), '{PUNCT}', '', 'g')"
    return f"list_filter(regexp_split_to_array({cleaned}, '{WS}'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def em(p: str, g: str) -> str:
    return f"(CASE WHEN array_to_string({p}, ' ') = array_to_string({g}, ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def f1(p: str, g: str) -> str:
    common = (
        f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: "
        f"least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"
    )
    return f"(CASE WHEN {common} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({p}) + len({g})) END)"


def lcs(a: str, b: str) -> str:
    """Plain LCS dynamic programme: one ``list_reduce`` per row of the table."""
    inner = (
        f"list_reduce(range(1, len({b}) + 1), lambda cur, j: list_append(cur, "
        f"CASE WHEN w = {b}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0])"
    )
    init = f"list_transform(range(0, len({b}) + 1), lambda z: 0)"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce({a}, lambda prev, w: {inner}, {init})[len({b}) + 1] END)"


def rougel(p: str, g: str) -> str:
    return f"(CASE WHEN {lcs(p, g)} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {lcs(p, g)} / (len({p}) + len({g})) END)"


def bleu_tokens(x: str) -> str:
    s = f"lower({x})"
    for old, new in PRE_13A:
        s = f"replace({s}, {lit(old)}, {lit(new)})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in TOKENIZE_13A:
        s = f"regexp_replace({s}, {lit(pat)}, {lit(rep.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return ws_tokens(s)


def ngram_sql(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def bleu_ctes(src: str, key: str, group: list[str], hyp: str, refs: str, p: str = "bl") -> str:
    """CTEs computing corpus BLEU per ``group`` over relation ``src``; the last CTE is
    ``{p}_f(group..., bleu, sys_len, ref_len, correct_1..4, total_1..4)``."""
    g = ", ".join(group)
    b = f"{p}_b AS (SELECT {g}, {key} AS k, {bleu_tokens(hyp)} AS h, list_transform({refs}, lambda r: {bleu_tokens('r')}) AS rs FROM {src})"
    hg = " UNION ALL ".join(f"SELECT {g}, k, {n} AS n, unnest({ngram_sql('h', n)}) AS gram FROM {p}_b" for n in range(1, 5))
    rx = f"{p}_rx AS (SELECT k, unnest(rs) AS r, generate_subscripts(rs, 1) AS ridx FROM {p}_b)"
    rg = " UNION ALL ".join(f"SELECT k, ridx, {n} AS n, unnest({ngram_sql('r', n)}) AS gram FROM {p}_rx" for n in range(1, 5))
    closest = "list_min(list_transform(rs, lambda r: abs(len(r) - len(h)) * 1000000 + len(r))) % 1000000"
    tot = ", ".join(f"sum(greatest(len(h) - {n - 1}, 0))::BIGINT AS total_{n}" for n in range(1, 5))
    cor = ", ".join(f"sum(CASE WHEN n = {n} THEN c ELSE 0 END)::BIGINT AS c{n}" for n in range(1, 5))
    z = [" + ".join(f"(CASE WHEN c{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, n + 1)) for n in range(1, 5)]
    ps = [f"(CASE WHEN c{n} = 0 THEN 100.0 / (pow(2, {z[n - 1]}) * total_{n}) ELSE 100.0 * c{n} / total_{n} END)" for n in range(1, 5)]
    score = (
        "CASE WHEN (c1 = 0 AND c2 = 0 AND c3 = 0 AND c4 = 0) OR total_1 = 0 OR total_2 = 0 OR total_3 = 0 OR total_4 = 0 THEN 0.0::DOUBLE "
        "ELSE (CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END) ELSE 1.0 END) * exp(("
        + " + ".join(f"ln({x})" for x in ps) + ") / 4) END"
    )
    using = ", ".join(group)
    return f"""{b},
{p}_hg AS ({hg}),
{p}_hc AS (SELECT {g}, k, n, gram, count(*) AS ch FROM {p}_hg GROUP BY ALL),
{rx},
{p}_rg AS ({rg}),
{p}_rc AS (SELECT k, n, gram, max(c) AS cr FROM (SELECT k, ridx, n, gram, count(*) AS c FROM {p}_rg GROUP BY ALL) GROUP BY ALL),
{p}_clip AS (SELECT {', '.join('hc.' + c for c in group)}, hc.n, least(hc.ch, coalesce(rc.cr, 0)) AS c FROM {p}_hc hc LEFT JOIN {p}_rc rc
             ON hc.k = rc.k AND hc.n = rc.n AND hc.gram = rc.gram),
{p}_corr AS (SELECT {g}, {cor} FROM {p}_clip GROUP BY {g}),
{p}_tot AS (SELECT {g}, sum(len(h))::BIGINT AS sys_len, sum({closest})::BIGINT AS ref_len, {tot} FROM {p}_b GROUP BY {g}),
{p}_j AS (SELECT t.*, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4
          FROM {p}_tot t LEFT JOIN {p}_corr USING ({using})),
{p}_f AS (SELECT {g}, {score} AS bleu, sys_len, ref_len, c1::BIGINT AS correct_1, c2::BIGINT AS correct_2,
                 c3::BIGINT AS correct_3, c4::BIGINT AS correct_4, total_1, total_2, total_3, total_4 FROM {p}_j)"""
