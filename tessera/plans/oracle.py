"""DuckDB SQL builders for the correctness oracle.

These produce plain SQL over the driver's parquet views; they re-state the
rules in SQL (column classes, context words, masks) rather than calling the
Spark code, so the comparison is independent.  DuckDB's regex engine has no
look-ahead, so SSN candidates are extracted with a plain pattern and the
excluded prefixes filtered afterwards (a rejected candidate cannot overlap a
valid one).
"""

from __future__ import annotations

from .. import profiles as P
from ..profiles import get_profile


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def column_class_sql(name_expr: str, prof) -> str:
    low = f"lower(trim({name_expr}))"
    return (f"CASE WHEN {any_contains(low, prof.safe_col_words)} THEN 'safe' "
            f"WHEN {any_contains(low, prof.risky_col_words)} THEN 'risky' ELSE 'free' END")


def mask_sql(t: str, x: str, prof) -> str:
    if t == "SSN":
        return f"regexp_replace({x}, '^\\d{{3}}-\\d{{2}}-', 'XXX-XX-')"
    if t == "CREDIT_CARD":
        d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
        return f"CASE WHEN length({d}) >= 4 THEN 'XXXX-XXXX-XXXX-' || right({d}, 4) ELSE 'XXXX-XXXX-XXXX-XXXX' END"
    if t == "PHONE":
        return f"regexp_replace({x}, '^\\+?1?[\\-.\\s]?\\(?\\d{{3}}\\)?[\\-.\\s]\\d{{3}}', 'XXX-XXX')"
    if t == "EMAIL":
        sp = f"string_split({x}, '@')"
        return f"CASE WHEN len({sp}) = 2 THEN left({sp}[1], 2) || '***@' || {sp}[2] ELSE '***@***' END"
    if t == "DATE_OF_BIRTH":
        return f"regexp_replace({x}, '^\\d{{1,2}}[/\\-]\\d{{1,2}}[/\\-]', {q(prof.dob_mask_prefix)})"
    if t == "PASSPORT":
        return f"left({x}, 2) || '****'"
    if prof.pad_fallback_mask:
        return f"left({x}, 2) || repeat('•', greatest(4, length({x}) - 2))"
    return f"left({x}, 2) || '••••'"


def extract_sql(t: str, cell: str, prof) -> str:
    if t == "SSN":
        cand = f"regexp_extract_all({cell}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b')"
        return (f"list_filter({cand}, lambda s: NOT (s[1:3] IN ('000', '666') OR s[1:1] = '9' "
                f"OR s[5:6] = '00' OR s[8:11] = '0000'))")
    return f"regexp_extract_all({cell}, {q(prof.pattern(t))})"


def matches_sql(cell: str, kind: str, col_name: str, types, prof) -> str:
    parts = []
    for t in types:
        guarded = cell
        if t != "CREDIT_CARD":
            cond = f"{kind} = 'text'"
            if t == "EMAIL":
                cond += f" AND lower(trim({col_name})) NOT IN ({', '.join(q(c) for c in prof.email_columns)})"
            guarded = f"(CASE WHEN {cond} THEN {cell} ELSE '' END)"
        parts.append(f"list_transform({extract_sql(t, guarded, prof)}, lambda x: "
                     f"struct_pack(pii_type := {q(t)}, raw_value := x, masked := {mask_sql(t, 'x', prof)}))")
    return "(" + " || ".join(parts) + ")"


def confidence_sql(cls: str, cell: str, prof) -> str:
    ctx = any_contains(f"lower({cell})", prof.risky_context_words)
    return (f"CASE WHEN {cls} = 'safe' THEN (CASE WHEN {ctx} THEN 0.75 ELSE 0.15 END) "
            f"WHEN {cls} = 'risky' THEN 1.0 WHEN {ctx} THEN 0.90 ELSE 0.50 END::DOUBLE")


def reason_sql(cls: str, col_name: str, prof) -> str:
    if not prof.with_reason:
        return "NULL::VARCHAR"

    def f(tpl):
        head, tail = tpl.split("{col}")
        return f"{q(head)} || {col_name} || {q(tail)}"
    return (f"CASE WHEN {cls} = 'safe' THEN {f(P.REASON_SAFE)} WHEN {cls} = 'risky' THEN {f(P.REASON_RISKY)} "
            f"ELSE {f(P.REASON_FREE)} END")


def cells_sql(table: str, dataset_expr: str, key_expr: str, columns) -> str:
    """``columns``: list of (name, sql_expr, kind) -> long form cells CTE body."""
    sel = []
    for name, expr, kind in columns:
        sel.append(f"SELECT {dataset_expr} AS dataset, {key_expr} AS row_key, {q(name)} AS col_name, "
                   f"{q(kind)} AS kind, {expr} AS cell FROM {table} WHERE {expr} IS NOT NULL")
    return "\nUNION ALL ".join(sel)


def findings_sql(cells_cte: str, profile="cli", sensitivity="high") -> str:
    """Findings with the scan's column names from a CTE of cells."""
    prof = get_profile(profile)
    types = prof.active_types(sensitivity)
    cls = column_class_sql("col_name", prof)
    return f"""
WITH cells AS ({cells_cte}),
arrs AS (
  SELECT dataset, row_key, col_name, cell, {cls} AS cls,
         {matches_sql('cell', 'kind', 'col_name', types, prof)} AS matches
  FROM cells),
ex AS (
  SELECT dataset, row_key, col_name, cell, cls, unnest(matches) AS m,
         generate_subscripts(matches, 1) - 1 AS match_idx
  FROM arrs WHERE len(matches) > 0),
f AS (
  SELECT dataset, row_key, col_name AS "column", m.pii_type AS pii_type, CAST(match_idx AS INTEGER) AS match_idx,
         m.raw_value AS raw_value, m.masked AS masked, {confidence_sql('cls', 'cell', prof)} AS confidence,
         {reason_sql('cls', 'col_name', prof)} AS reason
  FROM ex)
SELECT *, CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM f"""
