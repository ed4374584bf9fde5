"""DuckDB SQL for the queries of ``core_queries`` that SQL can express."""

from __future__ import annotations

_LONG = "(regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(ltrim(v, '+') AS HUGEINT) BETWEEN -9223372036854775808 AND 9223372036854775807)"
_DOUBLE = r"(regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(ltrim(v, '+') AS DOUBLE)))"

_REFERENCES = """
    SELECT 'edges_tsv' AS table_name, edge_id AS row_id, 'from_id' AS field, from_id AS variable, loaded_at, day AS period FROM edges_tsv
    UNION ALL SELECT 'edges_tsv', edge_id, 'to_id', to_id, loaded_at, day FROM edges_tsv
    UNION ALL SELECT 'node_props', prop_id, 'variable', variable, loaded_at, loaded_at::DATE FROM node_props
"""
_ORPHANS = f"""
    SELECT table_name, row_id, field, period FROM ({_REFERENCES}) r
    WHERE variable IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM nodes_tsv n WHERE n.variable = r.variable AND n.loaded_at <= r.loaded_at AND (n.removed_at IS NULL OR n.removed_at > r.loaded_at))
"""
_PER_KEY = """
    SELECT 'from_id' AS field, from_id AS key_value, count(*) AS n_rows, count(DISTINCT to_id) AS n_targets, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM edges_tsv GROUP BY from_id
    UNION ALL SELECT 'type', type, count(*), count(DISTINCT to_id), min(loaded_at), max(loaded_at) FROM edges_tsv GROUP BY type
"""

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_TRIPLE = rf"\((\?{_NAME}|[A-Za-z0-9_]+)(:{_NAME})?\)-\[(\?{_NAME}(:{_NAME})?|:{_NAME})\]->\((\?{_NAME}|[A-Za-z0-9_]+)(:{_NAME})?\)"
_OPERAND = rf"""(\?{_NAME}(\.{_NAME})?|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|"[^"]*")"""
_TEST = rf"\(\s*{_OPERAND}\s*(=|!=|<=|>=|<|>)\s*{_OPERAND}\s*\)"
_PATTERN = rf"{_TRIPLE}(\s*,\s*{_TRIPLE})*( WHERE {_TEST}( AND {_TEST})*)?"
_SECONDS = r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
#: Type and pattern of the fields of both kinds of lines, and what the field should be.
_LSQB = {
    "c1": ("VARCHAR", "(?s).+", "system, not empty"), "c2": ("VARCHAR", "(?s).*", "text"), "c3": ("BIGINT", "0*[1-9][0-9]*", "integer above 0"), "c4": ("BIGINT", "[1-9]", "one digit 1-9"),
    "c5": ("DOUBLE", _SECONDS, "decimal number"), "c6": ("BIGINT", "[0-9]+", "integer without sign"), "c7": ("BIGINT", "[0-9]+", "integer without sign"), "c8": ("VARCHAR", _PATTERN, "pattern"),
}
_NEO4J = {"c1": ("BIGINT", "0*[1-9][0-9]*", "integer above 0"), "c2": ("VARCHAR", "[0-9]+|NC", "integer without sign or NC"), "c3": ("DOUBLE", _SECONDS, "decimal number")}


def _fields(table: str, form: dict, delimiter: str, mark: str, blanks: str) -> str:
    """Lines with their fields by the quoting rule and the reason for refusing them, null for valid ones."""
    piece = f'("([^"]|"")*"|[^"{delimiter}]*)'
    split = f"""list_transform(regexp_extract_all(bare || {mark}, '{piece}{delimiter}', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE trim(f, {blanks}) END)"""
    named = ", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(form))
    fails = lambda n, p: f"NOT regexp_full_match({n}, '{p}')"
    casts = " ".join(f"WHEN TRY_CAST({n} AS {t}) IS NULL AND {n} <> '' AND {fails(n, p)} THEN '{n}: not {w}'" for n, (t, p, w) in form.items() if t != "VARCHAR")
    exact = " ".join(f"WHEN {fails(n, p)} THEN '{n}: not {w}'" for typed in (True, False) for n, (t, p, w) in form.items() if (t != "VARCHAR") == typed)
    counts = f"WHEN len(f) < {len(form)} THEN 'missing columns' WHEN len(f) > {len(form)} THEN 'too many columns'"
    return f"""(SELECT *, CASE WHEN raw IS NULL THEN 'no line' WHEN NOT regexp_full_match(bare, '{piece}({delimiter}{piece})*') THEN 'broken quoting' {counts} {casts} {exact} END AS reason
        FROM (SELECT *, {named} FROM (SELECT *, {split} AS f FROM (SELECT line_id, file_name, load_day, line AS raw, CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE line END AS bare FROM {table}))))"""


def _rows(lines: str, form: dict) -> str:
    columns = ", ".join(f"TRY_CAST({n} AS {t}) AS {n}" for n, (t, _, _) in form.items())
    return f"SELECT line_id, file_name, load_day, {columns} FROM {lines} WHERE reason IS NULL"


_LSQB_LINES, _NEO4J_LINES = _fields("lsqb_lines", _LSQB, ",", "','", "' ' || chr(9)"), _fields("neo4j_lines", _NEO4J, r"\t", "chr(9)", "' '")
_BOTH = f"(SELECT 'lsqb_lines' AS table_name, line_id, file_name, load_day, raw, reason FROM {_LSQB_LINES} UNION ALL SELECT 'neo4j_lines', line_id, file_name, load_day, raw, reason FROM {_NEO4J_LINES})"
_PAIR = "e.from_id = t.from_id AND e.to_id = t.to_id"
_CELLS = "SELECT variable, trim(key) AS key, arg_max(trim(value), prop_id) AS v FROM node_props WHERE variable IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"
_UNQUOTED = "CASE WHEN length(v) >= 2 AND v[1] IN (chr(34), chr(39)) AND v[1] = v[-1] THEN v[2:-2] ELSE v END"

ORACLE = {
    "p2_cells": f"""
        SELECT * FROM (SELECT variable, key, CASE WHEN declared_type = 'long' AND {_LONG} THEN ltrim(v, '+')::BIGINT END AS long_value, CASE WHEN declared_type = 'double' AND {_DOUBLE} THEN ltrim(v, '+')::DOUBLE END AS double_value,
            CASE WHEN declared_type = 'string' THEN {_UNQUOTED} END AS string_value
            FROM ({_CELLS}) JOIN prop_keys USING (key)) WHERE long_value IS NOT NULL OR double_value IS NOT NULL OR string_value IS NOT NULL""",
    "p4_found": f"SELECT table_name, line_id FROM {_BOTH} WHERE reason IS NOT NULL",
    "p4_rejects": f"SELECT * FROM {_BOTH} WHERE reason IS NOT NULL",
    "p4_lsqb_rows": _rows(_LSQB_LINES, _LSQB),
    "p4_neo4j_rows": _rows(_NEO4J_LINES, _NEO4J),
    "p5_composite": f"""
        WITH t AS (SELECT DISTINCT from_id, to_id FROM edges_tsv WHERE type = 'KNOWS' AND loaded_at::DATE > day), e AS (SELECT * FROM edges_tsv)
        SELECT 'simple' AS semantics, edge_id FROM e WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE {_PAIR})
        UNION ALL SELECT 'full', edge_id FROM e WHERE (from_id IS NULL) <> (to_id IS NULL) OR (from_id IS NOT NULL AND to_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE {_PAIR}))
        UNION ALL SELECT 'partial', edge_id FROM e WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE {_PAIR})
        UNION ALL SELECT 'partial', edge_id FROM e WHERE from_id IS NULL AND to_id IS NOT NULL AND to_id NOT IN (SELECT to_id FROM t WHERE to_id IS NOT NULL)
        UNION ALL SELECT 'partial', edge_id FROM e WHERE to_id IS NULL AND from_id IS NOT NULL AND from_id NOT IN (SELECT from_id FROM t WHERE from_id IS NOT NULL)""",
    "p6_zone_contradictions": "SELECT feed, zone, zone AS told_zone FROM feeds WHERE false",
    "p1_certified_counts": """
        SELECT run_day, status, q,
            count(*) FILTER (WHERE isfinite(time_ms) AND time_ms BETWEEN 0 AND 86400000) AS n,
            count(*) FILTER (WHERE time_ms IS NULL) AS n_null,
            count(*) FILTER (WHERE time_ms IS NOT NULL AND NOT isfinite(time_ms)) AS n_nan,
            count(*) FILTER (WHERE isfinite(time_ms) AND NOT time_ms BETWEEN 0 AND 86400000) AS n_out_of_range,
            true AS certified
        FROM milldb_runs, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q) GROUP BY run_day, status, q""",
    "p2_found": f"""
        WITH cells AS (SELECT variable, trim(key) AS key, arg_max(trim(value), prop_id) AS v FROM node_props WHERE variable IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
        SELECT variable, key FROM cells JOIN prop_keys USING (key)
        WHERE (declared_type = 'long' AND NOT coalesce({_LONG}, false)) OR (declared_type = 'double' AND NOT coalesce({_DOUBLE}, false))""",
    "p3_found": f"SELECT field, key_value FROM ({_PER_KEY}) WHERE key_value IS NOT NULL AND n_rows * 100 >= 2 * (SELECT count(*) FROM edges_tsv)",
    "p3_per_key": _PER_KEY,
    "p5_found": f"SELECT table_name, row_id, field FROM ({_ORPHANS})",
    "p5_report": f"SELECT table_name, field, period, count(*) AS n_orphans FROM ({_ORPHANS}) GROUP BY ALL",
}
