"""SQL text for checking reconciliations against another engine.

Written as a join of row-numbered sides, on purpose unlike the stack-and-group plan it checks.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, as in functions.compare: which texts count as a number or as a full date.
NUMBER = r"^\s*[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?\s*$"
DATE = r"^(\d{4}|\d{5})-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}.*)?$"


@dataclass(frozen=True)
class Col:
    """One compared column: how it is normalized, what else counts as equal, how it is shown."""

    name: str
    norm: str = "{}"
    also: str | None = None
    text: str = "CAST({} AS VARCHAR)"


def within(epsilon: float) -> str:
    """Equal within a tolerance, for typed numbers."""
    return f"abs(CAST({{s}} AS DOUBLE) - CAST({{t}} AS DOUBLE)) <= {epsilon}"


def text_within(epsilon: float) -> str:
    """Equal within a tolerance, for numbers in text."""
    number = "CASE WHEN regexp_matches({}, '" + NUMBER + "') THEN TRY_CAST({} AS DOUBLE) END"
    return f"abs({number.replace('{}', '{s}')} - {number.replace('{}', '{t}')}) <= {epsilon}"


def same_time() -> str:
    """Equal as timestamps, for full dates in text."""
    stamp = "CASE WHEN regexp_matches({}, '" + DATE + "') THEN TRY_CAST({} AS TIMESTAMP) END"
    return stamp.replace("{}", "{s}") + " = " + stamp.replace("{}", "{t}")


def _apply(template: str, **values: str) -> str:
    out = template
    for name, value in values.items():
        out = out.replace("{" + name + "}", value)
    return out


def joined(keys: list[str], columns: list[Col]) -> str:
    """CTEs from ``src`` and ``tgt`` to ``j``: one row per key, with flags and cell columns."""
    key_list = ", ".join(keys)
    names = ", ".join(c.name for c in columns)
    order = ", ".join(f"{c.name} ASC NULLS FIRST" for c in columns) or key_list

    def side(name: str) -> str:
        return f"""
{name}1 AS (
  SELECT * FROM (
    SELECT {key_list}{', ' + names if names else ''},
           row_number() OVER (PARTITION BY {key_list} ORDER BY {order}) AS _rn,
           count(*) OVER (PARTITION BY {key_list}) AS _n
    FROM {name}) WHERE _rn = 1)"""

    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    parts = []
    for c in columns:
        s, t = c.norm.replace("{}", f"s.{c.name}"), c.norm.replace("{}", f"t.{c.name}")
        exact = f"({s} IS NOT DISTINCT FROM {t})"
        match = exact
        if c.also:
            match = f"({exact} OR coalesce({_apply(c.also, s=s, t=t)}, false))"
        s_text, t_text = c.text.replace("{}", f"s.{c.name}"), c.text.replace("{}", f"t.{c.name}")
        parts += [
            f"{exact} AS {c.name}_x",
            f"{match} AS {c.name}_m",
            f"CASE WHEN {match} THEN 'MATCH' ELSE 'MISMATCH: ' || coalesce({s_text}, 'NULL') || ' || ' "
            f"|| coalesce({t_text}, 'NULL') END AS {c.name}_status",
            f"{s_text} AS {c.name}_source",
            f"{t_text} AS {c.name}_target",
        ]
    cells = ",\n         ".join(parts)
    all_x = " AND ".join(f"{c.name}_x" for c in columns) or "true"
    all_m = " AND ".join(f"{c.name}_m" for c in columns) or "true"
    return f"""{side('src').strip()},{side('tgt')},
paired AS (
  SELECT {', '.join(f'coalesce(s.{k}, t.{k}) AS {k}' for k in keys)},
         coalesce(s._n, 0) AS n_s, coalesce(t._n, 0) AS n_t{',' if cells else ''}
         {cells}
  FROM src1 s FULL OUTER JOIN tgt1 t ON {on}),
j AS (
  SELECT *,
         CASE WHEN n_s = 0 THEN 'Missing in Source' WHEN n_t = 0 THEN 'Missing in Target'
              ELSE 'Found in Both' END AS validation_status,
         n_s > 0 AND n_t > 0 AND NOT ({all_x}) AS mismatch_exact,
         n_s > 0 AND n_t > 0 AND NOT ({all_m}) AS mismatch
  FROM paired)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


SUMMARY = """
SELECT source_count, target_count, source_keys, target_keys, found_in_both, missing_in_source,
       missing_in_target, mismatched_rows, mismatched_rows_exact,
       source_count - source_keys AS source_duplicate_rows,
       target_count - target_keys AS target_duplicate_rows,
       found_in_both - mismatched_rows AS matching_rows,
       CASE WHEN greatest(source_keys, target_keys) > 0
            THEN (found_in_both - mismatched_rows) / greatest(source_keys, target_keys) * 100
            ELSE 0.0 END AS match_percentage,
       abs(source_count - target_count) AS row_count_diff
FROM (
  SELECT CAST(coalesce(sum(n_s), 0) AS BIGINT) AS source_count,
         CAST(coalesce(sum(n_t), 0) AS BIGINT) AS target_count,
         count(*) FILTER (n_s > 0) AS source_keys,
         count(*) FILTER (n_t > 0) AS target_keys,
         count(*) FILTER (validation_status = 'Found in Both') AS found_in_both,
         count(*) FILTER (validation_status = 'Missing in Source') AS missing_in_source,
         count(*) FILTER (validation_status = 'Missing in Target') AS missing_in_target,
         count(*) FILTER (mismatch) AS mismatched_rows,
         count(*) FILTER (mismatch_exact) AS mismatched_rows_exact
  FROM j)
"""


def triplets(columns: list[Col]) -> str:
    return ", ".join(f"{c.name}_status, {c.name}_source, {c.name}_target" for c in columns)


def detail(keys: list[str], columns: list[Col], where: str = "mismatch OR validation_status <> 'Found in Both'") -> str:
    cells = ", " + triplets(columns) if columns else ""
    return f"SELECT validation_status, {', '.join(keys)}{cells} FROM j WHERE {where}"


RANK = (
    "CASE validation_status WHEN 'Found in Both' THEN 1 WHEN 'Missing in Source' THEN 2 ELSE 3 END"
)
