"""Builders for the oracle SQL. Nothing here is used by the library."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tablescope.operators.relationships import ForeignKey

from .data import AS_OF, SCHEMA, view_columns, views_sql

NUMERIC = ("int", "bigint", "double")


def with_views(body: str, *ctes: str) -> str:
    """A statement over the defect views and further common table expressions."""
    return f"WITH RECURSIVE {views_sql()}" + "".join(f",\n{c}" for c in ctes) + f"\n{body}"


def rounded(sql: str, doubles: Sequence[str], digits: Mapping[str, int]) -> str:
    if not doubles:
        return sql
    changed = ", ".join(f'round(cast("{c}" AS double), {digits.get(c, 6)}) + 0.0 AS "{c}"'
                        for c in doubles)
    return f"SELECT * REPLACE ({changed}) FROM (\n{sql}\n)"


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL ".join(parts)


def same(names: Sequence[str]) -> dict[str, str]:
    return {n: n for n in names}


def nulls_cte(tables: Mapping[str, str], name: str = "nulls") -> str:
    """(table, ordinal, column, type, row_count, null_count, null_pct, completeness)."""
    rows = [f"SELECT '{t}' AS \"table\", {i} AS ordinal, '{c}' AS \"column\", '{ty}' AS type, "
            f"count(*) AS row_count, count(*) - count({c}) AS null_count FROM {v}"
            for t, v in tables.items() for i, (c, ty) in enumerate(view_columns(v), start=1)]
    return (f"{name} AS (SELECT *, CASE WHEN row_count > 0 THEN null_count * 100.0::double / "
            "row_count ELSE 0.0 END AS null_pct, 100.0 - CASE WHEN row_count > 0 THEN "
            "null_count * 100.0::double / row_count ELSE 0.0 END AS completeness "
            f"FROM ({union(rows)}))")


def distinct_cte(tables: Mapping[str, str], name: str = "dist") -> str:
    rows = [f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS "
            f"distinct_count FROM {v}" for t, v in tables.items()
            for c, ty in view_columns(v) if not ty.startswith("array")]
    return f"{name} AS ({union(rows)})"


def profile_ctes(tables: Mapping[str, str]) -> list[str]:
    """nulls, dist and prof: the full column profile."""
    return [nulls_cte(tables), distinct_cte(tables), """prof AS (
  SELECT n.*, d.distinct_count,
    CASE WHEN null_pct > 30 THEN 'CRITICAL' WHEN null_pct > 5 THEN 'WARNING' ELSE 'PASS' END
      AS status,
    CASE WHEN row_count > 0 THEN d.distinct_count * 100.0::double / row_count
         WHEN d.distinct_count IS NOT NULL THEN 0.0 ELSE 0.0 END AS uniqueness
  FROM nulls n LEFT JOIN dist d USING ("table", "column"))"""]


def fk_stats_cte(fks: Sequence[ForeignKey], views: Mapping[str, str] | None = None,
                 name: str = "fkstats") -> str:
    view = (views or {}).get
    rows = []
    for fk in fks:
        c, p = view(fk.child_table, fk.child_table), view(fk.parent_table, fk.parent_table)
        cc, pc = fk.child_column, fk.parent_column
        rows.append(
            f"SELECT '{fk.child_table}' AS child_table, '{cc}' AS child_column, "
            f"'{fk.parent_table}' AS parent_table, '{pc}' AS parent_column, "
            f"{str(fk.inferred).lower()} AS inferred, "
            f"(SELECT count(*) FROM {c}) AS child_rows, "
            f"(SELECT count({cc}) FROM {c}) AS total_fk_values, "
            f"(SELECT count(*) FROM {c} x WHERE x.{cc} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {p} y WHERE y.{pc} = x.{cc})) AS orphaned_count, "
            f"(SELECT count(DISTINCT {cc}) FROM {c}) AS child_distinct, "
            f"(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {c} GROUP BY {cc})) "
            "AS child_max_freq, "
            f"(SELECT count(*) FROM {p}) AS parent_rows, "
            f"(SELECT count(DISTINCT {pc}) FROM {p}) AS parent_distinct, "
            f"(SELECT count(DISTINCT x.{cc}) FROM {c} x WHERE EXISTS (SELECT 1 FROM {p} y "
            f"WHERE y.{pc} = x.{cc})) AS matched_distinct")
    return (f"{name} AS (SELECT *, CASE WHEN total_fk_values > 0 THEN (total_fk_values - "
            "orphaned_count) * 100.0::double / total_fk_values ELSE 100.0 END AS integrity_pct "
            f"FROM ({union(rows)}))")


def as_of(table: str) -> str:
    return f"TIMESTAMP '{AS_OF.get(table, AS_OF['*'])}'"


def newest_cte(tables: Mapping[str, str], name: str = "newest") -> str:
    rows = [f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", max({c}) AS newest, "
            f"cast(floor(epoch({as_of(t)} - max({c})) / 86400) AS integer) AS days_ago, "
            f"epoch({as_of(t)} - max({c})) / 86400.0 AS age FROM {v}"
            for t, v in tables.items() for c, ty in view_columns(v) if ty == "timestamp_ntz"]
    return f"{name} AS ({union(rows)})"


def outliers_cte(tables: Mapping[str, str], name: str = "outl") -> str:
    rows = []
    for t, v in tables.items():
        for c, ty in view_columns(v):
            if ty in NUMERIC:
                rows.append(
                    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", any_value(q1) AS q1, "
                    "any_value(q3) AS q3, any_value(q1 - 1.5 * (q3 - q1)) AS lower_fence, "
                    "any_value(q3 + 1.5 * (q3 - q1)) AS upper_fence, count(*) AS row_count, "
                    f"count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR "
                    f"{c} > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
                    f"min({c})::double AS lo, max({c})::double AS hi, any_value(q2) AS q2 "
                    f"FROM {v}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) "
                    f"AS q2, quantile_cont({c}, 0.75) AS q3 FROM {v}) HAVING count(*) > 0")
    return (f"{name} AS (SELECT *, outlier_count * 100.0::double / row_count AS outlier_pct "
            f"FROM ({union(rows)}))")


# --- the catalog measured on the base tables -----------------------------------------

def catalog_ctes(declared: Sequence[ForeignKey]) -> list[str]:
    """pk, cols, fks, tabs: keys proposed from the data, proven and name-inferred FKs."""
    names = same(SCHEMA)
    position = ", ".join(f"('{t}', {i}, {len(c)})" for i, (t, c) in
                         enumerate(SCHEMA.items(), start=1))
    return [
        *profile_ctes(names),
        """cand AS (SELECT "table", "column", ordinal, row_count FROM prof WHERE row_count > 0
  AND null_count = 0 AND distinct_count = row_count)""",
        """pk AS (SELECT "table", arg_min("column", ordinal) AS "column" FROM cand
  GROUP BY "table")""",
        """cols AS (SELECT n."table", n.ordinal, n."column", n.type, n.null_count > 0 AS nullable,
  pk."column" IS NOT NULL AS primary_key, c."column" IS NOT NULL AS "unique"
  FROM nulls n LEFT JOIN pk ON pk."table" = n."table" AND pk."column" = n."column"
  LEFT JOIN cand c ON c."table" = n."table" AND c."column" = n."column")""",
        f"""pos AS (SELECT * FROM (VALUES {position}) v("table", position, column_count))""",
        """tabs AS (SELECT pos."table", position, any_value(row_count) AS row_count,
  any_value(column_count) AS column_count FROM pos JOIN nulls USING ("table")
  GROUP BY pos."table", position)""",
        fk_stats_cte(declared),
        """shared AS (SELECT "column", "table", position, count(*) OVER (PARTITION BY "column")
  AS uses FROM cols JOIN pos USING ("table") WHERE "column" LIKE '%\\_id' ESCAPE '\\')""",
        """named AS (SELECT "column", coalesce(
    arg_min("table", position) FILTER (WHERE contains(lower("table"),
      lower(left("column", length("column") - 3)))), min("table")) AS parent
  FROM shared WHERE uses >= 2 GROUP BY "column")""",
        """byname AS (SELECT s."table" AS child_table, s."column" AS child_column,
  n.parent AS parent_table, s."column" AS parent_column, true AS inferred
  FROM shared s JOIN named n ON n."column" = s."column" WHERE s."table" <> n.parent)""",
        """declared AS (SELECT child_table, child_column, parent_table, parent_column,
  false AS inferred FROM fkstats WHERE total_fk_values > 0 AND orphaned_count = 0)""",
        """fks AS (SELECT * FROM declared UNION ALL SELECT * FROM byname b WHERE NOT EXISTS
  (SELECT 1 FROM declared d WHERE d.child_table = b.child_table
   AND d.child_column = b.child_column AND d.parent_table = b.parent_table))""",
    ]


GRAPH_CTES = [
    "edge AS (SELECT DISTINCT child_table AS src, parent_table AS dst FROM fks)",
    """und AS (SELECT src, dst FROM edge WHERE src <> dst UNION
  SELECT dst, src FROM edge WHERE src <> dst)""",
    """reach AS (SELECT "table" AS node, "table" AS other FROM tabs UNION
  SELECT r.node, u.dst FROM reach r JOIN und u ON u.src = r.other)""",
    "comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)",
    """deg AS (SELECT t."table" AS node, count(u.dst) AS degree,
  count(u.dst) / ((SELECT count(*) FROM tabs) - 1)::double AS centrality
  FROM tabs t LEFT JOIN und u ON u.src = t."table" GROUP BY t."table")""",
]
