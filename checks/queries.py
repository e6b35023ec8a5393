"""Every registered query: a Spark callable beside its oracle SQL.

Floating-point results are rounded to 6 places on both sides, because the order in
which an engine adds decides the last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tablescope.functions.exprs import union_all
from tablescope.operators import (catalog as cat, dates, discovery as disc, graph, infer, issues,
                                  profile as prof, quality as q, relationships as rel, stats)
from tablescope.plans import scorecard as cards
from tablescope.policy import EnumRule, QualityPolicy, SequenceRule, WEIGHTS6
from tablescope.session import scratch_path
from tablescope.sources import readers, sqltext, store, writers

from . import data, sql
from .data import (AS_OF, BY_NAME, CARD_FKS, CARD_KEYS, CARD_TABLES, DECLARED, ORDER_KEYS, POLICY,
                   SCHEMA, TEXT_TYPES, WRONG)


@dataclass(frozen=True)
class Source:
    """The tables of one scale folder."""

    spark: SparkSession
    sf_dir: str
    opened: dict[str, DataFrame] = field(default_factory=dict)

    def t(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = data.table(self.spark, self.sf_dir, name)
        return self.opened[name]

    def tables(self, names=None) -> dict[str, DataFrame]:
        chosen = sql.same(SCHEMA) if names is None else names
        if not isinstance(chosen, dict):
            chosen = sql.same(chosen)
        return {alias: self.t(view) for alias, view in chosen.items()}

    def card_tables(self) -> dict[str, DataFrame]:
        return self.tables(CARD_TABLES)

    def catalog(self) -> cat.Catalog:
        """Keys proposed from the data, proven declared keys, keys inferred by name."""
        tables = self.tables()
        profile = prof.column_profile(tables)
        keys = disc.candidate_keys(profile)
        return cat.extract_catalog(tables, disc.propose_primary_keys(keys), self.fks(), keys,
                                   profile)

    def light_catalog(self) -> cat.Catalog:
        """The same without keys and nullability, for rules that need neither."""
        tables = self.tables()
        return cat.Catalog(cat.extract_tables(tables), cat.extract_columns(tables), self.fks())

    def fks(self) -> DataFrame:
        proven = rel.valid_fks(rel.check_fks(rel.relationship_stats(self.tables(), DECLARED)))
        return cat.merge_fks(proven.withColumn("inferred", F.lit(False)), self.fks_by_name())

    def fks_by_name(self) -> DataFrame:
        tables = self.tables()
        return cat.infer_fks_by_name(cat.extract_columns(tables), cat.extract_tables(tables))

    def nodes(self) -> DataFrame:
        return cat.extract_tables(self.tables()).select(F.col("table").alias("node"))

    def edges(self) -> DataFrame:
        return graph.edges(self.fks())


@dataclass(frozen=True)
class Query:
    run: Callable[[Source], DataFrame]
    oracle: str | None
    digits: dict[str, int]


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, doubles=(), digits=None):
    """Register the decorated function under `name`.

    `doubles` are the floating-point results; `digits` sets other places for some.
    """
    places = digits or {}

    def add(run: Callable[[Source], DataFrame]):
        REGISTRY[name] = Query(run, oracle and sql.rounded(oracle, doubles, places), places)
        return run
    return add


def tidy(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round floating-point columns; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits.get(f.name, 6)) + F.lit(0.0)
                        ).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = REGISTRY[name]
    return tidy(chosen.run(Source(spark, sf_dir)), chosen.digits)


PCT = ("null_pct", "completeness")
CATALOG = sql.catalog_ctes(DECLARED)
ALL = sql.same(SCHEMA)

# ====================================================================================
# Profiles
# ====================================================================================

_orders = {"orders": "d_orders"}
_profile_orders = sql.profile_ctes(_orders)


@query("null_profile_orders", sql.with_views("SELECT * FROM nulls", sql.nulls_cte(_orders)), PCT)
def _(s):
    return prof.null_profile(s.tables(_orders))


@query("null_profile_all", sql.with_views("SELECT * FROM nulls", sql.nulls_cte(ALL)), PCT)
def _(s):
    return prof.null_profile(s.tables())


@query("table_row_counts", sql.union([f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}"
                                      for t in SCHEMA]))
def _(s):
    return prof.row_counts(s.tables())


@query("completeness_status", sql.with_views(
    'SELECT "table", "column", null_pct, status FROM prof', *_profile_orders), ["null_pct"])
def _(s):
    return prof.completeness_status(prof.null_profile(s.tables(_orders))).select(
        "table", "column", "null_pct", "status")


@query("completeness_score", sql.with_views(
    'SELECT "table", CASE WHEN max(row_count) > 0 THEN 100 - avg(null_pct) ELSE 0.0 END AS '
    'completeness FROM nulls GROUP BY "table"', sql.nulls_cte(CARD_TABLES)), ["completeness"])
def _(s):
    return prof.completeness_score(prof.null_profile(s.card_tables()))


_DISTINCT = ('SELECT "table", "column", row_count, distinct_count, uniqueness AS cardinality_pct '
             "FROM prof WHERE distinct_count IS NOT NULL")


@query("distinct_profile_orders", sql.with_views(_DISTINCT, *_profile_orders),
       ["cardinality_pct"])
def _(s):
    return prof.distinct_profile(s.tables(_orders))


@query("distinct_profile_all", sql.with_views(_DISTINCT, *sql.profile_ctes(ALL)),
       ["cardinality_pct"])
def _(s):
    return prof.distinct_profile(s.tables())


# sketches are checked for their error, since no two sketches agree to the digit
@query("distinct_profile_approx", sql.with_views(
    'SELECT "table", "column", row_count, true AS close FROM prof',
    *sql.profile_ctes(sql.same(["lineitem", "orders"]))))
def _(s):
    tables = s.tables(["lineitem", "orders"])
    exact = prof.distinct_profile(tables).select("table", "column", F.col("distinct_count").alias(
        "exact"))
    return prof.distinct_profile(tables, approx=True).join(exact, ["table", "column"]).select(
        "table", "column", "row_count",
        (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.2 * F.col("exact") + 1).alias(
            "close"))


@query("column_profile", sql.with_views(
    """SELECT "table", "column", ordinal, type, row_count, null_count, null_pct, completeness,
    status, distinct_count, uniqueness, CASE WHEN type = 'string' AND row_count > 0 AND
    uniqueness < 5 THEN 'POSSIBLE_ENUM' END AS flag FROM prof""", *sql.profile_ctes(CARD_TABLES)),
    [*PCT, "uniqueness"])
def _(s):
    return prof.column_profile(s.card_tables())


@query("enum_candidates", sql.with_views(
    """SELECT "table", "column", distinct_count, uniqueness AS cardinality_pct FROM prof
    WHERE type = 'string' AND row_count > 0 AND uniqueness < 5""", *sql.profile_ctes(ALL)),
    ["cardinality_pct"])
def _(s):
    return prof.enum_candidates(prof.column_profile(s.tables()))


@query("all_null_columns", sql.with_views(
    'SELECT "table", "column", row_count FROM nulls WHERE row_count > 0 AND '
    "null_count = row_count", sql.nulls_cte(CARD_TABLES)))
def _(s):
    return prof.all_null_columns(prof.null_profile(s.card_tables()))


_freq_orders = sql.union([f"SELECT '{c}' AS \"column\", cast({c} AS varchar) AS \"value\", "
                          f"count(*) AS n FROM d_orders GROUP BY {c}"
                          for c, _ in data.view_columns("d_orders")])


@query("value_freq_orders", sql.with_views(_freq_orders))
def _(s):
    return prof.value_freq(s.t("d_orders"))


def _typed_modes(view: str) -> str:
    return sql.union([
        f"(SELECT '{c}' AS \"column\", cast({c} AS varchar) AS mode, count(*) AS n FROM {view} "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} ASC NULLS FIRST LIMIT 1)"
        for c, _ in data.view_columns(view)])


@query("column_modes", sql.with_views(_typed_modes("d_orders")))
def _(s):
    return prof.column_modes(s.t("d_orders"))


@query("column_modes_lineitem", sql.with_views(_typed_modes("lineitem")))
def _(s):
    return prof.column_modes(s.t("lineitem"))


def _top(view: str, columns, k=5) -> str:
    return sql.union([
        f"SELECT '{c}' AS \"column\", rank, \"value\", left(\"value\", 10) AS label, n FROM "
        f"(SELECT cast({c} AS varchar) AS \"value\", count(*) AS n, cast(row_number() OVER "
        f"(ORDER BY count(*) DESC, cast({c} AS varchar) ASC NULLS FIRST) AS integer) AS rank "
        f"FROM {view} GROUP BY 1) WHERE rank <= {k}" for c in columns])


@query("top_values_orders", sql.with_views(_top("d_orders", [
    "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])))
def _(s):
    return prof.top_values(s.t("d_orders"), ["o_custkey", "o_orderstatus", "o_orderdate",
                                             "o_orderpriority"])


@query("top_values_events", sql.with_views(_top("events", ["event_type", "user_id", "props"])))
def _(s):
    return prof.top_values(s.t("events"), ["event_type", "user_id", "props"])


def _scalar(view: str) -> list[str]:
    return [c for c, ty in data.view_columns(view) if not ty.startswith("array")]


def _over_all(s: Source, operator) -> DataFrame:
    """One operator on each of the tables, with the table's name."""
    return union_all([operator(df).select(F.lit(t).alias("table"), "*") for t, df in s.tables().items()])


def _named(t: str, rows: str) -> str:
    return f"SELECT '{t}' AS \"table\", * FROM ({rows})"


@query("column_modes_all", sql.union([_named(t, sql.union([
    f"(SELECT '{c}' AS \"column\", cast({c} AS varchar) AS mode, count(*) AS n FROM {t} "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} ASC NULLS FIRST LIMIT 1)" for c in _scalar(t)]))
    for t in SCHEMA]))
def _(s):
    return _over_all(s, prof.column_modes)


@query("top_values_all", sql.union([_named(t, _top(t, _scalar(t))) for t in SCHEMA]))
def _(s):
    return _over_all(s, prof.top_values)


def _with_rank(df: DataFrame) -> DataFrame:
    """The order of a small sorted relation as a column."""
    return df.withColumn("rank", F.row_number().over(
        Window.orderBy(F.monotonically_increasing_id())))


@query("columns_by_null_rate", sql.with_views(
    'SELECT "table", "column", null_pct, (row_number() OVER (ORDER BY null_pct DESC, "table", '
    '"column"))::integer AS rank FROM nulls', sql.nulls_cte(_orders)), ["null_pct"])
def _(s):
    return _with_rank(prof.sort_columns(prof.null_profile(s.tables(_orders)))).select(
        "table", "column", "null_pct", "rank")


@query("tables_by_score", sql.with_views(
    'SELECT "table", completeness, (row_number() OVER (ORDER BY completeness, "table"))::integer '
    'AS rank FROM (SELECT "table", 100.0 - avg(null_pct) AS completeness FROM nulls GROUP BY 1)',
    sql.nulls_cte(sql.same(SCHEMA))), ["completeness"])
def _(s):
    return _with_rank(prof.sort_columns(prof.completeness_score(prof.null_profile(s.tables())),
                                        "completeness", descending=False))


@query("null_matrix_orders", sql.with_views(
    "SELECT 'orders' AS \"table\", " + ", ".join(
        f"max(null_pct) FILTER (WHERE \"column\" = '{c}') AS {c}"
        for c, _ in data.view_columns("d_orders")) + " FROM nulls", sql.nulls_cte(_orders)),
    [c for c, _ in data.view_columns("d_orders")])
def _(s):
    return stats.null_matrix(prof.null_profile(s.tables(_orders)),
                             [c for c, _ in data.view_columns("d_orders")])


@query("cardinality_bars", sql.with_views(
    'SELECT "table", "column", uniqueness AS cardinality_pct, 5.0::double AS enum_line_pct, '
    "uniqueness < 5 AS below_line FROM prof WHERE distinct_count IS NOT NULL", *_profile_orders),
    ["cardinality_pct"])
def _(s):
    return stats.cardinality_bars(prof.column_profile(s.tables(_orders)))


# ====================================================================================
# Statistics and distributions
# ====================================================================================

def _numeric(view: str) -> list[str]:
    return [c for c, ty in data.view_columns(view) if ty in sql.NUMERIC]


def _numeric_stats(view: str) -> str:
    return sql.union([
        f"SELECT '{c}' AS \"column\", count(v) AS \"count\", avg(v) AS mean, "
        "stddev_samp(v) AS std, var_samp(v) AS var, min(v) AS \"min\", max(v) AS \"max\", "
        "max(v) - min(v) AS \"range\", skewness(v) AS skew, kurtosis(v) AS kurtosis, "
        "quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
        "quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, "
        f"(SELECT {c}::double FROM {view} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1) AS mode "
        f"FROM (SELECT {c}::double AS v FROM {view})" for c in _numeric(view)])


_STATS = ["mean", "std", "var", "min", "max", "range", "skew", "kurtosis", "q1", "median", "q3",
          "iqr", "mode"]

for _view in ("lineitem", "d_orders", "events", "d_customer"):
    @query(f"numeric_stats_{_view.removeprefix('d_')}", sql.with_views(_numeric_stats(_view)),
           _STATS, {"var": 0, "std": 3, "mean": 4})
    def _(s, view=_view):
        return stats.numeric_stats(s.t(view))


@query("numeric_stats_approx", sql.with_views(sql.union([
    f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", true AS close FROM lineitem"
    for c in _numeric("lineitem")])))
def _(s):
    near = stats.numeric_stats(s.t("lineitem"), approx=True)
    exact = stats.quartiles(s.t("lineitem")).select("column", *[
        F.col(c).alias(f"exact_{c}") for c in ("q1", "median", "q3")])
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"exact_{c}")) for c in ("q1", "median", "q3")])
    return near.join(exact, "column").select(
        "column", "count", (off <= F.lit(0.02) * F.col("range")).alias("close"))


@query("basic_stats", sql.with_views(sql.union([
    f"SELECT '{c}' AS \"column\", min({c})::double AS \"min\", max({c})::double AS \"max\", "
    f"avg({c}) AS \"avg\" FROM d_lineitem" for c in _numeric("d_lineitem")])).replace(
    "avg(", "round(avg(").replace(") AS \"avg\"", "), 4) AS \"avg\""), ["min", "max", "avg"])
def _(s):
    return stats.basic_stats(s.t("d_lineitem"))


@query("typed_mean", sql.with_views(sql.union([
    f"SELECT '{c}' AS \"column\", count(try_cast({c} AS double)) AS numeric_count, "
    f"avg(try_cast({c} AS double)) AS mean FROM d_text"
    for c in ("o_custkey", "o_totalprice", "o_orderstatus")])), ["mean"])
def _(s):
    return stats.typed_mean(s.t("d_text"), ["o_custkey", "o_totalprice", "o_orderstatus"])


def _date_stats(view: str, columns=None) -> str:
    def common(part, c):
        return (f"(SELECT cast({part}({c}) AS integer) FROM {view} WHERE {c} IS NOT NULL GROUP BY "
                f"{part}({c}) ORDER BY count(*) DESC, {part}({c}) LIMIT 1)")
    return sql.union([
        f"SELECT '{c}' AS \"column\", min({c}) AS earliest, max({c}) AS latest, "
        f"cast(floor(epoch(max({c}) - min({c})) / 86400) AS integer) AS range_days, "
        f"{common('year', c)} AS common_year, {common('month', c)} AS common_month FROM {view}"
        for c in columns or [c for c, ty in data.view_columns(view) if ty == "timestamp_ntz"]])


for _view in ("d_orders", "lineitem", "events"):
    @query(f"date_stats_{_view.removeprefix('d_')}", sql.with_views(_date_stats(_view)))
    def _(s, view=_view):
        return stats.date_stats(s.t(view))


def _text_stats(view: str) -> str:
    def extreme(c, order):
        return (f"(SELECT {c} FROM {view} WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) {order}, {c} LIMIT 1)")
    return sql.union([
        f"SELECT '{c}' AS \"column\", {extreme(c, 'DESC')} AS most_frequent, "
        f"{extreme(c, 'ASC')} AS least_frequent, count(DISTINCT {c}) AS distinct_count, "
        f"avg(length({c})) AS avg_len, min(length({c}))::integer AS min_len, "
        f"max(length({c}))::integer AS max_len FROM {view}"
        for c, ty in data.view_columns(view) if ty == "string" and c != "o_comment"])


for _view in ("d_orders", "d_customer", "documents", "events"):
    @query(f"text_stats_{_view.removeprefix('d_')}", sql.with_views(_text_stats(_view)),
           ["avg_len"])
    def _(s, view=_view):
        return stats.text_stats(s.t(view))


_TEXT_TABLES = [t for t, columns in SCHEMA.items() if any(ty == "string" for _, ty in columns)]


@query("text_stats_all", sql.union([_named(t, _text_stats(t)) for t in _TEXT_TABLES]), ["avg_len"])
def _(s):
    return _over_all(s, stats.text_stats)


def _histogram(view: str, columns, bins: int) -> str:
    return sql.union([
        f"SELECT '{c}' AS \"column\", bin::integer AS bin, lo + (bin - 1) * step AS bin_low, "
        "lo + bin * step AS bin_high, coalesce(n, 0) AS n FROM (SELECT *, CASE WHEN hi = lo THEN "
        f"1.0 ELSE (hi - lo) / {bins} END AS step FROM (SELECT min({c})::double AS lo, "
        f"max({c})::double AS hi FROM {view}), range(1, {bins + 1}) r(bin)) LEFT JOIN "
        f"(SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor(({c} - lo) / (hi - lo) * {bins}) + 1, "
        f"{bins}) END::integer AS bin, count(*) AS n FROM {view}, (SELECT min({c})::double AS lo, "
        f"max({c})::double AS hi FROM {view}) WHERE {c} IS NOT NULL GROUP BY 1) USING (bin)"
        for c in columns])


@query("histogram_lineitem", sql.with_views(_histogram("d_lineitem", _numeric("d_lineitem"), 10)),
       ["bin_low", "bin_high"])
def _(s):
    return stats.histogram(s.t("d_lineitem"))


@query("histogram_events", sql.with_views(_histogram("events", ["value"], 10)),
       ["bin_low", "bin_high"])
def _(s):
    return stats.histogram(s.t("events"), ["value"])


@query("histogram30_orders", sql.with_views(_histogram("d_orders", ["o_totalprice"], 30)),
       ["bin_low", "bin_high"])
def _(s):
    return stats.histogram(s.t("d_orders"), ["o_totalprice"], bins=30)


_INFINITE = ("CASE WHEN event_id % 97 = 0 THEN cast('Infinity' AS double) WHEN event_id % 89 = 0 "
             "THEN cast('-Infinity' AS double) ELSE value END")


@query("histogram_infinite", sql.with_views(
    _histogram("finite", ["value"], 10) + "".join(
        f"\nUNION ALL SELECT 'value', {bin_no}, {edge}, {edge}, count(*) FROM mixed "
        f"WHERE value = {edge} HAVING count(*) > 0"
        for bin_no, edge in ((0, "'-infinity'::double"), (11, "'infinity'::double"))),
    f"mixed AS (SELECT {_INFINITE} AS value FROM events)",
    "finite AS (SELECT value FROM mixed WHERE abs(value) < 'infinity'::double)"),
    ["bin_low", "bin_high"])
def _(s):
    return stats.histogram(s.t("events").selectExpr(f"{_INFINITE} AS value"))


@query("range_large_integers", sql.with_views(
    "SELECT 'k' AS \"column\", count(k) AS \"count\", (max(k) - min(k))::double AS \"range\" "
    "FROM (SELECT 9007199254740993 + o_orderkey % 10 AS k FROM orders)"), ["range"])
def _(s):
    return stats.moments(s.t("orders").selectExpr("9007199254740993 + o_orderkey % 10 AS k")).select(
        "column", "count", "range")


_LARGE = {"k": "9007199254740993 + o_orderkey % 10", "d": "-9223372036854775807 + o_custkey",
          "c": "o_custkey"}


@query("numeric_stats_large_integers", sql.with_views(sql.union([
    f"SELECT '{c}' AS \"column\", count(v) AS \"count\", min(v) AS \"min\", max(v) AS \"max\", "
    "(max(v)::hugeint - min(v))::decimal(38,0) AS \"range\", "
    f"(SELECT {e} FROM orders GROUP BY {e} ORDER BY count(*) DESC, {e} LIMIT 1) AS mode "
    f"FROM (SELECT {e} AS v FROM orders)" for c, e in _LARGE.items()])))
def _(s):
    return stats.integer_stats(s.t("orders").selectExpr(*[f"{e} AS {c}" for c, e in _LARGE.items()]))


_OUT = ["q1", "q3", "lower_fence", "upper_fence", "outlier_pct"]

for _view in ("d_lineitem", "d_orders", "events", "d_customer"):
    @query(f"iqr_outliers_{_view.removeprefix('d_')}", sql.with_views(
        'SELECT "column", q1, q3, lower_fence, upper_fence, row_count, outlier_count, '
        'outlier_pct, outlier_pct > 5 AS "warning" FROM outl',
        sql.outliers_cte({"x": _view})), _OUT)
    def _(s, view=_view):
        return stats.iqr_outliers(s.t(view))


@query("box_plot", sql.with_views(
    'SELECT "column", q1, q2 AS median, q3, lower_fence, upper_fence, lo AS "min", hi AS "max", '
    "outlier_count FROM outl", sql.outliers_cte({"x": "d_lineitem"})),
    ["q1", "median", "q3", "lower_fence", "upper_fence", "min", "max"])
def _(s):
    return stats.box_plot(s.t("d_lineitem"))


@query("outlier_points", sql.with_views(
    'SELECT event_id, \'value\' AS "column", "value", lower_fence, upper_fence, true AS '
    'is_outlier FROM events, outl WHERE outl."column" = \'value\' AND '
    '("value" < lower_fence OR "value" > upper_fence)', sql.outliers_cte({"x": "events"})),
    ["lower_fence", "upper_fence", "value"])
def _(s):
    return stats.outlier_points(s.t("events"), "event_id", ["value"])


def _correlation(view: str) -> str:
    names = _numeric(view)
    return sql.union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, " + (
        "1.0" if a == b else f"corr({a}, {b})") + f" AS correlation FROM {view}" + (
        " LIMIT 1" if False else "") + " HAVING count(*) > 0" for a in names for b in names])


_WIDE = {f"c{i}": f"cast(l_quantity * {i % 4} + l_tax * {i * 100} + l_extendedprice * {i % 3} "
         "/ 1000 AS double)" for i in range(1, 13)}


@query("correlation_wide", sql.with_views(
    sql.union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
               + ("1.0" if a == b else f"corr({a}, {b})") + " AS correlation FROM wide"
               for a in _WIDE for b in _WIDE]).replace(" FROM wide", " FROM wide HAVING count(*) > 0"),
    "wide AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)"),
    ["correlation"])
def _(s):
    return stats.correlation_matrix(s.t("lineitem").selectExpr(
        *[f"{e} AS {c}" for c, e in _WIDE.items()]))


for _view in ("d_lineitem", "d_orders"):
    @query(f"correlation_{_view.removeprefix('d_')}", sql.with_views(_correlation(_view)),
           ["correlation"])
    def _(s, view=_view):
        return stats.correlation_matrix(s.t(view))


# ====================================================================================
# Relationships
# ====================================================================================

KEYS4 = "child_table, child_column, parent_table, parent_column"
_card_stats = sql.fk_stats_cte(CARD_FKS, CARD_TABLES)


@query("fk_cardinality", sql.with_views(
    f"""SELECT {KEYS4}, child_rows, child_distinct, child_max_freq, parent_rows, parent_distinct,
    CASE WHEN child_rows = 0 OR parent_rows = 0 THEN 'one-to-many'
      WHEN child_distinct = child_rows AND child_max_freq = 1 THEN 'one-to-one'
      WHEN parent_distinct < parent_rows AND child_max_freq > 1 THEN 'many-to-many'
      ELSE 'one-to-many' END AS cardinality FROM fkstats""",
    sql.fk_stats_cte([*CARD_FKS, rel.ForeignKey("labels", "doc_id", "documents", "doc_id")],
                     CARD_TABLES)))
def _(s):
    tables = {**s.card_tables(), **s.tables(["documents"])}
    return rel.cardinality(rel.relationship_stats(
        tables, [*CARD_FKS, rel.ForeignKey("labels", "doc_id", "documents", "doc_id")]))


@query("orphan_count_orders", sql.with_views(
    "SELECT count(*) AS orphaned_count FROM d_orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)"))
def _(s):
    return rel.orphan_count(s.t("d_orders"), "o_custkey", s.t("customer"), "c_custkey")


@query("orphan_count_null_parent", sql.with_views(
    "SELECT count(*) AS orphaned_count FROM d_orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM d_customer c WHERE c.c_custkey = o.o_custkey)"))
def _(s):
    return rel.orphan_count(s.t("d_orders"), "o_custkey", s.t("d_customer"), "c_custkey")


@query("orphan_rows", sql.with_views(
    "SELECT o_orderkey, o_custkey FROM d_orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM d_customer c WHERE c.c_custkey = o.o_custkey)"))
def _(s):
    return rel.orphans(s.t("d_orders"), "o_custkey", s.t("d_customer"), "c_custkey").select(
        "o_orderkey", "o_custkey")


@query("fk_integrity", sql.with_views(
    f"SELECT {KEYS4}, total_fk_values, orphaned_count, integrity_pct, inferred, "
    "integrity_pct < 99 AS breach FROM fkstats", _card_stats), ["integrity_pct"])
def _(s):
    return rel.fk_integrity(s.card_tables(), CARD_FKS)


@query("fk_integrity_decimal", """WITH c AS (SELECT o_custkey::decimal(20,2) AS a,
    o_custkey::decimal(25,4) + 0.5 * (o_orderkey % 2) AS b FROM orders),
    p AS (SELECT c_custkey AS k, c_custkey::decimal(12,1) AS d FROM customer)
    SELECT 'a' AS child_column, 'k' AS parent_column, count(*) AS total_fk_values,
      count_if(a NOT IN (SELECT k FROM p)) AS orphaned_count FROM c
    UNION ALL SELECT 'b', 'd', count(*), count_if(b NOT IN (SELECT d FROM p)) FROM c""")
def _(s):
    tables = {"c": s.t("orders").selectExpr(
        "cast(o_custkey AS decimal(20,2)) AS a",
        "cast(cast(o_custkey AS decimal(20,4)) + 0.5 * (o_orderkey % 2) AS decimal(25,4)) AS b"),
        "p": s.t("customer").selectExpr("c_custkey AS k", "cast(c_custkey AS decimal(12,1)) AS d")}
    fks = [rel.ForeignKey("c", "a", "p", "k"), rel.ForeignKey("c", "b", "p", "d")]
    return rel.fk_integrity(tables, fks).select("child_column", "parent_column", "total_fk_values", "orphaned_count")


@query("fk_integrity_large_keys", """SELECT count(*) AS total_fk_values,
    count_if(o_custkey % 2 = 1) AS orphaned_count FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def _(s):
    # children around 2^53 + 1 are neighbours of the doubles that the parents hold
    known = s.t("orders").join(s.t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    tables = {"c": known.selectExpr("9007199254740992L + o_custkey AS k"),
              "p": s.t("customer").where("c_custkey % 2 = 0").selectExpr(
                  "cast(9007199254740992L + c_custkey AS double) AS k")}
    return rel.fk_integrity(tables, [rel.ForeignKey("c", "k", "p", "k")]).select(
        "total_fk_values", "orphaned_count")


@query("fk_integrity_decimal38", """WITH c AS (SELECT o_custkey + 0.5 * (o_orderkey % 3) AS a, o_custkey AS b FROM orders)
    SELECT 'a' AS child_column, 'wide' AS parent_column, count(*) AS total_fk_values,
      count_if(a NOT IN (SELECT c_custkey FROM customer)) AS orphaned_count FROM c
    UNION ALL SELECT 'b', 'wide', count(*), count_if(b NOT IN (SELECT c_custkey FROM customer)) FROM c
    UNION ALL SELECT 'b', 'fine', count(*), count_if(b NOT IN (SELECT c_custkey FROM customer)) FROM c
    UNION ALL SELECT 'a', 'd', count(*), count_if(a NOT IN (SELECT c_custkey FROM customer)) FROM c""")
def _(s):
    """Types that no decimal of 38 digits holds together, and decimals against doubles."""
    tables = {"c": s.t("orders").selectExpr(
        "cast(o_custkey + cast(0.5 AS decimal(2,1)) * (o_orderkey % 3) AS decimal(38,10)) AS a",
        "cast(o_custkey AS decimal(38,0)) AS b"),
        "p": s.t("customer").selectExpr(
            "cast(c_custkey AS decimal(38,0)) AS wide", "cast(c_custkey AS decimal(38,30)) AS fine",
            "cast(c_custkey AS double) AS d")}
    fks = [rel.ForeignKey("c", a, "p", b) for a, b in (("a", "wide"), ("b", "wide"), ("b", "fine"), ("a", "d"))]
    return rel.fk_integrity(tables, fks).select("child_column", "parent_column", "total_fk_values", "orphaned_count")


@query("fk_integrity_by_table", sql.with_views(
    'SELECT "table", coalesce(avg(integrity_pct), 100.0) AS fk_integrity FROM (SELECT DISTINCT '
    '"table" FROM nulls) n LEFT JOIN fkstats f ON f.child_table = n."table" GROUP BY "table"',
    sql.nulls_cte(CARD_TABLES), _card_stats), ["fk_integrity"])
def _(s):
    tables = s.card_tables()
    return rel.table_integrity(rel.fk_integrity(tables, CARD_FKS), prof.row_counts(tables))


@query("avg_fk_integrity", sql.with_views(
    "SELECT avg(integrity_pct) AS avg_fk_integrity, count(*) AS fk_count FROM fkstats",
    _card_stats), ["avg_fk_integrity"])
def _(s):
    return rel.average_integrity(rel.fk_integrity(s.card_tables(), CARD_FKS))


_PROPOSED = [*DECLARED, BY_NAME, *WRONG]
_proposed_stats = sql.fk_stats_cte(_PROPOSED)


@query("validate_fks", sql.with_views(
    f"SELECT {KEYS4}, total_fk_values, orphaned_count, orphaned_count = 0 AS valid FROM fkstats "
    "WHERE total_fk_values > 0", _proposed_stats))
def _(s):
    return rel.check_fks(rel.relationship_stats(s.tables(), _PROPOSED))


@query("validate_fks_failed", sql.with_views(
    f"SELECT {KEYS4}, orphaned_count || ' rows without a parent' AS error FROM fkstats "
    "WHERE total_fk_values > 0 AND orphaned_count > 0", _proposed_stats))
def _(s):
    return rel.failed_fks(rel.check_fks(rel.relationship_stats(s.tables(), _PROPOSED)))


@query("join_coverage", sql.with_views(
    f"""SELECT {KEYS4}, child_distinct, parent_distinct, matched_distinct,
    child_distinct - matched_distinct AS child_only,
    parent_distinct - matched_distinct AS parent_only,
    CASE WHEN child_distinct > 0 THEN matched_distinct * 100.0::double / child_distinct END
      AS child_coverage_pct,
    CASE WHEN parent_distinct > 0 THEN matched_distinct * 100.0::double / parent_distinct END
      AS parent_coverage_pct FROM fkstats""", _card_stats),
    ["child_coverage_pct", "parent_coverage_pct"])
def _(s):
    return rel.join_coverage(rel.relationship_stats(s.card_tables(), CARD_FKS))


# --- discovery -------------------------------------------------------------------

_FAMILIES = {"int": "integral", "bigint": "integral", "string": "text",
             "timestamp_ntz": "timestamp"}
_SQL_TYPES = {"integral": "bigint", "text": "varchar", "timestamp": "timestamp"}


def _discovered() -> str:
    pairs = []
    for kind in ("integral", "text", "timestamp"):
        values = sql.union([
            f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::{_SQL_TYPES[kind]} AS v FROM {t} "
            f"WHERE {c} IS NOT NULL" for t, columns in SCHEMA.items() for c, ty in columns
            if _FAMILIES.get(ty) == kind])
        pairs.append(
            f"SELECT l.t AS child_table, l.c AS child_column, r.t AS parent_table, "
            "r.c AS parent_column, count(*) AS common, any_value(n) AS child_distinct FROM "
            f"({values}) l JOIN ({values}) r ON l.v = r.v AND NOT (l.t = r.t AND l.c = r.c) "
            f"JOIN (SELECT t, c, count(*) AS n FROM ({values}) GROUP BY t, c) d "
            "ON d.t = l.t AND d.c = l.c GROUP BY ALL HAVING count(*) = any_value(n)")
    return sql.union(pairs)


_sim = ("1.0 - levenshtein(lower(child_column), lower(parent_column))::double / "
        "greatest(length(child_column), length(parent_column))")


@query("discover_fks", sql.with_views(
    f"""SELECT {KEYS4}, child_distinct, row_count AS parent_distinct, {_sim} AS similarity,
    child_distinct * 100.0::double / row_count AS coverage_pct,
    cast(row_number() OVER (PARTITION BY child_table, child_column ORDER BY {_sim} DESC,
      child_distinct * 100.0::double / row_count DESC, parent_table, parent_column) AS integer)
      AS rank
    FROM incl JOIN cand ON cand."table" = parent_table AND cand."column" = parent_column
    WHERE child_table <> parent_table""", *CATALOG[:4], f"incl AS ({_discovered()})"),
    ["similarity", "coverage_pct"])
def _(s):
    tables = s.tables()
    return disc.discover_fks(tables)


_MIXED = {"a": "SELECT DISTINCT o_custkey::varchar AS v FROM orders WHERE o_custkey IS NOT NULL",
          "b": "SELECT DISTINCT c_custkey::varchar AS v FROM customer",
          "w": "SELECT DISTINCT l_orderkey::varchar || repeat('0', 20) AS v FROM lineitem",
          "f": "SELECT DISTINCT rtrim(rtrim(l_tax::decimal(38,18)::varchar, '0'), '.') AS v FROM lineitem",
          "h": "SELECT DISTINCT rtrim(rtrim((c_custkey::decimal(18,4) / 2)::decimal(20,6)::varchar, '0'), '.') AS v FROM customer"}


@query("discover_fks_mixed_types", "WITH " + ", ".join(f"{t} AS ({e})" for t, e in _MIXED.items())
       + ", pairs AS (" + sql.union([
           f"SELECT '{x}' AS child_table, '{y}' AS parent_table, (SELECT count(*) FROM {x}) AS child_distinct, "
           f"(SELECT count(*) FROM {x} WHERE v IN (SELECT v FROM {y})) AS common"
           for x in _MIXED for y in ("b", "h") if x != y])
       + ") SELECT child_table, 'k' AS child_column, parent_table, 'k' AS parent_column, child_distinct "
         "FROM pairs WHERE common = child_distinct")
def _(s):
    """Keys of several exact types; w and f need more than 38 digits between them."""
    lines, customers = s.t("lineitem"), s.t("customer")
    tables = {"a": s.t("orders").selectExpr("cast(o_custkey AS decimal(12,2)) AS k"),
              "b": customers.selectExpr("c_custkey AS k"),
              "w": lines.selectExpr("cast(concat(l_orderkey, repeat('0', 20)) AS decimal(38,0)) AS k"),
              "f": lines.selectExpr("cast(l_tax AS decimal(38,18)) AS k"),
              "h": customers.selectExpr("cast(cast(c_custkey AS decimal(18,4)) / 2 AS decimal(20,6)) AS k")}
    return disc.discover_fks(tables).select(*rel.FK_COLUMNS, "child_distinct")


@query("candidate_keys", sql.with_views(
    'SELECT "table", "column", ordinal, row_count FROM cand', *CATALOG[:4]))
def _(s):
    return disc.candidate_keys(prof.column_profile(s.tables()))


@query("propose_primary_keys", sql.with_views('SELECT "table", "column" FROM pk', *CATALOG[:5]))
def _(s):
    return disc.propose_primary_keys(disc.candidate_keys(prof.column_profile(s.tables())))


_PAIRS = {"conversations": [("conv_id", "turn"), ("conv_id", "role")],
          "lineitem": [("l_orderkey", "l_linenumber")], "d_customer": [("c_custkey", "c_name")]}


@query("composite_keys", sql.with_views(sql.union([
    f"SELECT '{t}' AS \"table\", '{a},{b}' AS \"columns\", (SELECT count(*) FROM {t}) AS "
    f"row_count, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) AS distinct_count, "
    f"(SELECT count(*) FROM {t}) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t} WHERE "
    f"{a} IS NOT NULL AND {b} IS NOT NULL)) AS is_key" for t, ps in _PAIRS.items()
    for a, b in ps])))
def _(s):
    return disc.composite_keys(s.tables(list(_PAIRS)), _PAIRS)


# --- graph -----------------------------------------------------------------------

_GRAPH = [*CATALOG, *sql.GRAPH_CTES]


@query("graph_metrics", sql.with_views(
    """SELECT (SELECT count(*) FROM tabs) AS total_nodes, (SELECT count(*) FROM edge) AS
    total_edges, (SELECT count(DISTINCT component) FROM comp) AS connected_components,
    (SELECT count(DISTINCT component) FROM comp) = 1 AS is_connected,
    round((SELECT count(*) FROM edge)::double / ((SELECT count(*) FROM tabs)
      * ((SELECT count(*) FROM tabs) - 1)), 4) AS density,
    (SELECT node FROM deg ORDER BY centrality DESC, node LIMIT 1) AS hub_table,
    (SELECT round(max(centrality), 4) FROM deg) AS hub_degree""", *_GRAPH),
    ["density", "hub_degree"])
def _(s):
    return graph.graph_metrics(s.nodes(), s.edges())


@query("components", sql.with_views("SELECT node, component FROM comp", *_GRAPH))
def _(s):
    return graph.connected_components(s.nodes(), s.edges())


@query("degree_centrality", sql.with_views("SELECT node, degree, centrality FROM deg", *_GRAPH),
       ["centrality"])
def _(s):
    return graph.degree_centrality(s.nodes(), s.edges())


@query("isolated_tables", sql.with_views(
    'SELECT "table" AS node FROM tabs WHERE "table" NOT IN (SELECT src FROM edge) AND "table" '
    "NOT IN (SELECT dst FROM edge)", *_GRAPH))
def _(s):
    return graph.isolated(s.nodes(), s.edges())


_BETWEEN = [
    *_GRAPH,
    "core AS (SELECT node FROM comp WHERE component = (SELECT component FROM comp "
    "WHERE node = 'lineitem'))",
    """walk AS (SELECT node AS s, node AS v, 0 AS dist, [node] AS path FROM core UNION ALL
  SELECT w.s, u.dst, w.dist + 1, list_append(w.path, u.dst) FROM walk w JOIN und u
  ON u.src = w.v WHERE NOT list_contains(w.path, u.dst))""",
    "near AS (SELECT s, v, min(dist) AS dist FROM walk GROUP BY s, v)",
    "short AS (SELECT w.s, w.v, w.path FROM walk w JOIN near n USING (s, v, dist) WHERE w.s <> w.v)",
    "total AS (SELECT s, v, count(*) AS paths FROM short GROUP BY s, v)",
    """share AS (SELECT x.node, count(*) / any_value(t.paths)::double AS part
  FROM (SELECT s, v, unnest(path) AS node FROM short) x JOIN total t USING (s, v)
  WHERE x.node <> x.s AND x.node <> x.v GROUP BY x.node, x.s, x.v)""",
]


@query("betweenness", sql.with_views(
    """SELECT node, coalesce(sum(part), 0) / (((SELECT count(*) FROM core) - 1)
    * ((SELECT count(*) FROM core) - 2))::double AS betweenness
    FROM core LEFT JOIN share USING (node) GROUP BY node""", *_BETWEEN), ["betweenness"])
def _(s):
    parts = graph.connected_components(s.nodes(), s.edges())
    home = parts.where("node = 'lineitem'").select("component")
    core = parts.join(home, "component", "left_semi").select("node")
    edges = s.edges().join(core, F.col("src") == F.col("node"), "left_semi")
    return graph.betweenness(core, edges)


# ====================================================================================
# Catalog
# ====================================================================================

@query("catalog_columns", sql.with_views(
    'SELECT "table", ordinal, "column", type, nullable, primary_key, "unique", '
    "cast(NULL AS varchar) AS default_value FROM cols", *CATALOG[:6]))
def _(s):
    return s.catalog().columns


def _stored(s: Source) -> store.StoredCatalog:
    """The catalog measured, saved, and read back."""
    def build():
        tables = s.tables()
        profile = prof.column_profile(tables)
        keys = disc.candidate_keys(profile)
        return cat.extract_catalog(tables, disc.propose_primary_keys(keys), s.fks(), keys, profile), profile

    return store.stored_catalog(s.spark, scratch_path(s.spark, "catalog"), s.sf_dir, build)


@query("stored_catalog_columns", sql.with_views(
    'SELECT "table", ordinal, "column", type, nullable, primary_key, "unique", '
    "cast(NULL AS varchar) AS default_value FROM cols", *CATALOG[:6]))
def _(s):
    return _stored(s).catalog.columns


@query("stored_catalog_profile", sql.with_views(
    """SELECT p."table", p.ordinal, p."column", p.type, p.row_count, p.null_count, p.distinct_count, p.status,
    c.primary_key FROM prof p JOIN cols c USING ("table", "column")""", *CATALOG[:6]))
def _(s):
    found = _stored(s)
    return found.profile.join(found.catalog.columns.select("table", "ordinal", "primary_key"), [
        "table", "ordinal"]).select("table", "ordinal", "column", "type", "row_count", "null_count",
                                    "distinct_count", "status", "primary_key")


# three loads of two tables, profiled one by one; distinct counts within 2.5 % of the exact ones
_LOADS = {"orders": ("d_orders", "o_orderkey"), "lineitem": ("d_lineitem", "l_orderkey")}


@query("profile_by_parts", sql.with_views(sql.union([
    f"SELECT '{t}' AS \"table\", {i} AS ordinal, '{c}' AS \"column\", count(*) AS row_count, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_exact, true AS near FROM {v}"
    for t, (v, _) in _LOADS.items() for i, (c, _) in enumerate(data.view_columns(v), start=1)])))
def _(s):
    path = scratch_path(s.spark, "profile")
    for part in range(3):
        store.write_profile_part({t: s.t(v).where(f"{k} % 3 = {part}") for t, (v, k) in _LOADS.items()},
                                 path, f"load{part}")
    exact = prof.distinct_counts({t: s.t(v) for t, (v, _) in _LOADS.items()}).withColumnRenamed(
        "distinct_count", "distinct_exact")
    off = F.abs(F.col("distinct_count") - F.col("distinct_exact"))
    return store.read_profile(s.spark, path).join(exact, ["table", "column"]).select(
        "table", "ordinal", "column", "row_count", "null_count", "distinct_exact",
        (off <= F.col("distinct_exact") * 0.025).alias("near"))


@query("catalog_tables", sql.with_views(
    'SELECT "table", position, row_count, column_count FROM tabs', *CATALOG))
def _(s):
    return s.light_catalog().tables


@query("catalog_totals", sql.with_views(
    """SELECT count(*) AS total_tables, cast(sum(column_count) AS bigint) AS total_columns,
    cast(sum(row_count) AS bigint) AS total_rows FROM tabs""", *CATALOG))
def _(s):
    return cat.catalog_totals(s.light_catalog().tables)


_LABEL = """CASE WHEN bool_or(inferred) AND bool_or(NOT inferred) THEN 'mixed'
    WHEN bool_or(inferred) THEN 'inferred' ELSE 'explicit' END"""


@query("catalog_meta", sql.with_views(
    f"""SELECT 'testdata' AS database_name, 'parquet' AS input_type, count(*) AS total_tables,
    cast(sum(column_count) AS bigint) AS total_columns, cast(sum(row_count) AS bigint) AS
    total_rows, (SELECT {_LABEL} FROM fks) AS fk_source,
    TIMESTAMP '2002-01-01 00:00:00' AS extraction_timestamp FROM tabs""", *CATALOG))
def _(s):
    return cat.catalog_meta(s.light_catalog(), "testdata", "parquet", AS_OF["*"])


@query("fk_source_label", sql.with_views(f"SELECT {_LABEL} AS fk_source FROM fks", *CATALOG))
def _(s):
    return cat.fk_source_label(s.fks())


@query("infer_fks_by_name", sql.with_views(
    f"""SELECT {KEYS4}, inferred, (SELECT count(doc_id) FROM labels) AS total_fk_values,
    (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d
      WHERE d.doc_id = l.doc_id)) AS orphaned_count FROM byname""", *CATALOG))
def _(s):
    found = rel.fk_list(s.fks_by_name())
    return rel.relationship_stats(s.tables(), found).select(
        *rel.FK_COLUMNS, "inferred", "total_fk_values", "orphaned_count")


@query("merge_fks", sql.with_views(f"SELECT {KEYS4}, inferred FROM fks", *CATALOG))
def _(s):
    return s.fks()


_MEASURED = [*CATALOG, sql.fk_stats_cte([*DECLARED, BY_NAME], name="cardstats"),
             """edgecard AS (SELECT f.*, CASE WHEN child_rows = 0 OR parent_rows = 0 THEN
  'one-to-many' WHEN child_distinct = child_rows AND child_max_freq = 1 THEN 'one-to-one'
  WHEN parent_distinct < parent_rows AND child_max_freq > 1 THEN 'many-to-many'
  ELSE 'one-to-many' END AS cardinality FROM fks f JOIN cardstats c
  USING (child_table, child_column, parent_table, parent_column))"""]


@query("relationships", sql.with_views(
    """SELECT child_table AS from_table, child_column AS from_column, parent_table AS to_table,
    parent_column AS to_column, inferred, cardinality FROM edgecard""", *_MEASURED))
def _(s):
    measured = rel.cardinality(rel.relationship_stats(s.tables(), [*DECLARED, BY_NAME]))
    return cat.relationships(s.fks(), measured)


_ROLE_COUNTS = """rolecount AS (SELECT t."table", row_count, column_count,
  (SELECT count(*) FROM fks f WHERE f.child_table = t."table") AS fks_out,
  EXISTS (SELECT 1 FROM fks f WHERE f.parent_table = t."table" AND f.child_table <> t."table")
  AS referenced FROM tabs t)"""


@query("table_roles", sql.with_views(
    """SELECT *, CASE WHEN fks_out = 0 AND NOT referenced THEN 'isolated'
    WHEN fks_out = 2 AND column_count <= 4 THEN 'junction' WHEN fks_out >= 2 THEN 'fact'
    ELSE 'dimension' END AS role FROM rolecount""", *CATALOG, _ROLE_COUNTS))
def _(s):
    return cat.table_roles(s.light_catalog())


@query("table_roles_app", sql.with_views(
    """SELECT *, CASE WHEN fks_out = 0 AND NOT referenced THEN 'isolated'
    WHEN fks_out >= 2 THEN 'fact' WHEN referenced THEN 'dimension' ELSE 'referring' END AS role
    FROM rolecount""", *CATALOG, _ROLE_COUNTS))
def _(s):
    return cat.table_roles(s.light_catalog(), "app")


# anomalies look at the defect views, where there is something to find
_ANOMALY_VIEWS = {**ALL, "orders": "d_orders", "customer": "d_customer", "empty": "d_empty"}
_ANOMALY_CTES = [
    *sql.profile_ctes(_ANOMALY_VIEWS), CATALOG[3], CATALOG[4],
    """acols AS (SELECT n."table", n.ordinal, n."column", pk."column" IS NOT NULL AS primary_key
  FROM nulls n LEFT JOIN pk ON pk."table" = n."table" AND pk."column" = n."column")""",
    f"""found AS (
  SELECT DISTINCT 'warning' AS severity, 'EMPTY_TABLE' AS code, "table", cast(NULL AS varchar)
    AS "column", 'table ' || "table" || ' has 0 rows' AS message FROM nulls WHERE row_count = 0
  UNION ALL SELECT DISTINCT 'error', 'NO_PRIMARY_KEY', "table", NULL, 'table ' || "table" ||
    ' has no primary key' FROM acols WHERE "table" NOT IN (SELECT "table" FROM pk)
  UNION ALL SELECT 'info', 'AMBIGUOUS_NAME', "table", "column", 'column ' || "column" || ' in ' ||
    "table" || ' has an ambiguous name' FROM acols WHERE lower("column") IN
    ('id', 'data', 'value', 'info', 'name', 'type', 'status', 'code', 'key', 'flag', 'desc',
     'text', 'note', 'temp')
  UNION ALL SELECT 'error', 'DUPLICATE_COLUMN', "table", "column", 'duplicate column ' ||
    "column" || ' in ' || "table" FROM (SELECT *, row_number() OVER (PARTITION BY "table",
    lower("column") ORDER BY ordinal) AS nth FROM acols) WHERE nth > 1
  UNION ALL SELECT 'warning', 'ORPHAN_FK_COLUMN', "table", "column", 'column ' || "column" ||
    ' in ' || "table" || ' looks like a foreign key but has no constraint' FROM acols
    WHERE "column" LIKE '%\\_id' ESCAPE '\\' AND NOT primary_key
    AND NOT ("table" = 'labels' AND "column" = 'doc_id')
  UNION ALL SELECT 'warning', 'ALL_NULL_COLUMN', "table", "column", 'column ' || "column" ||
    ' in ' || "table" || ' is entirely NULL' FROM nulls WHERE row_count > 0
    AND null_count = row_count)""",
]


def _anomaly_catalog(s: Source):
    tables = s.tables(_ANOMALY_VIEWS)
    profile = prof.column_profile(tables)
    primary = disc.propose_primary_keys(disc.candidate_keys(profile))
    fks = rel.fk_relation(s.spark, [*DECLARED, BY_NAME])
    return cat.extract_catalog(tables, primary, fks), profile


@query("anomalies", sql.with_views("SELECT * FROM found", *_ANOMALY_CTES))
def _(s):
    return cat.anomalies(*_anomaly_catalog(s))


# customers beside the account they were copied from: names that repeat exactly and in case
_TWIN_NAMES = ["c_custkey", "c_nationkey", "C_CUSTKEY", "c_acctbal", "c_nationkey", "gone"]
_TWINS_SQL = """t AS (SELECT c_custkey AS x1, c_nationkey AS x2, c_custkey % 7 AS x3, c_acctbal AS x4,
    CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS x5, cast(NULL AS varchar) AS x6 FROM customer)"""


def _twins(s: Source):
    return s.t("customer").selectExpr("c_custkey", "c_nationkey", "c_custkey % 7 AS b", "c_acctbal",
                                      "CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS d",
                                      "cast(NULL AS string) AS gone").toDF(*_TWIN_NAMES)


@query("column_profile_duplicate_columns", f"WITH {_TWINS_SQL} " + sql.union([
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) AS row_count, count(*) - count(x{i}) AS null_count, "
    f"count(DISTINCT x{i}) AS distinct_count FROM t" for i, c in enumerate(_TWIN_NAMES, start=1)]))
def _(s):
    return prof.column_profile({"twins": _twins(s)}).select(
        "ordinal", "column", "row_count", "null_count", "distinct_count")


@query("null_profile_duplicate_columns", f"WITH {_TWINS_SQL} " + sql.union([
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) AS row_count, count(*) - count(x{i}) AS null_count "
    "FROM t" for i, c in enumerate(_TWIN_NAMES, start=1)]))
def _(s):
    return prof.null_profile({"twins": _twins(s)}).select("ordinal", "column", "row_count", "null_count")


@query("anomalies_duplicate_columns", f"""WITH {_TWINS_SQL}
    SELECT 'error' AS severity, 'DUPLICATE_COLUMN' AS code, 'twins' AS "table", c AS "column",
      'duplicate column ' || c || ' in twins' AS message FROM (VALUES ('C_CUSTKEY'), ('c_nationkey')) v(c)
    UNION ALL SELECT 'warning', 'ALL_NULL_COLUMN', 'twins', 'gone', 'column gone in twins is entirely NULL'
      FROM t HAVING count(*) > 0 AND count(x6) = 0
    UNION ALL SELECT 'error', 'NO_PRIMARY_KEY', 'twins', NULL, 'table twins has no primary key'
      FROM t HAVING count(*) <> count(DISTINCT x1)""")
def _(s):
    tables = {"twins": _twins(s)}
    profile = prof.column_profile(tables)
    keys = disc.candidate_keys(profile)
    catalog = cat.extract_catalog(tables, disc.propose_primary_keys(keys), rel.fk_relation(s.spark, []), keys,
                                  profile)
    return cat.anomalies(catalog, profile)


@query("schema_stats", sql.with_views(
    """SELECT (SELECT count(*) FROM pk) AS total_pks, 8::bigint AS total_fks,
    1::bigint AS total_inferred_fks, (SELECT count(*) FROM found) AS total_anomalies,
    (SELECT count(DISTINCT "table") FROM found) AS tables_with_anomalies""", *_ANOMALY_CTES))
def _(s):
    catalog, profile = _anomaly_catalog(s)
    return cat.schema_stats(catalog, cat.anomalies(catalog, profile))


@query("search_tables", sql.with_views(
    "SELECT \"table\", position, row_count, column_count FROM tabs WHERE contains(lower(\"table\"), "
    "'ion')", *CATALOG))
def _(s):
    return cat.search_tables(s.light_catalog().tables, "ION")


@query("neighbours", sql.with_views(
    """SELECT DISTINCT neighbour FROM (SELECT parent_table AS neighbour FROM fks WHERE child_table
    = 'orders' UNION ALL SELECT child_table FROM fks WHERE parent_table = 'orders')""", *CATALOG))
def _(s):
    return cat.neighbours(s.fks(), "orders")


@query("neighbourhood", sql.with_views(
    """SELECT "table", ordinal, "column", type FROM cols WHERE "table" = 'nation' OR "table" IN
    (SELECT parent_table FROM fks WHERE child_table = 'nation' UNION ALL
     SELECT child_table FROM fks WHERE parent_table = 'nation')""", *CATALOG))
def _(s):
    return cat.neighbourhood(s.light_catalog(), "nation").select("table", "ordinal", "column",
                                                                 "type")


@query("in_out_degree", sql.with_views(
    """SELECT "table", (SELECT count(*) FROM fks WHERE child_table = t."table") AS fks_out,
    (SELECT count(*) FROM fks WHERE parent_table = t."table") AS fks_in FROM tabs t""", *CATALOG))
def _(s):
    return cat.in_out_degree(s.light_catalog())


@query("in_out_edges", sql.with_views(
    f"""SELECT 'out' AS direction, {KEYS4} FROM fks WHERE child_table = 'orders' UNION ALL
    SELECT 'in', {KEYS4} FROM fks WHERE parent_table = 'orders'""", *CATALOG))
def _(s):
    fks = s.fks()
    return cat.outgoing(fks, "orders").select(F.lit("out").alias("direction"), *rel.FK_COLUMNS
                                              ).union(
        cat.incoming(fks, "orders").select(F.lit("in"), *rel.FK_COLUMNS))


@query("weak_entities", sql.with_views(
    """SELECT pk."table", count(*) AS key_columns FROM pk LEFT JOIN (SELECT DISTINCT child_table,
    child_column FROM fks) f ON f.child_table = pk."table" AND f.child_column = pk."column"
    GROUP BY pk."table" HAVING count(f.child_table) = count(*)""", *CATALOG))
def _(s):
    return cat.weak_entities(s.catalog())


@query("participation", sql.with_views(
    f"""SELECT {KEYS4}, CASE WHEN c.nullable THEN 'partial' ELSE 'total' END AS participation
    FROM fks f JOIN cols c ON c."table" = f.child_table AND c."column" = f.child_column""",
    *CATALOG))
def _(s):
    return cat.participation(s.catalog())


@query("participation_defects", sql.with_views(
    f"""SELECT {KEYS4}, CASE WHEN total_fk_values < child_rows THEN 'partial' ELSE 'total' END
    AS participation FROM fkstats""", _card_stats))
def _(s):
    tables = s.card_tables()
    columns = cat.observed_nullability(cat.extract_columns(tables), prof.null_profile(tables))
    return cat.participation(cat.Catalog(cat.extract_tables(tables), columns,
                                         rel.fk_relation(s.spark, CARD_FKS)))


@query("columns_with_fk", sql.with_views(
    """SELECT c."table", ordinal, c."column", type, primary_key, nullable, "unique",
    coalesce(f.parent_table || '.' || f.parent_column, '') AS fk_target,
    CASE WHEN f.child_table IS NULL THEN '' WHEN f.inferred THEN 'inferred' ELSE 'explicit' END
    AS fk_kind FROM cols c LEFT JOIN fks f ON f.child_table = c."table"
    AND f.child_column = c."column" """, *CATALOG))
def _(s):
    return cat.columns_with_fk(s.catalog())


@query("key_columns", sql.with_views(
    """SELECT "table", ordinal, "column", replace(type, ' ', '_') AS type, CASE WHEN primary_key
    THEN 'PK' ELSE 'FK' END AS marker FROM cols c WHERE primary_key OR EXISTS (SELECT 1 FROM fks f
    WHERE f.child_table = c."table" AND f.child_column = c."column")""", *CATALOG))
def _(s):
    return cat.key_columns(s.catalog())


@query("er_edges", sql.with_views(
    """SELECT child_table AS from_node, parent_table AS to_node, min(child_column) AS from_column,
    CASE arg_min(cardinality, child_column) WHEN 'one-to-one' THEN '||--||'
      WHEN 'many-to-many' THEN '}o--o{' ELSE '||--o{' END AS symbol,
    array_to_string(list_transform(string_split(replace(replace(min(child_column), '_id', ''),
      '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
    FROM edgecard GROUP BY child_table, parent_table""", *_MEASURED))
def _(s):
    measured = rel.cardinality(rel.relationship_stats(s.tables(), [*DECLARED, BY_NAME]))
    return cat.er_edges(cat.relationships(s.fks(), measured))


def _samples() -> str:
    rows = []
    for t in ORDER_KEYS:
        order = ", ".join(ORDER_KEYS[t])
        for c, ty in SCHEMA[t]:
            if ty.startswith("array"):  # floats are written differently by the two engines
                continue
            rows.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", string_agg(v, ' | ' ORDER BY rn) "
                f"AS samples FROM (SELECT left(cast({c} AS varchar), 50) AS v, row_number() OVER "
                f"(ORDER BY {order}) AS rn FROM {t} WHERE {c} IS NOT NULL) "
                "WHERE rn <= 3")
    return sql.union(rows)


@query("column_dictionary", sql.with_views(
    """SELECT c."table", ordinal, c."column", type, nullable, primary_key,
    coalesce(f.parent_table || '.' || f.parent_column, '') AS fk_target,
    coalesce(s.samples, '') AS samples FROM cols c JOIN smp s USING ("table", "column")
    LEFT JOIN fks f ON f.child_table = c."table" AND f.child_column = c."column" """,
    *CATALOG, f"smp AS ({_samples()})"))
def _(s):
    catalog = s.catalog()
    wanted = s.tables(list(ORDER_KEYS))
    return cat.column_dictionary(
        cat.Catalog(catalog.tables.where(F.col("table").isin(*ORDER_KEYS)), catalog.columns,
                    catalog.fks), wanted, ORDER_KEYS).where("type not like 'array%'")


@query("dictionary_csv_roundtrip", sql.with_views(
    """SELECT c."table", ordinal, c."column", type, nullable, primary_key,
    f.parent_table || '.' || f.parent_column AS fk_target, nullif(s.samples, '') AS samples
    FROM cols c JOIN smp s USING ("table", "column")
    LEFT JOIN fks f ON f.child_table = c."table" AND f.child_column = c."column" """,
    *CATALOG, f"smp AS ({_samples()})"))
def _(s):
    """The dictionary written as a file and read back; empty cells are NULL there."""
    catalog = s.catalog()
    dictionary = cat.column_dictionary(
        cat.Catalog(catalog.tables.where(F.col("table").isin(*ORDER_KEYS)), catalog.columns, catalog.fks),
        s.tables(list(ORDER_KEYS)), ORDER_KEYS).where("type not like 'array%'")
    path = f"{scratch_path(s.spark, 'csv')}/dictionary.csv"
    writers.write_dictionary_csv(dictionary, path)
    text = readers.read_any(s.spark, path)["dictionary"]
    return text.withColumns({"ordinal": F.col("ordinal").cast("int"), "nullable": F.col("nullable").cast("boolean"),
                             "primary_key": F.col("primary_key").cast("boolean")})


@query("column_dictionary_defects", """WITH h AS (SELECT o_orderkey,
    CASE WHEN o_orderkey > 40 AND o_orderkey % 3 = 0 THEN o_orderpriority END AS late,
    CASE WHEN o_orderkey % 997 = 5 THEN o_orderstatus END AS rare FROM orders)
    SELECT 'late' AS "column", string_agg(v, ' | ' ORDER BY k) AS samples FROM
      (SELECT o_orderkey AS k, late AS v FROM h WHERE late IS NOT NULL ORDER BY k LIMIT 3)
    UNION ALL SELECT 'rare', string_agg(v, ' | ' ORDER BY k) FROM
      (SELECT o_orderkey AS k, rare AS v FROM h WHERE rare IS NOT NULL ORDER BY k LIMIT 3)
    UNION ALL SELECT 'o_orderkey', string_agg(v, ' | ' ORDER BY k) FROM
      (SELECT o_orderkey AS k, cast(o_orderkey AS varchar) AS v FROM h ORDER BY k LIMIT 3)""")
def _(s):
    holes = s.t("orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey > 40 AND o_orderkey % 3 = 0 THEN o_orderpriority END AS late",
        "CASE WHEN o_orderkey % 997 = 5 THEN o_orderstatus END AS rare")
    tables = {"holes": holes}
    catalog = cat.Catalog(cat.extract_tables(tables), cat.extract_columns(tables),
                          rel.fk_relation(s.spark, []))
    return cat.column_dictionary(catalog, tables, {"holes": ["o_orderkey"]}).select("column", "samples")


# many sparse columns: samples lie anywhere in the table, and all come from one scan
_SPARSE = {f"s{i:02d}": f"CASE WHEN l_orderkey % {211 + 7 * i} = {i} THEN l_extendedprice END" for i in range(24)}


@query("column_dictionary_sparse", f"WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       f"l_extendedprice, {', '.join(f'cast(cast({e} AS decimal(18, 2)) AS varchar) AS {c}' for c, e in _SPARSE.items())} "
       "FROM lineitem) " + sql.union([
           f"SELECT '{c}' AS \"column\", coalesce(string_agg(v, ' | ' ORDER BY rn), '') AS samples FROM (SELECT {c} AS v, "
           "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn "
           f"FROM h WHERE {c} IS NOT NULL) WHERE rn <= 3" for c in _SPARSE]))
def _(s):
    sparse = s.t("lineitem").selectExpr(*ORDER_KEYS["lineitem"], *[
        f"cast(cast({e} AS decimal(18, 2)) AS string) AS {c}" for c, e in _SPARSE.items()])
    tables = {"sparse": sparse}
    catalog = cat.Catalog(cat.extract_tables(tables), cat.extract_columns(tables), rel.fk_relation(s.spark, []))
    return cat.column_dictionary(catalog, tables, {"sparse": ORDER_KEYS["lineitem"]}).where(
        F.col("column").startswith("s")).select("column", "samples")


@query("sample_rows_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5", ["o_totalprice"])
def _(s):
    return cat.sample_rows(s.t("orders"), 5, ["o_orderkey"])


@query("sample_rows_json", sql.union([
    f"SELECT '{t}' AS \"table\", cast(row_number() OVER (ORDER BY {c}) AS integer) AS rn, "
    "'{' || " + " || ',' || ".join(
        f"'\"{n}\":' || " + (f"'\"' || {n} || '\"'" if ty == "string" else f"cast({n} AS varchar)")
        for n, ty in SCHEMA[t]) + f" || '}}' AS row_json FROM (SELECT * FROM {t} ORDER BY {c} LIMIT 5)"
    for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("part", "p_partkey"),
                 ("customer", "c_custkey"))]))
def _(s):
    return cat.sample_row_json(s.tables(["region", "nation", "part", "customer"]), ORDER_KEYS)


# ====================================================================================
# Types of text data
# ====================================================================================

_TEXT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_flag", "o_shipped"]
_LINE_TEXT = [f"cast({c} as string) as {c}" for c, _ in SCHEMA["lineitem"]]
_LINE_TEXT_CTE = "line_text AS (SELECT " + ", ".join(
    f"cast({c} AS varchar) AS {c}" for c, _ in SCHEMA["lineitem"]) + " FROM lineitem)"


def _inferred(view: str, columns, rule: str) -> str:
    return sql.union([
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, {rule} AS inferred_type FROM "
        f"(SELECT nullif({c}, '') AS v FROM {view})" for i, c in enumerate(columns, start=1)])


def _re(pattern: str) -> str:
    return f"regexp_matches(v, '{pattern}')"


# what the rules are expected to accept, stated apart from the library
_IS_NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_IS_ISO, _IS_SLASH = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}"
_IS_ISO_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}"
_IS_WHOLE, _IS_PLAIN, _IS_RECENT = r"^-?[0-9]+$", r"^-?[0-9]+[.]?[0-9]*$", r"^20[0-9]{2}-[0-9]{2}"


_STRICT = (f"CASE WHEN count(v) = 0 THEN 'TEXT' WHEN bool_and({_re(_IS_NUMBER)}) AND "
           f"bool_and(try_cast(v AS double) = floor(try_cast(v AS double))) THEN 'INTEGER' "
           f"WHEN bool_and({_re(_IS_NUMBER)}) THEN 'REAL' WHEN greatest("
           + ", ".join(f"avg({_re(p)}::integer)" for p in (_IS_ISO, _IS_SLASH, _IS_ISO_MOMENT))
           + ") > 0.8 THEN 'DATETIME' ELSE 'TEXT' END")
_REGEX = (f"CASE WHEN count(v) = 0 THEN 'TEXT' WHEN bool_and({_re(_IS_WHOLE)}) THEN "
          f"'INTEGER' WHEN bool_and({_re(_IS_PLAIN)}) THEN 'REAL' WHEN "
          f"avg({_re(_IS_ISO)}::integer) > 0.8 THEN 'DATETIME' ELSE 'TEXT' END")
_BOOL = ("CASE WHEN count(v) = 0 THEN 'VARCHAR(255)' WHEN bool_and(lower(v) IN ('0', '1', 'true', "
         f"'false')) THEN 'BOOLEAN' WHEN bool_and({_re(_IS_RECENT)} AND try_cast(v AS "
         f"timestamp) IS NOT NULL) THEN 'DATETIME' WHEN bool_and({_re(_IS_NUMBER)} AND NOT "
         f"contains(v, '.')) THEN 'INTEGER' WHEN bool_and({_re(_IS_NUMBER)}) THEN 'REAL' "
         "ELSE 'VARCHAR(255)' END")
_line_names = [c for c, _ in SCHEMA["lineitem"]]

for _mode, _key, _rule in (("strict", "strict", _STRICT), ("sample5", "bool", _BOOL),
                           ("regex100", "regex", _REGEX)):
    @query(f"infer_types_{_key}", sql.with_views(sql.union([
        _inferred("d_text", _TEXT_COLUMNS, _rule), _inferred("line_text", _line_names, _rule)]),
        _LINE_TEXT_CTE))
    def _(s, mode=_mode):
        return infer.infer_types(s.t("d_text"), mode).unionByName(
            infer.infer_types(s.t("lineitem").selectExpr(*_LINE_TEXT), mode))


_FAIL = {"INTEGER": f"CASE WHEN {_re(_IS_NUMBER)} THEN try_cast(v AS bigint) END",
         "REAL": f"CASE WHEN {_re(_IS_NUMBER)} THEN try_cast(v AS double) END",
         "DATETIME": "try_cast(v AS timestamp)", "BOOLEAN": "try_cast(v AS boolean)"}


@query("apply_types_failures", sql.with_views(sql.union([
    f"SELECT '{c}' AS \"column\", '{t}' AS inferred_type, count(*) FILTER (WHERE v IS NOT NULL AND "
    f"({_FAIL[t]}) IS NULL) AS failures FROM (SELECT nullif({c}, '') AS v FROM d_text)"
    for c, t in TEXT_TYPES.items()])))
def _(s):
    return infer.cast_failures(s.t("d_text"), TEXT_TYPES)


@query("apply_types", sql.with_views(
    """SELECT try_cast(o_orderkey AS bigint) AS o_orderkey, try_cast(o_custkey AS bigint) AS
    o_custkey, o_orderstatus, try_cast(nullif(o_totalprice, '') AS double) AS o_totalprice,
    try_cast(o_orderdate AS timestamp) AS o_orderdate, try_cast(o_flag AS boolean) AS o_flag,
    try_cast(o_shipped AS timestamp) AS o_shipped FROM d_text"""), ["o_totalprice"])
def _(s):
    text = s.t("d_text")
    found = infer.type_map(infer.infer_types(text, "strict"))
    return infer.apply_types(text, {**found, "o_flag": "BOOLEAN", "o_custkey": "INTEGER"})


# ====================================================================================
# Quality
# ====================================================================================

@query("duplicate_pk_lineitem", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(s):
    return q.duplicate_keys(s.t("lineitem"), ["l_orderkey", "l_linenumber"])


def _violating_keys() -> str:
    return sql.union([
        f"SELECT '{t}' AS \"table\", '{','.join(k)}' AS key, count(*) AS duplicate_groups, "
        f"cast(sum(n - 1) AS bigint) AS surplus_rows FROM (SELECT count(*) AS n FROM "
        f"{CARD_TABLES[t]} GROUP BY {', '.join(k)} HAVING count(*) > 1) HAVING count(*) > 0"
        for t, k in CARD_KEYS.items()])


@query("key_violations", sql.with_views(
    f"SELECT *, 'CRITICAL' AS severity FROM ({_violating_keys()})"))
def _(s):
    return q.key_violations(s.card_tables(), CARD_KEYS)


@query("key_violations_per_column", sql.with_views(sql.union([
    f"SELECT '{t}' AS \"table\", '{c}' AS key, count(*) AS duplicate_groups, "
    f"cast(sum(n - 1) AS bigint) AS surplus_rows, 'CRITICAL' AS severity FROM (SELECT count(*) "
    f"AS n FROM {CARD_TABLES[t]} GROUP BY {c} HAVING count(*) > 1) HAVING count(*) > 0"
    for t, k in CARD_KEYS.items() for c in k])))
def _(s):
    return q.key_violations(s.card_tables(), CARD_KEYS, per_column=True)


@query("date_columns", sql.with_views(sql.union([
    *[f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", 'type' AS kind FROM {t} HAVING count(*) > 0"
      for t, cs in SCHEMA.items() for c, ty in cs if ty == "timestamp_ntz"],
    *[f"SELECT 'text' AS \"table\", '{c}' AS \"column\", 'text' AS kind FROM d_text HAVING "
      f"bool_and(regexp_matches({c}, '{_IS_ISO}'))" for c in _TEXT_COLUMNS]])))
def _(s):
    return q.date_columns({**s.tables(), "text": s.t("d_text")})


_newest = sql.newest_cte(CARD_TABLES)
_LINEAR = """linear AS (SELECT "table", "column", newest, days_ago, CASE WHEN days_ago > 365 THEN
  'DATA_STALE' ELSE 'FRESH' END AS status, greatest(0.0, 100.0 - days_ago * 100.0 / 3650.0)
  ::double AS score FROM newest WHERE newest IS NOT NULL)"""


def _linear(s):
    return q.freshness_linear(q.newest_dates(s.card_tables()), AS_OF)


@query("freshness_linear", sql.with_views("SELECT * FROM linear", _newest, _LINEAR), ["score"])
def _(s):
    return _linear(s)


@query("freshness_timeline", sql.with_views(
    'SELECT "table", "column", newest, status FROM linear', _newest, _LINEAR))
def _(s):
    return q.freshness_timeline(_linear(s))


_counts_cte = ('counts AS (SELECT "table", max(row_count) AS row_count FROM nulls '
               'GROUP BY "table")')
_LADDER_APP = """ladder_app AS (SELECT c."table", n.newest, CASE WHEN row_count = 0 THEN 50.0
  WHEN n."table" IS NULL THEN 80.0 WHEN n.newest IS NULL THEN 60.0 WHEN age <= 30 THEN 100.0
  WHEN age <= 365 THEN 80.0 WHEN age <= 1825 THEN 60.0 ELSE 40.0 END::double AS freshness
  FROM counts c LEFT JOIN (SELECT "table", max(newest) AS newest, min(age) AS age FROM newest
  GROUP BY "table") n ON n."table" = c."table")"""


@query("freshness_ladder_app", sql.with_views(
    "SELECT * FROM ladder_app", sql.nulls_cte(CARD_TABLES), _counts_cte, _newest, _LADDER_APP),
    ["freshness"])
def _(s):
    tables = s.card_tables()
    return q.freshness_ladder_app(prof.row_counts(tables), q.newest_dates(tables), AS_OF)


_LADDER_MODULE = """ladder_module AS (SELECT "table", "column", newest, days_ago, CASE WHEN
  days_ago <= 1 THEN 100.0 WHEN days_ago <= 7 THEN 95.0 WHEN days_ago <= 30 THEN 85.0
  WHEN days_ago <= 90 THEN 70.0 WHEN days_ago <= 365 THEN 50.0 ELSE 25.0 END::double AS score
  FROM newest WHERE newest IS NOT NULL)"""


@query("freshness_ladder_module", sql.with_views("SELECT * FROM ladder_module", _newest,
                                                 _LADDER_MODULE), ["score"])
def _(s):
    return q.freshness_ladder_module(q.newest_dates(s.card_tables()), AS_OF)


# --- dates held as text: order_date month first, ship_time day first, paid ISO --------

_DATED = {"dated": "d_dated", "empty": "d_empty", "nation": "nation"}
_READ_DATES = {
    "ISO": "CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} AS timestamp) END",
    "MM/dd/yyyy[ HH:mm[:ss]]": "try_strptime({c}, ['%m/%d/%Y', '%m/%d/%Y %H:%M', '%m/%d/%Y %H:%M:%S'])",
    "dd/MM/yyyy[ HH:mm[:ss]]": "try_strptime({c}, ['%d/%m/%Y', '%d/%m/%Y %H:%M', '%d/%m/%Y %H:%M:%S'])",
    "yyyy/MM/dd[ HH:mm[:ss]]": "try_strptime({c}, ['%Y/%m/%d', '%Y/%m/%d %H:%M', '%Y/%m/%d %H:%M:%S'])",
    "dd.MM.yyyy[ HH:mm[:ss]]": "try_strptime({c}, ['%d.%m.%Y', '%d.%m.%Y %H:%M', '%d.%m.%Y %H:%M:%S'])",
}


def _text_date_reads(views) -> str:
    return sql.union([
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS place, '{one}' AS notation, "
        f"count(nullif({c}, '')) AS cells, count({read.format(c=c)}) AS readable, "
        f"count(*) FILTER (WHERE regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS dated FROM {v}"
        for t, v in views.items() for c, ty in data.view_columns(v) if ty == "string"
        for i, (one, read) in enumerate(_READ_DATES.items())])


@query("text_dates", sql.with_views(
    f"""SELECT "table", "column", notation, cells, readable FROM (SELECT *, row_number() OVER (PARTITION BY
    "table", "column" ORDER BY readable DESC, place) AS nth FROM ({_text_date_reads(_DATED)})
    WHERE readable > 0 AND (contains("column", 'date') OR contains("column", 'time') OR dated = cells))
    WHERE nth = 1"""))
def _(s):
    return dates.text_dates(s.tables(_DATED))


_DATED_MOMENTS = {"order_date": "MM/dd/yyyy[ HH:mm[:ss]]", "ship_time": "dd.MM.yyyy[ HH:mm[:ss]]",
                  "paid": "ISO"}
_moments = "dm AS (SELECT o_orderkey, o_totalprice, stamp, " + ", ".join(
    f"{_READ_DATES[n].format(c=c)} AS {c}" for c, n in _DATED_MOMENTS.items()) + " FROM d_dated)"
_dated_newest = "newest AS (" + sql.union([
    f"SELECT 'dated' AS \"table\", '{c}' AS \"column\", max({c}) AS newest, "
    f"cast(floor(epoch({sql.as_of('dated')} - max({c})) / 86400) AS integer) AS days_ago, "
    f"epoch({sql.as_of('dated')} - max({c})) / 86400.0 AS age FROM dm"
    for c in (*_DATED_MOMENTS, "stamp")]) + ")"


def _notations(tables):
    return dates.notations_of(dates.text_dates(tables))


@query("freshness_text_dates", sql.with_views("SELECT * FROM linear", _moments, _dated_newest, _LINEAR),
       ["score"])
def _(s):
    tables = s.tables({"dated": "d_dated"})
    return q.freshness_linear(q.newest_dates(tables, _notations(tables)), AS_OF)


@query("freshness_ladder_app_text_dates", sql.with_views(
    "SELECT * FROM ladder_app", sql.nulls_cte({"dated": "d_dated"}), _counts_cte, _moments, _dated_newest,
    _LADDER_APP), ["freshness"])
def _(s):
    tables = s.tables({"dated": "d_dated"})
    return q.freshness_ladder_app(prof.row_counts(tables), q.newest_dates(tables, _notations(tables)), AS_OF)


@query("freshness_ladder_module_text_dates", sql.with_views(
    "SELECT * FROM ladder_module", _moments, _dated_newest, _LADDER_MODULE), ["score"])
def _(s):
    tables = s.tables({"dated": "d_dated"})
    return q.freshness_ladder_module(q.newest_dates(tables, _notations(tables)), AS_OF)


@query("date_stats_text", sql.with_views(_date_stats("dm", (*_DATED_MOMENTS, "stamp")), _moments))
def _(s):
    dated = s.t("d_dated")
    return stats.date_stats(dated, notations=_notations({"dated": dated})["dated"])


# goods shipped before they were ordered: the rule fires where both texts can be read
_DATED_POLICY = QualityPolicy(sequence_rules=(SequenceRule("order_date", "ship_time"),))


@query("date_sequence_text_dates", sql.with_views(
    """SELECT 'dated' AS "table", 'ship_time' AS "column", 'DATE_SEQUENCE_VIOLATION' AS code, count(*) AS n
    FROM dm WHERE ship_time < order_date HAVING count(*) > 0""", _moments))
def _(s):
    tables = s.tables({"dated": "d_dated"})
    return q.sequence_rule(tables, _DATED_POLICY.sequence_rules, _notations(tables))


@query("scorecard6_text_dates", sql.with_views(
    """SELECT *, .25 * completeness + .2 * uniqueness + .2 * fk_integrity + .15 * freshness
  + .1 * validity + .1 * consistency AS score FROM (SELECT 'dated' AS "table", n.row_count,
  100 - n.null_pct AS completeness, l.score AS freshness, 0::bigint AS uniqueness_violations,
  100.0 AS uniqueness, 100.0 AS fk_integrity, 0::bigint AS fk_breaches, o.n AS validity_violations,
  greatest(0.0, 100.0 - 10 * o.n) AS validity, x.n AS consistency_violations,
  greatest(0.0, 100.0 - 20 * x.n) AS consistency
  FROM (SELECT max(row_count) AS row_count, avg(null_pct) AS null_pct FROM nulls) n,
  (SELECT avg(score) AS score FROM linear) l,
  (SELECT count(*) AS n FROM outl WHERE outlier_pct > 5) o,
  (SELECT cast(count(*) > 0 AS bigint) AS n FROM dm WHERE ship_time < order_date) x)""",
    sql.nulls_cte({"dated": "d_dated"}), _moments, _dated_newest, _LINEAR,
    sql.outliers_cte({"dated": "d_dated"})), [*WEIGHTS6, "score"])
def _(s):
    tables = s.tables({"dated": "d_dated"})
    return cards.scorecard6(tables, {"dated": ["o_orderkey"]}, [], AS_OF, _DATED_POLICY,
                            text_dates=_notations(tables))


_rule_rows = [("part", "d_part", "p_retailprice", "INVALID_PRICE", "p_retailprice = 0"),
              ("orders", "d_orders", "o_totalprice", "INVALID_PRICE", "o_totalprice = 0"),
              ("lineitem", "d_lineitem", "l_extendedprice", "INVALID_PRICE", "l_extendedprice = 0"),
              ("lineitem", "d_lineitem", "l_discount", "INVALID_RANGE", "l_discount > 1.0")]
_DOMAIN = "domain AS (SELECT * FROM (" + sql.union([
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{code}' AS code, count(*) AS n FROM {v} "
    f"WHERE {test}" for t, v, c, code, test in _rule_rows]) + ") WHERE n > 0)"


@query("domain_rules", sql.with_views("SELECT * FROM domain", _DOMAIN))
def _(s):
    return q.domain_rules(s.card_tables())


@query("date_sequence", """SELECT 'DATE_SEQUENCE_VIOLATION' AS code, count(*) AS n FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def _(s):
    return q.sequence_violations_across(s.t("lineitem"), "l_shipdate", "l_orderkey",
                                        s.t("orders"), "o_orderdate", "o_orderkey")


@query("date_sequence_within", """SELECT 'joined' AS "table", 'l_shipdate' AS "column",
    'DATE_SEQUENCE_VIOLATION' AS code, count(*) AS n FROM lineitem JOIN orders
    ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def _(s):
    joined = s.t("lineitem").join(s.t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return q.sequence_rule({"joined": joined}, [SequenceRule("o_orderdate", "l_shipdate")])


@query("enum_rule", sql.with_views(
    """SELECT 'orders' AS "table", 'o_orderstatus' AS "column", 'INVALID_STATUS' AS code,
    count(*) AS n FROM d_orders WHERE coalesce(o_orderstatus NOT IN ('F', 'O', 'P'), true)
    UNION ALL SELECT 'events', 'event_type', 'INVALID_STATUS', count(*) FROM events
    WHERE event_type NOT IN ('click', 'view')"""))
def _(s):
    return q.enum_rule(s.tables({"orders": "d_orders", "events": "events"}), [
        EnumRule("o_orderstatus", ("F", "O", "P")),
        EnumRule("event_type", ("click", "view"), null_is_invalid=False)])


@query("outlier_violations", sql.with_views(
    """SELECT "table", "column", 'OUTLIER_WARNING' AS code, outlier_count AS n FROM outl
    WHERE outlier_pct > 5""", sql.outliers_cte(CARD_TABLES)))
def _(s):
    return q.outlier_violations(s.card_tables())


# --- scorecards ------------------------------------------------------------------

_CARD6 = [
    sql.nulls_cte(CARD_TABLES), _counts_cte, _card_stats, _newest, _LINEAR,
    sql.outliers_cte(CARD_TABLES), _DOMAIN, f"dup AS ({_violating_keys()})",
    """card AS (SELECT c."table", c.row_count,
  CASE WHEN row_count > 0 THEN 100 - (SELECT avg(null_pct) FROM nulls n WHERE
    n."table" = c."table") ELSE 0.0 END AS completeness,
  CASE WHEN row_count = 0 OR c."table" IN (SELECT "table" FROM dup) THEN 0.0 ELSE 100.0 END
    AS uniqueness,
  coalesce((SELECT avg(integrity_pct) FROM fkstats f WHERE f.child_table = c."table"), 100.0)
    AS fk_integrity,
  coalesce((SELECT avg(score) FROM linear l WHERE l."table" = c."table"), 100.0) AS freshness,
  (SELECT count(*) FROM dup d WHERE d."table" = c."table") AS uniqueness_violations,
  (SELECT count(*) FROM fkstats f WHERE f.child_table = c."table" AND integrity_pct < 99)
    AS fk_breaches,
  (SELECT count(*) FROM outl o WHERE o."table" = c."table" AND outlier_pct > 5)
    + (SELECT count(*) FROM domain d WHERE d."table" = c."table") AS validity_violations,
  CASE WHEN c."table" = 'orders' AND (SELECT count(*) FROM d_orders WHERE
    coalesce(o_orderstatus NOT IN ('F', 'O', 'P'), true)) > 0 THEN 1 ELSE 0 END::bigint
    AS consistency_violations FROM counts c)""",
    """card6 AS (SELECT *, .25 * completeness + .2 * uniqueness + .2 * fk_integrity
  + .15 * freshness + .1 * validity + .1 * consistency AS score FROM (SELECT *,
  CASE WHEN row_count = 0 THEN 0.0 ELSE greatest(0.0, 100.0 - 10 * validity_violations) END
    AS validity,
  CASE WHEN row_count = 0 THEN 0.0 ELSE greatest(0.0, 100.0 - 20 * consistency_violations) END
    AS consistency FROM card))""",
]
_SIX = list(WEIGHTS6)


def card6(s: Source) -> DataFrame:
    return cards.scorecard6(s.card_tables(), CARD_KEYS, CARD_FKS, AS_OF, POLICY)


@query("scorecard6", sql.with_views("SELECT * FROM card6", *_CARD6), [*_SIX, "score"])
def _(s):
    return card6(s)


@query("uniqueness_score", sql.with_views(
    'SELECT "table", uniqueness_violations, uniqueness FROM card6', *_CARD6), ["uniqueness"])
def _(s):
    tables = s.card_tables()
    return q.uniqueness_score(prof.row_counts(tables), q.key_violations(tables, CARD_KEYS))


@query("freshness_score", sql.with_views('SELECT "table", freshness FROM card6', *_CARD6),
       ["freshness"])
def _(s):
    return q.freshness_score(prof.row_counts(s.card_tables()), _linear(s))


@query("validity_score", sql.with_views(
    'SELECT "table", validity_violations, validity FROM card6', *_CARD6), ["validity"])
def _(s):
    tables = s.card_tables()
    found = q.outlier_violations(tables).unionByName(q.domain_rules(tables))
    return q.penalty_score(prof.row_counts(tables), found, POLICY.validity_penalty, "validity")


@query("consistency_score", sql.with_views(
    'SELECT "table", consistency_violations, consistency FROM card6', *_CARD6), ["consistency"])
def _(s):
    tables = s.card_tables()
    return q.penalty_score(prof.row_counts(tables), q.consistency_violations(tables, POLICY),
                           POLICY.consistency_penalty, "consistency")


@query("heat_bands", sql.with_views(
    """SELECT "table", "column", completeness, CASE WHEN completeness >= 95 THEN '95-100%'
    WHEN completeness >= 80 THEN '80-95%' WHEN completeness >= 60 THEN '60-80%'
    WHEN completeness >= 40 THEN '40-60%' WHEN completeness >= 0 THEN '0-40%' END AS band
    FROM nulls""", sql.nulls_cte(CARD_TABLES)), ["completeness"])
def _(s):
    return prof.null_profile(s.card_tables()).select(
        "table", "column", "completeness", issues.heat_band(F.col("completeness")).alias("band"))


@query("quality_radar", sql.with_views(sql.union([
    f"SELECT \"table\", '{d}' AS dimension, {d}::double AS dimension_score FROM card6"
    for d in _SIX]), *_CARD6), ["dimension_score"])
def _(s):
    return cards.quality_radar(card6(s), _SIX)


@query("quality_overview", sql.with_views(
    """SELECT "table", score, CASE WHEN score > 90 THEN 'green' WHEN score > 70 THEN 'orange'
    ELSE 'red' END AS color FROM card6""", *_CARD6), ["score"])
def _(s):
    return cards.quality_overview(card6(s))


@query("violation_counts", sql.with_views(sql.union([
    f"SELECT \"table\", '{kind}' AS type, {c} AS n FROM card6" for kind, c in (
        ("Uniqueness", "uniqueness_violations"), ("FK Breach", "fk_breaches"),
        ("Validity", "validity_violations"), ("Consistency", "consistency_violations"))]),
    *_CARD6))
def _(s):
    return cards.violation_counts(card6(s))


@query("remediation", sql.with_views(sql.union([
    f"SELECT \"table\", '{text}' AS suggestion FROM card6 WHERE {test}" for test, text in (
        ("completeness < 90", "Consider backfilling NULL values in critical columns."),
        ("fk_breaches > 0", "Repair orphan records in foreign key relationships."),
        ("freshness < 50", "Update data source; recent records are missing."))]), *_CARD6))
def _(s):
    return issues.remediation(card6(s))


_COLOR = ("CASE WHEN score >= 90 THEN 'green' WHEN score >= 75 THEN 'yellow' "
          "WHEN score >= 50 THEN 'orange' ELSE 'red' END")


def _card4(freshness: str) -> str:
    return f"""card4 AS (SELECT *, {_COLOR} AS color FROM (SELECT *, CASE WHEN row_count = 0 THEN 0.0
  ELSE least(100.0, greatest(0.0, completeness * .4 + fk_integrity * .3 + freshness * .2 + 8.0))
  END AS score FROM (SELECT c."table", c.row_count,
  CASE WHEN row_count > 0 THEN 100 - (SELECT avg(null_pct) FROM nulls n WHERE
    n."table" = c."table") ELSE 0.0 END AS completeness,
  coalesce((SELECT avg(integrity_pct) FROM fkstats f WHERE f.child_table = c."table"), 100.0)
    AS fk_integrity, {freshness} AS freshness FROM counts c)))"""


_CARD4_APP = [sql.nulls_cte(CARD_TABLES), _counts_cte, _card_stats, _newest, _LADDER_APP, _card4(
    '(SELECT freshness FROM ladder_app l WHERE l."table" = c."table")')]
_CARD4_MODULE = [sql.nulls_cte(CARD_TABLES), _counts_cte, _card_stats, _newest, _LADDER_MODULE,
                 _card4('CASE WHEN row_count = 0 THEN 50.0 ELSE coalesce((SELECT avg(score) FROM '
                        'ladder_module l WHERE l."table" = c."table"), 80.0) END')]
_FOUR = ["completeness", "fk_integrity", "freshness", "score"]


def card4(s: Source, ladder: str = "app") -> DataFrame:
    return cards.scorecard4(s.card_tables(), CARD_FKS, AS_OF, ladder)


@query("scorecard4", sql.with_views("SELECT * FROM card4", *_CARD4_APP), _FOUR)
def _(s):
    return card4(s)


@query("scorecard4_module", sql.with_views("SELECT * FROM card4", *_CARD4_MODULE), _FOUR)
def _(s):
    return card4(s, "module")


@query("grades", sql.with_views(
    f"""SELECT "table", score, {_COLOR} AS color, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75
    THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM card4""", *_CARD4_APP),
    ["score"])
def _(s):
    return q.grades(card4(s))


@query("overall_health", sql.with_views(
    """SELECT h AS overall_health, CASE WHEN h >= 90 THEN 'green' WHEN h >= 75 THEN 'yellow'
    ELSE 'red' END AS overall_color FROM (SELECT avg(score) AS h FROM card4 WHERE row_count > 0)""",
    *_CARD4_APP), ["overall_health"])
def _(s):
    return q.overall_health(card4(s))


# --- issues ----------------------------------------------------------------------

_P2 = "format('{{:.2f}}%', round({0}, 2))".format
_FK_MESSAGE = (f"'FK integrity ' || {_P2('integrity_pct')} || ', ' || orphaned_count || "
               "' orphaned -> ' || parent_table || '.' || parent_column")
_ISSUES_APP = f"""issues AS (
  SELECT CASE WHEN null_pct > 30 THEN 'critical' ELSE 'warning' END AS severity,
    'HIGH_NULL' AS code, "table", "column", 'null rate ' || {_P2('null_pct')} AS message,
    null_pct AS "value" FROM prof WHERE row_count > 0 AND null_pct > 5
  UNION ALL SELECT CASE WHEN integrity_pct < 90 THEN 'critical' ELSE 'warning' END, 'FK_FAIL',
    child_table, child_column, {_FK_MESSAGE}, integrity_pct FROM fkstats WHERE integrity_pct < 99)"""
_ISSUES_MODULE = f"""issues AS (
  SELECT CASE WHEN null_pct > 80 THEN 'critical' ELSE 'warning' END AS severity,
    'HIGH_NULL_RATE' AS code, "table", "column", 'null rate ' || {_P2('null_pct')} AS message,
    null_pct AS "value" FROM prof WHERE row_count > 0 AND null_pct > 50
  UNION ALL SELECT 'info', 'LOW_UNIQUENESS', "table", "column", 'uniqueness ' ||
    {_P2('uniqueness')} || ', ' || distinct_count || ' distinct', uniqueness FROM prof
    WHERE uniqueness < 5 AND distinct_count > 0 AND row_count > 10
  UNION ALL SELECT 'warning', 'STALE_DATA', "table", "column", 'last record ' || days_ago ||
    ' days ago', days_ago::double FROM newest WHERE days_ago > 365
  UNION ALL SELECT CASE WHEN integrity_pct < 80 THEN 'critical' ELSE 'warning' END,
    'FK_INTEGRITY_FAILURE', child_table, child_column, {_FK_MESSAGE}, integrity_pct FROM fkstats
    WHERE integrity_pct < 100)"""
_ISSUE_CTES = [*sql.profile_ctes(CARD_TABLES), _card_stats, _newest]
_ISSUE_COLUMNS = 'severity, code, "table", "column", message, "value"'


def _issues(s: Source, policy: str) -> DataFrame:
    tables = s.card_tables()
    report = rel.fk_integrity(tables, CARD_FKS)
    if policy == "app":
        return issues.issues_app(prof.null_profile(tables), report)
    return issues.issues_module(prof.column_profile(tables), report,
                                q.with_age(q.newest_dates(tables), AS_OF))


@query("issues_app", sql.with_views(f"SELECT {_ISSUE_COLUMNS} FROM issues", *_ISSUE_CTES,
                                    _ISSUES_APP), ["value"])
def _(s):
    return issues.ranked(_issues(s, "app"))


@query("issues_module", sql.with_views(f"SELECT {_ISSUE_COLUMNS} FROM issues", *_ISSUE_CTES,
                                       _ISSUES_MODULE), ["value"])
def _(s):
    return issues.ranked(_issues(s, "module"))


@query("top_issues", sql.with_views(
    f"""SELECT {_ISSUE_COLUMNS} FROM issues ORDER BY CASE severity WHEN 'critical' THEN 1
    WHEN 'warning' THEN 2 ELSE 3 END, "table", "column", code LIMIT 10""", *_ISSUE_CTES,
    _ISSUES_MODULE), ["value"])
def _(s):
    return issues.top_issues(_issues(s, "module"))


@query("column_issues", sql.with_views(
    """SELECT n."table", n."column", n.ordinal, coalesce(codes, '') AS codes,
    coalesce(issue_count, 0) AS issue_count FROM nulls n LEFT JOIN (SELECT "table", "column",
    string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS issue_count FROM issues
    GROUP BY "table", "column") i USING ("table", "column")""", *_ISSUE_CTES, _ISSUES_MODULE))
def _(s):
    return issues.column_issues(prof.null_profile(s.card_tables()), _issues(s, "module"))


@query("completeness_buckets", sql.with_views(
    """SELECT cast(position AS integer) AS position, band, count(n."table") AS "columns",
    count(n."table") * 100.0::double / (SELECT count(*) FROM nulls WHERE row_count > 0)
    AS share_pct FROM (VALUES (1, '95-100%', 95, 101), (2, '80-95%', 80, 95), (3, '60-80%', 60, 80),
    (4, '40-60%', 40, 60), (5, '0-40%', 0, 40)) b(position, band, lo, hi) LEFT JOIN nulls n
    ON n.row_count > 0 AND completeness >= lo AND completeness < hi GROUP BY position, band""",
    sql.nulls_cte(CARD_TABLES)), ["share_pct"])
def _(s):
    return issues.completeness_buckets(prof.null_profile(s.card_tables()))


@query("sample_exposure", "SELECT cast(sum(least(n, 3)) AS bigint) AS sampled_rows, "
       "cast(sum(n) AS bigint) AS total_rows, round(sum(least(n, 3)) * 100.0::double / sum(n), 4) "
       "AS exposure_pct FROM (" + sql.union([f"SELECT count(*) AS n FROM {t}" for t in SCHEMA])
       + ")", ["exposure_pct"])
def _(s):
    return issues.sample_exposure(prof.row_counts(s.tables()))


# ====================================================================================
# Sources and sinks
# ====================================================================================

@query("csv_roundtrip", "SELECT * FROM orders", ["o_totalprice"])
def _(s):
    path = f"{scratch_path(s.spark, 'csv')}/orders.csv"
    writers.write_csv(s.t("orders"), path)
    text = readers.read_csvs(s.spark, [path])["orders"]
    return infer.apply_types(text, infer.type_map(infer.infer_types(text)))


@query("csv_roundtrip_text", "SELECT doc_id, text, lang FROM documents")
def _(s):
    path = f"{scratch_path(s.spark, 'csv')}/documents.csv"
    writers.write_csv(s.t("documents").select("doc_id", "text", "lang"), path)
    text = readers.read_any(s.spark, path)["documents"]
    return infer.apply_types(text, {"doc_id": "INTEGER"})


@query("document_fields", """SELECT field, count(*) AS documents, 'object' AS type,
    field = '_id' AS primary_key FROM (SELECT unnest(json_keys(props)) AS field FROM events)
    GROUP BY field""")
def _(s):
    return readers.document_fields(s.t("events"), "props")


@query("csv_malformed", """SELECT 'nation' AS "table", count(*) AS rows,
    count_if(n_nationkey % 5 = 0 OR n_nationkey % 7 = 1) AS malformed_rows FROM nation""")
def _(s):
    path = f"{scratch_path(s.spark, 'csv')}/nation.csv"
    lines = s.t("nation").selectExpr(
        "n_nationkey AS k", "concat_ws(',', n_nationkey, n_name, if(n_nationkey % 7 = 1, NULL, "
        "n_regionkey), if(n_nationkey % 5 = 0, if(n_nationkey % 7 = 1, 'x,y', 'x'), NULL)) AS line")
    head = s.spark.sql("SELECT -1 AS k, 'n_nationkey,n_name,n_regionkey' AS line")
    # one file, header first: text files have no header of their own
    head.unionAll(lines).repartition(1).sortWithinPartitions("k").select("line").write.text(path)
    return readers.csv_malformed(s.spark, [path])


@query("read_any_malformed", """SELECT count(*) AS rows, count_if(n_nationkey % 5 = 0) AS malformed_rows,
    string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || ',x', '|' ORDER BY n_nationkey)
      FILTER (WHERE n_nationkey % 5 = 0) AS kept FROM nation""")
def _(s):
    path = f"{scratch_path(s.spark, 'csv')}/nation.csv"
    lines = s.t("nation").selectExpr("n_nationkey AS k", "concat_ws(',', n_nationkey, n_name, n_regionkey, "
                                     "if(n_nationkey % 5 = 0, 'x', NULL)) AS line")
    head = s.spark.sql("SELECT -1 AS k, 'n_nationkey,n_name,n_regionkey' AS line")
    head.unionAll(lines).repartition(1).sortWithinPartitions("k").select("line").write.text(path)
    rows = readers.read_any(s.spark, path, malformed="whole")["nation"]
    whole = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("k"), "whole")))
    bad = F.filter(whole, lambda r: r["whole"].isNotNull())
    return rows.agg(F.count("n_nationkey").alias("rows"), F.count("whole").alias("malformed_rows"),
                    F.array_join(F.transform(bad, lambda r: r["whole"]), "|").alias("kept"))


@query("document_fields_malformed", """SELECT count(*) AS documents,
    count_if(event_id % 10 = 3 OR event_id % 10 = 7) AS unreadable FROM events""")
def _(s):
    spoiled = s.t("events").selectExpr("""CASE WHEN event_id % 10 = 3 THEN 'no json'
        WHEN event_id % 10 = 7 THEN '[1, 2]' ELSE props END AS document""")
    return readers.unreadable_documents(spoiled, "document")


@query("document_fields_nested", sql.union([
    f"SELECT '{c}' AS field, count(*) AS documents, 'object' AS type, false AS primary_key "
    "FROM orders" for c, _ in SCHEMA["orders"]]))
def _(s):
    path = scratch_path(s.spark, "documents")
    writers.write_report(s.t("orders"), path, "json")
    return readers.document_fields(readers.read_documents(s.spark, path), "document")


@query("report_roundtrip", sql.with_views("SELECT * FROM nulls", sql.nulls_cte(CARD_TABLES)), PCT)
def _(s):
    path = scratch_path(s.spark, "report")
    report = prof.null_profile(s.card_tables())
    writers.write_report(report, path, "json")
    return s.spark.read.schema(report.schema).json(path)


_MARK = {"mysql": "`", "postgres": '"', "oracle": '"'}


# the expected target of every type that the tables have, by dialect; doubles fall to text,
# as the rule looks for real and float only
_TARGETS = {
    "mysql": {"int": "INT", "bigint": "INT", "double": "LONGTEXT", "string": "LONGTEXT",
              "timestamp_ntz": "LONGTEXT", "array<float>": "LONGTEXT"},
    "postgres": {"int": "INTEGER", "bigint": "INTEGER", "double": "TEXT", "string": "TEXT",
                 "timestamp_ntz": "TEXT", "array<float>": "DOUBLE PRECISION"},
    "oracle": {"int": "NUMBER(12,0)", "bigint": "NUMBER(12,0)", "double": "CLOB", "string": "CLOB",
               "timestamp_ntz": "CLOB", "array<float>": "NUMBER"},
}


def _target(dialect: str, type_: str = "type", key: str = "primary_key") -> str:
    serial = f"WHEN {key} AND {type_} IN ('int', 'bigint') THEN 'SERIAL' " if dialect == "postgres" else ""
    return f"CASE {serial}" + " ".join(
        f"WHEN {type_} = '{one}' THEN '{target}'" for one, target in _TARGETS[dialect].items()) + " END"


@query("type_mapping", sql.with_views(
    'SELECT "table", "column", type, primary_key, ' + ", ".join(
        f"{_target(d)} AS {d}" for d in sqltext.DIALECTS) + " FROM cols", *CATALOG[:6]))
def _(s):
    return sqltext.type_mapping(s.catalog().columns)


def _ddl(dialect: str) -> str:
    mark = _MARK[dialect]
    key_line = "''" if dialect == "postgres" else "CASE WHEN primary_key THEN ' NOT NULL' ELSE '' END"
    drop = (f"'DROP TABLE IF EXISTS {mark}' || \"table\" || '{mark};' || chr(10) || "
            if dialect == "mysql" else "")
    return (f"SELECT \"table\", {drop}'CREATE TABLE {mark}' || \"table\" || '{mark} (' || chr(10) || "
            f"string_agg('  {mark}' || \"column\" || '{mark} ' || {_target(dialect)} || {key_line}, "
            "',' || chr(10) ORDER BY ordinal) || coalesce(',' || chr(10) || '  PRIMARY KEY (' || "
            f"string_agg('{mark}' || \"column\" || '{mark}', ', ' ORDER BY ordinal) FILTER (WHERE "
            "primary_key) || ')', '') || chr(10) || ');' AS ddl FROM cols GROUP BY \"table\"")


for _d in sqltext.DIALECTS:
    @query(f"ddl_{_d}", sql.with_views(_ddl(_d), *CATALOG))
    def _(s, dialect=_d):
        return sqltext.table_ddl(s.catalog(), dialect)


def _insert(view: str, name: str, dialect: str) -> str:
    mark = _MARK[dialect]
    columns = data.view_columns(view)
    names = ", ".join(f"{mark}{c}{mark}" for c, _ in columns)
    values = " || ', ' || ".join(
        f"coalesce(cast({c} AS varchar), 'NULL')" if ty in sql.NUMERIC else
        f"coalesce('''' || replace(cast({c} AS varchar), '''', '''''') || '''', 'NULL')"
        for c, ty in columns)
    return (f"SELECT 'INSERT INTO {mark}{name}{mark} ({names}) VALUES (' || {values} || ');' "
            f"AS statement FROM {view}")


for _key, _view, _name, _d in (("nation", "nation", "nation", "mysql"),
                               ("orders", "d_orders", "orders", "postgres"),
                               ("documents", "documents", "documents", "oracle")):
    @query(f"insert_sql_{_key}", sql.with_views(_insert(_view, _name, _d)))
    def _(s, view=_view, name=_name, dialect=_d):
        return sqltext.insert_statements(s.t(view), name, dialect)
