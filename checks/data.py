"""The test tables, their defect views, and what is declared about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.operators.relationships import ForeignKey
from tablescope.policy import EnumRule, QualityPolicy, SequenceRule

SCHEMA = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}

# Views over the base tables that hold defects; the same text runs in both engines.
DEFECTS = {
    "d_orders": ("orders", {
        "o_custkey": "case when o_orderkey % 101 = 0 then o_custkey + 1000000 "
                     "when o_orderkey % 37 = 0 then null else o_custkey end",
        "o_orderstatus": "case when o_orderkey % 13 = 0 then null "
                         "when o_orderkey % 97 = 0 then 'X' else o_orderstatus end",
        "o_totalprice": "case when o_orderkey % 2 = 0 then null else o_totalprice end",
        "o_orderdate": "case when o_orderkey % 500 = 0 then null else o_orderdate end",
        "o_comment": "cast(null as varchar(10))",
    }),
    "d_part": ("part", {
        "p_retailprice": "case when p_partkey % 50 = 0 then 0 else p_retailprice end"}),
    "d_lineitem": ("lineitem", {
        "l_discount": "case when l_orderkey % 211 = 0 then 1.5e0 else l_discount end",
        "l_extendedprice": "case when l_orderkey % 12 = 0 then l_extendedprice * 20 "
                           "else l_extendedprice end"}),
}

# orders with dates held as text, in several notations: (column, type, Spark SQL, DuckDB SQL)
DATED = [
    ("o_orderkey", "bigint", "o_orderkey", "o_orderkey"),
    ("o_totalprice", "double", "o_totalprice", "o_totalprice"),
    ("order_date", "string", "case when o_orderkey % 17 = 0 then 'unknown' when o_orderkey % 23 = 0 "
     "then '' else date_format(o_orderdate, 'MM/dd/yyyy') end",
     "case when o_orderkey % 17 = 0 then 'unknown' when o_orderkey % 23 = 0 then '' "
     "else strftime(o_orderdate, '%m/%d/%Y') end"),
    ("ship_time", "string", "case when o_orderkey % 31 = 0 then null else date_format(o_orderdate + "
     "case when o_orderkey % 19 = 0 then interval '-3' day else interval '10' day end, "
     "'dd.MM.yyyy HH:mm') end",
     "case when o_orderkey % 31 = 0 then null else strftime(o_orderdate + case when o_orderkey % 19 = 0 "
     "then interval '-3' day else interval '10' day end, '%d.%m.%Y %H:%M') end"),
    ("paid", "string", "date_format(o_orderdate + interval '400' day, 'yyyy-MM-dd HH:mm:ss')",
     "strftime(o_orderdate + interval '400' day, '%Y-%m-%d %H:%M:%S')"),
    ("update_text", "string", "case when o_orderkey % 2 = 0 then '2001-13-45' else o_orderpriority end",
     "case when o_orderkey % 2 = 0 then '2001-13-45' else o_orderpriority end"),
    ("stamp", "timestamp_ntz", "o_orderdate", "o_orderdate"),
]


def _select_list(base: str, changed: dict[str, str]) -> list[str]:
    names = [c for c, _ in SCHEMA[base]]
    added = [c for c in changed if c not in names]
    return [f"{changed[c]} as {c}" if c in changed else c for c in names + added]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or one of the defect views."""
    if name in DEFECTS:
        base, changed = DEFECTS[name]
        return table(spark, sf_dir, base).selectExpr(
            *[e.replace("varchar(10)", "string") for e in _select_list(base, changed)])
    if name == "d_customer":
        base = table(spark, sf_dir, "customer")
        extra = base.where("c_custkey % 100 = 0")
        nameless = base.where("c_custkey = 1").selectExpr(
            "cast(null as bigint) as c_custkey", *base.columns[1:])
        return base.unionByName(extra).unionByName(nameless)
    if name == "d_empty":
        return table(spark, sf_dir, "orders").where("false")
    if name == "d_text":
        return table(spark, sf_dir, "orders").selectExpr(*TEXT_COLUMNS_SPARK)
    if name == "d_dated":
        return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {c}" for c, _, e, _ in DATED])
    # a given schema saves a job that reads the file footers
    schema = ", ".join(f"`{c}` {ty}" for c, ty in SCHEMA[name])
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


# orders as text with unreadable cells, for the loading rules
_TEXT = {
    "o_orderkey": "cast(o_orderkey as {s})",
    "o_custkey": "case when o_orderkey % 29 = 0 then 'n/a' else cast(o_custkey as {s}) end",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "case when o_orderkey % 41 = 0 then '' else cast(o_totalprice as {s}) end",
    "o_orderdate": "case when o_orderkey % 17 = 0 then 'unknown' "
                   "else cast(o_orderdate as {s}) end",
    "o_flag": "case when o_orderkey % 3 = 0 then 'true' else '0' end",
    "o_shipped": "cast(cast(o_orderdate as date) + interval '20' year as date)",
}
TEXT_COLUMNS_SPARK = [f"{e.format(s='string')} as {c}" for c, e in _TEXT.items() if c != "o_shipped"]
TEXT_COLUMNS_SPARK.append("cast(cast(add_months(o_orderdate, 240) as date) as string) as o_shipped")
TEXT_COLUMNS_SQL = [f"{e.format(s='varchar')} as {c}" for c, e in _TEXT.items() if c != "o_shipped"]
TEXT_COLUMNS_SQL.append("cast(cast(o_orderdate + interval 240 month as date) as varchar) as o_shipped")
TEXT_TYPES = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_totalprice": "REAL",
              "o_orderdate": "DATETIME", "o_flag": "BOOLEAN", "o_orderstatus": "REAL"}


def views_sql() -> str:
    """The defect views as common table expressions (without the leading WITH)."""
    parts = [f"{name} AS (SELECT {', '.join(_select_list(base, changed))} FROM {base})"
             for name, (base, changed) in DEFECTS.items()]
    rest = ", ".join(c for c, _ in SCHEMA["customer"][1:])
    parts.append("d_customer AS (SELECT * FROM customer UNION ALL SELECT * FROM customer "
                 "WHERE c_custkey % 100 = 0 UNION ALL "
                 f"SELECT cast(null AS bigint), {rest} FROM customer WHERE c_custkey = 1)")
    parts.append("d_empty AS (SELECT * FROM orders WHERE false)")
    parts.append(f"d_text AS (SELECT {', '.join(TEXT_COLUMNS_SQL)} FROM orders)")
    parts.append("d_dated AS (SELECT " + ", ".join(f"{e} AS {c}" for c, _, _, e in DATED) + " FROM orders)")
    return ",\n".join(parts)


DECLARED = [
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
BY_NAME = ForeignKey("labels", "doc_id", "documents", "doc_id", True)
WRONG = [
    ForeignKey("lineitem", "l_partkey", "supplier", "s_suppkey"),
    ForeignKey("events", "user_id", "supplier", "s_suppkey"),
    ForeignKey("documents", "n_chars", "labels", "doc_id"),
]

# the scorecard runs over the defect views under their base names
CARD_TABLES = {"region": "region", "nation": "nation", "supplier": "supplier",
               "customer": "d_customer", "part": "d_part", "orders": "d_orders",
               "lineitem": "d_lineitem", "events": "events", "labels": "labels",
               "empty": "d_empty"}
CARD_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"],
             "customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
             "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
             "labels": ["doc_id"], "empty": ["o_orderkey"]}
CARD_FKS = DECLARED
AS_OF = {"*": "2002-01-01 00:00:00", "events": "2024-02-01 00:00:00"}
POLICY = QualityPolicy(enum_rules=(EnumRule("o_orderstatus", ("F", "O", "P")),),
                       sequence_rules=(SequenceRule("o_orderdate", "l_shipdate"),))
ORDER_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
              "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
              "events": ["event_id"], "labels": ["doc_id"], "documents": ["doc_id"],
              "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
              "conversations": ["conv_id", "turn"],
              "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           "l_extendedprice"]}


def view_columns(name: str) -> list[tuple[str, str]]:
    """(column, type) of a table or view."""
    if name in DEFECTS:
        base, changed = DEFECTS[name]
        return SCHEMA[base] + [(c, "string") for c in changed
                               if c not in dict(SCHEMA[base])]
    if name == "d_customer":
        return SCHEMA["customer"]
    if name == "d_empty":
        return SCHEMA["orders"]
    if name == "d_dated":
        return [(c, ty) for c, ty, _, _ in DATED]
    return SCHEMA[name]
