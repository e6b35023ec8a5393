"""Registered queries against their oracle SQL, at the smallest scale.

By default one query per operator family runs; CHECK_ALL=1 runs every registered one.
`python -m checks.compare` does the same at sf0.01.
"""

import os

import pytest

import __spark_entry__ as entry_module
from checks import compare, queries

SF = "/root/testdata/sf0.001"
SAMPLE = """null_profile_orders completeness_score column_profile value_freq_orders column_modes
top_values_orders numeric_stats_orders date_stats_orders text_stats_customer histogram_lineitem
iqr_outliers_lineitem correlation_orders fk_cardinality orphan_count_null_parent fk_integrity
validate_fks join_coverage discover_fks composite_keys components betweenness catalog_columns
merge_fks table_roles anomalies column_dictionary er_edges infer_types_strict infer_types_bool
infer_types_regex apply_types_failures key_violations freshness_linear freshness_ladder_app
freshness_ladder_module domain_rules date_sequence enum_rule scorecard6 scorecard4 issues_module
remediation completeness_buckets csv_roundtrip_text document_fields ddl_mysql insert_sql_orders
text_dates date_stats_text scorecard6_text_dates anomalies_duplicate_columns column_dictionary_sparse
stored_catalog_profile profile_by_parts type_mapping
""".split()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(queries.REGISTRY) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    oracle = queries.REGISTRY[name].oracle
    assert compare.difference(queries.run(name, spark, SF), duck, oracle) is None


def test_contract(spark):
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names)
    assert len(names) > 100
    first = entry_module.entry(spark)
    assert first.count() == 10
    assert "score" in first.columns
