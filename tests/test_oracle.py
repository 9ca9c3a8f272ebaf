"""Registered queries against their DuckDB twins on the smallest data folder
(the full set runs with ``python tests/oracle_compare.py``)."""

import pytest

from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["sales_match", "sales_features", "feature_table", "iqr_cap", "near_pairs", "first_site",
         "leads_master", "star_aged", "implant_list", "zip3_territory", "null_safe_lookup",
         "hash_split", "oversample", "target_histogram", "metrics", "auc", "auc_pr", "best_run"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert res["cols_ok"], res
    assert res["rows"] == res["oracle_rows"], res
    assert res["exact"], res


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
