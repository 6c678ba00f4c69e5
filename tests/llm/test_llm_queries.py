import os

import pytest

from kvartal.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_with_stable_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    want = {
        "p3_found": ["listing_id_a", "listing_id_b"], "p4_found": ["row_no"], "p6_percentiles": ["h3", "listed_month", "p10", "p50", "p90", "n_values", "rank_error"], "p6_rank_errors": ["h3", "n_values", "within", "collapsed"], "p7_ids": ["doc_id", "ids"],
        "p8_containers": ["doc_id", "piece_no", "n_tokens", "container_id"], "p9_found": ["doc_id"],
    }
    assert df.columns == want[name] and df.count() > 0


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES)
