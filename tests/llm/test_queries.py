import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from lingloom.llm import queries as Q  # noqa: E402

COLUMNS = {
    "p1_found": ["lang", "origin", "rec_key", "run_no"], "p2_found": ["end_pos", "source_id", "start_pos"], "p3_found": ["defect", "row_id"], "p4_found": ["kind", "length_from", "plan_id"],
    "p5_found": ["candidate_index", "source_id"], "p6_found": ["source_id_a", "source_id_b"], "p9_found": ["mix_id", "source"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_and_has_its_columns(spark, name):
    df = Q.queries()[name](spark, SF)
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name]
    assert df.distinct().count() == df.count() > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(Q.oracle_sql()[name])
    named = [d[0] for d in rel.description]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[named.index(c)] for c in cols) for r in rel.fetchall())


def test_near_duplicates_of_the_table_like_brute_force(spark):
    from tests.llm.test_near_duplicates import brute

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/sampled_sources.parquet").select("source_id", "source_text").collect()]
    assert {(r[0], r[1]) for r in Q.p6_found(spark, SF).collect()} == brute(rows)
