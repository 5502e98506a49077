from docweft.llm import oracle, queries


def test_every_query_runs(spark, data):
    for name, query in queries.queries().items():
        assert query(spark, data).limit(5).collect() is not None, name


def test_found_queries_have_the_columns_given(spark, data):
    want = {"p1_found": ["term", "mark"], "p2_found": ["tbl", "id_a", "id_b"], "p4_found": ["tbl", "rec_id", "fld", "pii_type"], "p5_found": ["tbl", "item_id"], "p8_found": ["doc_id", "kind"]}
    made = queries.queries()
    assert {n: made[n](spark, data).columns for n in want} == want


def test_sql_is_for_known_queries():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
