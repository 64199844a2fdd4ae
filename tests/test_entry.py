import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 80
    for n in range(1, 11):
        if entry.HAS_LLM:
            assert sum(q.startswith(f"op{n}_") for q in queries) == 1
