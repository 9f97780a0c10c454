import __spark_entry__ as entry_points


def test_entry_and_registry(spark, sf_dir):
    names = set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= names and len(names) > 50
    assert entry_points.entry(spark).count() == 4


def test_a_cheap_query_of_each_theme(spark, sf_dir):
    queries = entry_points.queries()
    for name in ("country_allocation", "operator_mix", "source_blocks", "log_dedupe", "manifest_check"):
        assert queries[name](spark, sf_dir).count() > 0
