"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs_flagship(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["id", "name", "age"]
    assert df.count() >= 0


def test_every_query_is_callable_with_an_oracle():
    from rivulet.plans import all_oracles, all_queries
    q, o = E.queries(), E.oracle_sql()
    own = all_queries()
    assert len(own) == 86 and set(own) == set(all_oracles()) and set(own) <= set(q) and set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    assert all(isinstance(sql, str) and sql.strip() for sql in o.values())
