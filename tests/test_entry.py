"""The driver contract: entry() on sf0.001, queries() and oracle_sql() keys."""

import __spark_entry__ as E


def test_entry_schema_and_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["strategy", "rank", "instruction", "input", "chosen", "rejected"]
    rows = df.collect()
    assert rows and {r["strategy"] for r in rows} == {"symmetric", "next_neighbor"}
    for strategy in ("symmetric", "next_neighbor"):
        ranks = sorted(r["rank"] for r in rows if r["strategy"] == strategy)
        assert ranks == list(range(len(ranks)))


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
