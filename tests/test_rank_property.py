"""Property: the bucketed global rank equals Python's sort, whatever the score distribution."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prefspark.operators.rank import rank_by_score

SCORES = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, -2.0, math.inf, -math.inf, math.nan]),
                   st.floats(allow_nan=False, width=32))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores=st.lists(SCORES, max_size=300), buckets=st.integers(2, 9))
def test_rank_matches_python_sort(spark, scores, buckets):
    rows = [(i, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "id long, score_datainf double")
    got = {r["id"]: r["rank"] for r in rank_by_score(df, buckets=buckets).collect()}

    def key(row):
        i, s = row
        missing = s is None or math.isnan(s)
        return (missing, 0.0 if missing else -s, i)
    want = {i: r for r, (i, _) in enumerate(sorted(rows, key=key))}
    assert got == want
