from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.operators import rolling


def brute(rows, periods, last):
    day, first = defaultdict(int), {}
    for e, d, v in rows:
        if e is not None and d is not None and d <= last:
            day[e, d] += max(v or 0, 0)
            first[e] = min(first.get(e, d), d)
    return {(e, d): tuple(sum(day.get((e, d - i), 0) for i in range(p)) for p in periods) for e, f in first.items() for d in range(f, last + 1)}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(100, 150)), st.one_of(st.none(), st.integers(-5, 9))), max_size=30))
def test_like_brute_force(frame, rows):
    df = frame(rows, "e string, day int, v bigint").withColumn("first", F.lit("clash")).withColumn("entity", F.lit("clash"))
    got = rolling.rolling_totals(rolling.daily_totals(df, "e", F.col("day"), ["v"]), ["v"], 150, (7, 30))
    assert {(r.entity, r.day): (r.v_7, r.v_30) for r in got.collect()} == brute(rows, (7, 30), 150)


def test_edges(frame):
    empty = frame([], "e string, d int, v bigint")
    assert rolling.rolling_totals(rolling.daily_totals(empty, "e", F.col("d"), ["v"]), ["v"], None).count() == 0
    rows = frame([("a", 1, 10), ("a", 1, 10), ("a", 30, 30), ("b", 40, None), (None, 3, 1), ("c", None, 1)], "e string, d int, v bigint")
    got = {(r.entity, r.day): r for r in rolling.rolling_totals(rolling.daily_totals(rows, "e", F.col("d"), ["v"]), ["v"], 40).collect()}
    assert len(got) == 41 and got["a", 1].v_7 == 20 and got["a", 8].v_7 == 0 and got["a", 30].v_30 == 50 and got["a", 31].v_30 == 30
    assert got["a", 36].v_avg_7 == 30 / 7 and got["b", 40].v_30 == 0 and got["a", 30].days_seen == 30
    hot = rolling.surges(rolling.rolling_totals(rolling.daily_totals(rows, "e", F.col("d"), ["v"]), ["v"], 40), ["v"], 7, 30, 70)
    assert sorted((r.entity, r.day) for r in hot.collect()) == [("a", d) for d in range(31, 37)]  # on day 30 it is 30 of 50


def test_no_shuffle_after_the_entity_is_partitioned(frame):
    df = frame([("a", 1, 1)], "e string, d int, v bigint")
    plan = rolling.rolling_totals(rolling.daily_totals(df, "e", F.col("d"), ["v"]), ["v"], 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by entity and day, and by entity
