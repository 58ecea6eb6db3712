"""Groups that many batches emit again: against plain Python, and without a shuffle of what is laid out."""

import random

from pyspark.sql import functions as F

from brookframe.operators.groups import COUNT, SUM, Agg, group_by, windowed_group_by

SCHEMA = "__partition int, __batch long, __timestamp long, k string, n long"
AGGS = [Agg(COUNT, "n", "c"), Agg(SUM, "n", "total")]


def brute(rows, size=None, retention=None):
    out, state, time = [], {}, {}
    for p, b in sorted({(r[0], r[1]) for r in rows}):
        poll = [r for r in rows if r[:2] == (p, b)]
        time[p] = max([time.get(p, -(1 << 62)), *(r[2] for r in poll)])
        for _, _, t, k, n in poll:
            group = (p, k, t // size * size if size else 0)
            c, total = state.get(group, (0, None))
            state[group] = (c + 1, total if n is None else (total or 0) + n)
        state = {g: v for g, v in state.items() if g[0] != p or not size or g[2] + size >= time[p] - retention}
        out += [(b, g[1], *((g[2], g[2] + size) if size else ()), *v) for g, v in state.items() if g[0] == p]
    return out


def test_against_plain_python(spark):
    dice = random.Random(4)
    rows = [(p, b, 7 * b - 40 - dice.choice([0, 0, 3, 30, 90]), dice.choice(["a", "b", None]), dice.choice([1, 5, None])) for p in (0, 3) for b in (2, 3, 7, 8, 20, 21, 40) for _ in range(dice.randint(1, 6))]
    df = spark.createDataFrame(rows, SCHEMA)
    for got, want in ((windowed_group_by(df, ["k"], 10, AGGS, 25, by_batch=True), brute(rows, 10, 25)), (group_by(df, ["k"], AGGS, by_batch=True), brute(rows))):
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_what_is_emitted_again_is_not_shuffled(spark):
    rows = spark.range(40).select(F.lit(0).alias("__partition"), F.col("id").alias("__batch"), F.lit(5).cast("long").alias("__timestamp"), F.lit("a").alias("k"), F.col("id").alias("n"))
    for got in (windowed_group_by(rows, ["k"], 10, AGGS, by_batch=True), group_by(rows, ["k"], AGGS, by_batch=True)):
        above = got._jdf.queryExecution().sparkPlan().toString().split("Generate explode")
        assert len(above) == 2 and "Sort" not in above[0] and "Window" not in above[0] and got.count() == 40
        executed = got._jdf.queryExecution().executedPlan().toString().split("Generate explode")
        assert "Exchange hashpartitioning" not in executed[0]
