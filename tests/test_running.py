"""Running numbers and sums over ranges, and the rows of one large key in several tasks."""

import random

from pyspark.sql import functions as F

from curavine.operators import keys, running


def loop(rows, value=lambda r: 1):
    """Running sums of (key, order, ...) rows by key, in order."""
    total, out = {}, []
    for r in sorted(rows, key=lambda r: r[1]):
        total[r[0]] = total.get(r[0], 0) + value(r)
        out.append((r[0], r[1], total[r[0]]))
    return sorted(out, key=str)


def test_numbers_equal_a_loop(spark):
    random.seed(4)
    places = random.sample(range(10_000), 2000)
    rows = [(random.choice(["hot"] * 8 + [None, "", "a", "b"]), p, random.choice([0, 1, None])) for p in places]
    df = spark.createDataFrame(rows, "k string, ord long, v long")
    for ranges in (1, 7):
        got = running.numbered_within(df, ["k"], ["ord"], ranges=ranges)
        assert got.columns == ["k", "ord", "v", "number"]
        assert sorted(((r.k, r.ord, r.number) for r in got.collect()), key=str) == loop(rows)
        got = running.running_sums(df, ["k"], ["ord"], {"s": F.col("v"), "n": F.lit(1)}, ranges=ranges)
        assert got.columns == ["k", "ord", "v", "s", "n"]
        found = got.collect()
        assert sorted(((r.k, r.ord, r.s) for r in found), key=str) == loop(rows, lambda r: r[2] or 0)
        assert sorted(((r.k, r.ord, r.n) for r in found), key=str) == loop(rows)


def test_numbers_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(5 - i % 3, i) for i in range(30)], "a int, b int")
    got = [(r.a, r.b) for r in running.numbered_within(df, [], ["a", F.col("b").desc()], ranges=4).orderBy("number").collect()]
    assert got == sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (r[0], -r[1]))
    assert running.numbered_within(df.limit(0), ["a"], ["b"]).count() == 0
    assert running.running_sums(df.limit(0), [], ["b"], {"s": F.lit(1)}).count() == 0


def test_one_key_is_shared_out(spark):
    """With one key over all rows, ranges get like shares of it, and no window sees more than one of them."""
    df = spark.range(40_000).select(F.lit("all").alias("k"), F.col("id").alias("ord"))
    shares = [r["count"] for r in running._ordered(df, ["k"], ["ord"], 8).groupBy("__run_range").count().collect()]
    assert len(shares) == 8 and max(shares) < 1.5 * 40_000 / 8
    out = keys.seen_before(df, "k", "ord")
    assert out.agg(F.sum(F.abs(F.col("seen") - F.col("ord")))).first()[0] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "sum(__run_n" in plan  # the only window is over ranges
    ranked = keys.running_count(df, ["k"], "ord", F.col("ord") % 3 == 0, "n")
    assert ranked.agg(F.sum(F.abs(F.col("n") - (F.floor(F.col("ord") / 3) + 1)))).first()[0] == 0
