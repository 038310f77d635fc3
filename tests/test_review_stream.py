"""The review pass on a stream: stopped and resumed as if it hadn't been."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from curavine.streaming import crawl_gate, review

SCHEMA = "url string, n long, checked boolean, plan boolean, hard boolean, rank int"


def pictures(n=60):
    return [(f"u{k % 50}" if k % 13 else "", k, k % 4 == 0, k % 8 == 0, k % 7 == 0, k % 3) for k in range(n)]


def passed(spark, folder, out, most, files=1, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    answers = spark.createDataFrame([(f"u{k}", k % 2 == 0, 0.9 if k % 5 else 0.1) for k in range(40)], "url string, is_plan boolean, confidence double")
    df = review.review_stream(stream, answers, "url", "n", F.col("rank"), F.col("checked"), F.col("plan"), F.col("hard"), most, **how)
    return crawl_gate.run_available(df, out)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def loop(batches, most, keep_unchecked=True):
    asked, out = 0, []
    for rows in batches:
        keys = list(dict.fromkeys(r[0] for r in sorted((r for r in rows if not r[2] and r[0]), key=lambda r: (r[5], r[1]))))[: max(0, most - asked)]
        asked += len(keys)
        for url, n, checked, plan, hard, _ in rows:
            k = int(url[1:]) if url else 99
            ask = not checked and url in keys
            kept = plan if checked else (k % 2 == 0 and k % 5 > 0 and not hard) if ask and k < 40 else keep_unchecked
            out.append((n, ask, kept))
    return sorted(out)


def found(df):
    return sorted((r.n, r.asked, r.kept) for r in df.collect())


def test_a_stopped_pass_goes_on(spark, tmp_path):
    rows = pictures()
    batches = [rows[:20], rows[20:25], rows[25:50], rows[50:]]
    for b in batches:
        put(spark, f"{tmp_path}/whole", b)
    whole = found(passed(spark, f"{tmp_path}/whole", f"{tmp_path}/one", 22))
    for b in batches:  # each run begins where the one before has stopped
        put(spark, f"{tmp_path}/parts", b)
        parts = found(passed(spark, f"{tmp_path}/parts", f"{tmp_path}/more", 22))
    assert whole == parts == loop(batches, 22) and sum(a for _, a, _ in whole) >= 22
    again = found(passed(spark, f"{tmp_path}/parts", f"{tmp_path}/more", 22))
    assert again == parts


def test_budgets_of_none_and_of_all(spark, tmp_path):
    put(spark, f"{tmp_path}/in", pictures())
    for most in (0, 1000):
        assert found(passed(spark, f"{tmp_path}/in", f"{tmp_path}/{most}", most, keep_unchecked=False)) == loop([pictures()], most, False)


def most_rows_of_a_task(spark, since):
    """Of the stages from since on: the most rows that a task has got by a shuffle; and the next stage's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    stages = [stages.apply(k) for k in range(stages.size())]
    most = 0
    for s in stages:
        if s.stageId() >= since and s.shuffleReadRecords():
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            done = [tasks.apply(k).taskMetrics() for k in range(tasks.size())]
            most = max([most, *(m.get().shuffleReadMetrics().recordsRead() for m in done if m.isDefined())])
    return most, 1 + max((s.stageId() for s in stages), default=-1)


def test_no_task_gets_a_batch_as_a_whole(spark, tmp_path):
    n = 6000
    rows = [(f"u{k}", k, k % 4 == 0, k % 8 == 0, k % 7 == 0, k % 3) for k in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    _, since = most_rows_of_a_task(spark, 0)
    assert found(passed(spark, f"{tmp_path}/in", f"{tmp_path}/run", 5, files=100)) == loop([rows], 5)
    assert most_rows_of_a_task(spark, since)[0] < n / 2


def test_first_keys_are_those_of_a_sort(spark):
    rng = random.Random(4)
    for keys, n in ((3, 40), (30, 300), (400, 500)):
        rows = [(f"k{rng.randrange(keys)}", rng.choice([-1, 0, 5, 2**31 - 1]), rng.choice([None, 2**53, 2**53 + 1, *range(20)])) for _ in range(n)]
        df = spark.createDataFrame(rows, "__key string, __priority int, __place long").repartition(3)
        best = {}
        for k, p, at in rows:
            best[k] = min(best.get(k, (p, at is None, at or 0)), (p, at is None, at or 0))
        for most in (0, 1, 7, 29, 1000):
            assert [r[0] for r in review.first_keys(df, most).collect()] == sorted(best, key=lambda k: (best[k], k))[:most]


def test_places_beyond_what_doubles_hold(spark, tmp_path):
    rows = [(f"u{50 - k}", 2**60 + k, False, False, False, 0) for k in range(40)]
    put(spark, f"{tmp_path}/in", rows[::-1])
    assert found(passed(spark, f"{tmp_path}/in", f"{tmp_path}/run", 9)) == loop([rows], 9)


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    rows = pictures()
    for b in (rows[:20], rows[20:40], rows[40:]):
        put(spark, f"{tmp_path}/in", b)
    once = found(passed(spark, f"{tmp_path}/in", f"{tmp_path}/run", 22))
    assert once == loop([rows[:20], rows[20:40], rows[40:]], 22)
    for name in ("2", ".2.crc"):  # as if the driver had died before it noted the last batch
        Path(f"{tmp_path}/run/checkpoint/commits/{name}").unlink()
    assert found(passed(spark, f"{tmp_path}/in", f"{tmp_path}/run", 22)) == once


def test_runs_have_budgets_of_their_own(spark, tmp_path):
    df = spark.createDataFrame(pictures(12), SCHEMA)
    asked = lambda number, run: review.with_budget(df, number, f"{tmp_path}/kept", "url", "n", F.when(~F.col("checked"), F.col("rank")), 3, run).where("asked").count()
    assert [asked(0, "a"), asked(1, "a"), asked(2, "b"), asked(3, "b"), asked(0, "a")] == [3, 0, 3, 0, 3]


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = passed(spark, f"{tmp_path}/in", f"{tmp_path}/run", 5)
    assert out.collect() == [] and out.columns[-4:] == ["asked", "is_plan", "confidence", "kept"]
