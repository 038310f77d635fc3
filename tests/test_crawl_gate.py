"""State by key on streams: marks of what is known, and back-offs that timers end."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curavine.streaming import crawl_gate

T0 = datetime(2024, 1, 1)
VISIT = "k string, id long, t timestamp, ok boolean, why string"
HOURS = {"captcha": 72.0, "soon": 0.5}


def visits(seed, n=200):
    random.seed(seed)
    times = sorted(random.choices(range(0, 20 * 24 * 60), k=n))
    return [(random.choice(["a", "b", "ü", "c"]), i, T0 + timedelta(minutes=m), random.random() < 0.5, random.choice(["captcha", "soon", "http", None])) for i, m in enumerate(times)]


def put(spark, rows, folder, schema=VISIT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def by_loop(rows, known=()):
    """Admitted, failures and end of each visit, and the ends that are over at the last visit's time."""
    state, out, due = dict(known), {}, []
    end = max(r[2] for r in rows)
    for k, i, t, ok, why in sorted(rows, key=lambda r: (r[2], r[1])):
        failures, until = state.get(k, (0, None))
        if until is not None and t < until:
            out[i] = (False, failures, until)
            continue
        failures, until = (0, None) if ok else (failures + 1, t + timedelta(hours=HOURS.get(why, 24)))
        state[k] = failures, until
        out[i] = True, failures, until
    return out, {k: u for k, (_, u) in state.items() if u is not None and u <= end}


def gate(spark, folder, files=1, **how):
    stream = spark.readStream.schema(VISIT).option("maxFilesPerTrigger", files).parquet(folder)
    return crawl_gate.back_off(stream, "k", "id", "t", F.col("ok"), F.col("why"), HOURS, **how)


def seen(out):
    rows = out.collect()
    return {r.visit: (r.admitted, r.failures, r.until) for r in rows if r.kind == "visit"}, [r for r in rows if r.kind == "due"]


def test_back_off_in_one_run_and_after_restarts(spark, tmp_path):
    rows = visits(1)
    want, over = by_loop(rows)
    put(spark, rows, f"{tmp_path}/whole")
    whole, due = seen(crawl_gate.run_available(gate(spark, f"{tmp_path}/whole"), f"{tmp_path}/one"))
    assert whole == want and {r.k: r["at"] for r in due} == over
    for a, b in ((0, 60), (60, 61), (61, 200)):  # each run takes up where the one before ended
        put(spark, rows[a:b], f"{tmp_path}/parts")
        parts, due = seen(crawl_gate.run_available(gate(spark, f"{tmp_path}/parts"), f"{tmp_path}/more"))
    assert parts == want
    assert {(r.k, r["at"]) for r in due} >= set(over.items()) and len({(r.k, r["at"]) for r in due}) == len(due)  # each end once


def test_back_off_begins_with_states(spark, tmp_path):
    rows = [("a", 1, T0, True, None), ("a", 2, T0 + timedelta(hours=5), True, None), ("b", 3, T0 + timedelta(hours=6), False, "soon"), ("c", 4, T0 + timedelta(hours=7), False, None)]
    put(spark, rows, f"{tmp_path}/in")
    known = {"a": (2, T0 + timedelta(hours=3)), "b": (4, None)}
    states = spark.createDataFrame([(k, f, u) for k, (f, u) in known.items()], "k string, failures int, next_crawl_after timestamp")
    got, _ = seen(crawl_gate.run_available(gate(spark, f"{tmp_path}/in", states=states), f"{tmp_path}/run"))
    assert got == by_loop(rows, known)[0] and got[1][:2] == (False, 2) and got[3][1] == 5


def test_the_clock_ends_a_back_off(spark, tmp_path):
    put(spark, [("a", 1, T0, False, "soon")], f"{tmp_path}/in")
    stream = spark.readStream.schema(VISIT).parquet(f"{tmp_path}/in")
    out = crawl_gate.back_off(stream, "k", "id", "t", F.col("ok"), F.col("why"), {"soon": 2 / 3600}, by_clock=True)
    run = out.writeStream.format("memory").queryName("clocked").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        rows = lambda kind: spark.sql(f"SELECT * FROM clocked WHERE kind = '{kind}'").collect()
        for _ in range(160):
            time.sleep(0.5)
            if rows("due"):
                break
        assert [(r.visit, r.admitted) for r in rows("visit")] == [(1, True)] and len(rows("due")) == 1
        put(spark, [("a", 2, T0, True, None)], f"{tmp_path}/in")
        for _ in range(160):
            time.sleep(0.5)
            if len(rows("visit")) == 2:
                break
        assert {r.visit: (r.admitted, r.failures) for r in rows("visit")} == {1: (True, 1), 2: (True, 0)}
    finally:
        run.stop()


def test_news_of_batches_and_of_restarts(spark, tmp_path):
    schema = "n int, _k string, t timestamp"
    batches = [[(1, "a", T0), (2, "a", T0 - timedelta(days=1)), (3, "b", None), (4, None, T0)], [(5, "a", T0), (6, "a", T0 + timedelta(microseconds=1)), (7, "b", T0), (8, None, T0)], [(9, "a", T0), (10, "b", T0 - timedelta(days=1)), (11, "c", T0), (12, "b", None)]]
    marks = spark.createDataFrame([("c", T0), ("d", T0)], "_k string, watermark timestamp")
    for begin, name, want in ((None, "none", [1, 2, 3, 4, 6, 7, 11, 12]), (marks, "marks", [1, 2, 3, 4, 6, 7, 12])):
        for rows in batches:
            put(spark, rows, f"{tmp_path}/{name}", schema)
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
            out = crawl_gate.run_available(crawl_gate.news(stream, "_k", "t", begin), f"{tmp_path}/{name}-run")
        assert sorted(r.n for r in out.collect()) == want
        assert out.where("n = 6").first().t == T0 + timedelta(microseconds=1)
