from collections import defaultdict

import corpus_pipeline as cp

from .brute import near_components


def test_stages_do_what_they_say(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "123 456 ...", "en", "s", 11), (90_002, None, "en", "s", 0), (90_003, "The of and that with by are was", "en", "s", 30), (90_003, "The of and that with by are was", "en", "s", 30)], docs.schema)
    docs.unionByName(extra).write.parquet(f"file://{tmp_path}/0")
    at, kept = docs, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        at = spark.read.parquet(f"file://{tmp_path}/{k}")
        stage(spark, at, sf).write.parquet(f"file://{tmp_path}/{k + 1}")
        kept[name] = spark.read.parquet(f"file://{tmp_path}/{k + 1}")
        if k < len(cp.STAGES) - 1:
            assert kept[name].columns == docs.columns
    first = [(r.doc_id, r.text) for r in kept["language id"].collect()]
    assert len(first) == docs.count() + 2 and not {90_001, 90_002} & {i for i, _ in first}
    groups = defaultdict(list)
    for i, t in first:
        groups[t.encode().lower()].append(i)
    second = {r.doc_id: r.text for r in kept["exact dedup"].collect()}
    assert sorted(second) == sorted(max(v) for v in groups.values()) and kept["exact dedup"].count() == len(groups)
    label = near_components(second, cp.NEAR_PERCENT)
    third = {r.doc_id: r.text for r in kept["minhash near-dedup"].collect()}
    assert sorted(third) == sorted(set(label.values()))
    packed = kept["packing"].collect()
    assert {r.doc_id for r in packed} == set(third)


def test_run_gives_the_last_stage(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_and_on_empty_tables(spark, sf):
    """Null and repeated ids, columns whose names clash with the operators' own, and no rows at all."""
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    rows = [(None, text), (None, text), (1, text.upper()), (1, None), (2, ""), (2, text + "once more today"), (None, "another text that is like no other one " * 4), (3, "12 34")]
    schema = "doc_id long, text string, id string, t string, level int, name string, kept string, component_id long, length int, lang string, source string"
    odd = spark.createDataFrame([(i, t, "x", "y", 1, "z", "k", 5, 9, "en", None) for i, t in rows], schema)
    own = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(cp.STAGES)
    exact = stages["exact dedup"](spark, odd, sf)
    assert exact.columns == odd.columns
    got = own(exact)
    # of equal texts the largest id stays; null and empty texts are equal
    assert got == sorted([(1, text.upper()), (2, ""), (2, text + "once more today"), (None, "another text that is like no other one " * 4), (3, "12 34")], key=str) and {tuple(r)[2:] for r in exact.collect()} == {("x", "y", 1, "z", "k", 5, 9, "en", None)}
    near = stages["minhash near-dedup"](spark, odd, sf)
    left = [t for _, t in own(near)]
    assert near.columns == odd.columns and len(left) == 5 and sum(bool(t) and t.lower().startswith("the quick") for t in left) == 1 and sum(not t for t in left) == 2
    assert stages["packing"](spark, odd, sf).count() == len(rows)
    assert stages["language id"](spark, odd, sf).columns == odd.columns
    none = odd.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0, name
