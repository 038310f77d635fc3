import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from curavine.llm import embedding_dedup, exact_dedup, near_dedup, queries
from curavine.llm.common import ROW_KEY, connected_components

from ..compare import same
from .brute import components, near_components, shingle_set

ODD = "doc_id long, text string, id string, t string, level int, name string, sig binary, n int, cid long, kept string"


def odd(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", b"s", 2, 3, "k") for i, t in rows], ODD)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_exact_matches_sql(spark, sf, duck):
    same(queries.op1_exact_dedup(spark, sf), duck.execute(queries.oracle_sql()["op1_exact_dedup"]))


def test_exact_over_many_levels(spark):
    random.seed(1)
    base = ["".join(random.choice("ab") for _ in range(random.choice([0, 1, 3, 4, 5, 63, 64, 65, 200]))) for _ in range(60)]
    rows = [(i, random.choice([t, t.upper(), t + "Ä", t])) for i, t in enumerate(base * 2)]
    rows += [(None, base[0]), (None, "alone"), (500, None), (500, ""), (501, "ÀÉ"), (502, "àé"), (503, "x" * 300_000), (504, "X" * 299_999 + "y"), (505, "X" * 300_000)]
    got = exact_dedup.exact_dedup(odd(spark, rows), block_bytes=4).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    want = sorted((str(i), str(max((x for x in v if x is not None), default=None)), len(v), hashlib.sha256(k).hexdigest()) for k, v in groups.items() for i in v)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert len(kept) == len(groups) and all(len(v) == 1 for v in kept.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(odd(spark, rows).limit(0)).count() == 0


def test_names_do_not_depend_on_hashes(spark, monkeypatch):
    """Blocks that share both hashes are told apart: the salt is changed until none do."""
    real, calls = exact_dedup.F.xxhash64, []

    def weak(*cols):
        calls.append(1)
        return real(*cols) if len(calls) > 8 else exact_dedup.F.lit(1).cast("long")

    monkeypatch.setattr(exact_dedup.F, "xxhash64", weak)
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_size for r in got} == {1: 2, 2: 1, 3: 2}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_matches_brute_force(spark, sf, percent):
    docs = documents(spark, sf)
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(6):  # chains of edits around the threshold
        own = [random.choice(vocabulary) for _ in range(random.choice([12, 40, 150]))]
        for k in range(12):
            docs.append((10_000 + 100 * g + k, " ".join(own)))
            for _ in range(max(1, len(own) // 60)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
    docs += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "One two"), (20_004, "one  TWO"), (20_005, "one two"), (20_006, "w " * 50_000), (20_007, "w " * 49_000), (20_008, "一 二 三 四 五 六")]
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()
    want = near_components(dict(docs), percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingle_set(t)) for r, t in ((r, dict(docs)[r.doc_id]) for r in got))
    assert all(r.kept == (r.doc_id == r.component_id) == r.keeps_row for r in got)


def test_near_repeats_nulls_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (7, text), (7, text), (9, text + " eight"), (None, "only nulls here reach each other now"), (None, "only nulls here reach each other now"), (3, None), (3, None)]
    got = near_dedup.near_dedup(odd(spark, rows), percent=75).collect()
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "7", "7", "7", "7", "None", "None"]
    assert sum(r.keeps_row for r in got) == 4  # one for each group, and each text without words
    assert len({r[ROW_KEY] for r in got}) == len(rows)
    assert near_dedup.near_dedup(odd(spark, rows).limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        n = 3000
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        regs = near_dedup.sketch(np.concatenate((np.sort(a), np.sort(b))), np.array([n, n]))
        found = near_dedup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(found - share) < 4 * np.sqrt(share * (1 - share) / near_dedup.REGISTERS) + 0.01
    far = near_dedup.sketch(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), np.array([100_000, 100_000]))
    assert near_dedup.estimate(far[:1], far[1:], np.array([100_000]), np.array([100_000]))[0] < 0.02


def test_cells_of_blocks_find_what_one_cell_finds(spark, monkeypatch):
    random.seed(8)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for k in range(60):
        own = list(base)
        own[random.randrange(60)] = f"u{k % 20}"
        docs.append((k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = near_components(dict(docs), 85)
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 7)
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df, percent=85).collect()} == want


def test_connected_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    want = components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and {n for n, c in want.items() if n != c} <= set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine):
    good = {}
    for k, (_, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    label = components(range(len(rows)), links)
    least = {}
    for k, c in label.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((str(i), degree[k], str(least.get(label[k]) if k in good else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("blocks", [2048, 9])
def test_embeddings_match_brute_force(spark, sf, monkeypatch, blocks):
    monkeypatch.setattr(embedding_dedup, "GUESTS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for g in range(8):
        centre = rng.standard_normal(64)
        for k in range(12):
            rows.append((10_000 + 20 * g + k, [float(x) for x in (centre + rng.standard_normal(64) * 0.12).astype("float32")]))
    rows += [(1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] * 64), (5, [None] * 64), (None, rows[0][1]), (rows[0][0], rows[0][1]), (6, [1e-30] * 64), (7, [1e30] * 64), (8, [1.0, 2.0]), (9, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vec string, cid int")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_vectors([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 0.95)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_recall_of_embeddings_at_the_threshold():
    """Pairs at a cosine of exactly 0.95 are found by the tables and the counts of the production plan."""
    plan, rng, found = embedding_dedup.Plan(0.95, 64, 50_000), np.random.default_rng(6), 0
    assert plan.cuts > 2
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((3000, 64))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    met = (plan.keys(a) == plan.keys(b)) & (np.abs(a @ plan.sorted - b @ plan.sorted) <= plan.sorted_window)
    counts = (np.abs(a @ plan.counted - b @ plan.counted) <= plan.window).sum(axis=1)
    found = met.any(axis=1) & (counts >= plan.needed)
    assert found.mean() >= 0.995


def test_merging_links_names_components():
    random.seed(5)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(130)]
    tie = np.arange(200)
    for k in range(0, 130, 40):
        part = np.array(links[k : k + 40])
        embedding_dedup._merge(tie, part[:, 0], part[:, 1])
    assert dict(enumerate(tie.tolist())) == components(range(200), links)


def _alike(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_words_that_a_polynomial_hash_confuses_are_told_apart(spark):
    """The Thue-Morse word and its complement agree in any polynomial hash modulo a power of two."""
    pairs = []
    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        pairs += ["".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)]
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_links_hold_on_true_shingles(spark, monkeypatch):
    """Where all hashes agree, every pair is a candidate; only those whose words agree are linked."""
    monkeypatch.setattr(near_dedup.tc, "shingles", lambda words, counts, k: (np.full(len(counts), 7, np.uint64), np.ones(len(counts), np.int64)))
    batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array([1, 1]), near_dedup.pa.array([2, 3]), near_dedup.pa.array([b"a b c d e f"] * 2), near_dedup.pa.array([b"a b c d e g", b"a b  c d e f"])], names=["a", "b", "x", "y"])
    out = list(near_dedup._confirmed(80, 5)([batch]))
    assert [b.to_pylist() for b in out] == [[{"a": 1, "b": 3}]]


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, near_dedup.near_dedup])
def test_partitions_of_a_scan_do_not_matter(spark, sf, operator):
    """A table that is cut otherwise, as when executors come or go, gives the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _alike(operator(docs.repartition(7, "source")).drop(ROW_KEY), operator(docs.coalesce(1)).drop(ROW_KEY))
