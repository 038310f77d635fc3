import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from curavine.llm import packing, pieces, queries, token_counts

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b ", "▁x", "a▁ b", "日本語のテキスト🙂 \t\n x", "x" * 3000, "ab" * 2000 + " " * 70 + "é", "\x00a", "<s> </s> <0x41> <unk>", "It's <|endoftext|> 12345\n\n  ok", "a b　c", None]


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (10_000, "")]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_tokens int, t string, length string")


def test_pieces_match_the_library(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = documents(spark, sf)
    got = pieces.piece_digests(clashing(spark, rows), MODEL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert pieces.piece_digests(clashing(spark, rows).limit(0), MODEL).count() == 0


def test_pieces_round_trip(spark):
    rows = [(k, t) for k, t in enumerate(ODD)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = pieces.piece_encode(clashing(spark, rows), MODEL)
    assert {r.id: r.ids for r in enc.collect()} == {k: sp.encode(t or "", add_eos=True) for k, t in rows}
    assert {r.id: r.text for r in pieces.piece_decode(enc, MODEL).collect()} == {k: sp.decode(sp.encode(t or "")) for k, t in rows}
    null = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert {r.id: r.text for r in pieces.piece_decode(null, MODEL).collect()} == {1: None, 2: ""}


def test_heap_and_arrays_agree():
    random.seed(4)
    m = pieces.pieces(MODEL)
    parts = [" " * random.randint(1, 3) + "".join(random.choice("thaeriosnd'é日🙂A1.") for _ in range(random.randint(0, 60))) for _ in range(400)]
    assert m._together([p.replace(" ", "▁") for p in parts]) == [m._by_heap(p.replace(" ", "▁")) for p in parts]


def test_marks_make_no_new_parts_of_words():
    words, marks = ["thing", "Été", "und", "日本", "x", "²", "7", "e\u0301"], ["", ",", ".", ".\n", "²", "².", "\x01", ")", "_", "1", "🙂", "  "]
    text = " ".join(a + w + b + v for w in words for v in words for a in marks for b in marks)
    pieces.pieces.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"])
    (got,) = pieces._digests(MODEL)(iter([batch]))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = sp.encode(text, add_eos=True)
    row = got.to_pylist()[0]
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert len(pieces.pieces(MODEL).seen) < 1_500  # of 9,216 words with marks


def test_a_wrong_encoder_is_noticed(monkeypatch):
    m = pieces.Pieces(MODEL)
    monkeypatch.setattr(m, "encode_parts", lambda parts: [[5] for _ in parts])
    with pytest.raises(AssertionError):
        m.learn([" hello"])


def test_trees_follow_edits():
    random.seed(3)
    tk = tokenizers.Tokenizer.from_file(BYTES)
    full = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    fast = lambda t: len(token_counts.token_ids(BYTES, t)) if t else 0
    pool = ["a", " ", "  ", "\n", "é", "word", " word", "'s", "1", "12", "!", " <|endoftext|>", "\t", "日本", "🙂"]
    for _ in range(120):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 120)))
        tree = token_counts.TokenTree(text, fast, random.choice([3, 10, 40]))
        for _ in range(10):
            pos, delete, insert = random.randint(0, len(text) + 2), random.choice([0, 1, 3, 20]), "".join(random.choice(pool) for _ in range(random.choice([0, 1, 4, 30])))
            at = min(pos, len(text))
            text = text[:at] + insert + text[at + delete :]
            tree.edit(pos, delete, insert)
            assert tree.text() == text and tree.n_tokens == full(text) and tree.n_chars == len(text)


def test_only_touched_regions_are_encoded_again():
    fast = lambda t: len(token_counts.token_ids(BYTES, t)) if t else 0
    tree = token_counts.TokenTree("some words here " * 5000, fast)
    tree.edit(40_000, 3, "new")
    assert 0 < tree.encoded < 3 * token_counts.LEAF_CHARS


def test_redacted_counts(spark, sf):
    tk = tokenizers.Tokenizer.from_file(BYTES)
    rows = documents(spark, sf) + [(1, "mail a.b@c.de and 12345678 or x@y, a@b.c@d.e"), (2, "@ @. 1234567")]
    got = token_counts.token_counts(clashing(spark, rows), BYTES).collect()
    want = []
    for i, t in rows:
        t = t or ""
        edited = t
        for a, n, to in token_counts.redactions(t):
            edited = edited[:a] + to + edited[a + n :]
        count = lambda x: len(tk.encode(x, add_special_tokens=False).ids)
        want.append((str(i), count(t), count(edited), len(edited)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in got) == sorted(want)
    assert token_counts.redactions("mail a.b@c.de, 12345678")[0] == (15, 8, "<number>")
    assert token_counts.token_counts(clashing(spark, rows).limit(0), BYTES).count() == 0


def test_given_edits(spark):
    docs = clashing(spark, [(1, "hello world"), (2, None), (3, "kept")])
    edits = spark.createDataFrame([(1, 2, 5, 6, None), (1, 1, 0, 0, "oh "), (2, 1, 9, 9, "new"), (8, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq int, pos int, delete int, insert string")
    got = {r.doc_id: r.text for r in token_counts.edited_counts(docs, edits, BYTES).collect()}
    assert got == {1: "oh herld", 2: "new", 3: "kept"}


def check_packed(found, texts, window):
    tk = tokenizers.Tokenizer.from_file(BYTES)
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in found:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for spans, total in [(by_doc[i], len(ids[i])) for i in ids] + [(s, None) for s in by_seq.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= window
    return [sum(n for _, n in s) for s in by_seq.values()]


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_covers_every_token(spark, sf, window):
    rows = {i: t for i, t in documents(spark, sf) if i is not None and i < 10_014}
    found = packing.pack(clashing(spark, list(rows.items())), BYTES, window=window).collect()
    sizes = check_packed(found, rows, window)
    assert sum(s < window for s in sizes) <= 1  # only the last sequence isn't full
    assert sorted({r.sequence_id for r in found}) == list(range(len(sizes)))


def test_packing_edges(spark):
    df = clashing(spark, [(None, "a"), (None, "a"), (1, None), (1, "")])
    found = packing.pack(df, BYTES).collect()
    assert len(found) == 4 and sum(r.length for r in found) == 6
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_least_squares_plan():
    rng = np.random.default_rng(1)
    h = np.zeros(2049, np.int64)
    for n in rng.integers(1, 2048, 200_000):
        h[n] += 1
    plan = packing.solve(h, 2048)
    used = np.zeros_like(h)
    for combo, n in plan:
        assert sum(combo) == 2048 and n > 0
        for c in combo:
            used[c] += n
    assert (used <= h).all() and used.sum() > 0.9 * h.sum()
    assert packing.solve(np.zeros(2049, np.int64), 2048) == []


def test_full_queries_have_all_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op3_token_counts(spark, sf).count() == queries.op4_sentencepiece(spark, sf).count() == n
    assert queries.op6_packing(spark, sf).selectExpr("count(distinct doc_id)").first()[0] == n


def test_very_long_runs_of_white_space(spark):
    """The faster tokenizer's matcher fails on these; results are those of the tokenizers library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" " * 3_000_000, "a" + "\n" * 1_200_000 + "b", "x" * 1_000_000]
    want = [len(packing._tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert [got[i] for i in range(3)] == want
    packed = {r.doc_id: r.doc_tokens for r in packing.pack(docs, path).collect()}
    assert [packed[i] for i in range(3)] == [n + 1 for n in want]


def test_many_redactions_take_time_in_proportion():
    """Numbers and addresses are met in one pass: 50,000 edits of one text."""
    import time

    text = lambda n: " ".join(f"a{k}@b.example 12345678{k % 10} x+1@c.de9999999" for k in range(n))
    by_pairs = []
    mails = [(m.start(), m.end()) for m in re.finditer(r"[\w.+-]+@[\w.-]+", text(50))]
    for m in re.finditer(r"\d{7,}", text(50)):
        if not any(a < m.end() and m.start() < b for a, b in mails):
            by_pairs.append((m.start(), m.end() - m.start(), "<number>"))
    assert [e for e in token_counts.redactions(text(50)) if e[2] == "<number>"] == by_pairs[::-1]
    start = time.process_time()
    token_counts.redactions(text(2_000))
    small = time.process_time() - start
    start = time.process_time()
    assert len(token_counts.redactions(text(17_000))) > 50_000 - 1
    assert time.process_time() - start < 8.5 * 4 * max(small, 0.02)


def test_what_is_remembered_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 200_000)
    model = pieces.Pieces(MODEL)
    for k in range(60):
        model.learn([" " + chr(0x4E00 + (k * 37 + i) % 5000) * 300 + str(i) for i in range(10)])
        assert len(model.seen) <= 70 and len(model.before) <= 70
    long_text = "".join(chr(0x4E00 + i * 7 % 9000) for i in range(200_000))
    model.learn([" " + long_text])
    model.learn([" next"])
    assert len(model.seen) == 1 and model.seen[" next"][1] == " next"
