import re
import time
import zlib

import numpy as np
import pytest

from curavine.llm import chat, html_text, language, lm, queries

from ..compare import same
from .brute import Backoff
from .brute import lm as brute_lm


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2.0) for i, t, lang in rows], "doc_id long, text string, lang string, n int, t string, score double")


@pytest.mark.parametrize(("chunk", "least"), [(8_000_000, 4), (3_000, 1)])
def test_scores_match_brute_force(spark, sf, monkeypatch, chunk, least):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9001, None, None), (9002, "", None), (9003, "zzz qqq", None), (9004, "y " * 5000, None), (9005, "y y y", None)]
    got = lm.score(clashing(spark, rows), least=least).collect()
    want = brute_lm([(i, t) for i, t, _ in rows], lm.DISCOUNT, least)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_chunks")]


def test_model_beats_its_base(spark, sf):
    got = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_score_edges(spark):
    one = lm.score(clashing(spark, [(None, "a b", None), (None, "a b", None)])).collect()
    assert len(one) == 2 and one[0].n_tokens == 3 and one[0].train_tokens == 6
    assert lm.score(clashing(spark, []).limit(0)).count() == 0
    out = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    r = lm.score(clashing(spark, [(out, "a", None)])).first()  # nothing to train on
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0


def test_scores_do_not_depend_on_the_partitions_of_a_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in lm.score(d).collect()) for d in (docs.coalesce(1), docs.repartition(7, "source")))
    assert one == many


def test_probabilities_of_every_state_sum_to_one(spark):
    """Scores of one-word continuations of a history, that of an unknown word among them, share out the whole mass."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, ["a b c a b", "b c", "a b d", "c a b c", "d"][k % 5], None) for k, i in enumerate(train)]
    out = [i for i in range(100, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    words = ["a", "b", "c", "d", "unknown", ""]
    for history in ("", "a", "b", "a b", "b c", "c a", "d d", "unknown a"):
        # the probability of a word after the history, from the scores of texts with and without it
        probe = [(i, f"{history} {w}", None) for i, w in zip(out, words)] + [(out[10], f"{history} a q", None)]
        got = {r.doc_id: r.score for r in lm.score(clashing(spark, rows + probe)).collect()}
        model = Backoff([(i, t) for i, t, _ in rows], lm.DISCOUNT, lm.LEAST)
        own = tuple(["start", *(w.encode() for w in history.split())][-2:])
        assert sum(model.p(w, own) for w in [*model.c, b"unknown"]) == pytest.approx(1.0)
        want = brute_lm([(i, t) for i, t, _ in rows + probe], lm.DISCOUNT, lm.LEAST)
        assert all(got[i] == pytest.approx(want[i][4], rel=1e-9) for i in got)


def test_languages_of_held_out_texts(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.selectExpr("avg(int(lang_pred = lang))", "count(*)").first()
    assert n > 100 and right > 0.97
    assert found.where("rejected").count() == 0
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_language_edges(spark):
    en, de = "the house and the garden of the town ", "das haus und der garten von der stadt "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!! ::", None), (103, "the", None), (None, en, None), (104, en * 20_000, None), (103, "the", None), (105, "x\0y the house", None), (106, "½ ² ৬ Ⅷ", "de")]
    got = language.identify(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == by[106].lang_pred == "und" and by[102].rejected and by[102].score == 0.0
    assert by[104].lang_pred == "en" and by[None].lang_pred == "en" and not by[103].rejected
    assert all(0 <= r.score <= 1 for r in got)
    far = language.identify(clashing(spark, rows + [(200, "ξψφ" * 400, None)])).where("doc_id = 200").first()
    assert far.rejected
    none = language.identify(clashing(spark, [(1, "text", None)])).first()
    assert none.lang_pred == "und" and none.rejected
    assert language.identify(clashing(spark, rows).limit(0)).count() == 0


def brute_language(model, text):
    """Language and cosine of a text, from runs of three bytes counted one by one."""
    raw = text.lower().replace("\0", " ").encode("utf-8", "replace")
    raw = re.sub(b" +", b" ", b" " + bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in raw) + b" ")
    n = np.zeros(language.FEATURES)
    for i in range(len(raw) - 2):
        n[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> 20] += 1
    x = np.log1p(n) * model.idf
    cosines = model.centres @ (x / max(np.linalg.norm(x), 1e-12))
    return model.languages[model.owner[cosines.argmax()]], cosines.max()


def test_predictions_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.identify(docs, model=model).collect():
        lang, cosine = brute_language(model, texts[r.doc_id] or "")
        assert r.lang_pred == lang and r.score == pytest.approx(min(max(cosine, 0), 1), abs=1e-5)


def test_repeated_rows_do_not_widen_the_sample(spark):
    rows = [(None, "the house and the town", "en")] * 3000 + [(i, f"das haus und die stadt {i}", "de") for i in range(50)]
    model = language.fit(clashing(spark, rows), per_language=10_000)
    assert model.languages == ["de", "en"] and len(model.centres) == 5  # one distinct English text


def test_language_does_not_read_labels_of_held_out_rows(spark):
    rows = [(i, "the house and the town " * 3, "en") for i in range(200)]
    model = language.fit(clashing(spark, rows))
    import zlib

    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    assert language.fit(clashing(spark, other)).languages == model.languages == ["en"]


def many_languages(labels, texts):
    """Rows of invented languages, each with 40 words of its own."""
    rows = []
    for k in range(labels):
        rng = np.random.default_rng(k)
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)]
        rows += [(k * texts + i, " ".join(rng.choice(words, 60)), f"x{k:04}") for i in range(texts)]
    return rows


def test_every_language_is_learned(spark):
    rows = many_languages(600, 6)
    docs = clashing(spark, rows)
    model = language.fit(docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learned) > 590 and model.languages == sorted(learned)
    of = {i: lang for i, _, lang in rows}
    got = [r for r in language.identify(docs, model=model).collect() if of[r.doc_id] in learned]
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 1000 and sum(r.lang_pred == of[r.doc_id] for r in unseen) > 0.98 * len(unseen)
    assert not any(r.rejected for r in got)


def test_long_texts_of_languages_with_few_short_ones_are_kept(spark):
    rows = [(i, t[:80], lang) for i, t, lang in many_languages(40, 6)]
    model = language.fit(clashing(spark, rows))
    long = [(10_000 + i, " ".join(x for j, x, y in many_languages(40, 6) if y == lang), lang) for i, lang in enumerate(model.languages)]
    got = language.identify(clashing(spark, long), model=model).collect()
    assert [r.lang_pred for r in got] == model.languages and not any(r.rejected for r in got)


def test_chat_matches_sql(spark, sf, duck):
    same(queries.op9_chat_format(spark, sf), duck.execute(queries.oracle_sql()["op9_chat_format"]))


def test_chat_runs_no_python(spark, sf):
    plan = queries.op9_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


CHAT = "conv_id long, turn long, role string, text string, id string, kind string, status int"


def chats(spark, rows, schemas=None):
    return chat.format_chat(spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], CHAT), schemas)


def test_items_of_a_message_keep_their_order(spark):
    calls = '{"tool_calls":[{"id":"b","name":"add"},{"id":"a","name":"add"},{"id":"c","name":"add"}],"content":"hm"}'
    rows = [(1, 3, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"a"}'), (1, 2, "tool", '{"tool_call_id":"a"}'), (1, 1, "tool", '{"tool_call_id":"c"}')]
    got = sorted((r.order_turn, r.order_step, r.kind, r.id, r.status) for r in chats(spark, rows).collect())
    assert [g[2:4] for g in got] == [("call", "b"), ("call", "a"), ("result", "a"), ("result", "a"), ("call", "c"), ("result", "c"), ("message", None)]
    assert {g[0] for g in got} == {3} and got[2][4] == "ambiguous"


def test_calls_come_after_the_results_that_they_use(spark):
    call = lambda i, *uses: '{"id":"%s","name":"add","arguments":{%s}}' % (i, ",".join(f'"x{k}":["${u}"]' for k, u in enumerate(uses)))
    said = lambda *calls: '{"tool_calls":[%s]}' % ",".join(calls)
    rows = [(1, 1, "assistant", said(call("a", "b"), call("c", "a", "b"))), (1, 2, "assistant", said(call("b"), call("self", "self"))), (1, 3, "tool", '{"tool_call_id":"b"}'), (1, 4, "tool", '{"tool_call_id":"a"}'), (1, 0, "tool", '{"tool_call_id":"c"}')]
    rows += [(2, 1, "assistant", said(call("p", "q"), call("q", "p"), call("r", "q"), call("s", "nobody"))), (3, 1, "assistant", said(call("a")))]
    got = chats(spark, rows).collect()
    at = {(r.conv_id, r.kind, r.id): (r.order_turn, r.order_step, r.order_depth) for r in got}
    order = [at[1, k, i] for k, i in (("call", "b"), ("result", "b"), ("call", "a"), ("result", "a"), ("call", "c"), ("result", "c"))]
    assert order == sorted(set(order)) and at[1, "result", "b"] == (3, 0, 0) and at[1, "result", "a"] == (4, 0, 0)
    status = {(r.conv_id, r.id): r.status for r in got if r.kind == "call"}
    assert status[1, "self"] == status[2, "p"] == status[2, "q"] == status[2, "r"] == "cyclic"
    assert status[2, "s"] == status[3, "a"] == "open" and status[1, "c"] == "answered" and at[2, "call", "q"] == (1, 2, 0)


def test_tool_calls_are_linked_ordered_and_checked(spark):
    schemas = {"add": {"x": {"type": "number", "required": True}, "y": {"type": "integer", "required": True, "maximum": 1}, "how": {"type": "string", "enum": ["fast", "slow"]}}}
    calls = '{"tool_calls":[{"id":"a","name":"add","arguments":{"y":2,"x":1.50}},{"id":"b","name":"add","arguments":"{\\"x\\":\\"q\\",\\"how\\":\\"odd\\"}"},{"id":"c","name":"zap","arguments":5},{"id":"d","name":"add","arguments":{"y":1,"x":3}}],"content":"hm"}'
    rows = [(1, 3, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 5, "tool", '{"tool_call_id":"zz"}'), (1, 6, "tool", '{"tool_call_id":"d"}'), (1, 7, "tool", '{"tool_call_id":"d"}')]
    got = {(r.kind, r.id, r.turn): r for r in chats(spark, rows, schemas).collect()}
    a = got["call", "a", 3]
    assert a.status == "answered" and a.problems == "y: too large" and not a.valid
    assert a.json == '{"arguments":{"x":1.5,"y":2},"conversation":1,"id":"a","kind":"call","name":"add","role":"assistant","status":"answered","turn":3}'
    assert got["call", "b", 3].problems == "how: not allowed; x: not of type number; y: missing"
    assert got["call", "c", 3].problems == "unknown tool"
    assert got["call", "d", 3].status == got["result", "d", 6].status == "ambiguous"
    early = got["result", "a", 2]
    assert (early.order_turn, early.order_step) == (3, 1) and (a.order_turn, a.order_step) == (3, 0)
    assert got["result", "zz", 5].status == "orphan" and got["message", None, 3].status == "plain"


def test_chat_edges(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "{broken"), (2, None, "user", None), (None, 1, "user", "x"), (3, 1, None, '\u0001 é"\\/\n'), (4, 1, "user", "twice"), (4, 1, "user", "twice"), (4, 2, "assistant", "y"), (5, 1, "assistant", "z" * 100_000)]
    got = chats(spark, rows).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].status == "answered" and by[1, 2].status == "linked" and by[5, 1].status == "orphan"
    assert by[4, 1].status == by[4, 2].status == "ambiguous"
    assert by[2, None].id is None and by[2, None].problems == "prompt: too short"
    assert by[3, 1].json == '{"content":"\\u0001 é\\"\\\\/\\n","conversation":3,"kind":"message","role":"unknown","status":"plain","turn":1}'
    assert chats(spark, []).count() == 0


def expected_article(page):
    """Blocks of the test pages' article element."""
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body))
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    want = {r.page_id: expected_article(r.html) for r in pages.collect()}
    assert sum(got[k].text == want[k] for k in want) == len(want)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_labeller_on_unseen_pages():
    model, writer = html_text.trained(), html_text._Writer(4242)
    right = total = 0
    for _ in range(200):
        own = html_text.blocks(writer.page())
        if own:
            y = np.array([b.label == "1" for b in own])
            right += (model.label([own])[0] == y).sum()
            total += len(own)
    assert right / total > 0.985


def test_gradients_are_right():
    model, rng = html_text.Labeller(3), np.random.default_rng(5)
    x = rng.standard_normal((5, 3, html_text.INPUTS)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    y = (rng.random((5, 3)) < 0.5).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = model.scores(x, mask)
        return np.where(mask, np.logaddexp(0, s) - y * s, 0).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name in ("Wf", "Uf", "bf", "Wb", "Ub", "bb", "V", "c"):
        p = model.p[name].reshape(-1)
        for k in rng.choice(len(p), 3):
            old, eps = p[k], 1e-3
            p[k] = old + eps
            up = loss()
            p[k] = old - eps
            down = loss()
            p[k] = old
            assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_blocks_of_odd_markup():
    text = lambda p: [b.text for b in html_text.blocks(p)]
    assert text(None) == text("") == text("<div></div>") == []
    assert text("a &amp; b\n\n c&nbsp;d") == ["a & b c d"]
    assert text('<p>x<script>var t="</p>";</script>y</p>z') == ["xy", "z"]
    assert text("<p><b>one<br><p>two<li>three") == ["one", "two", "three"]
    assert text("<a title='>'>t</a><!-- c <p> --><style>p{}</style>u") == ["tu"]
    assert text("</p></div>a<p>b</span>c") == ["a", "bc"]
    assert text("<script>never closed <p>x") == []
    assert text("<p>1 < 2 & 3 > 2") == ["1 < 2 & 3 > 2"]
    assert len(text("<div>" * 3000 + "deep")) == 1
    assert text("<p>a <b>b <i>c</b> d</i></p>e") == ["a b c d", "e"]
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]


def test_all_elements_around_a_block_count():
    outer = html_text.blocks("<nav class=menu>" + "<div>" * 60 + "x")[0]
    assert outer.path & html_text._bit("nav") and outer.path & html_text._bit(".menu") and outer.leaf == "div"


@pytest.mark.parametrize(
    "page", ["<div>" * 50_000 + "x" + "</div>" * 50_000, "<i>" * 50_000 + "<b>" * 50_000 + "x" + "</i>" * 50_000, "<ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p><font>x" * 50_000]
)
def test_time_grows_with_the_page(page):
    start = time.process_time()
    assert html_text.blocks(page)
    assert time.process_time() - start < 10


def test_extract_edges(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    df = spark.createDataFrame([(1, None, None, 1, "x"), (None, "u", "", 1, "x"), (3, "u", "<nav><a href=x>Home</a></nav>", 1, "x"), (3, "u", "<nav><a href=x>Home</a></nav>", 1, "x"), (4, "u", "<article>" + "<p>Long story of a town and its people.</p>" * 20_000 + "</article>", 1, "x")], schema)
    got = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("3", 0), ("3", 0), ("4", 20_000 * 37 - 1), ("None", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_pages_are_labelled_by_stretches(monkeypatch):
    """The state is carried from one stretch to the next: scores are those of the whole page."""
    model = html_text.trained(pages=60, epochs=1)
    writer = html_text._Writer(3)
    page = html_text.blocks("".join(writer.page() for _ in range(30)))
    x, mask = html_text.padded([html_text.inputs([page])], len(page))
    whole = model.scores(x, mask)[:, 0]
    monkeypatch.setattr(html_text, "STRETCH", 64)
    assert len(page) > 5 * 64 and np.allclose(model.stretched(page), whole, atol=1e-4)
    assert (model.label([page, page[:10]])[0] == (model.stretched(page) > 0)).all()


def test_a_dense_page_needs_bounded_memory():
    import tracemalloc

    model = html_text.trained(pages=60, epochs=1)
    page = html_text.blocks("<p>a" * 100_000)
    tracemalloc.start()
    assert len(model.label([page])[0]) == len(page) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 120_000_000  # all inputs at once would be 169 MB, and twice that when padded
    tracemalloc.stop()


def test_a_long_chain_of_calls_stops_nothing(spark):
    """Each call uses the one behind it: as many rounds as calls, and no number of them is too many."""
    import json

    n = 25
    calls = [{"id": f"c{k}", "name": "respond", "arguments": {"prompt": f"$c{k + 1}"} if k + 1 < n else {"prompt": "x"}} for k in range(n)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (2, 0, "user", "hello"), (2, 1, "assistant", "hi")]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [r.id for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_step, r.order_depth))]
    assert order == [f"c{k}" for k in reversed(range(n))] and sum(r.conv_id == 2 for r in got) == 2
