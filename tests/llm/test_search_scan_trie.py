import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from curavine.llm import lexical_search, prefix_trie, queries, secret_scan
from curavine.llm.rule_automaton import Automaton, Rule

from ..compare import same

# --- secrets -----------------------------------------------------------------------------------------------



def brute_spans(text):
    """The rules by Python's own expressions, letters of the keys written out in both cases."""
    both = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    assign = rf"""(?:{both(["password", "passwd", "secret", "token", "api_?key"])})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    own = {"assign": (assign, 12), "hex": ("([0-9a-f]+)", 16)}
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern, least = own.get(rule.kind, (rule.pattern, rule.least))
        found += [(m.start(), k, rule.kind, m.end()) for m in re.finditer(pattern, text) if not m.lastindex or len(m[m.lastindex]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


PARTS = [
    "password", "PassWd", "secret", "secretoken", "token", "api_key", "apikey", "APIkey", ":", "=", " ", "  ", '"', "'", "abcdef0123456789", "deadbeef", "AKIA", "AKIA", "ABCDEFGHIJ0123",
    "é", "ſecret=", "日", "-", ".", "xyz=", "\n", "ghp_", "a" * 36, "xoxb-", "eyJ", "eyJhbGciOi", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "----", "0", "f", "g", "K",
]
FIXED = [
    "", None, "password: token: abcdefghijklmnop", "token==abcdefghijkl", "secret = \"abcdefghijkl\" 'x'", "TOKEN:abcdefghijk", "aAKIA" + "B" * 13, "aAKIA" + "B" * 14, "AKIAKIAKIA" + "C" * 12,
    "0123456789abcdefg" * 2, "é日token=日abcdefghijklm", "passwd='abcdefghijkl=='\x00" + "f" * 16, "f" * 100_000, "token:a " * 5_000, "toKen:abcdefghijkl", "ſecret:abcdefghijkl",
]


def test_automaton_equals_expressions():
    random.seed(11)
    for _ in range(4000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 25)))
        assert secret_scan.spans_of(text.encode()) == brute_spans(text), text
    for text in FIXED:
        assert secret_scan.spans_of((text or "").encode()) == brute_spans(text or "")


def test_automaton_is_deterministic_and_minimal():
    a = Automaton((Rule("x", "a(?:b|c)+d?"), Rule("y", "[ab]{2,3}")))
    assert a.states <= a.built and len(a.table) == 256 * a.states
    assert a.scan(b"abcbdabcaabba") == [(0, 0, 5), (1, 0, 2), (0, 5, 8), (1, 5, 7), (1, 8, 11), (0, 9, 12), (1, 11, 13)]
    assert secret_scan.automaton(secret_scan.RULES).states < secret_scan.automaton(secret_scan.RULES).built
    assert Automaton((Rule("opt", "ab?c?"),)).scan(b"abcacab") == [(0, 0, 3), (0, 3, 5), (0, 5, 7)]
    with pytest.raises(ValueError):
        Automaton((Rule("gap", "a(?:bc)*"),))
    with pytest.raises(ValueError):
        Automaton((Rule("look", "(?=a)b"),))


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, kind int")
    return secret_scan.find_secrets(docs)


def test_spans_of_odd_rows(spark):
    rows = [*enumerate(FIXED), (None, "token=abcdefghijkl"), (3, "token==abcdefghijkl")]
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in scanned(spark, rows).collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(((i, brute_spans(t or "")) for i, t in rows), key=key)
    assert scanned(spark, rows).limit(0).count() == 0 and scanned(spark, []).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefghijkl0123456789abcdef!"), (2, None), (3, "AKIA" + "B" * 14 + " x")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()} == {1: "é [assign]!", 2: None, 3: "[access] x"}


def test_secret_scan_matches_sql(spark, sf, duck):
    same(queries.op11_secret_scan(spark, sf), duck.execute(queries.oracle_sql()["op11_secret_scan"]))


def test_secret_scan_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    random.seed(5)
    texts = [*FIXED, *("".join(random.choice(PARTS) for _ in range(random.randint(0, 40))) for _ in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op11_secret_scan(spark, str(tmp_path)), con.execute(queries.oracle_sql()["op11_secret_scan"]))


# --- search ------------------------------------------------------------------------------------------------


def brute_search(docs, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(str(item), k + 1, str(i), -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


ODD_TEXTS = [None, "", "  .,- ", "Foo foo FOO bar", "foo bar", "foo bar", "Àé àé É", "x" * 5000, "foo " * 3000, "日本 語 foo", "a-b_c\x00d\x7fe", "1 2 3 foo2"]


def searched(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, row long, n int, term string")
    b = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id long, text string, item long, number string")
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in lexical_search.search(d, b, **how).collect())


def test_search_of_odd_rows(spark):
    random.seed(12)
    words = ["foo", "Bar", "baz", "qux", "é", "É", "日本", "1", "zz9"]
    docs = [*enumerate(ODD_TEXTS), (None, "foo bar"), (None, "rare foo"), (5, "foo bar"), (5, "foo bar"), *((100 + k, " ".join(random.choices(words, k=random.randint(0, 30)))) for k in range(300))]
    items = [(1, "foo bar foo"), (2, None), (3, ""), (1, "Foo, BAR!"), (None, "rare é"), (4, "unknown"), (5, " ".join(words * 3)), (6, "foo"), (7, "a b c d e")]
    want = brute_search(docs, items)
    assert searched(spark, docs, items, docs_per_shard=50) == want
    assert searched(spark, docs, items, wanted_bytes=0) == want  # the terms are found by a join
    assert searched(spark, docs, items, top=3) == brute_search(docs, items, 3)
    assert searched(spark, docs, []) == searched(spark, [], items) == []


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BITS", 1)
    random.seed(13)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(random.choices(words, k=random.randint(1, 40)))) for k in range(400)]
    items = [(k, " ".join(random.choices(words, k=5))) for k in range(23)]
    assert searched(spark, docs, items, docs_per_shard=64) == brute_search(docs, items)


def test_search_matches_sql(spark, sf, duck):
    same(queries.op12_lexical_search(spark, sf), duck.execute(queries.oracle_sql()["op12_lexical_search"]))


# --- trie --------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    built = {}
    for c, turns in own.items():
        turns.sort()
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [t[3:] for t in own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, name string, n int")
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df, **how).collect()), key=str)


def conversations(seed, n, texts, most):
    random.seed(seed)
    return [(c, t, random.choice(["user", "assistant", None]), random.choice(texts)) for c in range(n) for t in range(random.randint(1, most))]


@pytest.mark.parametrize("shard_turns, fan", [(1, 2), (5, 2), (30, 32), (65_536, 32)])
def test_trie_equals_brute_force(spark, shard_turns, fan):
    rows = conversations(shard_turns, 120, ["a", "a b", "", None, "é  ü\nx"], 4)
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(3)]  # a large group of copies
    rows += [(-7, 0, "user", "minus"), (-20, 0, "user", "a b"), (None, 0, "user", "nobody"), (400, None, "user", "late"), (400, 0, "user", "first"), (401, 1, "x", "tie"), (401, 1, "x", "tie"), (401, 1, "y", "tie")]
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(520, t, "user", f"long {t}") for t in range(299)]
    assert trie_of(spark, rows, shard_turns=shard_turns, fan=fan) == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "a", "b")]) == []


def test_tree_is_balanced():
    trie = prefix_trie.Trie()
    for k in prefix_trie.medians(1023):
        trie.insert([k], [1])
    depth, left = 0, [(trie.down[0], 1)]
    while left:
        at, d = left.pop()
        depth = max(depth, d)
        left += [(x, d + 1) for x in (trie.smaller[at], trie.larger[at]) if x >= 0]
    assert depth == 10


def test_trie_matches_sql(spark, sf, duck):
    same(queries.op13_prefix_trie(spark, sf), duck.execute(queries.oracle_sql()["op13_prefix_trie"]))
