"""Near duplicates, decontamination, nearest neighbours, chat formatting, pipeline: against brute force."""

import hashlib
import json
import random
import re
import time
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import ann, chat, decontamination, near_dups, queries
from meterlake.llm.common import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_classes(rows):
    """Least id per connected component of texts that are equal or align to 0.8 of their five-word shingles."""
    sets = [near_dups.shingle_sets([t.encode()])[0].tolist() if t is not None else [] for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is None or b is None:
                continue
            x, y = sets[i], sets[j]
            if a == b or (x and y and len(set(x) & set(y)) > 0.3 * min(len(x), len(y)) and (n := lcs(x, y)) / (len(x) + len(y) - n) >= 0.8):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, t, least[root(i)]) for i, (d, t) in enumerate(rows)}


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(10)]
    for i in range(20, 45):  # one group with up to five edits each
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, None), (54, ""), (55, ""), (56, "two words"), (57, "Two  Words!"), (58, "???"), (7, rows[7][1])]
    rows.append((60, " ".join(base[75:] + base[:75])))
    return rows


def test_near_duplicates_match_brute_force(spark, docs):
    for rows in (near_rows(), [(r["doc_id"], r["text"]) for r in docs.collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "class_id": F.lit("x")})
        got = near_dups.near_duplicates(df)
        joined = {(r["doc_id"], r["class_id"]) for r in got.collect()}
        assert joined == {(d, c) for d, _, c in slow_classes(rows)} and got.count() == len(rows)
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_meet_by_prefixes(spark):
    """A family on one template below the threshold, with near pairs inside it, and no bucket small enough to compare."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(120)], []
    for i in range(36):
        own = base + [word() for _ in range(20 + i % 3)]
        rows.append((2 * i, " ".join(own)))
        if i % 4 == 0:
            own[130] = word()
            rows.append((2 * i + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, c) for d, _, c in slow_classes(rows)}
    for most in (0, near_dups.PAIRS):
        assert {(r["doc_id"], r["class_id"]) for r in near_dups.near_duplicates(df, most_pairs=most).collect()} == want
    assert len({c for _, c in want}) > 20


@pytest.mark.parametrize("kind", ["string", "int"])
def test_near_duplicates_of_other_ids(spark, kind):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    text = str if kind == "string" else int
    groups = {}
    for d, _, c in slow_classes(rows):
        groups.setdefault(c, set()).add(text(d))
    assert {(r["doc_id"], r["class_id"]) for r in near_dups.near_duplicates(df).collect()} == {(d, min(g)) for g in groups.values() for d in g}


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(r["doc_id"] for r in near_dups.deduplicate(df).collect())
    assert kept == Counter({c: 1 for _, _, c in slow_classes(rows)})


def test_documents_go_by_text_not_by_id(spark):
    a, b, u = "one two three four five six", "seven eight nine ten eleven twelve", "a text that nothing else in here equals"
    rows = [(3, a), (7, a), (7, u), (5, b), (3, b), (None, u), (None, "lonely"), (None, "lonely"), (-4, "minus"), (9, "minus"), (1, None), (1, None), (None, None), (8, u), (8, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_gone", "_again", "_text", "_own", "_best", "id", "node", "root")})
    got = near_dups.deduplicate(df)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter([(3, a), (7, u), (3, b), (None, "lonely"), (-4, "minus"), (1, None), (1, None), (None, None)])
    classes = Counter((r["doc_id"], r["class_id"]) for r in near_dups.near_duplicates(df).collect())
    assert classes == Counter([(3, 3), (7, 3), (7, 7), (5, 3), (3, 3), (None, 7), (None, None), (None, None), (-4, -4), (9, -4), (1, 1), (1, 1), (None, None), (8, 7), (8, 7)])
    assert near_dups.deduplicate(df.limit(0)).count() == 0


def test_banded_alignment_and_bounds():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = a.copy()[: rng.integers(1, len(a) + 1)]
        b[rng.integers(0, len(b))] = 99
        exact = lcs(a.tolist(), b.tolist())
        s, found = exact / (len(a) + len(b) - exact), near_dups.similarity(a, b)
        assert found == 0 and s < 0.8 or abs(found - s) < 1e-12
        assert near_dups.aligned(a.tolist(), b.tolist(), 100) == exact


def test_bands_slide_and_widen(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(near_dups, "LEAST_BAND", 4)
    for _ in range(60):
        a = rng.integers(0, 40, rng.integers(20, 200)).tolist()
        b = a.copy()
        for _ in range(rng.integers(0, 30)):
            at = rng.integers(0, len(b))
            b[at : at + int(rng.integers(0, 4))] = rng.integers(0, 40, rng.integers(0, 4)).tolist()
            b = b or [1]
        exact = lcs(a, b)
        assert near_dups.aligned(a, b, 400) == exact == near_dups.aligned(b, a, 400)
        assert near_dups.aligned(a, b, 400, exact) == exact and near_dups.aligned(a, b, 400, exact + 1) in (0, exact)
        # a band as wide as what is left over loses nothing
        assert near_dups.aligned(a, b, max(1, len(a) + len(b) - 2 * exact)) == exact


def test_a_million_words_are_aligned():
    a = np.arange(1_000_000, dtype=np.uint64) % np.uint64(700_001)
    b = np.delete(a, np.arange(500, 1_000_000, 9_973))
    b[250_000] = 999_999_999
    start = time.perf_counter()
    same = len(b) - 1
    assert near_dups.similarity(a, b) == same / (len(a) + len(b) - same)
    assert time.perf_counter() - start < 60
    assert near_dups.similarity(a, b[::-1].copy()) < 0.8


def test_order_matters_to_the_samples():
    a = near_dups.shingle_sets([b" ".join(b"w%d" % i for i in range(200))])[0]
    b = near_dups.shingle_sets([b" ".join(b"w%d" % i for i in [*range(100, 200), *range(100)])])[0]
    same, moved = np.mean(near_dups.bands(a) == near_dups.bands(a)), np.mean(near_dups.bands(a) == near_dups.bands(b))
    assert same == 1 and moved < 0.5


def slow_contamination(docs, items):
    out = {}
    windows = []
    for i, t in items:
        w = words_of((t or "").encode())
        n = min(13, len(w))
        windows += [(str(i), w[k : k + n]) for k in range(len(w) - n + 1)] if w else []
    for d, t in docs:
        w = words_of((t or "").encode())
        hit, own = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    own.add(i)
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(8)
    words = ["the", "of", "a", "und", "é", "x1", "z"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (3, say(4)), (4, "lonely"), (5, None), (6, ""), (7, "..."), (10, say(5))]
    items.append((8, items[0][1].upper()))
    rows = [(1, say(50) + " " + items[0][1] + " " + say(50)), (2, items[1][1]), (3, "a lonely. word"), (4, None), (5, ""), (6, items[0][1][:40]), (7, say(400)), (8, items[2][1] + "-" + items[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit(1), "item_id": F.lit(2), "shingle": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == slow_contamination(rows, items)
    clean = decontamination.decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0


def test_decontamination_reads_long_texts_whole(spark):
    words = [f"w{i * 7919 % 50_021}" for i in range(300_000)]
    item = [f"item{i}" for i in range(20)]
    # the item ends the long text, and stands once more in its middle
    text = " ".join(words[:150_000] + item + words[150_000:] + item)
    df = spark.createDataFrame([(1, text), (2, " ".join(words[:40] + item))], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == {1: (300_040, 40, 1, False), 2: (60, 20, 1, True)}


def test_decontamination_salts_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SALT_ROWS", 3)
    monkeypatch.setattr(decontamination, "HOT", 2)
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, " ".join(f"w{i}" for i in range(5, 18))), (3, "alone here")]
    rows = [(i, f"x{i} y {passage} z") for i in range(40)] + [(50, "alone here " * 9), (51, "no")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == slow_contamination(rows, items)


@pytest.mark.parametrize("odd", ["\u00a0", "\u3000", "\u0085", "\u2003", "\u2028"])
def test_decontamination_keeps_unicode_spaces_inside_words(spark, odd):
    passage = " ".join(f"w{i}" for i in range(13))
    items = [(1, passage), (2, f"le prix{odd}net, est de dix euros; la somme due reste fixe cette fois"), (3, "a b c d")]
    rows = [(1, f"foo{odd}bar, {odd}. x, {passage}. end"), (2, items[1][1]), (3, f"z, a{odd}b, c d"), (4, f"z, {odd}, a b, c. d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.decontaminate(df, bench).collect()}
    assert got == slow_contamination(rows, items) and [got[i][4] for i in (1, 2, 3, 4)] == [True, True, False, True]


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[600:1100] = x[600]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (2080, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("x"), "ids": F.lit(1)})
    got = ann.nearest(df).collect()
    x64 = x.astype(float)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert abs(r["score"] - x64[r["query_id"]] @ x64[r["vec_id"]]) < 1e-9
    assert sorted(by) == list(range(0, 1500, 20))
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        s = np.round(x64 @ x64[q], 9)
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(1500), -s))[:20].tolist())
        hits, total = hits + len(want & {f[1] for f in found}), total + 20
    assert hits / total >= 0.95
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2), (2, 3), (3, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["spread", "giant", "overflow"])
def test_nearest_neighbours_of_spread_norms(spark, case):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if case == "spread":
        x *= 10 ** rng.uniform(-3, 5, 2000)[:, None]
    elif case == "giant":
        x[77] *= 10_000
    else:
        x[77] *= 1e160
        x[78] *= 1e-170
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(found) == 100 and hits / 2000 >= 0.95


def test_every_row_but_the_query_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (None, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(5), "q": F.lit("x"), "shard": F.lit(1)})
    got = Counter((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).collect())
    assert got == Counter([(0, 1, 0), (0, 2, 20), (0, 3, 1)] * 2 + [(20, 1, 0), (20, 2, 0), (20, 3, 1)])


def test_chat_links_orders_and_validates(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 3, "assistant", 'say "é"'), (None, 1, "user", "lost"), (2, None, "user", None)], "conv_id long, turn long, role string, text string").withColumn("json", F.lit("x"))
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "search", '{"limit":5,"query":"x"}', "b"), (1, 2, "b", "search", '{"limit":"5","extra":1}', None), (1, 2, "c", "fly", "{}", "gone"), (1, 4, "d", "sum", "[1]", "d"),
            (1, 5, "e", "lookup", '{"limit":101,"query":"q"}', None), (1, 6, "e", "lookup", "{}", None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, 7, "b", "late"), (1, 8, "b", "again"), (1, 2, "zzz", "orphan")], "conv_id long, turn long, call_id string, content string")
    tools = chat.tools(spark)
    rows = chat.format_chats(messages, calls, results, tools).collect()
    of = {(r["kind"], r["call_id"], r["turn"]): r for r in rows}
    assert len(rows) == 4 + 5 + 3
    assert of[("call", "a", 1)]["position"] > of[("result", "b", 7)]["position"] > of[("call", "b", 2)]["position"]
    assert of[("call", "a", 1)]["problems"] == "" and of[("call", "b", 2)]["problems"] == "type:limit,missing:query,unknown:extra"
    assert of[("call", "c", 2)]["problems"] == "tool:fly,after" and of[("call", "d", 4)]["problems"] == "json,cycle" and of[("call", "e", 5)]["problems"] == "range:limit,repeated"
    assert of[("result", "b", 8)]["problems"] == "repeated" and not of[("result", "zzz", 2)]["linked"] and of[("result", "b", 7)]["linked"]
    assert sorted(r["position"] for r in rows if r["position"]) == list(range(1, 11)) and sum(r["position"] is None for r in rows) == 2
    for r in rows:
        assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.format_chats(messages.limit(0), calls.limit(0), results.limit(0), tools).count() == 0


def test_chat_arguments_are_canonical_whatever_their_names(spark):
    said = [
        ('{"limit": 5,  "query":"x"}', ""), ('{"query":"x","limit":5}', ""), ('{"b, a, a, b":1, "query": "q", "limit": 1}', "unknown:b, a, a, b"), ('{"query, x":"x","limit":1}', "missing:query,unknown:query, x"),
        ('{"query: r":1, "limit": 1, "query": "a"}', "unknown:query: r"), ('{"limit": null, "query": {"a": [1, {"b": 2}]}}', "type:limit,type:query"), ('{"limit":1,"limit":2,"query":"x"}', "json"), ("", "json"), (None, "json"),
        ('{"query":"<,>: (x","limit":1e3}', "type:limit"),
    ]
    calls = spark.createDataFrame([(1, i, f"c{i}", "search", a, None) for i, (a, _) in enumerate(said)] + [(None, 3, "x", "sum", '{"limit":1}', "y"), (1, None, None, None, "{}", None)], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 2, None, "no id"), (None, 2, "c1", "no conversation"), (1, 5, "c1", "y" * 100_000)], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(messages, calls, results, chat.tools(spark)).collect()
    assert len(rows) == len(said) + 2 + 3
    of = {r["call_id"]: r for r in rows if r["kind"] == "call"}
    assert [of[f"c{i}"]["problems"] for i in range(len(said))] == [p for _, p in said]
    text = lambda i: json.loads(of[f"c{i}"]["json"]).get("arguments")
    assert text(0) == text(1) == '{"limit":5,"query":"x"}' and text(6) == said[6][0] and text(8) is None
    assert of["x"]["problems"] == "key" and of["x"]["position"] is None and of[None]["problems"] == "tool:,key"
    assert [r["linked"] for r in rows if r["kind"] == "result" and r["call_id"] != "c1"] == [False] and of["c1"]["linked"]


def test_long_chains_are_ordered(spark):
    n = 300
    calls = spark.createDataFrame([(1, i, f"c{i}", "sum", '{"limit":1}', f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, n, "c0", "slow")], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = sorted((r["position"], r["call_id"]) for r in chat.format_chats(messages, calls, results, chat.tools(spark)).collect() if r["kind"] == "call")
    assert [c for _, c in rows] == [f"c{i}" for i in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*sorted(cols)).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_pipeline_stages_match_brute_force(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secret_scan", "sentencepiece"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, "123"), (-2, None), (-3, "")]
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    whole = docs.select("doc_id", "lang").join(extra.drop("lang"), "doc_id", "right").select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(corpus_pipeline.STAGES)
    now = stage["language_id"](spark, whole, SF)
    assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == {d for d, _ in rows if d >= 0}
    kept = {r["doc_id"]: r["text"] for r in stage["near_duplicates"](spark, docs, SF).collect()}
    assert set(kept) == {c for _, _, c in slow_classes(rows[:-3])}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = slow_contamination(rows[:-3], items)
    assert {r["doc_id"] for r in stage["decontamination"](spark, docs, SF).collect()} == {d for d, v in judged.items() if not v[4]}
    clean = stage["secret_scan"](spark, docs, SF).collect()
    assert len(clean) == docs.count() and not any(re.search(r"(?i)token\s*=\s*\"[0-9a-f]{20}", r["text"]) for r in clean) and all(r["n_chars"] == len(r["text"]) for r in clean)
    assert corpus_pipeline.run(spark, SF).filter("not round_trip").count() == 0


def test_pipeline_of_odd_tables(spark, docs):
    clash = ("_key", "_uid", "_gone", "_again", "_text", "lang_pred", "score", "coverage", "shingle", "k")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(docs.filter("length(text) > 50").limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).drop("n_chars").withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in clash})
    odd = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(7_777_777).cast("long"), "text": F.lit("the of and in " + "thatin estion heing " * 20_000)}))
    rows = corpus_pipeline.apply(spark, odd, SF).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id'] or 0}" or r["doc_id"] == 7_777_777 for r in rows for c in clash)
    assert len({r["text"] for r in rows}) == len(rows) and all(r["round_trip"] for r in rows) and 7_777_777 in {r["doc_id"] for r in rows}
    assert corpus_pipeline.apply(spark, docs.limit(0), SF).count() == 0
