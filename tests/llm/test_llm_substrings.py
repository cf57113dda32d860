"""Substring dedup against every window spelled out."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from meterlake.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def slow(rows, window):
    """[(id, words, removed, kept)] by comparing every window with all others."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for (d, _), ws in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if n[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def rows_of(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, k1 string").repartition(3)
    got = substrings.deduplicate(df, **more).collect()
    for r in got:
        assert r["n_removed"] == sum(x["last"] - x["first"] + 1 for x in r["repeats"])
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["repeats"], r["repeats"][1:], strict=False))
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)


def test_whole_table_and_sql(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_substring_dedup(spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({substrings.ORACLE})").fetchall())
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == Counter(x[:3] for x in slow(rows, 35))
    assert sum(r["n_removed"] > 0 for r in got) > 5


def made(seed, letters):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 2)))
    passages = [[word() for _ in range(rng.randint(3, 30))] for _ in range(8)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randint(0, 6)):
            ws += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 15))]
        rows.append((i, rng.choice([" ", "\t", "\n ", "\x0b"]).join(ws)))
    return rows + [rows[3], (None, rows[4][1]), (90, None), (91, ""), (92, " \n")]


@pytest.mark.parametrize(("seed", "letters", "window", "gram"), [(1, "ab", 9, 4), (2, "abcdefghij", 12, 5), (3, "a", 7, 3), (4, "abcdé  x", 35, 12), (5, "abc", 6, 5)])
def test_small_words(spark, seed, letters, window, gram):
    """Few different words, so windows repeat inside and across documents in all ways, and seeds tie."""
    rows = made(seed, letters)
    assert rows_of(spark, rows, window=window, gram=gram) == Counter(slow(rows, window))


def test_long_text(spark, monkeypatch):
    """Texts far over a block and a chunk: repeats across their borders are found."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    long = " ".join(words[:1000] + words[200:330] + words[1000:] + words[2950:3000])
    rows = [(1, long), (2, " ".join(words[1500:1540])), (3, "x" * 5000), (4, " ".join(words[10:44]))]
    assert rows_of(spark, rows) == Counter(slow(rows, 35))
    monkeypatch.setattr(substrings, "BLOCK", 100)
    assert b" ".join(b for t in [long.encode()] for b in (x.strip() for x in substrings.blocks(t, 100))) == long.encode()
    h, bounds = substrings.word_hashes([long.encode(), b"a b", b"", b"c"])
    assert bounds.tolist() == [0, 3180, 3182, 3182, 3183]
    whole = {(s, t, lo + i) for a, b, t_, lo_, n_ in substrings.seeds(h, bounds) for s, t, lo, n in zip(a, t_, lo_, n_, strict=True) for i in range(n)}
    parts = {(s, t, lo + i) for a, b, t_, lo_, n_ in substrings.seeds(h, bounds, chunk=64) for s, t, lo, n in zip(a, t_, lo_, n_, strict=True) for i in range(n)}
    assert whole == parts and len(whole) == 3180 - 34


def test_common_passage(spark):
    """A passage that all documents share, each with words of its own around it, and copies of a text without repeats."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(f'a{i}_{j}' for j in range(i % 40))} {passage} {' '.join(f'b{i}_{j}' for j in range(40 - i % 7))}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(36))) for i in range(200)]
    assert rows_of(spark, rows) == Counter(slow(rows, 35))


def test_empty(spark):
    assert rows_of(spark, []) == Counter()


def test_least_places():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 5, 24, 31):
        assert substrings.least_places(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(200 - width + 1)]
