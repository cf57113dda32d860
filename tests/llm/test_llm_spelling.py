"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from meterlake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def slow(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if one_edit(w, v)]
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return Counter(out)


def rows_of(df, **more):
    return Counter(tuple(r) for r in spelling.group_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op13_spelling_variants(spark, SF).collect())
    assert got == slow(rows)
    assert sum(w[1] is not None for w in got) > 5


@pytest.mark.parametrize("crowd", [1, 3, 256])
def test_odd_texts(spark, crowd):
    """Accents, letters of few kinds, chains of forms, ties; groups small enough to be crowded."""
    rng = random.Random(crowd)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(30)]
        words += ["straÃße", "STRAßEN", "Ünïcödé", "ünïcödé", "naïveté×", "œuvreuses", "ÀÀÀÀÀÀÀ", "ààààààà", "Zeitung7Zeitungen", "don't"]
        rows.append((i, "\n".join(words)))
    chain = ["chained"] * 2 + ["chainede"] * 25 + ["chainedes"] * 260
    rows += [(500 + i, " ".join(chain[i::9])) for i in range(9)]
    rows += [rows[0], (None, rows[1][1]), (None, rows[1][1]), (700, None), (701, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    expected = slow(rows)
    assert rows_of(df, crowd=crowd) == expected
    by = {w[0]: w for w in expected}
    assert by["chained"][2] == "chainedes"


def test_long_words_and_empty(spark):
    long = "q" * 3000
    rows = [(1, f"{long} {long[1:]} {long} {long}s {long}s"), (2, f"{long[1:]} x"), (3, "ab " * 10_000)]
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == Counter()


def test_signatures_meet(spark):
    """Every pair one edit apart shares a signature."""
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice("abcdeßé") for _ in range(rng.randint(7, 12)))
        i, c = rng.randrange(len(w)), rng.choice("abcdeßé")
        pairs.append((w, rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])))
    words = spark.createDataFrame([(w, 2) for p in pairs for w in p], "word string, n long").distinct()
    signed = {r["word"]: set(r["s"]) for r in spelling.letter_parts(words).select("word", spelling.signatures("parts").alias("s")).collect()}
    assert all(signed[a] & signed[b] for a, b in pairs) and {len(s) for s in signed.values()} == {15}
