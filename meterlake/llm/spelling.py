"""Spelling variants: words one edit apart, by partition-and-enumerate signatures of their letters.

A word's letters are a set of (letter, how often before), so one inserted or deleted letter changes one element and a
replaced one two: words one edit apart are binary vectors of Hamming distance two at most.  Elements are dealt over
``PARTS`` parts by hash.  Two differences touch two parts at most, so such words agree in the other four, whichever these are: of
each choice of four parts (15 of them) a word has one signature, and equal signatures are joined.  Each candidate is
verified by its edit distance.

A signature that more than ``CROWD`` words share tells too little, so its words are not compared with each other there.  They
meet by the letters that are left when one is taken out, which words one edit apart share too: exact, and no such group is
larger than the alphabet times a word's length.

A word's form is its near word of largest count, if that is ``TIMES`` its own or more.  Counts grow at each step, so chains of
forms are short; roots are found by doubling.

Defined results: null and empty texts have no words; runs in documents without an id are counted, but none loses a letter;
repeated rows count each; words of equal count are ordered by code point; an empty table gives an empty result; other
columns are ignored.  Texts are read whole, and words are counted in each task before they are shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, slices
from .hashing import K1, K2, K3, mix

#: Letters of a run, shortest word, which of the runs lose a letter, occurrences of a word.
LETTERS, SHORTEST, LOSES, LEAST = "[A-Za-zÀ-ÿ]", 7, 31, 2
UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
TIMES = 10
PARTS, DIFFERENCES = 6, 2
CROWD = 256


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word): every run of ``shortest`` or more letters, in lower case, less one letter where its hash says so."""
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    low = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % LOSES == 0, short).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= shortest)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words that occur ``LEAST`` times or more."""
    return runs(docs, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def _letter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (word, n, parts): one hash for each part of a word's letters; an empty part has one too."""
    for b in slices(batches, 0):
        words = b.column(0)
        letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy())
        # a word's letters in order: equal ones lie together, and which of them one is tells it from the others
        own = np.sort(of.astype(np.uint64) << np.uint64(32) | letters)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(own)))
        before = np.arange(len(own)) - np.repeat(first, size)
        element = mix((own & np.uint64(0xFFFFFFFF)) * K1 + before.astype(np.uint64) * K2 + K3)
        # sums do not depend on the order of what is summed
        parts = np.zeros(len(words) * PARTS, np.uint64)
        np.add.at(parts, (own >> np.uint64(32)).astype(np.int64) * PARTS + (element % np.uint64(PARTS)).astype(np.int64), mix(element + K2))
        offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * PARTS)
        yield pa.record_batch([words, b.column(1), pa.ListArray.from_arrays(offsets, pa.array(parts.view(np.int64)))], ["word", "n", "parts"])


def letter_parts(words: DataFrame) -> DataFrame:
    return map_arrow(words.select("word", "n"), _letter_parts, "word string, n long, parts array<long>")


def signatures(parts: str) -> Column:
    """A word's signatures: the hashes of any ``PARTS - DIFFERENCES`` of its parts together, and which parts these are."""
    chosen = itertools.combinations(range(PARTS), PARTS - DIFFERENCES)
    return F.array(*(F.xxhash64(F.lit(k), *(F.col(parts)[i] for i in own)) for k, own in enumerate(chosen)))


def shortened(word: str) -> Column:
    """A word, and what is left of it when any one letter is taken out."""
    size = F.char_length(word)
    left = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, size)))
    return F.array_distinct(F.concat(F.array(F.col(word)), left))


def _met(rows: DataFrame, key: str) -> DataFrame:
    """(a, n_a, b, n_b) of rows with one key that are one edit apart, the smaller word first."""
    a, b = (rows.select(key, F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, key).filter(near).select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once, from (word, n); the smaller word first."""
    parts = materialize(letter_parts(words), "letters")
    signed = parts.select("word", "n", F.explode(signatures("parts")).alias("signature"))
    crowded = materialize(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("signature"), "crowded")
    few = signed.join(crowded, "signature", "left_anti")
    many = signed.join(crowded, "signature", "left_semi").select("word", "n").distinct().select("word", "n", F.explode(shortened("word")).alias("left"))
    return _met(few, "signature").unionByName(_met(many, "left")).distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of words that have near ones; form is null where none is frequent enough."""
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    return best.select("word", "n", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where their chains of forms end."""
    links = materialize(found.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "links")
        discard(links)
        links = step
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    found = materialize(forms(words, near_words(words, crowd)), "near-words")
    out = words.join(found.drop("n"), "word", "left").join(roots(found), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
