"""Substring dedup by seeds and extension: words of passages that occur more than once go.

A window is ``window`` words in a row.  Its seed is the least hash of the ``gram``-word runs inside it, so equal windows
have equal seeds at the same place (winnowing), and a text has few of them: windows in a row share one.

1. Texts are brought together once: equal ones become one row with its number of copies, bucketed by their key.
2. Seeds are counted by hash alone; only those that occur more than once are looked at again.
3. A seed's occurrence is extended both ways to the span of all windows that have it.  Where a span equals another one, all
   its windows repeat, which settles the inside of long repeats and exact copies with one row for some two dozen words.
4. What is left are seeds at the edges of a repeat, and common runs in different surroundings.  Of these every window is
   hashed, once for each different span, and windows that occur more than once are kept.
5. Spans and windows together, merged, are the maximal repeats of a text over the threshold.

No pair of occurrences is ever formed, so a passage in many documents costs one row per occurrence.  Seeds and spans (or
windows) are joined by two 64-bit hashes of different word runs together.  A common seed is counted in each task before it is
shuffled, and joins leave it to Spark to split what is still skewed.

Defined results: null and empty texts have no words; texts shorter than a window stay whole; a window that occurs twice in
one document, overlapping itself or not, counts as repeated; of an exact copy all windows are repeated, so nothing is left
of it but words that no window covers; equal and null ids have a row each; an empty table gives an empty result; other
columns are ignored.  Texts are read whole: long ones in blocks, the words' hashes of one text (8 bytes a word) at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir
from .common import map_arrow, materialize, slices
from .hashing import K1, K2, K3, Bloom, mix, run_hashes

WINDOW, GRAM = 35, 12
#: Bytes of a text split at once, windows looked at together.
BLOCK, CHUNK = 1 << 22, 1 << 17
BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
BLANK = re.compile(rb"[ \t-\r]")
KEY = ["k1", "k2"]
FACTOR = np.uint64(0xD1342543DE82EF95)


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in blocks of about ``size`` bytes that end between words."""
    at = 0
    while at < len(text):
        end = BLANK.search(text, at + size) if at + size < len(text) else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of some texts, and where each text's words begin."""
    found, counts = [], []
    group, size = [], 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        a = np.frombuffer(b" ".join(group).translate(BLANKS), np.uint8)
        inside = np.zeros(len(a) + 2, bool)
        np.not_equal(a, 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        found.append(run_hashes(a, starts, ends))
        counts.extend(np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in group)]))))
        group, size = [], 0

    for t in texts:
        if len(t) <= BLOCK:
            group.append(t)
            size += len(t)
            if size >= BLOCK:
                flush()
            continue
        flush()
        before = len(counts)
        for b in blocks(t):
            group = [b]
            flush()
        own = sum(counts[before:])
        del counts[before:]
        counts.append(own)
    flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum([0, *counts])


class Runs:
    """Hashes of any runs of words in constant time each, by sums of powers."""

    _power = _inverse = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if len(Runs._power) < n:
            size = max(n, CHUNK + 4 * WINDOW)
            Runs._power, Runs._inverse = (np.cumprod(np.append(np.uint64(1), np.full(size, f))) for f in (FACTOR, np.uint64(pow(int(FACTOR), -1, 1 << 64))))
        self.sums = np.append(np.uint64(0), np.cumsum(words * Runs._power[: len(words)]))

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[first + size] - self.sums[first]) * Runs._inverse[first])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` values in a row the place of the least one, the first of equals."""
    low, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        by = min(have, width - have)
        take = low[by:] < low[:-by]
        place, low, have = np.where(take, place[by:], place[:-by]), np.minimum(low[:-by], low[by:]), have + by
    return place


def seeds(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Per run of windows with one seed: hash of the seed, hash of the span of these windows, text, first window, windows.

    A run that reaches over two chunks is two runs, of which each has its own span."""
    for at in range(0, max(0, len(words) - window + 1), chunk):
        own = words[at : at + chunk + window - 1]
        n = len(own) - window + 1
        runs, start = Runs(own), np.arange(n)
        grams = runs.of(np.arange(len(own) - gram + 1), gram)
        place = least_places(grams, window - gram + 1)
        text = np.searchsorted(bounds, np.arange(at, at + len(own)), side="right") - 1
        start = start[text[:n] == text[window - 1 :]]
        if not len(start):
            continue
        p = place[start]
        new = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(p) != 0)))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start)))
        lo, p = start[first], p[first]
        span = mix(runs.of(lo, size + window - 1) * K1 + (size * 64 + (p - lo)).astype(np.uint64) * K3)
        yield grams[p], span, text[lo], at + lo - bounds[text[lo]], size


def _count_seeds(window: int, gram: int):
    """(text, copies) to (seed, span, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            copies = b.column(1).to_numpy()
            for seed, span, text, _, _ in seeds(*word_hashes(b.column(0).to_pylist()), window, gram):
                yield pa.record_batch([pa.array(seed.view(np.int64)), pa.array(span.view(np.int64)), pa.array(copies[text])], ["seed", "span", "n"])

    return run


def _find_seeds(bloom, window: int, gram: int):
    """(text, k1, k2, copies) to the runs whose seed a filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Bloom = bloom.value
        for b in slices(batches, 0):
            k1, k2, copies = (b.column(i).to_numpy() for i in (1, 2, 3))
            for seed, span, text, lo, size in seeds(*word_hashes(b.column(0).to_pylist()), window, gram):
                at = np.flatnonzero(wanted.holds(seed))
                t = text[at]
                yield pa.record_batch(
                    [pa.array(x) for x in (seed[at].view(np.int64), span[at].view(np.int64), k1[t], k2[t], copies[t], lo[at].astype(np.int32),
                        size[at].astype(np.int32))],
                    ["seed", "span", "k1", "k2", "n", "lo", "size"],
                )

    return run


def _hash_windows(window: int):
    """(text, k1, k2, runs) to every window of some runs: (seed, window, k1, k2, n, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            words, bounds = word_hashes(b.column(0).to_pylist())
            lists, own = b.column(3), b.column(3).flatten()
            text = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            seed, n, lo, size = (own.field(i).to_numpy() for i in range(4))
            for at in range(0, len(seed), CHUNK // 16):
                part = slice(at, at + CHUNK // 16)
                times = size[part]
                of = np.repeat(np.arange(len(times)), times) + at
                start = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                first = bounds[text[of]] + start
                # a window's words, gathered: runs lie apart, so running sums over all words would not pay
                factor = np.cumprod(np.append(np.uint64(1), np.full(window - 1, FACTOR)))
                total = np.zeros(len(first), np.uint64)
                for i in range(window):
                    total += words[first + i] * factor[i]
                t = text[of]
                yield pa.record_batch(
                    [pa.array(seed[of]), pa.array(mix(total * K2).view(np.int64)), b.column(1).take(pa.array(t)), b.column(2).take(pa.array(t)),
                        pa.array(n[of]), pa.array(start.astype(np.int32))],
                    ["seed", "window", "k1", "k2", "n", "lo"],
                )

    return run


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words the windows of some spans cover."""
    edge = np.zeros(n + 1, np.int64)
    lo, size = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "size"))
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + size + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _strip(window: int):
    """(text, k1, k2, spans) to (k1, k2, n_words, n_removed, repeats, kept)."""

    def one(text: bytes, spans: list[dict] | None) -> tuple:
        if not spans:
            parts = [b.split() for b in blocks(text)]
            return sum(map(len, parts)), 0, [], b" ".join(b" ".join(p) for p in parts if p)
        # spans are within the text, so their last end bounds what must be known before it is split
        gone = covered(max(s["lo"] + s["size"] for s in spans) + window - 1, spans, window)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        n, kept = 0, []
        for b in blocks(text):
            words = b.split()
            own = gone[n : n + len(words)].tolist()
            left = [w for w, g in zip(words, own, strict=False) if not g] + words[len(own) :]
            n += len(words)
            if left:
                kept.append(b" ".join(left))
        repeats = [{"first": int(a), "last": int(z) - 1} for a, z in zip(edges[::2], edges[1::2], strict=True)]
        return n, int(gone.sum()), repeats, b" ".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            got = [one(t, s) for t, s in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            n, removed, repeats, kept = zip(*got, strict=True)
            repeats = pa.array(repeats, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield pa.record_batch([b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), repeats,
                pa.array(kept, pa.binary()).cast(pa.string())], ["k1", "k2", "n_words", "n_removed", "repeats", "kept"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, text): equal texts have equal keys of 128 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("k1"), F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("k2"),
        "text")


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, k1, k2, n): each different text once, as a table bucketed by key, so that joins by key do not shuffle texts again."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).groupBy(*KEY).agg(F.first("text").cast("binary").alias("text"), F.count(F.lit(1)).alias("n"))
    name, n = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, *KEY).option("path", fresh_dir(spark, "texts")).format("parquet").saveAsTable(name)
    return spark.table(name)


def repeated(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, lo, size): runs of windows that occur more than once, by the text's key; both are counted in words."""
    spark = texts.sparkSession
    counted = map_arrow(texts.select("text", "n"), _count_seeds(window, gram), "seed long, span long, n long")
    common = materialize(
        counted.groupBy("seed").agg(F.sum("n").alias("n"), F.min("span").alias("a"), F.max("span").alias("b")).filter("n > 1")
        .select("seed", (F.col("a") == F.col("b")).alias("settled")), "seeds")
    bloom = spark.sparkContext.broadcast(Bloom.of(common, "seed"))
    found = map_arrow(texts.select("text", *KEY, "n"), _find_seeds(bloom, window, gram),
        "seed long, span long, k1 long, k2 long, n long, lo int, size int")
    hits = materialize(found.join(common, "seed"), "seed-hits")
    # one occurrence stands for all of a span
    open_ = hits.filter("not settled")
    spans = materialize(open_.groupBy("seed", "span").agg(F.sum("n").alias("n"), F.min(F.struct(*KEY, "lo", "size")).alias("at")), "spans")
    equal = open_.join(spans.filter("n > 1").select("seed", "span"), ["seed", "span"], "left_semi")
    wanted = spans.select("at.k1", "at.k2", F.struct("seed", "n", "at.lo", "at.size").alias("run")).groupBy(*KEY).agg(
        F.collect_list("run").alias("runs"))  # no more of them than the text has seeds
    windows = materialize(map_arrow(texts.select("text", *KEY).join(wanted, KEY).select("text", *KEY, "runs"), _hash_windows(window),
        "seed long, window long, k1 long, k2 long, n long, lo int"), "windows")
    again = windows.groupBy("seed", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("seed", "window")
    edges = windows.filter("n = 1").join(again, ["seed", "window"], "left_semi").withColumn("size", F.lit(1))
    places = [*KEY, "lo", "size"]
    return hits.filter("settled").select(*places).unionByName(equal.select(*places)).unionByName(edges.select(*places))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    per_text: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, repeats (first and last word of each maximal repeat), kept (the text
    that is left, one blank between words).

    ``per_text`` may change the columns once for each different text, before they are joined with its documents."""
    if not 0 < window - gram < 64:
        raise ValueError("a window must be longer than a gram, by less than 64 words")
    texts = distinct_texts(docs, id_col, text_col)
    spans = repeated(texts, window, gram).groupBy(*KEY).agg(F.collect_list(F.struct("lo", "size")).alias("spans"))
    found = map_arrow(texts.select("text", *KEY).join(spans, KEY, "left").select("text", *KEY, "spans"), _strip(window),
        "k1 long, k2 long, n_words long, n_removed long, repeats array<struct<first:int,last:int>>, kept string")
    found = per_text(found) if per_text else found
    return keyed(docs, id_col, text_col).drop("text").join(found, KEY).drop(*KEY)


#: Every window spelled out; for small tables.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  starts AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
  again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM starts SEMI JOIN again USING (h)),
  lists AS (SELECT r, list(j) AS js FROM gone GROUP BY r),
  kept AS (SELECT d.r, doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
      CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda w, k: NOT list_contains(js, k)) END AS ks FROM d LEFT JOIN lists USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept"""
