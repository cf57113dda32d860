"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window (13 words; a shorter item is one window) is a set of shingles: its pairs of
neighbouring words, or the word itself where it has one.  Shingles are ordered by rarity over all
documents.  Only full containment counts, so a window's prefix is its single rarest shingle, and a
document can hold the window only where it holds that shingle.

1. Count the windows' shingles over all documents (a Bloom filter picks them out); a window
   with a shingle that no document has is gone.
2. Find the prefix shingles in the documents and join them with the windows.  Positional and length
   bounds drop candidates whose window would start before the document or end after it.
3. Verify: the document's words there equal the window's.

The join key of a frequent prefix shingle is salted by document, with one salt for each ``SALT_ROWS`` times that the
shingle was counted, so a passage that a third of all documents share is spread over many tasks; the windows, not the
documents, are repeated for each salt.  Bloom filters are sized by what they hold, up to 2^27 bits; beyond that they let
more candidates through, which the join drops.

Defined results: null, empty and wordless documents have n_words 0 and no hits; null or wordless items
have no windows; texts of any length are read whole, each in one task; items with equal words all count; documents are told apart by row, so repeated rows
each get their own result; an empty benchmark leaves every document clean; an empty document table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, slices, words_of
from .hashing import Bloom, mix, pair_hashes, word_hashes

WINDOW = 13
SALT_ROWS = 20_000
#: Shingles that get more than one salt, the most frequent ones; they are broadcast.
HOT = 1 << 16


def _windows(size: int):
    """(class, text) to rows (class, window, n_words, shingle offset, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out: list[tuple] = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes([text])[0]
                words, pairs = text.split(b" "), pair_hashes(h).view(np.int64).tolist()
                n = min(size, len(words))
                for i in range(len(words) - n + 1):
                    window = b" ".join(words[i : i + n]).decode()
                    out += [(c, window, n, j, pairs[i + j]) for j in range(n - 1)] if n > 1 else [(c, window, 1, 0, int(h[:1].view(np.int64)[0]))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                ["class", "window", "len", "off", "shingle"])

    return run


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, words joined by one blank)."""
    for b in slices(batches, 1):
        yield pa.record_batch([b.column(0), pa.array([b" ".join(words_of(t or b"")).decode() for t in b.column(1).to_pylist()])],
            ["item_id", "words"])


def _shingle_hits(texts: list[bytes], bloom: Bloom):
    """Per slice: places (word index) and hashes of one- and two-word shingles in the filter."""
    h, starts, ends, first, data = word_hashes(texts)
    pairs = pair_hashes(h)
    inside = np.ones(len(pairs), bool)
    edge = first[(first > 0) & (first < len(h))] - 1
    inside[edge] = False
    two = np.flatnonzero(inside & bloom.holds(pairs)) if len(pairs) else np.zeros(0, int)
    one = np.flatnonzero(bloom.holds(h))
    return np.concatenate((one, two)), np.concatenate((h[one], pairs[two])), starts, ends, first, data


def _count(bloom_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            _, h, *_ = _shingle_hits([t or b"" for t in b.column(0).to_pylist()], bloom_bc.value)
            g, c = np.unique(h.view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(g), pa.array(c)], ["shingle", "n"])

    return run


def _candidates(bloom_bc, size: int):
    """(_uid, doc_id, text) to a row per candidate place with its salt, or one without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, hot, salts = bloom_bc.value
        for b in slices(batches, 2):
            texts = [t or b"" for t in b.column(2).to_pylist()]
            at, h, starts, ends, first, data = _shingle_hits(texts, bloom)
            doc = np.searchsorted(first, at, side="right") - 1
            empty = np.setdiff1d(np.arange(len(texts)), doc)
            n_words = np.diff(first)
            lo = np.maximum(at - (size - 1), first[doc])
            hi = np.minimum(at + size, first[doc + 1])
            context = [data[x:y] for x, y in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
            # bytes split at ASCII blanks only; str would also split at U+00A0 and the like, which are word characters
            context = [(b" ".join(c.split()) if b"  " in c else c).decode() for c in context]
            rows = np.concatenate((doc, empty))
            none = [None] * len(empty)
            take = pa.array(rows)
            place = np.minimum(np.searchsorted(hot, h.view(np.int64)), len(hot) - 1)
            own = mix(b.column(0).to_numpy()[doc].view(np.uint64)) % np.where(hot[place] == h.view(np.int64), salts[place], 1).astype(np.uint64)
            yield pa.record_batch(
                [
                    b.column(0).take(take), b.column(1).take(take), pa.array(n_words[rows], pa.int64()),
                    pa.array(h.view(np.int64).tolist() + none, pa.int64()), pa.array((at - first[doc]).tolist() + none, pa.int64()),
                    pa.array((lo - first[doc]).tolist() + none, pa.int64()), pa.array(context + none, pa.string()),
                    pa.array(own.tolist() + none, pa.int64()),
                ],
                ["_uid", "doc_id", "n_words", "shingle", "at", "lo", "context", "salt"],
            )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, _uid."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    items = materialize(map_arrow(items, _normal, "item_id string, words string").filter("words != ''").withColumn("class", F.sha2("words", 256)),
        "items")
    classes = items.groupBy("class").agg(F.first("words").cast("binary").alias("words"))
    listed = materialize(map_arrow(classes, _windows(window), "class string, window string, len int, off int, shingle long"), "windows")
    # rarity of every shingle of a window, over all documents
    seen = spark.sparkContext.broadcast(Bloom.of(listed.select("shingle").distinct(), "shingle"))
    counts = map_arrow(rows.select("text"), _count(seen), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = (
        listed.dropDuplicates(["window", "off"]).join(counts, "shingle", "left")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "off")))
        .filter("_rank = 1 and n > 0").select("window", "len", "off", "shingle", "n")
    )
    prefixes = materialize(ranked, "prefixes")
    # the counts above which a shingle is salted: SALT_ROWS, or what leaves HOT shingles
    often = prefixes.filter(F.col("n") > SALT_ROWS).select("shingle", "n").distinct().orderBy(F.desc("n")).limit(HOT + 1).collect()
    least = often[HOT]["n"] if len(often) > HOT else SALT_ROWS
    hot = sorted((r["shingle"], -(-r["n"] // SALT_ROWS)) for r in often if r["n"] > least) or [(0, 1)]
    wanted = spark.sparkContext.broadcast((Bloom.of(prefixes.select("shingle").distinct(), "shingle"), *np.array(hot, np.int64).T))
    found = map_arrow(rows, _candidates(wanted, window),
        f"_uid long, doc_id {kind}, n_words long, shingle long, at long, lo long, context string, salt long")
    # documents without a candidate keep one row, under a key of their own
    found = found.withColumns({"shingle": F.coalesce("shingle", F.xxhash64("_uid")), "salt": F.coalesce("salt", F.lit(-1).cast("long"))})
    salts = F.when(F.col("n") > least, F.ceil(F.col("n") / SALT_ROWS)).otherwise(1).cast("long")
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    begin = F.col("at") - F.col("off")
    fits = (begin >= F.col("lo")) & (begin + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("context", " "), (F.greatest(begin - F.col("lo"), F.lit(0)) + 1).cast("int"), F.col("len")),
        " ") == F.col("window")
    hits = found.alias("f").join(salted.alias("p"), (F.col("f.shingle") == F.col("p.shingle")) & (F.col("f.salt") == F.col("p.salt")) & fits & same,
        "left")
    hits = materialize(hits.select("_uid", "doc_id", "n_words", begin.alias("begin"), (begin + F.col("len")).alias("end"), "window"), "hits")
    # words inside any occurrence: the union of the intervals, in order
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(
        F.array_sort("spans"), start,
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["begin"]))).alias("n")),
    )["n"]
    per_doc = (
        hits.groupBy("_uid", "doc_id", "n_words")
        .agg(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("begin", "end"))).alias("spans"))
        .select("_uid", "doc_id", "n_words", union.alias("n_hit"))
    )
    of_class = hits.filter("window is not null").select("_uid", "window").distinct().join(listed.select("window", "class").distinct(),
        "window").select("_uid", "class").distinct()
    per_item = (
        of_class.join(items.select("class", "item_id").distinct(), "class")
        .groupBy("_uid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select(F.col("_uid").alias("_u"), F.size("ids").cast("long").alias("n"), F.sha2(F.concat_ws(",", "ids"), 256).alias("sha"))
    )
    return per_doc.join(per_item, F.col("_uid") == F.col("_u"), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "_uid",
    )


#: The contract in DuckDB SQL, over whole tables.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dwin d JOIN win ON d.words = win.words AND d.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
