"""Language identification with bit-sliced Bloom filters over character n-grams.

One Bloom filter per language, all of one shape, lie bit-sliced in a single array: slot ``s`` holds a
bitmask with bit ``l`` set where language ``l`` set its bit ``s``; beyond 64 languages it has more words.  A lookup ANDs the masks of an n-gram's
``HASHES`` slots and so gets every language that contains the n-gram at once.  Per document and language
the masks' bits are counted; ``(hits - n * fp) / (1 - fp)`` takes out the false positives expected of a
filter filled that far, and the language with most corrected hits wins.

A language contains an n-gram where its rate there is at least ``ratio`` of the n-gram's highest rate in
any language.  Profiles are fitted on a bounded sample of labelled rows: about ``sample_docs`` documents a
language, chosen by a hash of their id.  The filter's size depends on the number of languages only (16 MB for each 64 of
them), so what is broadcast never grows with the documents.

Defined results: ``und`` with score 0 for null or letterless text; where no n-gram is known, the most
frequent learned language with score 0; equal counts go to the language that sorts first; no training
rows give ``und`` throughout; repeated rows are judged one by one; an empty table gives an empty result.
An input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

ORDERS = (3, 4)
HASHES = 3
SLOT_BITS = 21
SAMPLE_DOCS = 3000
#: Code points worked on at once; a longer text is counted block by block.
BLOCK = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, 0 for what is no letter, a 0 before and after each; each text's start."""
    low = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in low)])
    raw = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[raw], raw, 0).astype(np.uint32), starts


def grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``n`` code points and which count: inner ones are letters."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n, np.uint64)
    ok = np.ones(size, bool)
    for i in range(n):
        part = codes[i : i + size]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += part
        if 0 < i < n - 1:
            ok &= part > 0
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, ok


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # for each word of the mask one row, a value a slot
    fp: np.ndarray  # false positive rate of each language
    usual: int  # the most frequent language

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of all corrected hits) and coverage (corrected hits per n-gram)."""
        codes, starts = codes_of(texts)
        k = len(self.languages)
        hits, total = np.zeros((len(texts), k)), np.zeros(len(texts))
        low = np.uint64((1 << SLOT_BITS) - 1)
        for at in range(0, len(codes), BLOCK):
            for n in ORDERS:
                block = codes[at : at + BLOCK + n - 1]
                h, ok = grams(block, n)
                cut = np.clip(starts - at, 0, len(h))
                run = np.concatenate(([0], np.cumsum(ok)))
                total += np.diff(run[cut])
                kind = self.masks.dtype.type
                for word, masks in enumerate(self.masks):
                    mask = masks[h & low]
                    for j in range(1, HASHES):
                        mask &= masks[(h >> np.uint64(SLOT_BITS * j)) & low]
                    for i in range(64 * word, min(k, 64 * word + 64)):
                        np.cumsum(((mask >> kind(i % 64)) & kind(1)).astype(bool) & ok, out=run[1:])
                        hits[:, i] += np.diff(run[cut])
        some = np.add.reduceat(np.concatenate((codes > 0, [False])).astype(np.int64),
            np.minimum(starts[:-1], len(codes))) > 0 if len(texts) else np.zeros(0, bool)
        right = np.clip((hits - total[:, None] * self.fp) / (1 - self.fp), 0, None)
        best = np.where(right.max(axis=1, initial=0) > 0, right.argmax(axis=1) if k else 0, self.usual)
        top = right[np.arange(len(texts)), best] if k else np.zeros(len(texts))
        score = np.clip(top / np.maximum(right.sum(axis=1), 1e-9), 0, 1) * some
        coverage = np.clip(top / np.maximum(total, 1), 0, 1) * some
        return [self.languages[b] if s and k else "und" for b, s in zip(best, some, strict=True)], score * (k > 0), coverage * (k > 0)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang index, text) to distinct n-grams with their number, per slice of a batch."""
    for b in slices(batches, 1):
        of = np.array(b.column(0).to_pylist())
        texts = b.column(1).to_pylist()
        for lang in np.unique(of):
            codes, _ = codes_of([t for t, x in zip(texts, of, strict=True) if x == lang])
            for n in ORDERS:
                h, ok = grams(codes, n)
                g, c = np.unique(h[ok].view(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(g), pa.array(np.full(len(g), lang, np.int32)), pa.array(c)], ["gram", "lang", "n"])


def fit(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS, ratio: float = 0.2, min_count: int = 3,
) -> Model:
    """Learn from the rows of ``docs`` whose text and language are set."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.col(key_col).cast("string").alias("key")).filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(counts)
    dtype = np.uint8 if len(languages) <= 8 else np.uint64
    if not languages:
        return Model([], np.zeros((1, 1 << SLOT_BITS), dtype), np.zeros(0), 0)
    pick = F.create_map(*(F.lit(x) for i, a in enumerate(languages) for x in (a, i)))
    share = F.create_map(*(F.lit(x) for a in languages for x in (a, min(1.0, sample_docs / counts[a]))))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    found = map_arrow(sample.select(F.try_element_at(pick, F.col("lang")).alias("l"), "text"), _count_grams, "gram long, lang int, n long")
    per = found.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # rates: an n-gram's share of all n-grams counted for its language
    totals = {r[0]: r[1] for r in per.groupBy("lang").agg(F.sum("n")).collect()}
    rate = F.col("n") / F.try_element_at(F.create_map(*(F.lit(x) for i in range(len(languages)) for x in (i, float(totals.get(i, 1))))),
        F.col("lang"))
    lists = per.withColumn("rate", rate).groupBy("gram").agg(F.collect_list(F.struct("lang", "n", "rate")).alias("in"), F.max("rate").alias("most"))
    holders = F.filter("in", lambda x: (x["rate"] >= F.col("most") * ratio) & (x["n"] >= min_count))
    held = lists.select("gram", F.explode(holders).alias("held")).select("gram", "held.lang")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("lang", F.lit(64)))
    slots = F.array(*(F.shiftrightunsigned("gram", SLOT_BITS * j).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for j in range(HASHES)))
    filled = (
        held.select(F.floor(F.col("lang") / 64).cast("int").alias("word"), bit.alias("mask"), F.explode(slots).alias("slot"))
        .groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    )  # at most one row a slot and word
    masks = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), dtype)
    masks[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64).astype(dtype)
    fill = np.array([((masks[i // 64] >> dtype(i % 64)) & dtype(1)).mean() for i in range(len(languages))])
    return Model(languages, masks, fill**HASHES, max(range(len(languages)), key=lambda i: (counts[languages[i]], -i)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``coverage``; only the text is looked at."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "coverage")]
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 1 << 20):
            lang, score, coverage = bc.value.judge([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.array(coverage, pa.float64())], names=[*b.schema.names, "lang_pred", "score", "coverage"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("coverage", T.DoubleType())])
    return map_arrow(docs.select(*(f.name for f in kept)), run, schema)
