"""Token counts of whole texts with a byte-level BPE of the tokenizers library.

A text up to ``chunk_chars`` is one chunk.  A huge text is cut into chunks that overlap; each chunk is
encoded on its own with offsets, and neighbours are spliced at a boundary that both of them have
inside the overlap.  Such a boundary is stable: the split into pre-tokens reads from left to right
and looks only ahead, so two scans that once stop at the same place agree from there on, and the left
chunk's boundaries are right up to ``GUARD`` characters before its own end.  Where neighbours share
no boundary, those texts are encoded again with a four times wider overlap, in the end as one chunk.

Within a chunk, each distinct pre-token is encoded by the library once per worker; the merges of the
tokenizer never cross a pre-token.  Added tokens of the tokenizer that stand inside a text are cut out
first, as the library does by default.

Defined results: null and empty text have no tokens; repeated rows are counted one by one; an
empty table gives an empty result; only the id and the text are read, other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, slices

CHUNK_CHARS = 32_768
OVERLAP = 512
#: Characters before a chunk's end whose boundaries are not trusted (the longest added token is shorter).
GUARD = 64
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1_000_000


class Counter:
    """Counts tokens of a text piece by piece, each distinct piece encoded once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks with them or stand as whole words only are not supported")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.marks = added
        self.find = regex.compile(SPLIT).findall
        self.iter = regex.compile(SPLIT).finditer
        self.known: dict[str, int] = {}

    def learn(self, parts: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[p] = len(e.ids)

    def pieces(self, text: str) -> list[str]:
        if self.added and any(m in text for m in self.marks):
            out: list[str] = []
            for i, part in enumerate(self.added.split(text)):
                out += [part] if i % 2 else self.find(part)
            return out
        return self.find(text)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in split]

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Piece ends (from 0) with the number of tokens up to each."""
        parts = self.pieces(text)
        self.learn(set(parts))
        ends, sums, at, total = [0], [0], 0, 0
        for p in parts:
            at += len(p)
            total += self.known[p]
            ends.append(at)
            sums.append(total)
        return ends, sums


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in slices(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(count.counts(texts), pa.int64())], ["_uid", "n_bytes", "n_tokens"])

    return run


def _chunks(path: str, overlap: int):
    """Rows (_uid, k, start, last, text) to the boundaries in both overlaps and the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in slices(batches, 4):
            out: dict[str, list] = {n: [] for n in ("head_pos", "head_cum", "tail_pos", "tail_cum", "total")}
            for start, last, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                ends, sums = count.boundaries(text)
                trusted = len(text) if last else len(text) - GUARD
                head = [i for i, e in enumerate(ends) if e <= overlap]
                tail = [] if last else [i for i, e in enumerate(ends) if len(text) - overlap <= e <= trusted]
                out["head_pos"].append([start + ends[i] for i in head])
                out["head_cum"].append([sums[i] for i in head])
                out["tail_pos"].append([start + ends[i] for i in tail])
                out["tail_cum"].append([sums[i] for i in tail])
                out["total"].append(sums[-1])
            lists, long = pa.list_(pa.int64()), pa.int64()
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(3), *(pa.array(v, long if n == "total" else lists) for n, v in out.items())],
                ["_uid", "k", "last", *out],
            )

    return run


def _spliced(long: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(_uid, n_tokens), null where some neighbours share no boundary."""
    n = F.length("text")
    parts = (
        long.select("_uid", "text", F.explode(F.sequence(F.lit(0),
                    F.greatest(F.lit(0), F.floor((n - F.lit(overlap) - 1) / chunk_chars).cast("int")))).alias("k"))
        .select(
            "_uid", "k", (F.col("k") * chunk_chars).cast("long").alias("start"),
            (n <= (F.col("k") + 1) * chunk_chars + overlap).alias("last"),
            F.substring(F.col("text"), F.col("k") * chunk_chars + 1, F.lit(chunk_chars + overlap)).alias("text"),
        )
        .repartition("_uid", "k")
    )
    found = map_arrow(
        parts,
        _chunks(path, overlap),
        "_uid long, k int, last boolean, head_pos array<long>, head_cum array<long>, tail_pos array<long>, tail_cum array<long>, total long",
    )
    w = Window.partitionBy("_uid").orderBy("k")
    at = lambda pos, cum, x: F.element_at(F.map_from_arrays(pos, cum), x)
    return (
        found.withColumn("cut", F.array_min(F.array_intersect("tail_pos", F.lead("head_pos").over(w))))
        .withColumn("from", F.lag("cut").over(w))
        .withColumn("end_n", F.when(F.col("last"), F.col("total")).otherwise(at(F.col("tail_pos"), F.col("tail_cum"), F.col("cut"))))
        .withColumn("begin_n", F.when(F.col("k") == 0, F.lit(0)).otherwise(at(F.col("head_pos"), F.col("head_cum"), F.col("from"))))
        .withColumn("part", F.col("end_n") - F.col("begin_n"))
        .groupBy("_uid")
        .agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))
    )


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("text"))
    kind = rows.schema["_uid"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = map_arrow(rows.filter(~is_long).select("_uid", "text", size), _whole(tokenizer_path), f"_uid {kind}, n_bytes long, n_tokens long")
    out = short.withColumnRenamed("_uid", "doc_id")
    # the long texts are kept with a number of their own, since ids may repeat
    long = materialize(rows.filter(is_long).select(F.col("_uid").alias("doc_id"), F.monotonically_increasing_id().alias("_uid"), "text", size),
        "long-texts")
    longest = long.agg(F.max(F.length("text"))).first()[0]
    left = long
    while longest:
        if overlap >= longest:
            overlap, chunk_chars = longest, longest
        found = materialize(_spliced(left, tokenizer_path, max(chunk_chars, overlap), overlap), "spliced")
        done = found.filter(F.col("n_tokens").isNotNull())
        out = out.unionByName(long.join(done, "_uid").select("doc_id", "n_bytes", "n_tokens"))
        if found.filter(F.col("n_tokens").isNull()).isEmpty():
            break
        left = left.join(found.filter(F.col("n_tokens").isNull()).select("_uid"), "_uid", "left_semi")
        overlap *= 4
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
