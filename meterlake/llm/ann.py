"""Nearest neighbours by inner product with robust-pruned directed graphs.

Distinct vectors are hashed into shards.  In each shard a directed graph is grown in batches: a greedy beam
search from fixed entry points proposes neighbours for a node, and robust pruning keeps the nearest one
and drops every candidate that is ``alpha`` times nearer to a kept one than to the node, so that kept edges
stay diverse; edges are added backwards too and full nodes pruned again.  A query walks every shard's graph
with a beam; what the beams hold is scored exactly in double precision and merged.

Inner products become distances by one more component, sqrt(M^2 - |v|^2) with M the shard's largest norm (0 for queries).
A shard holds vectors of one band of norms only (a factor of two; ``BANDS`` of them at most), so that component never drowns the others,
however far norms spread; queries rank by the inner product itself.

The number of shards grows with the table's bytes, so a shard fits a task.  Only queries travel to the shards: a
partition is sorted so that a shard's index comes first and its queries stream past it, batch by batch.  Equal
vectors are one node that carries its k + 1 least rows, enough for any result; equal queries are searched once.

Defined results: null, empty and zero vectors and those with a null or non-finite component take no
part, as queries or candidates, nor do vectors of another length than the table's most frequent one; every row but the
query's own is a candidate, so a row that repeats the query's id and vector is found under that id; repeated
query rows have ``k`` neighbours each; equal scores go to the smaller id; fewer than k candidates are all returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, ship

K, DEGREE, BEAM, ALPHA = 20, 28, 56, 1.2
#: A shard's vectors as doubles; and how many shards a smaller table has, if it has that many thousand vectors.
SHARD_BYTES, FEW_SHARDS = 64 << 20, 8
#: Bands of norms, each up to twice the next; what lies below them shares the last one.
BANDS = 40
EXPAND, BATCH, ENTRIES, BUILD_BEAM = 4, 256, 16, 56


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nearest nodes met, nearest first: ids (-1: none) and minus the inner products.

    All nodes have one norm, so the nearest is that of the largest inner product.  The last row of ``x`` and of ``graph``
    stands for no node.
    """
    n, b = len(x) - 1, len(q)
    rows = np.arange(b)[:, None]

    def distance(ids: np.ndarray, q: np.ndarray = q) -> np.ndarray:
        return np.where(ids == n, np.inf, -np.matmul(x[ids], q[:, :, None])[:, :, 0])

    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids = np.full((b, beam), n)
    first = entries[:beam]
    ids[:, : len(first)] = first
    seen[:, first] = True
    dist = distance(ids)
    done = ids == n
    while True:
        todo = np.where(done, np.inf, dist)
        order = np.argsort(todo, axis=1, kind="stable")[:, :EXPAND]
        live = np.isfinite(np.take_along_axis(todo, order, 1))
        active = live.any(axis=1)
        if not active.any():
            break
        np.put_along_axis(done, order, True, 1)
        at = np.flatnonzero(active)
        picked = np.where(live, np.take_along_axis(ids, order, 1), n)[at]
        new = graph[picked].reshape(len(at), -1)
        new = np.where(new < 0, n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[at[:, None], new]] = n
        seen[at[:, None], new] = True
        # most of a step's neighbours were met before: what is new moves to the front, the rest is cut
        new.sort(axis=1)
        new = new[:, : max(1, int((new < n).sum(axis=1).max()))]
        d = distance(new, q[at])
        all_ids, all_d = np.concatenate((ids[at], new), axis=1), np.concatenate((dist[at], d), axis=1)
        all_done = np.concatenate((done[at], new == n), axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[at], dist[at], done[at] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_d, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (-1: none) those that no kept, nearer one makes needless."""
    n = len(x) - 1
    cand = np.sort(np.where(cand == nodes[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.where(cand < 0, n, cand)]
    d = ((v - x[nodes][:, None]) ** 2).sum(axis=2)
    d[cand < 0] = np.inf
    norm = (v * v).sum(axis=2)
    reach = alpha * alpha * (norm[:, :, None] + norm[:, None] - 2 * v @ v.transpose(0, 2, 1)) <= d[:, None]
    left, out, rows = d, np.full((len(nodes), degree), -1, np.int32), np.arange(len(nodes))
    for k in range(degree):
        first = left.argmin(axis=1)
        some = np.isfinite(left[rows, first])
        if not some.any():
            break
        out[some, k] = cand[rows, first][some]
        left[reach[rows, first] & some[:, None]] = np.inf
        left[rows, first] = np.inf
    return out


def width(degree: int) -> int:
    """Edges a node may have before it is pruned again to ``degree``: most edges are added without pruning."""
    return degree + degree // 2


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The graph (neighbours per node, -1: none) and its entry points; the last row of ``x`` is no node."""
    n, rng = len(x) - 1, np.random.default_rng(seed)
    graph = np.full((n + 1, width(degree)), -1, np.int32)
    order = rng.permutation(n)
    entries = np.sort(order[: min(ENTRIES, n)])
    near = ((x[entries][:, None] - x[entries][None]) ** 2).sum(axis=2).argsort(axis=1)[:, 1 : degree + 1]
    graph[entries, : near.shape[1]] = entries[near]
    size = BATCH // 8
    start = len(entries)
    placed = np.concatenate((entries, np.setdiff1d(order, entries, assume_unique=True)[rng.permutation(n - len(entries))])) if n else order
    while start < n:
        nodes = placed[start : start + size]
        found, _ = beam_search(x, graph, entries, x[nodes], beam)
        graph[nodes, :degree] = robust_prune(x, nodes, np.concatenate((found, np.roll(nodes, 1)[:, None]), axis=1).astype(np.int64), degree, alpha)
        # the same edges backwards; nodes that get too many are pruned again
        src = np.repeat(nodes, degree)
        dst = graph[nodes, :degree].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(targets), BATCH):
            t, f, c = targets[lo : lo + BATCH], first[lo : lo + BATCH], count[lo : lo + BATCH]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            more[np.repeat(np.arange(len(t)), c), place] = src[np.repeat(f, c) + place]
            both = np.concatenate((graph[t], more), axis=1)
            full = (both >= 0).sum(axis=1) > graph.shape[1]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : graph.shape[1]]
            graph[t[~full]] = packed[~full]
            if full.any():
                graph[t[full], degree:] = -1
                graph[t[full], :degree] = robust_prune(x, t[full], both[full], degree, alpha)
        start += len(nodes)
        size = min(BATCH, size * 2)
    return graph, entries


def _lifted(v: np.ndarray) -> np.ndarray:
    """Vectors scaled to norms of at most 1, with the component that makes all norms 1; a row for no node."""
    v = v / np.abs(v).max()
    norm = np.sqrt((v * v).sum(axis=1))
    most = float(norm.max())
    rest = np.sqrt(np.maximum(0.0, 1 - (norm / most) ** 2))
    lifted = np.concatenate((v / most, rest[:, None]), axis=1)
    return np.concatenate((lifted, np.zeros((1, lifted.shape[1])))).astype(np.float32)


ROWS = "array<struct<id:long,row:long>>"
_ROWS = pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))


def _local_copies(keep: int):
    """(row, id, vector, band) to distinct vectors with their least rows, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, list[tuple[int, int]]] = {}
            bands: list[int] = []
            for row, i, v, band in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if v not in seen:
                    bands.append(band)
                seen.setdefault(v, []).append((i, row))
            least = [[{"id": i, "row": r} for i, r in sorted(rows)[:keep]] for rows in seen.values()]
            yield pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(bands, pa.int32()), pa.array(least, _ROWS)], ["v", "band", "rows"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, vector, query) to the vector's bytes (float64, -0 as 0), its length and the power of two below its norm;
    what takes no part is left out."""
    for b in batches:
        keep, raw, dim, band = [], [], [], []
        for i, v in enumerate(b.column(2).to_pylist()):
            if v and None not in v:
                a = np.array(v, np.float64) + 0.0
                most = float(np.abs(a).max())
                if np.isfinite(most) and most > 0:
                    scaled = np.ldexp(a, -int(np.frexp(most)[1]))
                    keep.append(i)
                    raw.append(a.tobytes())
                    dim.append(len(a))
                    band.append(int(np.frexp(most)[1]) + int(np.floor(np.log2(scaled @ scaled) / 2)))
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(raw, pa.binary()), pa.array(dim, pa.int32()),
                pa.array(band, pa.int32()), b.column(3).take(at)], ["row", "id", "v", "dim", "band", "query"])


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1)


def _build_shard(degree: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v").reset_index(drop=True)
        graph, entries = build(_lifted(_matrix(pdf["v"])), degree, alpha=alpha)
        pdf["node"] = np.arange(len(pdf), dtype=np.int32)
        pdf["out"] = list(graph[:-1])
        pdf["entry"] = np.isin(pdf["node"], entries)
        return pdf[["shard", "node", "v", "rows", "out", "entry"]]

    return run


class _Shard:
    """A shard's index in a task's memory."""

    def __init__(self, batches: list[pa.RecordBatch], degree: int):
        t = pa.Table.from_batches(batches)
        self.v, self.rows = _matrix(t["v"].to_pylist()), [[(r["id"], r["row"]) for r in rows] for rows in t["rows"].to_pylist()]
        self.x = _lifted(self.v)
        self.graph = np.array([*t["out"].to_pylist(), [-1] * width(degree)], np.int64)
        self.entries = np.flatnonzero(t["entry"].to_numpy())

    def search(self, raw: list[bytes], beam: int, keep: int) -> list[list[dict]]:
        q, out = _matrix(raw), []
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        found, _ = beam_search(self.x, self.graph, self.entries, np.concatenate((unit, np.zeros((len(q), 1))), axis=1).astype(np.float32), beam)
        for own, near in zip(q, found, strict=True):
            near = near[near >= 0]
            score = (self.v[near] * own).sum(axis=1)
            best = sorted((-float(s), *r) for s, i in zip(score, near.tolist(), strict=True) for r in self.rows[i])[:keep]
            out.append([{"s": s, "id": i, "row": r} for s, i, r in best])
        return out


def _search(degree: int, beam: int, keep: int):
    """Rows sorted by shard, index rows before queries: holds one shard's index and lets its queries pass in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        found = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64()), ("row", pa.int64())]))
        for b in batches:
            at, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            # pieces of one shard and one kind
            cut = np.flatnonzero((at[1:] != at[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                if hi == lo:
                    continue
                if at[lo] != shard:
                    shard, held, index = at[lo], [], None
                part = b.slice(lo, hi - lo)
                if not query[lo]:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    index, held = _Shard(held, degree), []
                for s in range(0, part.num_rows, BATCH):
                    own = part.slice(s, BATCH)
                    yield pa.record_batch([own.column(6), own.column(0), pa.array(index.search(own.column(3).to_pylist(), beam, keep), found)],
                        ["q", "shard", "found"])

    return run


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K,
    degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest; queries: ids divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"), (F.col(id_col) % every == 0).alias("query"))
    rows = materialize(map_arrow(rows, _packed, "row long, id long, v binary, dim int, band int, query boolean"), "vectors")
    usual = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("band").alias("top")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    level = F.least(F.lit(usual["top"]) - F.col("band"), F.lit(BANDS - 1)).cast("int")
    rows = rows.filter(F.col("dim") == usual["dim"]).withColumn("band", level)
    # a band's shards follow its bytes; a table has few bands
    size, first, count = usual["dim"] * 8, {}, {}
    for band, n in sorted(rows.groupBy("band").count().collect()):
        first[band], count[band] = sum(count.values()), max(-(-n * size // SHARD_BYTES), min(FEW_SHARDS, n // 1000), 1)
    shards = sum(count.values())
    of = lambda m: F.element_at(F.create_map(*(F.lit(x) for p in m.items() for x in p)), F.col("band"))
    shard = (of(first) + F.pmod(F.xxhash64("v"), of(count))).cast("int")
    # equal vectors become one node with its k + 1 least rows: cut per batch, then per salt, then over all
    cut = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1).alias("rows")
    nodes = (
        map_arrow(rows.select("row", "id", "v", "band"), _local_copies(k + 1), f"v binary, band int, rows {ROWS}")
        .groupBy("v", "band", F.pmod(F.element_at("rows", 1)["row"], F.lit(16)).alias("salt")).agg(cut("rows"))
        .groupBy("v", "band").agg(cut("rows"))
        .withColumn("shard", shard)
    )
    index = nodes.repartitionById(shards, "shard").groupBy("shard").applyInPandas(_build_shard(degree, alpha),
        f"shard int, node int, v binary, rows {ROWS}, out array<int>, entry boolean")
    index = materialize(index, "graph")
    queries = rows.filter("query").select("id", "row", F.col("v").alias("qv"))
    asked = materialize(queries.select("qv").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    here = index.select("shard", F.lit(False).alias("is_query"), "node", "v", "out", "entry", F.lit(None).cast("long").alias("q"), "rows")
    there = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), F.lit(0).alias("node"),
        F.col("qv").alias("v"),
        F.lit(None).cast("array<int>").alias("out"), F.lit(False).alias("entry"), "q", F.lit(None).cast(ROWS).alias("rows"),
    )
    dealt = here.unionByName(there).repartitionById(shards, "shard").sortWithinPartitions("shard", "is_query", "node")
    found = map_arrow(dealt, _search(degree, beam, k + 1), "q long, shard int, found array<struct<s:double,id:long,row:long>>")
    # the best of up to 64 shards at a time, so no list grows with their number
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")
    merged = found.groupBy("q", F.floor(F.col("shard") / 64).alias("some")).agg(best).groupBy("q").agg(best)
    near = asked.join(merged, "q").select("qv", "found")
    return (
        queries.join(near, "qv")
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda f: f["row"] != F.col("row")), 1, k)))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.s")).alias("score"))
    )
