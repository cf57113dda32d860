"""Near-duplicate groups by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with which occurrence of that shingle it is.
One Order MinHash sample takes the ``PICK`` labelled shingles of least hash and keeps them *in text order*,
so it is equal for two texts only where the shingles agree and stand in the same order.  ``ROWS`` samples
make a band, ``BANDS`` bands a signature; texts that share a band are candidates.

Candidates are verified by banded alignment: the longest common subsequence of both shingle sequences,
with matches only inside the band of diagonals that a similarity of ``threshold`` allows; similarity is
aligned shingles over all (aligned once).  Bands slide with the row and widen only as far as the two texts differ, so
whole texts of a million words are compared at a cost of their length times their difference.  Groups are the connected components of verified links.

What keeps it whole under skew: exact copies are one node, so a group of copies costs one signature.  A
bucket's members are first compared with its least member only; once components are known, members of
buckets that still hold several components are compared across components, so no candidate pair of
different texts in different components is left out, while pairs inside a component are never made.  A bitmap of
a text's shingles bounds what two texts can share, and pairs that can't reach the threshold end in the join.  Where
a bucket would still need more than ``PAIRS`` comparisons, as with a family of texts on one template below the
threshold, its members go to a join on shingle prefixes instead: shingles in order of rarity, the longer text
offers the prefix that any text of the threshold must meet, the shorter one the still shorter prefix that suffices
there, and nothing that the comparison would find is lost.

A node's key begins with its least document id in sortable form, so the least key of a component is its class.

Defined results: a document's class id is the least doc_id in its group (documents without an id come last); null
texts form no groups; texts without words, the empty one included, group with exact copies only; a text of under
five words is one shingle; texts of any length are compared whole, each pair in one task; repeated rows get the same class; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_arrow, materialize, slices, small, unused
from .hashing import K1, K2, mix, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
PICK, ROWS, BANDS = 2, 3, 32
#: Places of the bitmap that bounds what two texts share.
MARKS = 2048
BLOCK = 8192
#: Diagonals of the first band tried.
LEAST_BAND = 64
#: Comparisons of one bucket's members; beyond it, its members meet by shingle prefixes.
PAIRS = 1 << 20


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's shingle hashes in order."""
    h, _, _, first, _ = word_hashes(texts)
    out = []
    n = len(h) - SHINGLE + 1
    full = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE):
        full = full * K1 + h[i : i + len(full)]
    full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(full[a : b - SHINGLE + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = one * K2 + h[i]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes that tell the first, second, ... occurrence of a shingle apart."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return s
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, mix(s + nth * K1), s)


_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * K2) | np.uint64(1)
_SHIFTS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * K1)


def bands(s: np.ndarray) -> np.ndarray:
    """The signature of a text: one 64-bit value per band."""
    if not len(s):
        return np.zeros(0, np.uint64)
    h, m = labelled(s), len(_FACTORS)
    best = np.full((m, 2), np.iinfo(np.uint64).max, np.uint64)
    where = np.zeros((m, 2), np.int64)
    rows = np.arange(m)
    for at in range(0, len(h), BLOCK):
        v = _FACTORS[:, None] * h[None, at : at + BLOCK] + _SHIFTS[:, None]
        for k in range(min(PICK, v.shape[1])):
            i = v.argmin(axis=1)
            x = v[rows, i]
            v[rows, i] = np.iinfo(np.uint64).max
            a, b = x < best[:, 0], (x >= best[:, 0]) & (x < best[:, 1])
            best[a, 1], where[a, 1] = best[a, 0], where[a, 0]
            best[a, 0], where[a, 0] = x[a], i[a] + at
            best[b, 1], where[b, 1] = x[b], i[b] + at
    if len(h) == 1:
        where[:, 1] = where[:, 0]
    where.sort(axis=1)
    sample = mix(h[where[:, 0]] * K1 + h[where[:, 1]])
    sig = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        sig = mix(sig * K2 + sample[r::ROWS])
    return sig


def _banded(a: list[int], b: list[int], places: dict[int, list[int]], width: int, need: float) -> int:
    """Longest common subsequence with matches at most ``width`` diagonals off, by bit-parallel rows; 0 once it can't reach ``need``.

    A block of rows holds bits only for the columns that it reaches; columns behind it are counted and dropped.
    """
    band, step = (1 << (2 * width + 1)) - 1, max(width // 8, LEAST_BAND)
    v = low = high = same = 0
    for r in range(0, len(a), step):
        lo, hi = min(max(0, r - width), len(b)), min(len(b), r + step + width)
        gone = lo - low
        same += gone - (v & ((1 << gone) - 1)).bit_count()
        v = v >> gone | ((1 << (hi - high)) - 1) << (high - lo)
        low, high, full = lo, hi, (1 << (hi - lo)) - 1
        masks: dict[int, int] = {}
        for i, x in enumerate(a[r : r + step], r):
            at = places.get(x)
            if not at:
                continue
            match = masks.get(x)
            if match is None:
                match = 0
                for j in at[bisect_left(at, lo) : bisect_left(at, hi)]:
                    match |= 1 << (j - lo)
                masks[x] = match
            first = i - width - lo
            u = v & match & (band << first if first >= 0 else band >> -first)
            if u:
                v = ((v + u) | (v - u)) & full
        if same + high - low - v.bit_count() + max(0, len(a) - r - step) < need:
            return 0
    return same + high - low - v.bit_count()


def aligned(a: list[int], b: list[int], width: int, need: float = 0) -> int:
    """Longest common subsequence with matches at most ``width`` diagonals off; may be 0 where it can't reach ``need``.

    Bands widen until one holds what is left over: an alignment that leaves ``d`` items of the two texts out strays at most
    ``d`` diagonals, so a band of ``d`` gives the same as any wider one, and texts that differ little cost little.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tried = LEAST_BAND
    while tried < width:
        same = _banded(a, b, places, tried, (len(a) + len(b) - tried) / 2)
        if len(a) + len(b) - 2 * same <= tried:
            return same
        tried *= 4
    return _banded(a, b, places, width, need)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned shingles over all shingles; 0 where it can't reach the threshold."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < threshold * max(na, nb):
        return 0.0
    need = threshold * (na + nb) / (1 + threshold)
    # shingles in common, in whatever order, bound the alignment from above
    if len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need - 1e-9:
        return 0.0
    n = min(na, nb)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    width = int(na + nb - 2 * need + 1e-9)
    same = head + tail + aligned(a[head : na - tail].tolist(), b[head : nb - tail].tolist(), width, need - 1e-9 - head - tail)
    return same / (na + nb - same)


def occupancy(s: np.ndarray) -> np.ndarray:
    """Which of ``MARKS`` places the shingles fall on, as 64-bit words."""
    out = np.zeros(MARKS // 64, np.uint64)
    place = mix(s * K2) & np.uint64(MARKS - 1)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def within_reach(a: str, b: str, threshold: float) -> Column:
    """False only where two texts can't reach the threshold.

    Each place that one text's shingles fall on and the other's don't stands for at least one shingle that the
    other lacks, so it bounds what they share from above, whatever the order.
    """
    def lacking(x: str, y: str) -> Column:
        gone = F.zip_with(f"{x}.marks", f"{y}.marks", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(gone, F.lit(0), lambda t, v: t + v)

    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    lengths = F.least(na, nb) >= threshold * F.greatest(na, nb)
    need = threshold / (1 + threshold) * (na + nb) - 1e-6
    return F.when(lengths, F.when(na - lacking(a, b) >= need, nb - lacking(b, a) >= need)).otherwise(False)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2, 1 << 20):
        sets = shingle_sets([t or b"" for t in b.column(2).to_pylist()])
        sig = [bands(s).view(np.int64) for s in sets]
        sizes = np.cumsum([0, *map(len, sig)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sig)))
        marks = pa.array([occupancy(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.record_batch([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), lists, marks],
            ["id", "text_hash", "n", "bands", "marks"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            left, right = shingle_sets(b.column(2).to_pylist()), shingle_sets(b.column(3).to_pylist())
            sim = np.array([similarity(x, y, threshold) for x, y in zip(left, right, strict=True)])
            keep = pa.array(np.flatnonzero(sim >= threshold - 1e-12))
            yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    return run


def _prefix_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to a row per labelled shingle."""
    for b in slices(batches, 1, 1 << 20):
        sets = [labelled(s).view(np.int64) for s in shingle_sets(b.column(1).to_pylist())]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(np.concatenate(sets))], ["node", "shingle"])


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified (a, b) of candidate pairs."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return materialize(map_arrow(both, _verify(threshold), "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Alternating large-star and small-star steps: every step is a minimum per node, written, and an equi-join with it, so a
    node with very many edges is only ever joined, which AQE can split, and summed up map-side first.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(edges, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = materialize(large.join(least, "u").select(ends.alias("e")).select("e.*").filter("u != v").distinct(), "edges")
        discard(large, least)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"),
                F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def sortable(text_hash: Column, key: Column, kind: str) -> Column:
    """A node's key: bytes that sort by id (missing ids last), then by the text's hash."""
    if kind in WHOLE:
        own = F.unhex(F.lpad(F.hex(F.coalesce(key.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        own = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.concat(F.when(key.isNull(), F.lit(b"\1")).otherwise(F.lit(b"\0")), own, text_hash)


def id_of(node: Column, kind: str) -> Column:
    """The id in a node's key."""
    if kind in WHOLE:
        own = (F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    else:
        own = node.substr(F.lit(2), F.octet_length(node) - F.lit(1 + HASH_BYTES)).cast("string")
    return F.when(F.substring(node, 1, 1) == F.lit(b"\0"), own.cast(kind))


WHOLE, HASH_BYTES = ("bigint", "int", "smallint", "tinyint"), 16


def text_hash(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 2 * HASH_BYTES))


def node_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, most_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (id, text_hash), and per distinct text its hash, number of rows, own key and its class's key."""
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = materialize(map_arrow(rows, _signatures, f"id {kind}, text_hash binary, n long, bands array<long>, marks array<long>"), "signatures")
    first = signed.filter("text_hash is not null").groupBy("text_hash").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("id"), F.count(F.lit(1)).alias("copies"),
        F.any_value(F.struct("n", "bands", "marks")).alias("s")
    )
    nodes = materialize(first.select(sortable(F.col("text_hash"), F.col("id"), kind).alias("node"), "text_hash", "id", "copies", "s.*"), "nodes")
    facts = nodes.select("node", "n", "marks")
    member = nodes.select("node", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("bucket"), "node", "pos")
    # buckets with company are few, and numbers alone find them; everything later works on their members
    shared = materialize(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket"), "buckets")
    here = materialize(member.join(small(shared), "bucket"), "company")
    pivots = here.groupBy("bucket").agg(F.min("node").alias("pivot"))
    member = materialize(here.join(pivots, "bucket").select("bucket", "node", "pos", "pivot"), "members")
    discard(shared, here)

    def reachable(pairs: DataFrame) -> DataFrame:
        """Distinct (a, b) without those whose bitmaps already rule them out."""
        one, two = facts.select(F.struct("node", "n", "marks").alias("x"),
            F.col("node").alias("a")), facts.select(F.struct("node", "n", "marks").alias("y"), F.col("node").alias("b"))
        return pairs.join(one, "a").join(two, "b").filter(within_reach("x", "y", threshold)).select("a", "b")

    pairs = materialize(reachable(member.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "pairs")
    wanted = materialize(member.select("node").distinct().join(nodes.select("node", F.col("text_hash").alias("h"), F.col("id").alias("i")), "node"),
        "wanted")
    texts = materialize(rows.join(small(wanted), (F.col("text_hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("i"))).select("node",
            "text").dropDuplicates(["node"]), "texts")
    links = _links(pairs, texts, threshold)
    labels = components(links)
    # what is left: bucket members in different components
    of = materialize(member.join(labels, "node", "left").select("bucket", "node", "pos", F.coalesce("root", "node").alias("root")), "rooted")
    sizes = of.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"),
        F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    most = materialize(most.select("bucket", F.col("m.root").alias("main"),
            ((F.col("all") - F.col("m.c")) * F.col("all") > most_pairs).alias("heavy")), "mixed")
    mixed = of.join(most, "bucket").join(nodes.select("node", F.struct("node", "n", "marks", "bands").alias("y")), "node").select("bucket", "pos",
        "root", "main", "heavy", "y")
    light = mixed.filter("not heavy")
    few = light.filter("root != main").select("bucket", F.col("root").alias("rx"), F.col("y").alias("x"))
    # a pair counts in the first bucket it shares only
    shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
    across = (
        few.join(light.select("bucket", "pos", "root", "y"), "bucket")
        .filter((F.col("rx") != F.col("root")) & (shared == F.col("pos") + 1) & within_reach("x", "y", threshold))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    )
    if not most.filter("heavy").isEmpty():
        own = of.join(most.filter("heavy"), "bucket").groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("few"))
        across = across.unionByName(reachable(by_prefix(own, texts, threshold))).distinct()
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = materialize(across.join(known, ["a", "b"], "left_anti"), "across")
    discard(member, of)
    if not across.isEmpty():
        more = _links(across, texts, threshold)
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    classes = nodes.select("node", "text_hash", "copies").join(labels, "node", "left").select("text_hash", "copies", "node",
        F.coalesce("root", "node").alias("root"))
    return signed.select("id", "text_hash"), materialize(classes, "classes")


def by_prefix(own: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components, at least one of them among the ``few``, that meet in a shingle of their prefixes.

    Two texts that reach the threshold share one of the longer text's n - ceil(t n) + 1 rarest shingles that is also among
    the shorter one's n - ceil(2 t / (1 + t) n) + 1 rarest.
    """
    here = materialize(map_arrow(texts.join(own, "node", "left_semi").select("node", "text"), _prefix_shingles, "node binary, shingle long"),
        "shingles")
    counts = here.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("node").orderBy("df", "shingle")
    n = F.count(F.lit(1)).over(Window.partitionBy("node"))
    ranked = here.join(counts, "shingle").withColumn("place", F.row_number().over(by_rarity)).withColumn("n", n)
    rest = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    ranked = ranked.filter(F.col("place") <= rest(threshold)).withColumn("short", F.col("place") <= rest(2 * threshold / (1 + threshold)))
    ranked = materialize(ranked.join(own, "node").select("node", "root", "few", "shingle", "n", "short"), "prefixes")
    longer = ranked.select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), F.col("few").alias("fx"))
    shorter = ranked.filter("short").select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"),
        F.col("few").alias("fy"))
    order = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    meets = order & (F.col("rx") != F.col("ry")) & (F.col("ny") >= F.col("nx") * threshold - 1e-9)
    found = [longer.filter("fx").join(shorter, "shingle").filter(meets), longer.filter("not fx").join(shorter.filter("fy"), "shingle").filter(meets)]
    return found[0].unionByName(found[1]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    most_pairs: int = PAIRS) -> DataFrame:
    """One row per document: its id and class_id, the least id of its group."""
    rows, classes = node_classes(docs, id_col, text_col, threshold, most_pairs)
    kind = rows.schema["id"].dataType.simpleString()
    of = classes.select("text_hash", id_of(F.col("root"), kind).alias("class_id"))
    alone = rows.filter("text_hash is null").select("id", F.col("id").alias("class_id"))
    return rows.join(of, "text_hash").select("id", "class_id").unionByName(alone).select(F.col("id").alias(id_col), "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per group, of the least id, whatever the ids; every row without a text stays.

    Rows go by their text, not by their id, so a text is kept where another one shares its id.
    """
    rows, classes = node_classes(docs, id_col, text_col, THRESHOLD, PAIRS)
    kind = rows.schema["id"].dataType.simpleString()
    mark, own, best = (unused(c, docs.columns) for c in ("_text", "_own", "_best"))
    marked = docs.withColumn(mark, text_hash(text_col))
    # texts of which some row goes: all rows of those that are not their class, all but one of the others
    some = materialize(classes.filter("copies > 1 or node != root").select(F.col("text_hash").alias(own),
            F.when(F.col("node") == F.col("root"), F.struct(id_of(F.col("root"), kind).alias("id"))).alias(best)), "some-go")
    here = F.col(mark) == F.col(own)
    texts = marked.filter(F.col(mark).isNotNull())
    whole = texts.join(small(some), here, "left_anti")
    one = texts.join(small(some.filter(F.col(best).isNotNull())),
        here & F.col(id_col).eqNullSafe(F.col(best)["id"])).select(*marked.columns).dropDuplicates([mark])
    return whole.unionByName(one).unionByName(marked.filter(F.col(mark).isNull())).drop(mark)
