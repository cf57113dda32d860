"""SentencePiece encoding and decoding as a max-plus path problem.

The model's pieces come from byte-pair merges, and a sequence of pieces is the encoding of its text
exactly if every two neighbours are: merging their joined text gives those two pieces again.  So
encoding is the best path over (place, last piece) with weight 0 for a step between pieces that go
together and minus infinity otherwise; exactly one path has weight 0.

* No piece has a blank mark after another character, so a word with its leading blank marks is a path of its
  own.  All distinct words of a slice are solved side by side in numpy: place by place, each word keeps the one
  piece that ends there on a path of weight 0.
* A giant document is cut into chunks anywhere.  A boundary state is the piece that ends at or runs across
  the cut (how far it runs, which piece).  Each chunk yields its max-plus transfer matrix from entry to
  exit states on its own; runs of ``FAN`` matrices are combined associatively, level by level, so no task sees more of
  a document than one run; going down again, the one path of weight 0 gives each cut its state; each chunk is
  then traced back on its own between its two states.

Results equal the library's for models of this kind (byte-pair pieces, byte fallback, identity
normalisation with a blank mark in front); other models are refused.

Defined results: null and empty text encode to no pieces and decode to the empty text; repeated rows
are encoded one by one; an empty table gives an empty result; columns named like an output are replaced,
all others stay, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, ship, slices, unused
from .hashing import Lookup, mix, run_hashes, spread

CHUNK_CHARS = 32_768
#: Matrices that one task combines.
FAN = 64
#: Entries of a worker's cache of neighbouring pieces, for the few paths that are walked one by one.
CACHE = 150_000
#: Slots of a worker's cache of neighbouring pieces, for words solved side by side.
PAIR_BITS = 20
#: Bytes of text solved at once.
SLICE = 1 << 21
#: Longer words are walked one by one.
LONG_UNIT = 64
NEVER_RANK = 1 << 40
MARK = "▁"
NEVER = -np.inf


class Pieces:
    """The vocabulary and which pieces may follow each other."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.rank = {n: -sp.get_score(i) for i, n in enumerate(self.names) if i not in special}
        self.ids = {n: i for i, n in enumerate(self.names) if i not in special}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        probe = "  a  ①ﬁ b "
        if any(re.search(f"[^{MARK}]{MARK}",
                n) for n in self.ids) or not all(sp.is_byte(b) for b in self.bytes) or sp.decode(sp.encode(probe)) != probe:
            raise ValueError("a model with byte-pair pieces, byte fallback and no normalisation is needed")
        #: True for a piece, False for what only begins one
        self.kinds = {n[:i]: False for n in self.ids for i in range(1, len(n))} | dict.fromkeys(self.ids, True)
        self.longest = max(map(len, self.ids))
        self.raw = [n.replace(MARK, " ").encode() for n in self.names]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        for i in special - set(self.bytes):
            self.raw[i] = b""
        self.after: dict[tuple[str, str], bool] = {}
        self._tables()

    def _tables(self) -> None:
        """Arrays by piece id; one more id, ``none``, stands for a character that is no piece."""
        n = self.none = len(self.names)
        self.merge_rank, self.length = np.full(n + 1, -1, np.int64), np.ones(n + 1, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.whole = np.zeros(n + 1, bool)
        self.whole[n] = True
        pairs: dict[int, int] = {}
        for name, i in self.ids.items():
            self.length[i] = len(name)
            parts = self.merged(name, keep_last=True)
            self.whole[i] = len(parts) <= 2
            if len(name) > 1:
                self.merge_rank[i] = self.rank[name]
                if self.whole[i]:
                    self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
                for k in range(1, len(name)):
                    if name[:k] in self.ids and name[k:] in self.ids:
                        pairs[self.ids[name[:k]] * (n + 1) + self.ids[name[k:]]] = int(self.rank[name])
        late = (self.merge_rank[self.left] > self.merge_rank) | (self.merge_rank[self.right] > self.merge_rank)
        if (late & self.whole).any():
            raise ValueError("a model whose pieces are merged from earlier pieces is needed")
        self.pairs = Lookup(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)), NEVER_RANK)
        flat = np.frombuffer("".join(self.ids).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in self.ids])
        self.known = Lookup(_prefix_hashes(flat, sizes), np.fromiter(self.ids.values(), np.int64, len(self.ids)), -1)
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.byte_ids = np.array(self.bytes, np.int32)
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def merged(self, text: str, keep_last: bool = False) -> list[str]:
        """Byte-pair merges of a short text, best rank first, leftmost first; ``keep_last``: all but the last one."""
        parts, get, never = list(text), self.rank.get, float("inf")
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            if keep_last and len(parts) == 2:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], never)
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Weight of a step: True for 0, False for minus infinity.  ``left`` may be empty."""
        key = (left, right)
        ok = self.after.get(key)
        if ok is None:
            if len(self.after) > 3 * CACHE:
                self.after.clear()
            unknown = (left and left not in self.rank) or right not in self.rank
            ok = self.after[key] = True if unknown and len(right) == 1 else self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def forward(self, text: str, begin: int, last: str, stop: int) -> dict[int, tuple[int, str]]:
        """Best paths from ``begin`` after piece ``last``: for each end, the start and the piece.

        Pieces start before ``stop`` and may run past it.  At most one path of weight 0 leads to an end.
        """
        kinds, after, n = self.kinds, self.after, len(text)
        back: dict[int, tuple[int, str]] = {}
        for i in range(begin, stop):
            if i == begin:
                left = last
            elif i in back:
                left = back[i][1]
            else:
                continue
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                kind = kinds.get(piece)
                if kind or j == i + 1:
                    ok = after.get((left, piece))
                    if self.fit(left, piece) if ok is None else ok:
                        back[j] = (i, piece)
                if kind is None:
                    break
        return back

    @staticmethod
    def trace(back: dict[int, tuple[int, str]], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            end, piece = back[end]
            out.append(piece)
        return out[::-1]

    def number(self, pieces: list[str]) -> array:
        out = array("i")
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fit`` for arrays of piece ids: kept answers, and ``_fits`` for the others."""
        key = left * (self.none + 1) + right
        slot = (mix(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            ok[new] = self._fits(left[new], right[new])
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the merges next to the cut, latest first: two pieces go together if nothing across it came earlier."""
        ok = self.whole[left] & self.whole[right]
        at = np.flatnonzero(ok & (left < self.none) & (right < self.none))
        a, b, limit = left[at], right[at], np.full(len(at), NEVER_RANK)
        while len(at):
            across = self.pairs.get((a * (self.none + 1) + b).view(np.uint64)) < limit
            ok[at[across]] = False
            ra, rb = self.merge_rank[a], self.merge_rank[b]
            more = ~across & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[more], a[more], b[more], ra[more], rb[more]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def solve(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words (longest first) in a row, and how many each has; ``none`` for other characters."""
        n, most = len(size), int(size[0]) if len(size) else 0
        run = np.zeros((most + 1, n), np.uint64)
        last = np.full((most + 1, n), -1, np.int64)
        live = np.searchsorted(-size, -np.arange(most + 1), side="right")
        for j in range(1, most + 1):
            m = int(live[j])
            run[j, :m] = run[j - 1, :m] * P + codes[start[:m] + (j - 1)].astype(np.uint64) + ONE
            words, lefts, pieces = [], [], []
            for i in range(max(0, j - self.longest), j):
                w = np.flatnonzero(last[i, :m] >= 0) if i else slice(0, m)
                piece = self.known.get(mix(run[j, w] - run[i, w] * POWERS[j - i]))
                if i == j - 1:
                    piece = np.where(piece < 0, self.none, piece)
                at = np.flatnonzero(piece >= 0)
                words.append(w[at] if i else at)
                pieces.append(piece[at])
                lefts.append(last[i, words[-1]])
            word, left, piece = np.concatenate(words), np.concatenate(lefts), np.concatenate(pieces)
            inner = left >= 0
            ok = self.whole[piece]
            ok[inner] = self.fits(left[inner], piece[inner])
            last[j, word[ok]] = piece[ok]
        # backtrace, all words at once
        place, steps = size.copy(), []
        word = np.arange(n)
        while len(word):
            piece = last[place[word], word]
            steps.append((word, piece, place[word]))
            place[word] -= self.length[piece]
            word = word[place[word] > 0]
        count = np.zeros(n, np.int64)
        for word, _, _ in steps:
            count[word] += 1
        end = np.cumsum(count)
        pieces, code = np.empty(int(end[-1]) if n else 0, np.int64), np.zeros(int(end[-1]) if n else 0, np.uint32)
        for k, (word, piece, at) in enumerate(steps):
            pieces[end[word] - 1 - k] = piece
            other = piece == self.none
            if other.any():
                code[end[word[other]] - 1 - k] = codes[start[word[other]] + at[other] - 1]
        return self._with_bytes(pieces, code, count)

    def _with_bytes(self, pieces: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become the pieces of their UTF-8 bytes."""
        other = pieces == self.none
        if not other.any():
            return pieces.astype(np.int32), count
        c = code[other].astype(np.int64)
        width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        sizes = np.ones(len(pieces), np.int64)
        sizes[other] = width
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        out[at[~other]] = pieces[~other]
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            some = width > k
            value = (c >> (6 * (width - 1 - k))) & 0x3F | 0x80
            value = np.where(k == 0, np.where(width == 1, c, head[width] | (c >> (6 * (width - 1)))), value)
            out[at[other][some] + k] = self.byte_ids[value[some]]
        owner = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(owner, sizes, len(count)).astype(np.int64)

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all normalised texts in a row, and where each text's ids begin."""
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        mark, feed = codes == ord(MARK), codes == 10
        begins = np.zeros(len(codes) + 1, bool)
        begins[bounds] = True
        begins[:-1] |= feed
        begins[1:] |= feed
        begins[1:-1] |= mark[1:] & ~mark[:-1]
        edge = np.flatnonzero(begins)
        start, size = edge[:-1], np.diff(edge)
        _, first, which = np.unique(run_hashes(codes, start, start + size), return_index=True, return_inverse=True)
        order = np.argsort(-size[first], kind="stable")
        first, back = first[order], np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        n_long = int(np.searchsorted(-size[first], -LONG_UNIT, side="left"))
        walked = [self.number(self.trace(self.forward(u, 0, "", len(u)), 0,
                    len(u))) for u in (joined[start[i] : start[i] + size[i]] for i in first[:n_long].tolist())]
        ids, count = self.solve(codes, start[first[n_long:]], size[first[n_long:]])
        if walked:
            ids = np.concatenate((*(np.frombuffer(x, np.int32) for x in walked), ids))
            count = np.concatenate(([len(x) for x in walked], count))
        which = back[which]
        own = count[which]
        at = np.concatenate(([0], np.cumsum(own)))
        out = ids[spread(np.cumsum(count)[which] - own, own)]
        return out, at[np.searchsorted(start, bounds)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_units([MARK + t.replace(" ", MARK) if t else "" for t in texts])

    def encode(self, text: str) -> array:
        return array("i", self.encode_all([text])[0].tolist())

    def decode(self, ids) -> str:
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        return data[1 if data[:1] == b" " else 0 :].decode("utf-8", "replace")

    def gives(self, ids: np.ndarray, at: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Which texts' ids decode to exactly these bytes."""
        size = self.raw_size[ids]
        data = self.raw_flat[spread(self.raw_at[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[at]
        sizes = np.array([len(w) for w in want])
        ok = np.diff(ends) == sizes
        if ok.all() and np.array_equal(data, np.frombuffer(b"".join(want), np.uint8)):
            return ok
        return np.array([o and data[a:z].tobytes() == w for o, a, z, w in zip(ok, ends[:-1], ends[1:], want, strict=True)], bool)

    # -- chunks of a giant document: text around [begin, end), as normalised characters

    def cuts(self, text: str, begin: int, end: int) -> tuple[int, int]:
        """First and last place in [begin, end] where a word begins for certain; (-1, -1) if none."""
        at = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}|(?<=\n)|(?=\n)", text[:end + 1]) if begin <= m.start() <= end and m.start()]
        return (at[0], at[-1]) if at else (-1, -1)

    def entries(self, text: str, begin: int) -> list[tuple[int, str]]:
        """States at ``begin``: how far the piece that starts before it runs on, and the piece."""
        out = []
        for start in range(max(0, begin - self.longest), begin):
            for end in range(begin, min(len(text), start + self.longest) + 1):
                piece = text[start:end]
                if piece in self.rank or end == start + 1:
                    out.append((end - begin, piece))
        return out

    def transfer(self, text: str, begin: int, end: int, final: bool) -> tuple[list, list, np.ndarray]:
        """Entry states, exit states and the max-plus matrix between them."""
        rows = self.entries(text, begin) if begin else [(0, "")]
        first, last = self.cuts(text, begin, end)
        exits: dict[tuple[int, str], int] = {}
        cells: list[tuple[int, int]] = []

        def leave(r: int, back: dict[int, tuple[int, str]]) -> None:
            for e in range(end, min(len(text), end + self.longest - 1) + 1):
                if e in back and back[e][0] < end and (not final or e == len(text)):
                    cells.append((r, exits.setdefault((e - end, back[e][1]), len(exits))))

        if first < 0:
            for r, (run, piece) in enumerate(rows):
                if begin + run >= end:
                    if begin + run > end or not final:
                        cells.append((r, exits.setdefault((begin + run - end, piece), len(exits))))
                    elif final:
                        cells.append((r, exits.setdefault((0, piece), len(exits))))
                    continue
                leave(r, self.forward(text, begin + run, piece, end))
        else:
            into = [r for r, (run, piece) in enumerate(rows) if begin + run <= first and (begin + run == first or first in self.forward(text[:first],
                        begin + run, piece, first))]
            if last < end:
                tail: list = []
                back = self.forward(text, last, "", end)
                n = len(cells)
                leave(0, back)
                tail = [c for _, c in cells[n:]]
                del cells[n:]
            else:
                # a word begins at the very end: the one exit state is that nothing runs across
                tail = [exits.setdefault((0, "|"), 0)]
            cells += [(r, c) for r in into for c in tail]
        matrix = np.full((len(rows), len(exits)), NEVER)
        for r, c in cells:
            matrix[r, c] = 0.0
        return rows, list(exits), matrix

    def between(self, chunks: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """For chunks (text, begin, end, state at begin, state at end): the pieces that start in each, and the part of the
        text that they cover."""
        heads, middles, tails, covers = [], [], [], []
        none = array("i")
        for text, begin, end, enter, leave in chunks:
            start, stop = begin + enter[0], end + leave[0]
            head, middle, tail = none, "", none
            if start >= end:
                start = stop
            else:
                first, last = self.cuts(text, begin, end)
                if first < 0:
                    head = self.number(self.trace(self.forward(text[:stop], start, enter[1], end), start, stop))
                else:
                    head = self.number(self.trace(self.forward(text[:first], start, enter[1], first), start, first))
                    middle = text[first:last]
                    if last < end:
                        tail = self.number(self.trace(self.forward(text[:stop], last, "", end), last, stop))
            heads.append(head)
            middles.append(middle)
            tails.append(tail)
            covers.append((start, stop))
        ids, at = self.encode_units(middles)
        parts = [x for h, a, z, t in zip(heads, at[:-1], at[1:], tails, strict=True) for x in (np.array(h, np.int32), ids[a:z],
                np.array(t, np.int32))]
        sizes = [len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) for i in range(0, len(parts), 3)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), covers


P, ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
POWERS = np.array([pow(int(P), i, 1 << 64) for i in range(LONG_UNIT + 1)], np.uint64)


def _prefix_hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of strings laid end to end, the hash that ``solve`` finds for a part of a word."""
    h, start = np.zeros(len(sizes), np.uint64), np.cumsum(sizes) - sizes
    for j in range(int(sizes.max())):
        more = sizes > j
        h[more] = h[more] * P + codes[start[more] + j].astype(np.uint64) + ONE
    return mix(h)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product in which max stands for plus and plus for times."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), NEVER)
    return (a[:, :, None] + b[None]).max(axis=1) if b.shape[1] else np.full((a.shape[0], 0), NEVER)


def join_states(columns: list, rows: list, b: np.ndarray) -> np.ndarray:
    """Rows of ``b`` in the order of the left side's exit states; "|" stands for any piece at the cut."""
    at = {s: i for i, s in enumerate(rows)}
    out = np.full((len(columns), b.shape[1]), NEVER)
    for i, s in enumerate(columns):
        if s in at:
            out[i] = b[at[s]]
        elif s == (0, "|"):
            some = [j for t, j in at.items() if t[0] == 0]
            if some:
                out[i] = b[some].max(axis=0)
    return out


def up(parts: list[tuple], lo: int, hi: int) -> tuple:
    """The product of matrices ``lo`` to ``hi``: entry states, exit states, matrix, and how it came about."""
    if hi - lo == 1:
        return (*parts[lo], None)
    mid = (lo + hi) // 2
    left, right = up(parts, lo, mid), up(parts, mid, hi)
    inner = join_states(left[1], right[0], right[2])
    return left[0], right[1], max_plus(left[2], inner), (left, right, inner)


def entry_of(node: tuple, state: tuple[int, str], c: int) -> int:
    """The row of a state; "|" stands for any piece that ends at the cut."""
    rows = {s: i for i, s in enumerate(node[0])}
    return rows[state] if state in rows else next(i for i, s in enumerate(node[0]) if s[0] == 0 and node[2][i, c] == 0)


def scan(parts: list[tuple[list, list, np.ndarray]], ends: tuple | None = None) -> list[tuple]:
    """States at all cuts of a run of chunks, by a tree of max-plus products and a walk down the tree.

    ``ends``: the states before the first and after the last chunk; without them the run is a whole document."""
    states: list = []

    def down(node, r: int, c: int) -> None:
        if node[3] is None:
            states.append((node[0][r], node[1][c]))
            return
        left, right, inner = node[3]
        k = int(np.argmax(left[2][r] + inner[:, c]))
        down(left, r, k)
        down(right, entry_of(right, left[1][k], c), c)

    root = up(parts, 0, len(parts))
    if root[2].size == 0 or root[2].max() == NEVER:
        raise ValueError("no path of weight 0")
    if ends is None:
        r, c = (int(x) for x in np.unravel_index(int(np.argmax(root[2])), root[2].shape))
    else:
        c = root[1].index(ends[1])
        r = entry_of(root, ends[0], c)
    down(root, r, c)
    return states


def _encode(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, at, SLICE):
            texts = [t or "" for t in b.column(at).to_pylist()]
            ids, bounds = m.encode_all(texts)
            same = m.gives(ids, bounds, [b" " + t.encode() if t else b"" for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(bounds)), pa.array(same)],
                names=[*b.schema.names, "piece_ids", "n_pieces", "round_trip"])

    return run


def _around(text: str, k: int, chunk: int, longest: int, total: int, first_char: int) -> tuple[str, int, int]:
    """The normalised text around chunk ``k`` and where the chunk begins and ends in it."""
    norm = text.replace(" ", MARK)
    if k == 0:
        return MARK + norm, 0, min(chunk, total) + 1
    begin = k * chunk - first_char
    return norm, begin, begin + min(chunk, total - k * chunk)


def _cut(long: DataFrame, chunk: int, margin: int, *more: str) -> DataFrame:
    """Chunks of the long texts with ``margin`` characters around each."""
    n = F.length("text")
    at = F.greatest(F.col("k") * chunk - margin, F.lit(0))
    return (
        long.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))))
        .select("_uid", "k", n.alias("total"), at.alias("from"),
            F.substring("text", at + 1, F.lit(chunk) + F.col("k") * chunk - at + margin).alias("part"), *more)
        .repartition("_uid", "k")
    )


def _matrices(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, 4, SLICE):
            out = []
            for k, total, start, part in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                text, begin, end = _around(part, k, chunk, m.longest, total, start)
                rows, cols, matrix = m.transfer(text, begin, end, (k + 1) * chunk >= total)
                out.append({"rows": [{"run": r, "piece": p} for r, p in rows], "cols": [{"run": r, "piece": p} for r, p in cols],
                        "cells": matrix.ravel().tolist()})
            state = pa.list_(pa.struct([("run", pa.int32()), ("piece", pa.string())]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([o["rows"] for o in out], state), pa.array([o["cols"] for o in out], state),
                    pa.array([o["cells"] for o in out], pa.list_(pa.float64()))], ["_uid", "k", "rows", "cols", "cells"])

    return run


STATE = "array<struct<run:int,piece:string>>"
MATRICES = f"_uid long, k int, rows {STATE}, cols {STATE}, cells array<double>"
STATES = "_uid long, k int, in_run int, in_piece string, out_run int, out_piece string"


def _parts(pdf: pd.DataFrame) -> list[tuple[list, list, np.ndarray]]:
    parts = []
    for rows, cols, cells in zip(pdf["rows"], pdf["cols"], pdf["cells"], strict=True):
        r, c = [(x["run"], x["piece"]) for x in rows], [(x["run"], x["piece"]) for x in cols]
        parts.append((r, c, np.asarray(cells, float).reshape(len(r), len(c))))
    return parts


def _product(fan: int):
    """A run's matrices to one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        parts = _parts(pdf)
        rows, cols, matrix, _ = up(parts, 0, len(parts))
        said = lambda states: [{"run": r, "piece": p} for r, p in states]
        return pd.DataFrame({"_uid": pdf["_uid"].iloc[:1].to_numpy(), "k": [int(pdf["k"].iloc[0]) // fan], "rows": [said(rows)], "cols": [said(cols)],
                "cells": [matrix.ravel().tolist()]})

    return run


def _said_states(pdf: pd.DataFrame, states: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"_uid": pdf["_uid"].to_numpy(), "k": pdf["k"].to_numpy(), "in_run": [a[0] for a, _ in states],
            "in_piece": [a[1] for a, _ in states], "out_run": [b[0] for _, b in states], "out_piece": [b[1] for _, b in states]})


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """A document's last run of matrices to the states at its cuts."""
    pdf = pdf.sort_values("k")
    return _said_states(pdf, scan(_parts(pdf)))


def _refine(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """A run's matrices and the states at its two ends to the states at its cuts."""
    pdf, e = pdf.sort_values("k"), ends.iloc[0]
    return _said_states(pdf, scan(_parts(pdf), ((e["in_run"], e["in_piece"]), (e["out_run"], e["out_piece"]))))


def cut_states(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """The states at all cuts of all documents: up in runs of ``fan`` matrices until a document is one run, and down again."""
    levels = [parts]
    while levels[-1].filter(F.col("k") >= fan).limit(1).count():
        runs = levels[-1].groupBy("_uid", F.floor(F.col("k") / fan).alias("_run"))
        levels.append(materialize(runs.applyInPandas(_product(fan), MATRICES), "products"))
    states = levels.pop().groupBy("_uid").applyInPandas(_combine, STATES)
    while levels:
        runs = levels.pop().withColumn("_run", F.floor(F.col("k") / fan)).groupBy("_uid", "_run")
        states = runs.cogroup(states.withColumn("_run", F.col("k").cast("long")).groupBy("_uid", "_run")).applyInPandas(_refine, STATES)
    return states


def _backtrace(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, 4, SLICE):
            chunks, texts = [], []
            for k, total, start, part, a, p, z, q in zip(*(b.column(i).to_pylist() for i in range(1, 9)), strict=True):
                text, begin, end = _around(part, k, chunk, m.longest, total, start)
                chunks.append((text, begin, end, (a, p), (z, q)))
                texts.append(part if k else " " + part)
            ids, at, covers = m.between(chunks)
            same = m.gives(ids, at, [t[a:z].encode() for t, (a, z) in zip(texts, covers, strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.record_batch([b.column(0), b.column(1), lists, pa.array(same)], ["_uid", "k", "ids", "same"])

    return run


OUT = ("piece_ids", "n_pieces", "round_trip")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """``docs`` with piece_ids, n_pieces and round_trip (decoding the pieces gives the text again)."""
    kept = [f for f in docs.schema.fields if f.name not in OUT]
    rows = docs.select(*(f.name for f in kept))
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
        T.StructField("round_trip", T.BooleanType())]
    is_long = F.coalesce(F.length(text_col), F.lit(0)) > chunk_chars
    short = map_arrow(rows.filter(~is_long), _encode(model_path, [f.name for f in kept].index(text_col)), T.StructType([*kept, *added]))
    uid = unused("_uid", rows.columns)
    whole = materialize(rows.filter(is_long).withColumn(uid, F.monotonically_increasing_id()), "long-texts")
    if whole.isEmpty():
        return short
    ship(docs.sparkSession)
    long = whole.select(F.col(uid).alias("_uid"), F.col(text_col).alias("text"))
    margin = model(model_path).longest + 1
    parts = materialize(map_arrow(_cut(long, chunk_chars, margin), _matrices(model_path, chunk_chars), MATRICES), "matrices")
    cut = _cut(long, chunk_chars, margin).join(cut_states(parts, fan), ["_uid", "k"])
    traced = map_arrow(cut.select("_uid", "k", "total", "from", "part", "in_run", "in_piece", "out_run", "out_piece"),
        _backtrace(model_path, chunk_chars), "_uid long, k int, ids array<int>, same boolean")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    joined = traced.groupBy("_uid").agg(ids.alias("piece_ids"), F.bool_and("same").alias("round_trip")).withColumnRenamed("_uid",
        unused("_own", rows.columns))
    own = joined.columns[0]
    return short.unionByName(whole.join(joined, F.col(uid) == F.col(own)).select(*rows.columns, "piece_ids",
            F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip"))


def decode(df: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its pieces; null ids give null."""
    kept = [f for f in df.schema.fields if f.name != out_col]
    at = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = [None if i is None else m.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return map_arrow(df.select(*(f.name for f in kept)), run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))
