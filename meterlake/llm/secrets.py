"""Secret scans: fixed patterns, and a character network over every other candidate.

The patterns' findings always stay.  Besides them, every run of 8 or more key characters is a candidate if it
holds a digit or a capital after a small letter, or has 16 or more characters; so are its parts between
separators.  A run that overlaps a pattern's finding is cut there, and the rest is judged.  A small
convolutional network in numpy reads a candidate with the text around it, a long one by overlapping windows of
which the largest probability counts, and gives a calibrated probability.  Short runs of one case without a
digit, which look like any word, are not candidates.  It is trained on labelled findings: the patterns' findings (secret) and other
candidates that do not resemble keys (not) from a bounded sample of documents, plus labelled examples made from
fixed shapes, so that either class is never empty.  What looks random and is no secret (UUIDs, digests in prose, embedded
images, ids in links, names in camel case) is among the made examples that are not secret.  Its threshold is the highest at which held-out secrets of the
kind that it judges, those the patterns would not find, are still recalled at ``recall``; the precision there is
reported beside it.

Defined results: null and empty text have no spans and the hash of the empty string; texts of any length are read whole, in
one sweep; model spans
never overlap the patterns' ones, and a part is not told beside the run that holds it; repeated rows are scanned one by one; an empty
table gives an empty result (the network then knows the made examples only); only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

KINDS = ("assign", "access", "hex", "model")
# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

LEAST_RUN, SURE_RUN = 8, 16
RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST_RUN},}}")
PART = re.compile("[A-Za-z0-9]+")
CHANGE = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
KEYLIKE = re.compile("[0-9]|[a-z][A-Z]")
HEX_BYTES = bytes(49 if b in b"0123456789abcdef" else 32 for b in range(256))

#: How much the network sees: text before, of the candidate's head and tail, and after.
BEFORE, HEAD, TAIL, AFTER = 24, 40, 8, 8
LENGTH = BEFORE + HEAD + TAIL + AFTER
SEEN = HEAD + TAIL
SAMPLE_DOCS, SAMPLE_FINDINGS = 20_000, 4_000
RECALL = 0.98
#: Made examples, the number of their secret shapes, and those shapes that the patterns find by themselves.
MADE, MADE_SECRETS, MADE_BASE = 6_400, 12, (2, 3)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' findings."""
    out = []
    data = text.encode("utf-8", "surrogatepass")
    low = data.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"1" * 24 in data.translate(HEX_BYTES):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Other runs of key characters, each followed by its parts between separators."""
    out = []

    def add(start: int, end: int) -> bool:
        value = text[start:end]
        ok = end - start >= LEAST_RUN and bool(KEYLIKE.search(value) or end - start >= SURE_RUN and PART.search(value))
        if ok:
            out.append((start, end))
        return ok

    # runs and findings both come in order: one sweep
    taken: list[tuple[int, int]] = []
    for start, _, end, _ in base:
        if taken and start <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    next_ = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while next_ < len(taken) and taken[next_][1] <= at:
            next_ += 1
        cuts, i = [], next_
        while i < len(taken) and taken[i][0] < end:
            cuts.append((max(taken[i][0], at), min(taken[i][1], end)))
            i += 1
        for a, z in [*cuts, (end, end)]:
            if add(at, a):
                parts = [(at + p.start(), at + p.end()) for p in PART.finditer(text[at:a])]
                for part in parts if len(parts) > 1 or parts and parts[0] != (at, a) else []:
                    add(*part)
            at = max(at, z)
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping stretches of at most what the network sees, which together cover a candidate."""
    return [(start, end)] if end - start <= SEEN else [(s, s + SEEN) for s in (*range(start, end - SEEN, SEEN // 2), end - SEEN)]


def _classes() -> np.ndarray:
    """Character classes of the first 256 code points; 0 is padding."""
    out = np.full(257, 1, np.uint8)
    for i in range(256):
        c = chr(i)
        out[i] = (
            2 if c.isdigit() and i < 128 else 3 if "a" <= c <= "f" else 4 if "g" <= c <= "z" else 5 if "A" <= c <= "F" else 6 if "G" <= c <= "Z"
            else 7 if c in " \t" else 8 if c in "\"'`" else 9 if c in ":=" else 10 if c in "+/" else 11 if c == "_" else 12 if c == "-" else 13 if c == "." else 14 if c == "\n" else 15 if i > 127 else 1
        )
    out[256] = 15
    return out


CLASSES, WIDTH = _classes(), 18  # one-hot classes, inside the candidate, relative length


def window(text: str, start: int, end: int, whole: tuple[int, int] | None = None) -> np.ndarray:
    """Character classes of a candidate and its surroundings; high bit: inside the candidate.

    A stretch of a longer candidate, ``whole``, is shown with what stands around the whole.
    """
    out = np.zeros(LENGTH, np.uint8)
    left, right = whole or (start, end)

    def put(at: int, part: str, flag: int) -> None:
        raw = np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), 256)
        out[at : at + len(raw)] = CLASSES[raw] | flag

    before = text[max(0, left - BEFORE) : left]
    put(BEFORE - len(before), before, 0)
    put(BEFORE, text[start : min(end, start + HEAD)], 128)
    if end - start > HEAD:
        put(BEFORE + HEAD, text[max(start + HEAD, end - TAIL) : end], 128)
    put(BEFORE + HEAD + TAIL, text[right : right + AFTER], 0)
    return out


def windows_of(text: str, start: int, end: int) -> list[np.ndarray]:
    """A candidate as the network sees it, stretch by stretch."""
    return [window(text, *p, (start, end)) for p in pieces(start, end)]


def features(windows: np.ndarray) -> np.ndarray:
    x = np.zeros((len(windows), LENGTH, WIDTH), np.float32)
    b, i = np.indices(windows.shape)
    x[b, i, windows & 15] = 1
    inside = windows >= 128
    x[:, :, 16] = inside
    x[:, :, 17] = (inside.sum(axis=1) / (HEAD + TAIL))[:, None]
    return x


@dataclass
class Network:
    """Convolution, rectifier, largest and mean value over places, two dense layers."""

    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    recalled: float = 1.0  # share of held-out secrets at the threshold
    precision: float = 1.0  # share of secrets among the held-out examples at the threshold
    K = 5

    @classmethod
    def fresh(cls, rng: np.random.Generator, filters: int = 32, hidden: int = 16) -> Network:
        g = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        return cls(g(cls.K * WIDTH, filters), np.zeros(filters, np.float32), g(2 * filters, hidden), np.zeros(hidden, np.float32), g(hidden, 1)[:, 0],
            0.0)

    def forward(self, x: np.ndarray):
        n = LENGTH - self.K + 1
        cols = np.lib.stride_tricks.sliding_window_view(x, self.K, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, -1)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        at = z.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(z, at[:, None], 1)[:, 0], z.mean(axis=1)), axis=1)
        h = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return h @ self.out + self.out_bias, (cols, z, at, pooled, h)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(features(windows[i : i + 512]))[0] for i in range(0, len(windows), 512)]) if len(windows) else np.zeros(0)

    def probability(self, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(windows) + self.scale[1], -30, 30)))

    def train(self, windows: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 16, rate: float = 3e-3) -> None:
        names = ("conv", "bias", "dense", "dense_bias", "out", "out_bias")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), 64):
                i = order[s : s + 64]
                logit, (cols, z, at, pooled, h) = self.forward(features(windows[i]))
                d = ((1 / (1 + np.exp(-logit)) - y[i]) * weight[i] / len(i)).astype(np.float32)
                g = {"out": h.T @ d, "out_bias": d.sum()}
                dh = np.outer(d, self.out) * (h > 0)
                g |= {"dense": pooled.T @ dh, "dense_bias": dh.sum(axis=0)}
                dp = dh @ self.dense.T
                f = z.shape[2]
                dz = np.repeat(dp[:, None, f:] / z.shape[1], z.shape[1], axis=1)
                np.put_along_axis(dz, at[:, None], np.take_along_axis(dz, at[:, None], 1) + dp[:, None, :f], 1)
                dz *= z > 0
                g |= {"conv": np.tensordot(cols, dz, ((0, 1), (0, 1))), "bias": dz.sum(axis=(0, 1))}
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))

    def calibrate(self, windows: np.ndarray, y: np.ndarray, recall: float, judged: np.ndarray | None = None, groups: np.ndarray | None = None) -> None:
        """Platt scaling on held-out findings, then the highest threshold that recalls as many of the ``judged`` secrets of each group."""
        x, a, b = self.logits(windows), 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            a -= 0.05 * (float(((p - y) * x).mean()) + 1e-3 * (a - 1))
            b -= 0.05 * float((p - y).mean())
        self.scale = (a, b)
        p = self.probability(windows)
        secret = (y > 0) if judged is None else (y > 0) & judged
        of = np.zeros(len(y), int) if groups is None else groups
        hits = [np.sort(p[secret & (of == g)]) for g in np.unique(of[secret])]
        if hits:
            self.threshold = float(min(h[int((1 - recall) * len(h))] for h in hits))
            self.recalled = float((p[secret] >= self.threshold).mean())
            self.precision = float((y[p >= self.threshold] > 0).mean())


def made_findings(rng: np.random.Generator, n: int = 400, hard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labelled examples of fixed shapes, each in a sentence and seen as the scan would see it or one of its parts.

    ``hard`` adds shapes of keys next to other text, and of random text that is no secret.
    """
    rows, y = [], []
    for i in range(n):
        text, start, end = made_text(rng, bool(i % 2), i // 2, hard)
        # what the scan would judge: a run that holds the secret, or any part of what only looks like one
        spans = [(s, e) for s, e in candidates(text, base_spans(text)) if (s <= start and e >= end if i % 2 else s < end and e > start)] or [(start, end)]
        own = windows_of(text, *spans[int(rng.integers(len(spans)))])
        rows.append(own[int(rng.integers(len(own)))])
        y.append(i % 2)
    return np.array(rows), np.array(y, np.float32)


def made_text(rng: np.random.Generator, secret: bool, kind: int, hard: bool = True) -> tuple[str, int, int]:
    """A sentence that holds a made secret, or what only looks like one, and where it stands."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = dig + "abcdef"
    pick = lambda s, k: "".join(np.array(list(s))[rng.integers(len(s), size=int(k))])
    some = lambda *s: s[int(rng.integers(len(s)))]
    between = lambda a, b: int(rng.integers(a, b))
    word = lambda: pick(low, between(2, 9))
    name = lambda k: "".join(word().capitalize() for _ in range(k))
    cased = lambda v: v.upper() if rng.random() < 0.5 else v
    host = lambda: some("https://", "http://", "https://www.") + word() + some(".com", ".org", ".net", ".example.com") + "/"
    # each shape: what leads to it, and itself
    secrets = [
        lambda: ("", pick(low + up + dig, between(20, 48))), lambda: ("", pick(low + up + dig + "+/", 40) + "="),
        lambda: ("", pick(hexa, between(24, 64))), lambda: ("", "AKIA" + pick(up + dig, 16)),
        lambda: ("", word() + "_" + pick(low + up + dig, 36)), lambda: ("", word() + "-" + pick(low + up + dig, 24)),
        lambda: ("", pick(low + up + dig, between(8, 16))), lambda: ("", pick(low + up, between(16, 40))),
        lambda: ("", "/".join((word(), word(), pick(low + up + dig, 24)))),
    ]
    secrets += [] if not hard else [
        lambda: ("AKIA" + pick(up + dig, 16) + some("/", "+", ":"), pick(low + up + dig, some(24, 40))), lambda: ("", some("ghp_", "sk_live_", "xoxb-", "glpat-") + pick(low + up + dig, between(20, 40))),
        lambda: (some("pwd: ", "key ", "Bearer ", "use \"", "is '"), pick(low + up + dig, between(9, 44))),
    ]
    plain = [
        lambda: ("", pick(dig, between(16, 20))), lambda: ("", f"{word()}{pick(dig, 1)}.{word()}.{word()}.com"),
        lambda: ("", "/".join(word() for _ in range(4)) + f"/{pick(dig, 2)}"), lambda: ("", "-".join(word() for _ in range(4)) + f"-{pick(dig, 2)}"),
        lambda: ("", f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}-{pick(dig, 6)}"), lambda: ("", word() + word() + word() + pick(dig, 2)),
        lambda: ("", "=" * 16 + pick(dig, 1)), lambda: ("", "....".join((word(), pick(dig, 3), word())) + "." * 8),
        lambda: ("", word() + name(2)), lambda: ("", f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}"),
        lambda: ("", word() + word() + pick(dig, 2)), lambda: ("", "-".join(word() for _ in range(4))),
    ]
    plain += [] if not hard else [
        # UUIDs
        lambda: ("", cased("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)))), lambda: (some("id ", "uuid:", "{"), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        # digests and short hashes in prose
        lambda: (some("sha256 ", "md5 ", "digest ", "SHA-1: "), pick(hexa, some(32, 40, 64)).upper()), lambda: (some("commit ", "revision ", "at "), pick(hexa, between(8, 13))),
        # embedded images and documents
        lambda: (f"data:{some('image/png', 'image/jpeg', 'font/woff2', 'application/pdf')};base64,", pick(low + up + dig + "+/", between(60, 400)) + some("", "=", "==")),
        # ids in links
        lambda: (host() + word() + some("?v=", "?id=", "?p="), pick(low + up + dig, between(8, 13))), lambda: ("", host() + word() + "/" + pick(low + up + dig, between(8, 24))),
        lambda: ("", host() + some("d/", "file/d/", "watch/", "item/") + pick(low + up + dig + "_-", between(16, 45)) + some("", "/edit", "/view")),
        # names in code, files and times
        lambda: (some("", "call ", "class "), some(word(), "") + name(between(3, 6))), lambda: ("", name(2) + some("2", "64", "V3") + name(1)),
        lambda: ("", ".".join((word(), word(), name(2), word() + name(1)))), lambda: ("", "_".join(word() for _ in range(between(3, 5))) + some("", "_v2", "_64")),
        lambda: ("", "_".join(word().upper() for _ in range(between(3, 5)))), lambda: ("", f"{some('IMG', 'DSC', 'VID')}_{pick(dig, 8)}_{pick(dig, 6)}.jpg"),
        lambda: ("", f"{pick(dig, 8)}T{pick(dig, 6)}Z"),
    ]
    lead, value = (secrets if secret else plain)[kind % len(secrets if secret else plain)]()
    left, right = f"{word()} {word()} {word()} {lead}", f"{some('', '.', ',', '}', ')')} {word()} {word()}"
    return left + value + right, len(left), len(left) + len(value)


def resembles_key(value: str) -> bool:
    """Whether an unlabelled candidate may well be a key: a part of it changes often between words, capitals and digits."""
    for m in PART.finditer(value):
        part = m.group()
        if len(part) >= LEAST_RUN and len(CHANGE.findall(part)) * 5 >= 2 * len(part):
            return True
    return False


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to labelled windows: the patterns' findings, every second without what stands before, and others.

    Of the patterns' findings, those without what stands before are of the kind that the network judges, unless
    their value alone is a finding."""
    for b in slices(batches, 0, 1 << 20):
        rows, y, judged = [], [], []
        for text in b.column(0).to_pylist():
            base = base_spans(text or "")
            for i, (_, kind, end, value) in enumerate(base):
                rows.append(window(text, value, end) if i % 2 else window(" " + text[value : end + AFTER], 1, end - value + 1))
                y.append(1)
                judged.append(i % 2 == 0 and kind == 0 and not base_spans(text[value:end]))
            for s, e in candidates(text or "", base):
                if not resembles_key(text[s:e]):
                    own = windows_of(text, s, e)
                    rows += own
                    y += [0] * len(own)
                    judged += [True] * len(own)
        yield pa.record_batch([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(y, pa.int32()), pa.array(judged, pa.bool_())],
            ["window", "y", "judged"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_findings: int = SAMPLE_FINDINGS,
    recall: float = RECALL, seed: int = 7) -> Network:
    """Train on at most ``sample_findings`` findings of each class from about ``sample_docs`` documents."""
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    rows = docs.filter(F.pmod(F.xxhash64(F.lit("secrets"), F.col(id_col)),
            F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(text_col).alias("text"))
    found = map_arrow(rows, _findings, "window binary, y int, judged boolean").withColumn("key", F.xxhash64("window"))
    sample = [r for y in (0, 1) for r in found.filter(F.col("y") == y).orderBy("key").limit(sample_findings).collect()]
    rng = np.random.default_rng(seed)
    windows, y = made_findings(rng, MADE, hard=True)
    judged = ~np.isin(np.arange(MADE) // 2 % MADE_SECRETS, MADE_BASE) | (y == 0)
    if sample:
        windows = np.concatenate((windows, np.array([np.frombuffer(bytes(r["window"]), np.uint8) for r in sample])))
        y = np.concatenate((y, np.array([r["y"] for r in sample], np.float32)))
        judged = np.concatenate((judged, np.array([r["judged"] for r in sample], bool)))
    held, groups = rng.random(len(y)) < 0.25, np.arange(len(y)) >= MADE
    net = Network.fresh(rng)
    net.train(windows[~held], y[~held], rng)
    net.calibrate(windows[held], y[held], recall, judged[held], groups[held])
    return net


def scan_texts(texts: list[str], net: Network) -> list[list[tuple[int, int, int, int]]]:
    """All spans of each text, (start, kind, end, start of the secret) in order."""
    out, owner, spans, first, windows = [], [], [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        for s, e in candidates(text, base):
            owner.append(i)
            spans.append((s, 3, e, s))
            first.append(len(windows))
            windows += windows_of(text, s, e)
    if windows:
        last: dict[int, int] = {}
        for i, span, p in zip(owner, spans, np.maximum.reduceat(net.probability(np.array(windows)), first), strict=True):
            # a run comes before its parts
            if p >= net.threshold and span[0] >= last.get(i, 0):
                out[i].append(span)
                last[i] = span[2]
        for i in last:
            out[i].sort()
    return out


def _said(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, the hash of the patterns' spans, and all spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bc = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found = scan_texts([t or "" for t in b.column(1).to_pylist()], bc.value)
            count = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(_said([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.record_batch([b.column(0), *count[:3], pa.array(sha, pa.string()), pa.array([_said(f) for f in found], pa.string()), count[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redact(docs: DataFrame, net: Network, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; all other characters stay."""
    fields = docs.schema.fields
    at = [f.name for f in fields].index(text_col)
    bc = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            clean = []
            for text, spans in zip(texts, scan_texts([t or "" for t in texts], bc.value), strict=True):
                parts, last = [], 0
                for start, end in sorted((s[3], s[2]) for s in spans):
                    if start >= last:
                        parts += [text[last:start], mark]
                    last = max(last, end)
                clean.append(text if text is None else "".join(parts) + text[last:])
            cols = list(b.columns)
            cols[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_arrow(docs, run, docs.schema)
