"""Secret scan: fixed patterns and a linear-chain conditional random field over tokens.

The patterns (assignments of passwords and keys, access keys, long hex strings) are matched in the whole
text. The field labels each token as outside, beginning or inside a secret: a line is a sequence
of tokens (runs of letters, digits and marks, or of signs), and a label's weight comes from the
token's own shape, the shapes of its neighbours, what a keyword or sign before it says, and the
document's kind (how much of it is assignments and how long it is). Viterbi decoding finds the
best labels of each line; lines in which no token can outweigh the label 'outside' under any
transition are settled without it, which changes no result. A span that the field finds is added where it
touches no span of the patterns, with kind crf.

The field is fitted by gradient ascent on the conditional likelihood of at most `TRAIN_LINES`
different pieces of lines (those with the smallest hash), labelled by the patterns: pieces with a match,
and as many without, from the documents with a match and from about `CLEAN_DOCS` others that a hash
chooses among all. A long line is cut into pieces of `PIECE` tokens, none inside a secret. So that the
field learns more than the patterns say, what they know is held out in copies of each piece
with a match: the keyword is hidden, the secret's length and alphabet are others, or both.
Offsets are code points, the end exclusive. Null and empty texts have no spans; repeated rows have
the same spans. Without a training line that holds a match the field adds nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import drop, save
from gridloom.llm.words import LOWER, Bytes, add_columns, byte_class, column, emit_rows

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A cheap superset of the texts with an assignment or an access key.
_MAYBE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]"
#: Bounds of the training sample: pieces of lines, and documents without a match that give some.
TRAIN_LINES, CLEAN_DOCS = 2000, 4000
#: Tokens of a piece.
PIECE = 200
STEPS, RATE, DECAY = 80, 0.3, 1e-3
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

WORDY = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)) | np.isin(np.arange(256), list(b"+/_.-"))
SPACE = byte_class((0x09, 0x0D), (0x20, 0x20))
KEYWORDS = (b"password", b"passwd", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"key", b"auth", b"credential", b"bearer")
#: Shapes: 0 line border; then by length (4) and make (8); 33 keyword; 34 = or :; 35 quotes; 36 other signs.
SHAPES = 37


def base_spans(text: str, maybe: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    out = []
    if maybe:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


class Tokens:
    """Tokens of a slice of documents with their shapes, in lines."""

    def __init__(self, texts: pa.Array):
        b = self.bytes = Bytes(texts)
        kind = np.where(SPACE, 0, np.where(WORDY, 1, 2)).astype(np.uint8)[b.data]
        edge = np.ones(len(kind), dtype=bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[b.offs[:-1][b.offs[:-1] < len(kind)]] = True
        at = np.flatnonzero(edge)
        stop = np.append(at[1:], len(kind))
        tok = kind[at] > 0
        self.start, self.end = at[tok], stop[tok]
        self.doc = np.searchsorted(b.offs, self.start, side="right") - 1
        feeds = np.concatenate([[0], np.cumsum(b.data == 0x0A)])
        line = feeds[self.start] + self.doc * (len(kind) + 1)
        new = np.ones(len(line), dtype=bool)
        new[1:] = line[1:] != line[:-1]
        self.first = np.flatnonzero(new)  # first token of each line
        self.shape = self._shapes(kind)
        signs = np.bincount(self.doc[self.shape == 34], minlength=b.n)
        count = np.maximum(np.bincount(self.doc, minlength=b.n), 1)
        self.file = (np.digitize(signs / count, [0.002, 0.02, 0.1]) * 3 + np.digitize(count, [50, 1000]))[self.doc]

    def _shapes(self, kind: np.ndarray) -> np.ndarray:
        d, s, e = self.bytes.data, self.start, self.end
        sums = {}
        for name, cls in (("digit", byte_class((0x30, 0x39))), ("upper", byte_class((0x41, 0x5A))), ("hex", byte_class((0x30, 0x39), (0x61, 0x66))), ("mark", np.isin(np.arange(256), list(b"+/_-")))):
            c = np.zeros(len(d) + 1, np.int32)
            np.cumsum(cls[d], out=c[1:])
            sums[name] = c[e] - c[s]
        n = e - s
        length = np.digitize(n, [6, 12, 20])
        mixed = (sums["digit"] > 0) & (sums["digit"] < n)
        make = np.select([sums["digit"] == n, mixed & (sums["hex"] == n), mixed & (sums["upper"] + sums["digit"] == n), mixed & (sums["upper"] > 0), mixed, sums["mark"] > 0, sums["upper"] > 1], [1, 2, 3, 4, 5, 6, 7], 0)
        shape = 1 + length * 8 + make
        low = Bytes(pa.array([], pa.binary()))
        low.raw, low.data = self.bytes.raw, LOWER[self.bytes.data]
        keys = Bytes(pa.array(KEYWORDS, pa.binary()))
        short = np.flatnonzero((n <= 10) & (kind[s] == 1))
        shape[short[np.isin(low.hashes(s[short], e[short]), keys.hashes(keys.offs[:-1], keys.offs[1:]))]] = 33
        sign = kind[s] == 2
        one = d[s]
        shape[sign] = np.select([np.isin(one, list(b"=:")), np.isin(one, list(b"\"'"))], [34, 35], 36)[sign]
        return shape

    def features(self) -> np.ndarray:
        """(tokens x 6) indexes into the field's weight tables."""
        n = len(self.shape)
        out = np.zeros((n, 6), np.int64)
        inline = np.arange(n) - np.repeat(self.first, np.diff(np.append(self.first, n)))
        out[:, 0] = self.shape
        for k in (1, 2, 3):
            out[k:, k] = np.where(inline[k:] >= k, self.shape[:-k], 0)
        nxt = np.zeros(n, np.int64)
        nxt[:-1] = np.where(inline[1:] > 0, self.shape[1:], 0)
        out[:, 4], out[:, 5] = nxt, self.file
        return out + np.arange(6) * SHAPES


class Field:
    """Weights: one for each feature and label, and for each pair of labels."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.emit[features[:, k]] for k in range(features.shape[1]))

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of all tokens; lines advance together, the longest ones to the end."""
        out = np.zeros(len(scores), np.int8)
        size = np.diff(np.append(first, len(scores)))
        gain = (scores[:, 1:].max(axis=1) - scores[:, 0]) + max(0.0, float((self.move - self.move[0, 0]).max())) * 2
        live = np.flatnonzero(np.maximum.reduceat(gain, first) > 0) if len(first) else first
        live = live[np.argsort(-size[live], kind="stable")]
        if not len(live):
            return out
        start, size = first[live], size[live]
        best, back = scores[start].copy(), []
        best[:, INSIDE] = -1e9  # a secret starts with its beginning
        for t in range(1, int(size[0])):
            on = int(np.searchsorted(-size, -t, side="left"))
            way = best[:on, :, None] + self.move[None]
            back.append(way.argmax(axis=1).astype(np.int8))
            best[:on] = way.max(axis=1) + scores[start[:on] + t]
        label = best.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            on = int(np.searchsorted(-size, -t, side="left"))
            out[start[:on] + t] = label[:on]
            if t:
                label[:on] = back[t - 1][np.arange(on), label[:on]]
        return out


def fit(lines: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """The field that maximises the conditional likelihood of lines (features, labels)."""
    lines = sorted(lines, key=lambda x: -len(x[1]))
    size = np.array([len(y) for _, y in lines])
    x, y = np.concatenate([f for f, _ in lines]), np.concatenate([y for _, y in lines])
    start = np.cumsum(size) - size
    steps = [(int(np.searchsorted(-size, -t, side="left"))) for t in range(int(size[0]))]
    theta, m, v = np.zeros((6 * SHAPES + 3, 3)), 0, 0
    theta[6 * SHAPES + OUTSIDE, INSIDE] = -8.0  # inside follows only beginning or inside
    gold = np.zeros_like(theta)
    for k in range(6):
        np.add.at(gold, (x[:, k], y), 1)
    inner = np.ones(len(y), dtype=bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    np.add.at(gold, (6 * SHAPES + y[at - 1], y[at]), 1)
    for step in range(1, STEPS + 1):
        move = theta[6 * SHAPES :]
        s = sum(theta[x[:, k]] for k in range(6))
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[start] = s[start]
        for t in range(1, len(steps)):
            i = start[: steps[t]] + t
            z = a[i - 1][:, :, None] + move[None]
            top = z.max(axis=1)
            a[i] = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + s[i]
        for t in range(len(steps) - 1, 0, -1):
            i = start[: steps[t]] + t
            z = move[None] + (s[i] + b[i])[:, None, :]
            top = z.max(axis=2)
            b[i - 1] = top + np.log(np.exp(z - top[:, :, None]).sum(axis=2))
        whole = np.repeat(np.log(np.exp(a[start + size - 1] - a[start + size - 1].max(axis=1, keepdims=True)).sum(axis=1)) + a[start + size - 1].max(axis=1), size)
        p = np.exp(a + b - whole[:, None])
        model = np.zeros_like(theta)
        for k in range(6):
            for c in range(3):
                model[: 6 * SHAPES, c] += np.bincount(x[:, k], weights=p[:, c], minlength=6 * SHAPES)
        pair = np.exp(a[at - 1][:, :, None] + move[None] + (s[at] + b[at])[:, None, :] - whole[at][:, None, None])
        model[6 * SHAPES :] += pair.sum(axis=0)
        g = (gold - model) / len(lines) - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: 6 * SHAPES], theta[6 * SHAPES :])


def _weak_labels(tokens: Tokens, texts: list[str]) -> np.ndarray:
    """Labels by the patterns: tokens inside a match's secret part are its beginning and inside."""
    label = np.zeros(len(tokens.start), np.int8)
    chars = tokens.bytes.chars_before()
    for i, text in enumerate(texts):
        own = slice(*np.searchsorted(tokens.doc, [i, i + 1]))
        base = chars[tokens.bytes.offs[i]]
        s, e = chars[tokens.start[own]] - base, chars[tokens.end[own]] - base
        for a, z, kind in base_spans(text):
            a = ASSIGN.match(text, a).start(2) if kind == 0 else a
            inside = np.flatnonzero((s < z) & (e > a)) + own.start
            label[inside] = INSIDE
            label[inside[:1]] = BEGIN
    return label


def pieces_of(first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """First tokens of the pieces of all lines, whose first tokens are given."""
    stop = np.append(first[1:], len(label))
    cuts = np.concatenate([np.arange(a, z, PIECE) for a, z in zip(first, stop, strict=True)] or [first])
    for k in np.flatnonzero(label[cuts] == INSIDE):  # inside a secret: where it ends
        while cuts[k] < len(label) and label[cuts[k]] == INSIDE:
            cuts[k] += 1
    return np.unique(cuts[cuts < len(label)])


def held_out_copies(x: np.ndarray, y: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Copies of a piece with a secret: keyword hidden; secret of another shape; both."""
    rng, out = np.random.default_rng(seed), []
    column = np.arange(5) * SHAPES
    for hide, reshape in ((True, False), (False, True), (True, True)):
        new = x.copy()
        if hide:  # a short plain word stands there
            at = new[:, :5] - column == 33
            new[:, :5] = np.where(at, column + 1, new[:, :5])
        if reshape:
            for t in np.flatnonzero(y == BEGIN):
                shape = 1 + int(rng.integers(2 if hide else 1, 4)) * 8 + int(rng.integers(2, 6))
                for k, u in ((0, t), (1, t + 1), (2, t + 2), (3, t + 3), (4, t - 1)):
                    if 0 <= u < len(new) and new[u, k] != k * SHAPES:  # not over a line's border
                        new[u, k] = k * SHAPES + shape
        out.append((new, y))
    return out


def learn(docs: DataFrame, text_col: str = "text", lines: int = TRAIN_LINES) -> Field | None:
    """The field, from at most `lines` different pieces of lines, half of them with a match."""
    n = docs.count()
    few = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CLEAN_DOCS / max(1, n)))

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        texts = column(batch, "text")
        hex_ = np.asarray(pc.fill_null(pc.match_substring_regex(texts, "[0-9a-f]{24}"), False))
        some = np.flatnonzero(_maybe(texts) | hex_ | np.asarray(pc.fill_null(column(batch, "few"), False)))
        if not len(some):
            return None
        t = Tokens(texts.take(pa.array(some)))
        if not len(t.start):
            return None
        x = t.features()
        y = _weak_labels(t, [s.as_py() or "" for s in texts.take(pa.array(some))])
        first = pieces_of(t.first, y)
        stop = np.append(first[1:], len(y))
        return {
            "hit": pa.array(np.maximum.reduceat(y, first) > 0),
            "ord": pa.array(t.bytes.hashes(t.start[first], t.end[stop - 1]).view(np.int64)),
            "x": pa.array([x[a:z].astype(np.int16).tobytes() for a, z in zip(first, stop, strict=True)], pa.binary()),
            "y": pa.array([y[a:z].tobytes() for a, z in zip(first, stop, strict=True)], pa.binary()),
        }

    rows = save(emit_rows(docs.select(F.col(text_col).alias("text"), few.alias("few")), "text", "hit boolean, ord bigint, x binary, y binary", fn), "lines")
    order = ["ord", "x", "y"]
    different = rows.distinct()  # a copied line counts once
    sample = different.where("hit").orderBy(*order).limit(lines // 2).unionByName(different.where("NOT hit").orderBy(*order).limit(lines // 2)).toArrow()
    drop(rows)
    got = [(np.frombuffer(x, np.int16).reshape(-1, 6).astype(np.int64), np.frombuffer(y, np.int8).astype(np.int64)) for x, y in zip(sample.column("x").to_pylist(), sample.column("y").to_pylist(), strict=True)]
    if not any(y.any() for _, y in got):
        return None
    copies = [c for k, (x, y) in enumerate(got) if y.any() for c in held_out_copies(x, y, k)]
    return fit([*got, *copies])


def _maybe(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False))


def find_secrets(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with secrets: array of (start, end, kind), by start, then kind; a column with this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def fn(batch: pa.RecordBatch) -> dict[str, list]:
        texts, model = column(batch, text_col), shared.value
        maybe = _maybe(texts)
        all_spans = [base_spans(text or "", m) for text, m in zip(texts.to_pylist(), maybe, strict=True)]
        if model is not None:
            t = Tokens(texts)
            if len(t.start):
                label = model.decode(model.scores(t.features()), t.first)
                chars = None
                begin = np.flatnonzero(label == BEGIN)
                if len(begin):
                    chars = t.bytes.chars_before()
                line_end = np.append(t.first[1:], len(label))
                for i in begin:
                    stop = line_end[np.searchsorted(t.first, i, side="right") - 1]
                    j = i + 1
                    while j < stop and label[j] == INSIDE:
                        j += 1
                    d = t.doc[i]
                    base = chars[t.bytes.offs[d]]
                    a, z = int(chars[t.start[i]] - base), int(chars[t.end[j - 1]] - base)
                    if not any(a < e and s < z for s, e, _ in all_spans[d]):
                        all_spans[d] = sorted([*all_spans[d], (a, z, 3)], key=lambda x: (x[0], x[2]))
        return {"secrets": [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans] for spans in all_spans]}

    return add_columns(docs, text_col, {"secrets": "array<struct<start:int,end:int,kind:string>>"}, fn)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, learn(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), count("crf"))
