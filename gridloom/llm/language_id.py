"""Language identification by unigram models over a fixed public vocabulary of pieces.

A word (a run of letters with the one space before it, A-Z lower-cased) has a probability in each
language: the sum over all its segmentations into pieces of the product of the pieces'
probabilities, by the forward algorithm. A text's score is the posterior of the language over its words,
with equal priors.

Learning is one pass over all labelled texts and one step of expectation maximisation from equal
piece probabilities: the forward-backward algorithm gives each piece's expected count in each
language. All words of a slice of a batch advance together, byte by byte, and a word that
repeats is computed once. Words that are so long that a product could leave the range of doubles are
summed in logarithms; no run of letters is cut, however long it is (scripts without spaces). Of
such a run both ways hold one block of positions at a time.

Null texts and texts without a letter are `und` with score 0. Labels that are null are not
learnt from; equal posteriors go to the language whose name sorts first. With nothing to
learn from, every text is `und`.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import LOWER, Bytes, Store, Table, add_columns, byte_class, caches, column, drop_stores, empty, keep_only, own_store, prepare, slices

UNKNOWN = "und"
SMOOTHING = 0.05
#: Cells (words x letters x languages) of a chunk, and positions of a word that are matched at once. Matches
#: take many times a chunk's own memory.
CELLS, BLOCK = 1 << 19, 1 << 15
#: Log of the smallest probability that is left to plain products.
SAFE = -600.0
#: Numbers (words x languages) that a task keeps; when they are more, it starts anew.
STORE = 2_000_000
#: Words that are counted before they are segmented.
COUNTED = 1 << 17
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_FOLD = np.where(LETTER, LOWER, 32).astype(np.uint8)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[Table, int, int]:
    """(table of piece hashes, number of pieces, longest piece in bytes) of the vocabulary's
    pieces that normalised words can hold, all single bytes of letters included."""
    with open(path, "rb") as f:
        own = [base64.b64decode(line.split()[0]) for line in f]
    inner = set(np.flatnonzero(LETTER & (LOWER == np.arange(256))).tolist())
    own = [p for p in own if set(p[1:]) <= inner and (p[0] == 32 or p[0] in inner)]
    if not {bytes([b]) for b in inner | {32}} <= set(own):
        raise ValueError(f"{path} lacks single bytes")
    b = Bytes(pa.array(own, pa.binary()))
    return Table(b.hashes(b.offs[:-1], b.offs[1:]), np.arange(len(own), dtype=np.int32)), len(own), max(map(len, own))


caches.append(pieces.cache_clear)


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _words(texts: pa.Array) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, document and distinct-word index of each word, start and end of distinct words)."""
    b = Bytes(texts, _FOLD)
    start, end, doc = b.runs(LETTER)
    start = np.where(start > b.offs[doc], start - 1, start)
    _, first, word = np.unique(b.hashes(start, end), return_index=True, return_inverse=True)
    return b, doc, word, start[first], end[first]


def _matches(b: Bytes, start: np.ndarray, size: np.ndarray, table: Table, longest: int, low: int, high: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end position, length, words, pieces) of all pieces that end at positions low + 1 to high of
    words that are sorted by size, descending; by end position and length."""
    live = int(np.searchsorted(-size, -low, side="left"))
    count = np.minimum(size[:live], high) - low
    word = np.repeat(np.arange(live), count)
    end = low + 1 + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    found = []
    for n in range(1, min(longest, high) + 1):
        if n > low + 1:
            on = end >= n
            word, end = word[on], end[on]
        at = start[word] + end
        t = table.get(b.hashes(at - n, at))
        w = np.flatnonzero(t >= 0)
        found.append((end[w], np.full(len(w), n), word[w], t[w]))
    end, length, word, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    key = end * (longest + 1) + length
    order = np.argsort(key, kind="stable")
    key, word, piece = key[order], word[order], piece[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    return [(int(key[a]) // (longest + 1), int(key[a]) % (longest + 1), word[a:z], piece[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _chunks(start: np.ndarray, end: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Words of like sizes, longest first in each chunk, so many that a table of their positions is bounded."""
    order = np.argsort(start - end, kind="stable")
    size, k = (end - start)[order], 0
    while k < len(order):
        n = max(1, CELLS // (width * (int(size[k]) + 1)))
        yield order[k : k + n]
        k += n


def log_probabilities(b: Bytes, start: np.ndarray, end: np.ndarray, table: Table, longest: int, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of each word, for each column (language) of p."""
    out = np.zeros((len(start), p.shape[1]))
    logp = np.log(p)
    for own in _chunks(start, end, p.shape[1]):
        size = (end - start)[own]
        top = int(size[0])
        plain = top * float(logp.min()) > SAFE
        # a word's last `longest` positions are all that its next ones need
        rows = min(top, longest + BLOCK) + 1
        alpha = np.full((rows, len(own), p.shape[1]), 0.0 if plain else -np.inf)
        alpha[0] = 1.0 if plain else 0.0
        base = 0  # the position of alpha[0]
        for low in range(0, top, BLOCK):
            high = min(top, low + BLOCK)
            if high - base >= rows:
                keep = min(longest, low - base)
                alpha[: keep + 1] = alpha[low - base - keep : low - base + 1].copy()
                alpha[keep + 1 :] = 0.0 if plain else -np.inf
                base = low - keep
            for i, n, w, t in _matches(b, start[own], size, table, longest, low, high):
                if plain:
                    alpha[i - base, w] += alpha[i - n - base, w] * p[t]
                else:
                    alpha[i - base, w] = np.logaddexp(alpha[i - base, w], alpha[i - n - base, w] + logp[t])
            done = np.flatnonzero((size > low) & (size <= high))
            last = alpha[size[done] - base, done]
            out[own[done]] = np.log(last) if plain else last
    return out


def _forward(b: Bytes, start: np.ndarray, size: np.ndarray, table: Table, longest: int, block: tuple[int, int], before: np.ndarray, n_pieces: int, plain: bool) -> tuple[np.ndarray, list]:
    """(alpha, matches) of a block's positions under equal piece probabilities; alpha begins with
    `before`, its rows up to the block's first position."""
    low, high = block
    found = _matches(b, start, size, table, longest, low, high)
    alpha = np.concatenate([before, np.full((high - low, before.shape[1]), 0.0 if plain else -np.inf)])
    base, logp = low + 1 - len(before), -np.log(n_pieces)
    for i, n, w, _ in found:
        if plain:
            alpha[i - base, w] += alpha[i - n - base, w] / n_pieces
        else:
            alpha[i - base, w] = np.logaddexp(alpha[i - base, w], alpha[i - n - base, w] + logp)
    return alpha, found


def expected_counts(b: Bytes, start: np.ndarray, end: np.ndarray, table: Table, longest: int, n_pieces: int, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) under equal piece probabilities; `weight` has
    each word's count in each language. Of words of several blocks, the way forward keeps the last
    `longest` positions before each block, and the way back fills one block after the other anew."""
    out = np.zeros((n_pieces, weight.shape[1]))
    logp = -np.log(n_pieces)
    for own in _chunks(start, end, 4):
        size = (end - start)[own]
        top = int(size[0])
        plain = top * logp > SAFE
        zero, one = (0.0, 1.0) if plain else (-np.inf, 0.0)
        blocks = [(low, min(top, low + BLOCK)) for low in range(0, top, BLOCK)]
        ends = [np.flatnonzero((size > low) & (size <= high)) for low, high in blocks]
        total, alpha, found = np.empty(len(own)), np.full((1, len(own)), one), []
        edges = []
        for block, done in zip(blocks, ends, strict=True):
            edges.append(alpha[-longest:].copy())
            alpha, found = _forward(b, start[own], size, table, longest, block, edges[-1], n_pieces, plain)
            total[done] = alpha[size[done] - block[1] - 1, done]
        late = np.full((1, len(own)), zero)  # beta of the last positions of a block, as later blocks leave it
        for block, done, before in zip(reversed(blocks), reversed(ends), reversed(edges), strict=True):
            if block[1] < top:
                alpha, found = _forward(b, start[own], size, table, longest, block, before, n_pieces, plain)
            beta, base = np.full_like(alpha, zero), block[0] + 1 - len(before)
            beta[-len(late) :] = late
            beta[size[done] - base, done] = one
            for i, n, w, t in reversed(found):  # pieces that end at i need beta[i] whole: later ends come first
                i, j = i - base, i - n - base
                if plain:
                    share = alpha[j, w] * beta[i, w] / n_pieces / total[w]
                    beta[j, w] += beta[i, w] / n_pieces
                else:
                    share = np.exp(alpha[j, w] + beta[i, w] + logp - total[w])
                    beta[j, w] = np.logaddexp(beta[j, w], beta[i, w] + logp)
                for k in range(weight.shape[1]):
                    np.add.at(out[:, k], t, share * weight[own[w], k])
            late = beta[: len(before)].copy()
    return out


class WordCounts:
    """Words of many slices with their counts by language, so that a word that a task meets again and
    again is segmented once (or a few times, until the store is sorted anew). A full store is emptied into `counts`."""

    def __init__(self, path: str):
        self.table, self.n, self.longest = pieces(path)
        self.index, self.words = Store(2 * COUNTED), []
        self.weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.counts: dict[str, np.ndarray] = {}
        self.names: dict[str, int] = {}
        self.bytes = 0

    def add(self, texts: pa.Array, langs: list[str]) -> None:
        b, doc, word, start, end = _words(texts)
        if not len(word):
            return
        lang = np.array([self.names.setdefault(x, len(self.names)) for x in langs])
        h, raw = b.hashes(start, end), b.data.tobytes()
        at, missing = self.index.get(h, 1)
        own = at[:, 0].astype(np.int64)
        own[missing] = np.arange(len(self.words), len(self.words) + len(missing))
        self.index.put(h[missing], own[missing, None].astype(float))
        self.words += [raw[s:e] for s, e in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
        self.bytes += int((end - start)[missing].sum())
        key, n = np.unique(own[word] * 4096 + lang[doc], return_counts=True)
        if len(self.names) > 4096:
            raise ValueError("more than 4096 languages")
        self.weights.append((key // 4096, key % 4096, n))
        if len(self.words) > COUNTED or self.bytes > 1 << 25 or len(self.weights) > 256:
            self.flush()

    def flush(self) -> None:
        """The words' expected counts go to `counts`."""
        if self.words:
            at, lang, n = (np.concatenate(x) for x in zip(*self.weights, strict=True))
            weight = np.zeros((len(self.words), len(self.names)))
            np.add.at(weight, (at, lang), n)
            b = Bytes(pa.array(self.words, pa.binary()))
            got = expected_counts(b, b.offs[:-1], b.offs[1:], self.table, self.longest, self.n, weight)
            for name, k in self.names.items():
                self.counts[name] = self.counts.get(name, 0) + got[:, k]
        self.index, self.words, self.weights, self.bytes = Store(2 * COUNTED), [], [], 0


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities: pieces x languages) from all rows of docs whose
    label and text are given. The counts are summed in the executors; the model that reaches the
    driver has at most one number for each piece and language."""
    path = path or vocabulary_path()
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(__name__)
        counts = WordCounts(path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts.add(column(part, "text"), column(part, "lang").to_pylist())
        counts.flush()
        for name, c in counts.counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "piece", "n"])
        counts = batch = part = c = at = None
        empty()

    prepare(docs.sparkSession)
    # rounded, so that the order of the sum doesn't show
    model = rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.round(F.sum("n"), 3).alias("n")).toArrow()
    langs = sorted(set(model.column("lang").to_pylist()))
    counts = np.zeros((pieces(path)[1], len(langs)))
    at = np.searchsorted(langs, np.asarray(model.column("lang").to_pylist(), dtype=str)) if langs else np.empty(0, int)
    counts[model.column("piece").to_numpy(), at] = model.column("n").to_numpy()
    counts += SMOOTHING
    return langs, counts / counts.sum(axis=0)


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred); columns with these names are replaced."""
    path = path or vocabulary_path()
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])
    name = uuid.uuid4().hex  # of this model, for the workers' stores

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, n = column(batch, text_col), batch.num_rows
        if not langs:
            return {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n}
        table, _, longest = pieces(path)
        b, doc, word, start, end = _words(texts)
        store, h = own_store(name, STORE // len(langs)), b.hashes(start, end)
        each, missing = store.get(h, len(langs))
        if len(missing):
            each[missing] = log_probabilities(b, start[missing], end[missing], table, longest, shared.value)
            store.put(h[missing], each[missing])
        total = np.stack([np.bincount(doc, weights=each[word, k], minlength=n) for k in range(len(langs))], axis=1)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        return {
            "lang_pred": [langs[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)],
            "score": np.where(letter, score, 0.0),
        }

    return add_columns(docs, text_col, {"lang_pred": "string", "score": "double"}, fn, [drop_stores])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
