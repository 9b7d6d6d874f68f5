"""Exact token counts of a byte-level BPE, by dynamic programming over prefixes.

For a piece of text that the tokenizer's pattern cuts out (a pretoken), the last token of the
encoding of each prefix is the one token that ends there and may follow the last token of the
rest ("may follow": the pair encodes to itself). So one pass gives the count at every prefix.
Pretokens are computed once per task and then looked up; counts of a text are running sums over
its pretokens, and the count at any prefix is such a sum and a stored count inside one pretoken.
Truncation to a budget and questions about any prefix need no further encoding.

The encoding is that of the tokenizers file with its defaults: no tokens are added, the special
string inside a text is one token. Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words
from gridloom.llm.words import Bytes, Table, add_columns, column

LIMIT = 1024
#: Entries of each store of counts that a task keeps; a full store starts anew.
STORE = 400_000


def _byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for
    themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at every prefix for one tokenizers file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        as_bytes = lambda s: bytes(names[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.id = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.longest = max(map(len, self.id))
        #: A merged token's two parts, and the token that two parts merge to; single bytes are their own parts.
        self.parts = {i: (i, i) for t, i in self.id.items() if len(t) == 1}
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in self.rank:
            a, b, c = self.id[left], self.id[right], self.id[left + right]
            self.joined[a, b] = c
            self.parts.setdefault(c, (a, b))
        self.follows: dict[tuple[int, int], bool] = {}
        self.sound = {t: i for t, i in self.id.items() if i in self.parts}
        whole = Bytes(pa.array(list(self.sound), pa.binary()))
        self.table = Table(whole.hashes(whole.offs[:-1], whole.offs[1:]), np.fromiter(self.sound.values(), np.int32))
        pairs = np.array([(a << 32) | b for a, b in self.joined], dtype=np.uint64)
        self.joins = Table(pairs, np.fromiter(self.joined.values(), np.int32))
        self.head, self.tail = (np.array([self.parts.get(i, (i, i))[k] for i in range(max(self.id.values()) + 1)]) for k in (0, 1))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.spans = regex.compile(public_tokenizers.PATTERN).finditer
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.store: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.kept: dict[str, np.ndarray] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b after token a stays as it is: undoing the later merge on either side of
        the border step by step, no merge across the border would have come earlier."""
        limit = 1 << 60
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            for left in (a > b, a <= b):
                if left:
                    limit, a = a, self.parts[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 != limit:
                        break
            else:
                return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of the encoding of piece[:i] for i = 0..len(piece), as one pretoken."""
        n, ids, follows, counts, last = len(piece), self.sound, self.follows, [0], [-1]
        if len(follows) > STORE:
            follows.clear()
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):  # the longest token first
                t = ids.get(piece[j:i])
                if t is not None:
                    if j:
                        pair = (last[j], t)
                        ok = follows.get(pair)
                        if ok is None:
                            ok = follows[pair] = self.may_follow(*pair)
                        if not ok:
                            continue
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {piece!r}")
        return counts

    def may_follow_each(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow for arrays of tokens."""
        out, on = np.zeros(len(a), dtype=bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 60)
        while len(on):
            c = self.joins.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            go = (c < 0) | (c >= limit)
            on, a, b, limit = on[go], a[go], b[go], limit[go]
            left, na, nb = a > b, self.tail[a], self.head[b]
            split_a = np.where(left, na != a, nb == b)  # the side whose later merge is undone
            end = (na == a) & (nb == b)
            limit = np.where(split_a, a, b + 1)
            a, b = np.where(split_a, na, a), np.where(split_a, b, nb)
            out[on[end]] = True
            on, a, b, limit = on[~end], a[~end], b[~end], limit[~end]
        return out

    def prefix_counts_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """prefix_counts of many pieces at once: (order, counts), where counts[k, i] is the count
        of pieces[order[k]][:i]; the prefixes of all pieces advance together."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        text = Bytes(pa.array([pieces[i] for i in order], pa.binary()))
        start, sizes = text.offs[:-1], sizes[order]
        counts = np.zeros((len(pieces), int(sizes[0]) + 1), dtype=np.int32)
        last = np.full_like(counts, -1)
        for i in range(1, int(sizes[0]) + 1):
            left = np.arange(int(np.searchsorted(-sizes, -i, side="right")))
            for n in range(min(i, self.longest), 0, -1):  # the longest token first
                t = self.table.get(text.hashes(start[left] + i - n, start[left] + i))
                fits = np.flatnonzero(t >= 0)
                if n < i:
                    fits = fits[self.may_follow_each(last[left[fits], i - n], t[fits])]
                got = left[fits]
                last[got, i], counts[got, i] = t[fits], counts[got, i - n] + 1
                left = np.delete(left, fits)
                if not len(left):
                    break
            if len(left):
                raise ValueError(f"no token ends at byte {i} of {pieces[order[left[0]]]!r}")
        return order, counts

    def count(self, pretoken: str) -> int:
        got = self.store.get(pretoken)
        if got is None:
            b = pretoken.encode()
            got = self.store[pretoken] = 1 if b in self.sound else self.prefix_counts(b)[-1]
        return got

    def learn(self, texts: list[str]) -> None:
        """Puts the counts of the texts' words into the stores, with one pass for all new ones."""
        for store in (self.store, self.first, self.spaced):
            if len(store) > STORE:
                store.clear()
        new: tuple[set[str], set[str]] = (set(), set())
        for text in texts:
            for line in text.split("\n"):
                words = line.split(" ")
                if words[0] not in self.first:
                    new[0].add(words[0])
                new[1].update(words[1:])
        regular = [[w for w in ws if w not in store and w and not (w[0].isspace() or w[-1].isspace() or any(s in w for s in self.special))] for ws, store in zip(new, (self.first, self.spaced), strict=True)]
        cut = [[self.split(w) for w in regular[0]], [self.split(f" {w}") for w in regular[1]]]
        pretokens = {p for ps in cut for pp in ps for p in pp}.difference(self.store)
        hard = []
        for p in pretokens:
            b = p.encode()
            if b in self.sound:
                self.store[p] = 1
            elif len(b) <= 64:
                hard.append((p, b))
            else:
                self.count(p)
        if hard:
            order, counts = self.prefix_counts_each([b for _, b in hard])
            for k, i in enumerate(order):
                self.store[hard[i][0]] = int(counts[k, len(hard[i][1])])
        for store, ws, ps in zip((self.first, self.spaced), regular, cut, strict=True):
            store.update((w, sum(map(self.store.__getitem__, p))) for w, p in zip(ws, ps, strict=True))

    def units(self, text: str) -> tuple[list[int], list[int]]:
        """Token counts and lengths of parts of the text between which the pattern always cuts.

        A word with the one space before it, a single line feed, and the first word of a line
        are such parts; they are looked up whole. Other texts are cut by the pattern itself.
        """
        counts, sizes = [], []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            got = [self.first.get(words[0]), *map(self.spaced.get, words[1:])]
            if None in got:
                pieces = self.pieces(text)
                return self.counts_of(pieces), list(map(len, pieces))
            counts += [1, *got] if k else got
            sizes += [1, len(words[0])] if k else [len(words[0])]
            sizes += [len(w) + 1 for w in words[1:]]
        return counts, sizes

    def _total(self, text: str) -> int:
        n, get, lines = 0, self.spaced.get, text.split("\n")
        try:
            for line in lines:
                words = line.split(" ")
                n += self.first[words[0]] + sum(map(get, words[1:]))
        except (KeyError, TypeError):  # a part that isn't regular
            return sum(self.counts_of(self.pieces(text)))
        return n + len(lines) - 1

    def pieces(self, text: str) -> list[str]:
        """Pretokens of a text in order, special strings whole."""
        if not self.special or not any(s in text for s in self.special):
            return self.split(text)
        return [p for k, part in enumerate(self.at_special(text)) for p in ([part] if k % 2 else self.split(part))]

    def counts_of(self, pieces: list[str]) -> list[int]:
        store, count = self.store, self.count
        return [1 if p in self.special else store.get(p) or count(p) for p in pieces] if any(s in pieces for s in self.special) else [store.get(p) or count(p) for p in pieces]

    def total(self, text: str) -> int:
        self.learn([text])
        return self._total(text) if text else 0

    def totals(self, texts: list[str]) -> list[int]:
        self.learn(texts)
        return [self._total(t) if t else 0 for t in texts]

    def cut(self, text: str, counts: list[int], sizes: list[int], budget: int) -> int:
        """Code points of the longest prefix with at most `budget` tokens, from the running sums of
        parts and the stored counts of the prefixes around the border."""
        sums, ends = np.cumsum(counts), np.cumsum(sizes)
        k = int(np.searchsorted(sums, budget, side="right"))
        first = max(0, k - 2)  # a run of white space before a word is two pretokens at most
        base, at = (int(sums[first - 1]), int(ends[first - 1])) if first else (0, 0)
        around = self.at_every_prefix(text[at : int(ends[min(k + 3, len(ends) - 1)])])
        return at + int(np.flatnonzero(base + around <= budget)[-1])

    def prefixes(self, pretoken: str) -> np.ndarray:
        """Token count of each prefix of a pretoken, by code points from 0; kept."""
        got = self.kept.get(pretoken)
        if got is None:
            if len(self.kept) > STORE:
                self.kept.clear()
            counts = np.array(self.prefix_counts(pretoken.encode()))
            ends = np.cumsum([0, *(len(c.encode()) for c in pretoken)])
            got = counts[ends]
            if len(pretoken) <= 64:
                self.kept[pretoken] = got
        return got

    def _plain_prefixes(self, text: str) -> np.ndarray:
        """at_every_prefix of a text whose special strings are ordinary text.

        Inside a pretoken a prefix has the tokens before it and those of the pretoken's prefix. Two
        cuts depend on what follows, so a prefix has another one: a run of white space is one
        pretoken until a word follows, and a contraction's letters are a word until it is whole.
        """
        out, done, at, pieces = np.zeros(len(text) + 1, np.int64), 0, 0, self.split(text)
        k = 0
        while k < len(pieces):
            p = pieces[k]
            if p.isspace():
                run, total = p, self.count(p)
                while k + 1 < len(pieces) and pieces[k + 1].isspace():
                    k += 1
                    run, total = run + pieces[k], total + self.count(pieces[k])
                joined = k + 1 < len(pieces) and pieces[k + 1][0] == " "
                inside = done + self.prefixes(run + " " if joined else run)[1:]
                end = at + len(run)
                done += total
                if joined:  # the run's last space is the next word's first
                    k += 1
                    out[end + 1 : end + len(pieces[k]) + 1] = done + self.prefixes(pieces[k])[1:]
                    done += self.count(pieces[k])
                out[at + 1 : at + 1 + len(inside)] = inside
                at = end + (len(pieces[k]) if joined else 0)
                if joined:
                    out[at] = done if len(pieces[k]) > 1 else out[at]
            else:
                if p[0] == "'" and len(p) > 1 and p[1].isalpha():
                    own = np.append(0, self.count("'") + self.prefixes(p[1:]))
                    own[-1] = self.count(p)
                else:
                    own = self.prefixes(p)
                out[at + 1 : at + len(p) + 1] = done + own[1:]
                done += self.count(p)
                at += len(p)
            k += 1
        return out

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Exact token count of text[:i] for i = 0..len(text), in one pass.

        A special string is one token once it is whole; before, its signs go with what stands before it.
        """
        if not self.special or not any(s in text for s in self.special):
            return self._plain_prefixes(text)
        out, done, at = np.zeros(len(text) + 1, np.int64), 0, 0
        parts = self.at_special(text)
        for k in range(0, len(parts), 2):
            part, special = parts[k], parts[k + 1] if k + 1 < len(parts) else ""
            own = self._plain_prefixes(part)
            out[at + 1 : at + len(part) + 1] = done + own[1:]
            if special:
                pieces = self.split(part)
                back = len(part)
                while pieces and (back == len(part) or pieces[-1].isspace()):  # the last pretoken and white space before
                    back -= len(pieces.pop())
                again = self._plain_prefixes(part[back:] + special[:-1])
                at_special = at + len(part)
                out[at_special + 1 : at_special + len(special)] = done + own[back] + again[len(part) - back + 1 :]
                done += int(own[-1]) + 1
                at = at_special + len(special)
                out[at] = done
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


words.caches.append(counter.cache_clear)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, budgets: tuple[int, ...] = (LIMIT,), text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """docs with n_bytes, n_tokens and, for each budget b, cut_b: the code points of the longest
    prefix that has at most b tokens. With `prefixes`, also prefix_tokens: the exact counts of
    text[:i] for i = 0..length, from which `tokens_before` and `longest_prefix` answer any other
    question. Columns with these names are replaced."""
    path = path or vocabulary_path()
    out = {"n_bytes": "bigint", "n_tokens": "bigint"} | {f"cut_{b}": "bigint" for b in budgets}
    if prefixes:
        out["prefix_tokens"] = "array<int>"

    def fn(batch: pa.RecordBatch) -> dict[str, list]:
        c, new = counter(path), {k: [] for k in out}
        texts = [t or "" for t in column(batch, text_col).to_pylist()]
        for text, n in zip(texts, c.totals(texts), strict=True):
            new["n_bytes"].append(len(text.encode()))
            new["n_tokens"].append(n)
            parts = c.units(text) if any(n > b for b in budgets) else ([], [])
            for b in budgets:
                new[f"cut_{b}"].append(len(text) if n <= b else c.cut(text, *parts, b))
            if prefixes:
                new["prefix_tokens"].append(c.at_every_prefix(text).astype(np.int32))
        return new

    return add_columns(docs, text_col, out, fn)


def tokens_before(prefix_tokens: Column, length: Column) -> Column:
    """Tokens of a text's prefix of so many code points, from its stored counts."""
    return F.get(prefix_tokens, F.least(length, F.size(prefix_tokens) - 1).cast("int"))


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of a text's longest prefix within a budget of tokens, from its stored counts."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits).cast("bigint")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), f"cut_{LIMIT}")
