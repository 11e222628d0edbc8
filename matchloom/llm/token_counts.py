r"""Token counts by a finite-state transducer compiled from a BPE tokenizer.

A word's BPE tokens can be found from left to right: the tokens of a prefix end in
exactly one vocabulary token that is compatible with the token before it (two tokens
are compatible if BPE, given their joined text, would not merge across the seam). A
state of the transducer therefore holds, for each suffix of what was read that some
token begins with, the trie node of that suffix, the token before it, and how many
tokens the text up to there has, relative to now. Reading a byte gives the next
state and the change of the count, which annotates the transition. A word's last
byte is a symbol of its own (it carries the end-of-word mark) and leads back to the
start state.

A suffix whose continuations are all incompatible with the token before it is left
out, and tokens that allow the same continuations count as one, which keeps states
few. They are found as texts need them and kept in one table of about ``MAX_STATES``
rows; a full table is emptied before the next texts, so memory is bounded and results
don't change.

Texts are cut into chunks of ``CHUNK`` bytes, and all chunks run in step, one table
look-up for each byte of all chunks. A chunk's state map (entry state to exit state and
tokens) is constant as soon as a word ends in it, so its part after the first word end
is run at once from the start state, and the parts before from the exits to their left.
Chunks within a long word have maps of several entry states: those that the bytes
before them leave from the start state, and those that the maps to their left lead to,
until no map leads out of the next one's. The maps are then composed along each word in
a parallel prefix scan, in as many steps as the logarithm of its chunks, which gives
each chunk its entry and thereby its tokens.

Normalisation (NFC, white space, lower case) and the pre-tokenizer's pattern are
evaluated on arrays of code points. Strings of special tokens are one token each.

Defined results: a null or empty text has no tokens; very long texts, and words, are
counted whole; of merges that overlap (ties in a text) the lowest rank, then the
leftmost goes first, as in the library; doc_ids may be null and of any type; repeated
rows are counted alike; other columns are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import text as tx

CHUNK, MAX_STATES, LIMIT = 256, 1 << 16, 2048
#: Bytes before a chunk within a word that are read for its first entry state.
LEAD = 64
#: Suffixes with so few continuations are looked into.
FEW = 150
VOCABULARY = "word_bpe_49k.json"
_SIGMA = str.maketrans("Σ", "σ")
#: Contractions that the pattern takes as one word when an apostrophe begins a run.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges over 512 symbols (a byte, or a byte that ends a word), as a trie of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 512
        self.born = [-1] * 512
        spelled: list[tuple[int, ...]] = [(k,) for k in range(512)]
        number = {s: k for k, s in enumerate(spelled)}

        def spell(s: str) -> tuple[int, ...]:
            if s.endswith(suffix) and s != suffix:
                body = [symbol[c] for c in s[: -len(suffix)]]
                return (*body[:-1], body[-1] + 256)
            return tuple(symbol[c] for c in s)

        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = spell(a), spell(b)
            if x in number and y in number:
                if x + y not in number:
                    number[x + y] = len(spelled)
                    spelled.append(x + y)
                    self.parts.append((number[x], number[y]))
                    self.born.append(r)
                self.rank.setdefault((number[x], number[y]), r)
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for s, k in number.items():
            node = 0
            for c in s:
                node = self.trie[node].setdefault(c, len(self.trie))
                if node == len(self.token):
                    self.trie.append({})
                    self.token.append(-1)
            self.token[node] = k
        self.seams: dict[tuple[int, int], bool] = {}
        self.whole = [self._is_whole(k) for k in range(len(spelled))]
        self.below: list[list[int] | None] = [None] * len(self.trie)
        for node in range(len(self.trie) - 1, -1, -1):  # children have larger numbers
            out: list[int] | None = []
            for child in self.trie[node].values():
                if out is None or self.below[child] is None:
                    out = None
                    break
                t = self.token[child]
                out = out + self.below[child] + ([t] if t >= 0 and self.whole[t] else [])
            self.below[node] = out if out is None or len(out) <= FEW else None
        self.kinds: dict[tuple[int, int], int | None] = {}
        self.first_of: dict[tuple, int] = {}

    def _spine(self, t: int, side: int) -> list[tuple[int, int, int]]:
        """(token, rank at which it was made, rank at which it was merged away) along one edge of ``t``."""
        out, until = [], sys.maxsize
        while True:
            out.append((t, self.born[t], until))
            if self.parts[t] is None:
                return out
            until, t = self.born[t], self.parts[t][side]

    def _open_seam(self, a: int, b: int, before: int = sys.maxsize) -> bool:
        """No merge of rank below ``before`` joins ``a`` to a ``b`` on its right."""
        right = self._spine(b, 0)
        for x, made_x, gone_x in self._spine(a, 1):
            for y, made_y, gone_y in right:
                r = self.rank.get((x, y))
                if r is not None and r < before and max(made_x, made_y) < r < gone_x and r <= gone_y:
                    return False
        return True

    def _is_whole(self, t: int) -> bool:
        """BPE makes ``t`` one token when it is given its text."""
        if self.parts[t] is None:
            return True
        a, b = self.parts[t]
        return self.whole_so_far(a) and self.whole_so_far(b) and self._open_seam(a, b, self.born[t])

    def whole_so_far(self, t: int) -> bool:
        return t < 512 or self._is_whole(t)

    def compatible(self, a: int, b: int) -> bool:
        ok = self.seams.get((a, b))
        if ok is None:
            if len(self.seams) > 1 << 20:
                self.seams.clear()
            ok = self.seams[a, b] = self._open_seam(a, b)
        return ok


    def kind(self, node: int, before: int) -> int | None:
        """A token that allows the same continuations of ``node`` as ``before``; None: there are none."""
        try:
            return self.kinds[node, before]
        except KeyError:
            k: int | None = before
            below = self.below[node]
            if below is not None:
                allowed = tuple(t for t in below if before < 0 or self.compatible(before, t))
                k = self.first_of.setdefault((node, allowed), before) if allowed else None
            self.kinds[node, before] = k
            return k


#: (trie node, token before or -1, tokens up to there relative to now)
State = tuple[tuple[int, int, int], ...]
_START: State = ((0, -1, 0),)


class Transducer:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = [_START]
        self.number = {_START: 0}
        # Each entry: next state << 8 | (change of the count + 128); -1: not found yet.
        self.table = np.full((256, 512), -1, "i4")

    def compile(self, state: int, symbol: int) -> int:
        """Fill in one transition; the state table must have room for one more."""
        found, kept = None, []
        for node, before, count in self.states[state]:
            child = self.v.trie[node].get(symbol)
            if child is None:
                continue
            kept.append((child, before, count))
            t = self.v.token[child]
            if found is None and t >= 0 and self.v.whole[t] and (before < 0 or self.v.compatible(before, t)):
                found = t, count + 1
        token, change = found
        if symbol >= 256:
            to = _START
        else:
            kind = self.v.kind
            to = (*((n, k, c - change) for n, b, c in kept if (k := kind(n, b)) is not None), (0, token, 0))
        k = self.number.get(to)
        if k is None:
            k = self.number[to] = len(self.states)
            self.states.append(to)
            if k >= len(self.table):
                grown = np.full((2 * len(self.table), 512), -1, "i4")
                grown[: len(self.table)] = self.table
                self.table = grown
        self.table[state, symbol] = k << 8 | change + 128
        return self.table[state, symbol]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes of the counts) of all lanes."""
        entry = self.table[state, symbol]
        missing = np.flatnonzero(entry < 0)
        for k in missing:
            e = self.table[state[k], symbol[k]]
            entry[k] = e if e >= 0 else self.compile(int(state[k]), int(symbol[k]))
        return entry >> 8, (entry & 255) - 128

    def full(self, lanes: int) -> bool:
        return len(self.states) + lanes >= MAX_STATES

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, sum of changes) of lanes [begin, end) of ``symbols``, in step."""
        total = np.zeros(len(begin), "i8")
        order = np.argsort(begin - end, kind="stable")
        length, at, s = (end - begin)[order], begin[order], state[order].copy()
        n = np.zeros(len(begin), "i8")
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            s[:live], d = self.step(s[:live], symbols[at[:live] + i])
            n[:live] += d
        exit_ = np.empty(len(begin), "i8")
        exit_[order], total[order] = s, n
        return exit_, total

    def counts(self, symbols: np.ndarray, chunk_start: np.ndarray, chunk_end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens emitted in each chunk; ``first``: chunks that begin at the start state."""
        n = len(chunk_start)
        marks = np.flatnonzero(symbols >= 256)
        k = np.searchsorted(marks, chunk_start)
        cut = np.where(k < len(marks), np.append(marks, len(symbols))[k] + 1, len(symbols) + 1)
        fixed = first | (cut <= chunk_end)  # the exit doesn't hang on the entry
        split = np.where(first, chunk_start, np.minimum(cut, chunk_end))
        exit_, total = self.run(symbols, split, chunk_end, np.zeros(n, "i8"))
        now = np.flatnonzero(~first & np.append(False, fixed[:-1]))  # entered from a known state
        out, more = self.run(symbols, chunk_start[now], split[now], exit_[now - 1])
        total[now] += more
        exit_[now[~fixed[now]]] = out[~fixed[now]]
        inner = np.flatnonzero(~first & ~np.append(True, fixed[:-1]))
        if len(inner):
            total[inner] += self.composed(symbols, inner, chunk_start, split, exit_)
        return total

    def composed(self, symbols: np.ndarray, inner: np.ndarray, chunk_start: np.ndarray, split: np.ndarray, exit_: np.ndarray) -> np.ndarray:
        """Tokens that chunks ``inner`` emit up to ``split``: chunks whose left neighbours lie within the same word.

        ``exit_`` is known of a neighbour that isn't itself ``inner``.
        """
        v = len(inner)
        chained = np.append(False, np.diff(inner) == 1)  # the neighbour is inner
        heads = np.flatnonzero(~chained)
        entry: list[dict[int, int]] = [{} for _ in range(v)]  # number of each entry state
        rows: list[list[tuple[int, int]]] = [[] for _ in range(v)]  # exit state and tokens of each
        lead = np.flatnonzero(chained)
        begin = chunk_start[inner[lead]]
        guess, _ = self.run(symbols, begin - np.minimum(LEAD, CHUNK), begin, np.zeros(len(lead), "i8"))
        fresh = [*zip(heads.tolist(), exit_[inner[heads] - 1].tolist(), strict=True), *zip(lead.tolist(), guess.tolist(), strict=True)]
        while fresh:
            for k, state in fresh:
                entry[k][state] = len(entry[k])
            lane = np.array([k for k, _ in fresh])
            out, n = self.run(symbols, chunk_start[inner[lane]], split[inner[lane]], np.array([state for _, state in fresh], "i8"))
            more = {}
            for k, o, c in zip(lane.tolist(), out.tolist(), n.tolist(), strict=True):
                rows[k].append((o, c))
                if k + 1 < v and chained[k + 1] and o not in entry[k + 1]:
                    more[k + 1, o] = None
            fresh = list(more)
        width = max(map(len, rows))
        to, count = np.zeros((v, width), "i8"), np.zeros((v, width), "i8")
        for k, found in enumerate(rows):
            for j, (o, c) in enumerate(found):
                count[k, j] = c
                if k + 1 < v and chained[k + 1]:
                    to[k, j] = entry[k + 1][o]
        depth = np.arange(v) - np.repeat(heads, np.diff(np.append(heads, v)))
        step = 1
        while step <= depth.max(initial=0):  # to[k]: from the entry of the chunk up to ``step`` before k, to that of the next one
            k = np.flatnonzero(depth >= step)
            to[k] = np.take_along_axis(to[k], to[k - step], axis=1)
            step *= 2
        at = np.zeros(v, "i8")
        at[lead] = to[lead - 1, 0]  # a word's first chunk has one entry state, number 0
        return count[np.arange(v), at]


def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, "u1")
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            out[c] = 1
        elif g == "N":
            out[c] = 2
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = 0
    return out


def normalise(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(_SIGMA).lower() if "Σ" in text else text.lower()


def symbols_of(text: str, classes: np.ndarray) -> np.ndarray:
    """The symbols of a normalised text: bytes of its words, +256 for the last of each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes[points]
    before = np.concatenate(([0], kind[:-1])).astype("u1")
    start = (kind != 0) & ((kind != before) | (kind == 2))
    quote = np.flatnonzero((points == 39) & (before != 3))
    if len(quote):
        for k in quote.tolist():
            for c in CONTRACTIONS:
                if text.startswith(c, k + 1):
                    start[k + 1] = False
                    if k + 1 + len(c) < len(kind) and kind[k + 1 + len(c)] != 0:
                        start[k + 1 + len(c)] = True
                    break
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    begins = np.cumsum(width) - width
    solid = np.repeat(kind != 0, width)
    mark = np.zeros(len(data), bool)
    mark[begins[start]] = True
    out = data[solid].astype("i8")
    mark = mark[solid]
    out[np.append(mark[1:], True)[: len(out)]] += 256
    return out


class Counter:
    def __init__(self, path: str) -> None:
        self.machine = Transducer(Vocabulary(path))
        self.classes = _classes()
        special = sorted(self.machine.v.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.hint = special[0][:2] if special else "\0"

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra, parts, owner = np.zeros(len(texts), "i8"), [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            pieces = [t]
            if self.special is not None and self.hint in t:
                pieces = self.special.split(t)
                extra[k] = len(pieces) - 1
            for p in pieces:
                if p and len(s := symbols_of(normalise(p), self.classes)):
                    parts.append(s)
                    owner.append(k)
        if not parts:
            return extra
        symbols = np.concatenate(parts)
        size = np.array([len(p) for p in parts])
        n = -(-size // CHUNK)
        part = np.repeat(np.arange(len(parts)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = (np.cumsum(size) - size)[part]
        begin = base + nth * CHUNK
        end = np.minimum(begin + CHUNK, base + size[part])
        if self.machine.full(1 << 13):
            self.machine.reset()
        got = self.machine.counts(symbols, begin, end, nth == 0)
        return extra + np.bincount(np.array(owner)[part], got, len(texts)).astype("i8")


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process and path."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _counting(path: str | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By import and not by reference: pickled functions have globals of their own in each task.
        from matchloom.llm import token_counts

        c = token_counts.counter(path or vocabulary_path())
        for batch in batches:
            column = batch.column(1)
            for i, j, _, at in tx.pieces(column):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(c.count(texts))],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )
        tx.release()

    return count


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs`` (doc_id, text); ``path`` of a BPE file."""
    if path is not None and not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_counting(path), f"doc_id {kind}, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
