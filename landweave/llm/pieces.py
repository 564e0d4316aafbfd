"""SentencePiece encoding and decoding, with sampled segmentations without replacement.

A text's lattice has a node before each character and an edge for each vocabulary piece. Edges carry the
log-probability of a Zipf law over the model's merge ranks, so that a path is a segmentation with a
probability. Its ``k`` sampled segmentations are the ``k`` largest Gumbel-perturbed paths. They are found
best first: a sampled path fixes its own perturbed value, and each decision on it leaves a set of untaken
paths, whose largest perturbed value is a Gumbel of their joint mass truncated at the path's value. The
set with the largest value is opened next, which is A-star search with an exact bound. The value of the
best unopened set is the threshold ``kappa`` of the inclusion score 1 - exp(-exp(log p - kappa)).

* Draws come from a counter-based generator keyed by (row key, sample, word, step): the same row gives
  the same samples in any batch, task or order. Samples of a row are distinct; a text with fewer than
  ``k`` segmentations gives them all, each with inclusion score 1.
* Characters outside the vocabulary become their bytes' pieces. Decoding is exact but for U+2581, which
  the format itself uses for a space.
* An empty or null text has the one empty segmentation. Repeated rows give repeated samples. A null key
  is a key of its own. Other columns aren't read.
* Texts are handled in pieces of 2.5 MB, a single longer text at once; the lattice of each distinct word of a
  piece is built once.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import MASK, joined, lean, mixed, slices, sums, utf8

K = 2
SPACE = "▁"

LETTER, MARK = "A-Za-z\u00c0-\u024f", "!-/:-@\\[-`{-~"
#: A word ends before a space or a line break, and where its first mark follows a letter.
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n{MARK}]*[{LETTER}](?=[{MARK}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+").findall
INSIDE = re.compile(f"[{LETTER}][{MARK}]")



class Model:
    """Pieces of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.normal = {p: k for k, (p, t) in enumerate(zip(pieces, kinds, strict=True)) if t == "normal"}
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(pieces, kinds, strict=True)) if t == "byte"}
        self.longest = max(map(len, self.normal))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or INSIDE.search(p) for p in self.normal):
            raise ValueError("pieces that hold an inner space, a line break or a mark after a letter aren't supported")
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        # a Zipf law over ranks: the least likely pieces share the last rank
        rank = {p: min(-scores[k], len(pieces)) + 1 for p, k in self.normal.items()}
        total = math.log(sum(1 / r for r in rank.values()))
        self.logp = {p: -math.log(r) - total for p, r in rank.items()}
        self.log_table = np.zeros(len(pieces))  # by id
        for p, k in self.normal.items():
            self.log_table[k] = self.logp[p]
        self.raw = [b""] * len(pieces)
        for p, k in self.normal.items():
            self.raw[k] = p.replace(SPACE, " ").encode()
        for b, k in self.bytes.items():
            self.raw[k] = bytes([b])
        self.raw_size = np.fromiter(map(len, self.raw), np.int32, len(pieces))
        self.raw_start = (np.cumsum(self.raw_size) - self.raw_size).astype(np.int32)
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize("A　 aﬁ") != f"A　{SPACE}aﬁ" and sp.normalize("A　 aﬁ") != f"{SPACE}A　{SPACE}aﬁ":
        raise ValueError("only the identity normaliser is supported")
    size = sp.get_piece_size()
    kind = lambda k: "byte" if sp.is_byte(k) else "other" if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) else "normal"
    return Model([sp.id_to_piece(k) for k in range(size)], [sp.get_score(k) for k in range(size)], [kind(k) for k in range(size)])


def words_of(text: str) -> list[str]:
    """The normalised text in parts that no piece crosses."""
    return WORDS(SPACE + text.replace(" ", SPACE)) if text else []


def decode(model: Model, ids) -> str:
    raw = b"".join(map(model.raw.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Prefixes:
    """All prefixes of all pieces in an open-addressing table keyed by a polynomial hash.

    ``find`` gives the piece of a string's hash, -1 for a mere prefix, -2 for neither.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model):
        known: dict[str, int] = {}
        for p, k in model.normal.items():
            for n in range(1, len(p)):
                known.setdefault(p[:n], -1)
            known[p] = k
        hashes = np.zeros(len(known), np.uint64)
        with np.errstate(over="ignore"):
            for n, p in enumerate(known):
                h = 0
                for c in p:
                    h = (h * int(self.BASE) + ord(c) + 1) & ((1 << 64) - 1)
                hashes[n] = h
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two prefixes share a hash")
        bits = max(10, int(len(known) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        for h, v in zip(hashes, known.values(), strict=True):
            slot = int(self.slots(np.array([h]))[0])
            while self.values[slot] != -2:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = h, v

    def slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = self.slots(h)
        out = np.where(self.keys[slot] == h, self.values[slot], -2)
        open_ = np.flatnonzero((out == -2) & (self.values[slot] != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == h[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.values[slot[open_]] != -2)]
        return out


def spell_alike(model: Model, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each row's ids (``sizes`` of them, one row after another) spell its text, all rows at once."""
    n = model.raw_size[ids]
    total = sums(n, sizes)
    want = [b" " + t if t else b"" for t in texts]
    same = total == np.fromiter(map(len, want), np.int64, len(want))
    if not same.all():  # rows of other lengths would shift the rest
        ends = np.cumsum(sizes)
        return np.array([b"".join(map(model.raw.__getitem__, ids[e - k : e].tolist())) == w for e, k, w in zip(ends, sizes, want, strict=True)], bool)
    at = np.repeat(model.raw_start[ids] - (np.cumsum(n) - n).astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)
    return sums(model.raw_flat[at] != np.frombuffer(b"".join(want), np.uint8), total) == 0


class Numbers(dict):
    """word -> its number, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Lattices:
    """Lattices of a set of words in flat arrays, built for all words in step.

    Each character is a node; nodes own runs of edges. Edge arrays: ``cum`` the cumulative conditional
    probability within the node (1 at its last edge), ``logp`` the conditional log-probability (exactly 0 for
    an only edge), ``piece``, and ``to`` (a node, or -1 at the word's end).
    """

    def __init__(self, model: Model, prefixes: Prefixes, words: list[str]):
        """Word k of the list starts at node ``start[k]``."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        self.start = ends - sizes
        n = len(codes)
        end = np.repeat(ends.astype(np.int32), sizes)
        logs = model.log_table
        # edges: strings that are pieces, longer and longer ones from each node
        active, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        froms, lengths, pieces, slots = [], [], [], []
        have = np.zeros(n + 1, np.int32)  # edges of each node so far
        size = 0
        while len(active):
            size += 1
            h = h * Prefixes.BASE + codes[active + size - 1] + np.uint64(1)
            found = prefixes.find(h)
            hit = found >= 0
            own = active[hit]
            froms.append(own)
            lengths.append(size)
            pieces.append(found[hit])
            slots.append(have[own])
            have[own] += 1
            if size == 1:
                unknown = active[~hit]
            on = (found >= -1) & (active + size < end[active])
            active, h = active[on], h[on]
        if n == 0:
            unknown = np.zeros(0, np.int64)
        extra = [text[u].encode("utf-8", "replace") for u in unknown]  # characters written as their bytes
        froms.append(unknown)
        lengths.append(1)
        pieces.append(np.array([model.bytes[x[0]] for x in extra], np.int64))
        slots.append(have[unknown])
        have[unknown] += 1
        # edges are laid out by their node's distance from the word's end, shorter pieces first
        away = end - np.arange(n, dtype=np.int32)
        order = np.argsort(away.astype(np.uint16) if n and away.max() < 1 << 16 else away, kind="stable")
        count = have[:n][order]
        begin = np.cumsum(count) - count
        first = np.empty(n, np.int32)
        first[order] = begin
        size_ = int(count.sum())
        more = sum(len(x) - 1 for x in extra)  # one more edge for each further byte
        target, piece = np.zeros(size_, np.int32), np.zeros(size_ + more, np.int32)
        for f, l, x, k in zip(froms, lengths, pieces, slots, strict=True):
            spot = first[f] + k
            target[spot], piece[spot] = f + l, x
        del froms, lengths, pieces, slots, active, h, codes
        source = np.repeat(order.astype(np.int32), count)
        inner = target < end[source] if n else np.zeros(0, bool)
        target[~inner] = n  # a word's end
        weight = logs[piece[:size_]]
        weight[first[unknown]] = 0.0  # such a node has this edge alone
        # mass of all paths from each node, backwards from the words' ends (node n), level by level;
        # near the end as numbers, farther on, where they could underflow, as logarithms
        levels = np.bincount(away, minlength=1)[1:] if n else np.zeros(0, np.int64)
        node_cuts = np.concatenate([[0], np.cumsum(levels)])
        edge_cuts = np.append(begin, size_)[node_cuts]
        logp = np.zeros(size_ + more)
        p = np.exp(weight)
        mass = np.ones(n + 1)
        near = min(len(levels), NEAR)
        for d in range(near):
            x, y, u, v = edge_cuts[d], edge_cuts[d + 1], node_cuts[d], node_cuts[d + 1]
            if x < y:
                p[x:y] *= mass[target[x:y]]
                total = np.add.reduceat(p[x:y], begin[u:v] - x)
                mass[order[u:v]] = total
                p[x:y] /= np.repeat(total, count[u:v])
        x = edge_cuts[near]
        logp[:x] = np.minimum(np.log(p[:x]), 0.0)
        beta = np.log(mass) if len(levels) > near else None
        for d in range(near, len(levels)):
            x, y, u, v = edge_cuts[d], edge_cuts[d + 1], node_cuts[d], node_cuts[d + 1]
            if x < y:
                w = weight[x:y] + beta[target[x:y]]
                top = np.repeat(np.maximum.reduceat(w, begin[u:v] - x), count[u:v])
                total = np.log(np.add.reduceat(np.exp(w - top), begin[u:v] - x)) + top[begin[u:v] - x]
                beta[order[u:v]] = total
                logp[x:y] = np.minimum(w - np.repeat(total, count[u:v]), 0.0)
                p[x:y] = np.exp(logp[x:y])
        del weight
        cum = np.ones(size_ + more)
        at = begin
        cum[at] = p[at]
        for k in range(1, int(count.max(initial=0))):  # sums within each node alone, so that no other word matters
            at = at[have[source[at]] > k]
            cum[at + k] = cum[at + k - 1] + p[at + k]
        del p
        cum[begin + count - 1] = 1.0
        logp[begin[count == 1]] = 0.0
        to = np.full(size_ + more, -1, np.int32)
        to[:size_][inner] = target[inner]
        # the other bytes of characters that aren't in the vocabulary: nodes with one edge each
        if more:
            node, at = n, size_
            for u, x in zip(unknown.tolist(), extra, strict=True):
                e = int(first[u])
                last = int(to[e])
                for byte in x[1:]:
                    to[e] = node
                    piece[at], to[at] = model.bytes[byte], last
                    e, node, at = at, node + 1, at + 1
            first = np.concatenate([first, size_ + np.arange(more, dtype=np.int32)])
            source = np.concatenate([source, n + np.arange(more, dtype=np.int32)])
            have = np.concatenate([have[:n], np.ones(more, np.int32)])
        self.first, self.count, self.source, self.cum, self.logp, self.piece, self.to = first, have, source, cum, logp, piece, to

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node at which the cumulative probability reaches ``u``."""
        edge = self.first[nodes]
        on = np.flatnonzero(u > self.cum[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] > self.cum[edge[on]]]
        return edge


def uniform(keys: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit counters (splitmix64)."""
    z = keys + np.uint64((stream * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def paths(t: Lattices, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draw a path through each word, from the node given, all words in step.

    Gives (decisions of each word, edges, keys), the decisions of all words one after another.
    """
    word = np.arange(len(nodes), dtype=np.int32)
    sizes = np.zeros(len(nodes), np.int32)
    parts = []
    while len(word):
        edge = t.draw(nodes, uniform(keys[word] + np.uint64(len(parts)), 1))
        parts.append((word, edge))
        sizes[word] += 1
        nodes = t.to[edge]
        on = nodes >= 0
        word, nodes = word[on], nodes[on]
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    edges = np.zeros(total, np.int32)
    for step, (word, edge) in enumerate(parts):
        edges[begin[word] + step] = edge
    del parts
    return sizes, edges, np.repeat(keys - begin.astype(np.uint64), sizes) + np.arange(total, dtype=np.uint64)


def untaken(logp: np.ndarray) -> np.ndarray:
    """log(1 - p), -inf where p is 1."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(logp))


def uniform_one(key: int, stream: int) -> float:
    """``uniform`` of one counter."""
    z = (key + stream * 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return (((z ^ (z >> 31)) >> 11) + 0.5) * 2.0**-53


def truncated(g: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Gumbel values ``g`` conditioned to lie below ``top``."""
    return -np.logaddexp(-top, -g)


ROOM = np.uint64(1 << 50)  # words kept for each sample


def counters(keys: np.ndarray, s: int, word: np.ndarray) -> np.ndarray:
    """Where the counters of a word begin: a hash of key, sample and word, so words of any length draw apart."""
    return mixed(keys + ROOM * np.uint64(s) + word)


class Row:
    """The search of one text: its samples so far, and its best sets of untaken paths."""

    __slots__ = ("open", "samples")

    def __init__(self):
        self.samples: list[tuple[np.ndarray, np.ndarray, float, float]] = []  # edges, words, value, log p
        self.open: list[tuple] = []  # (value, sample, decision, excluded edges)


#: Characters before a word's end up to which path masses are kept as plain numbers (above 1e-250 there).
NEAR = 40
#: What a Gumbel value of a 53-bit uniform number can reach, down and up.
LEAST, MOST = -3.7, 36.8


def sampled(texts: list[str], keys: np.ndarray, model: Model, prefixes: Prefixes, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` samples (piece ids, log p, log inclusion score), best first."""
    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    numbers = Numbers()
    number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int32, int(counts.sum()))
    del split
    t = Lattices(model, prefixes, list(numbers))
    starts = t.start[number]
    del numbers, number
    from_ = np.cumsum(counts) - counts
    rows = [Row() for _ in texts]
    live = np.arange(len(texts))
    begin = np.zeros(len(texts), np.int64)  # first word to draw anew
    value = gumbel(uniform(keys, 3)) if len(keys) else np.zeros(0)
    before = np.zeros(len(texts))  # log p of what is kept from an earlier sample
    heads: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    for s in range(k):
        if not len(live):
            break
        # fresh draws for all words from `begin` on, of all live rows together
        left = counts[live] - begin[live]
        owner = np.repeat(np.arange(len(live)), left)
        place = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left - begin[live], left)
        nodes = starts[np.repeat(from_[live], left) + place]
        sizes, edge, key = paths(t, nodes, counters(keys[live][owner], s, place.astype(np.uint64)))
        per = np.bincount(owner, weights=sizes, minlength=len(live)).astype(np.int64)  # decisions of each row
        ends = np.cumsum(per)
        words = np.repeat(place.astype(np.int32), sizes)
        prefix = np.zeros(len(edge))  # log p before each decision, summed for each row alone
        for lo, hi, start in zip((ends - per).tolist(), ends.tolist(), before[live].tolist(), strict=True):
            if lo < hi:
                np.cumsum(t.logp[edge[lo : hi - 1]], out=prefix[lo + 1 : hi])
                prefix[lo:hi] += start
        # Sets that can't be among the k best whatever their draw are left out: any k sets bound them.
        row_of = np.repeat(np.arange(len(live), dtype=np.int32), per)
        early = np.flatnonzero(np.arange(len(edge)) - np.repeat(ends - per, per) < 64)
        rest = prefix[early] + untaken(t.logp[edge[early]])  # log mass of the paths not taken there
        close = tops(rest, np.bincount(row_of[early], minlength=len(live)), k)
        floor = np.full(len(live), -np.inf)
        if close:
            ok = close[-1] >= 0
            floor[ok] = rest[close[-1][ok]] + LEAST - MOST
        some = np.flatnonzero(prefix >= floor[row_of])
        rest = prefix[some] + untaken(t.logp[edge[some]])
        keep = ~np.isneginf(rest)
        some, rest = some[keep], rest[keep]
        bound = truncated(rest + gumbel(uniform(key[some], 2)), value[live][row_of[some]])
        best = tops(bound, np.bincount(row_of[some], minlength=len(live)), k - s)
        for n, d in enumerate(live):
            row, lo, hi = rows[d], ends[n] - per[n], ends[n]
            head = heads[d]
            shift = len(head[0])
            own, of = (np.concatenate([head[0], edge[lo:hi]]), np.concatenate([head[1], words[lo:hi]])) if shift else (edge[lo:hi], words[lo:hi])
            row.samples.append((own, of, float(value[d]), float(t.logp[own].sum())))
            for x in best:
                if (j := x[n]) >= 0:
                    at = int(some[j])
                    row.open.append((float(bound[j]), s, at - lo + shift, (int(edge[at]),), float(prefix[at])))
        if s == k - 1:
            break
        go = []
        for d in live:
            if grown := opened(rows[d], t, keys[d], s + 1):
                heads[d] = grown[:2]
                value[d], before[d], begin[d] = grown[2:]
                go.append(d)
        live = np.array(go, np.int64)
    out = []
    for row in rows:
        kappa = max((o[0] for o in row.open), default=-np.inf)
        out.append([(t.piece[e], lp, log_inclusion(lp - kappa)) for e, _, _, lp in row.samples])
    return out


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 4:
        return 0.0 if x > 700 else math.log1p(-math.exp(-math.exp(x)))
    return math.log(-math.expm1(-math.exp(x))) if x > -30 else x


def tops(values: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """Positions of the ``n`` largest values of each run (-1: none left)."""
    out, values = [], values.copy()
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    begins = (np.cumsum(sizes) - sizes)[some]
    for _ in range(n):
        top = np.maximum.reduceat(values, begins)
        hit = np.flatnonzero(values == np.repeat(top, sizes[some]))
        run = np.searchsorted(begins, hit, side="right") - 1
        found = np.full(len(sizes), -1)
        found[some[run[::-1]]] = hit[::-1]  # the first of equals
        ok = found >= 0
        found[ok] = np.where(np.isneginf(values[found[ok]]), -1, found[ok])
        out.append(found)
        values[found[found >= 0]] = -np.inf
    return out


def opened(row: Row, t: Lattices, key: np.uint64, s: int) -> tuple | None:
    """Open the best set of untaken paths: the decision is drawn anew, and the word is finished.

    Gives (edges so far, their words, value, log p so far, next word), or None where all is taken.
    """
    if not row.open:
        return None
    row.open.sort(key=lambda o: -o[0])
    value, sample, at, taken, prefix = row.open.pop(0)
    edges, words, *_ = row.samples[sample]
    node = t.source[taken[0]]
    lo = int(t.first[node])
    hi = lo + int(t.count[node])
    word = int(words[at])
    step = int(at) - int(np.searchsorted(words[: at + 1], word, side="left"))
    counter = (int(counters(np.array([key], np.uint64), s, np.uint64(word))[0]) + step) & MASK
    draw = lambda stream: uniform_one(counter, stream)
    below = lambda mass: -float(np.logaddexp(-value, math.log(-math.log(draw(2))) - mass))
    left = [e for e in range(lo, hi) if e not in taken]
    p = np.exp(t.logp[left])
    e = left[min(int(np.searchsorted(np.cumsum(p), draw(1) * p.sum())), len(left) - 1)]
    rest = [x for x in left if x != e]
    if rest:  # what is still untaken here
        mass = prefix + float(np.logaddexp.reduce(t.logp[rest]))
        row.open.append((below(mass), s, at, (*taken, e), prefix))
    new, total, node = [e], prefix + float(t.logp[e]), int(t.to[e])
    while node >= 0:  # the word's other decisions
        counter = (counter + 1) & MASK
        e, u = int(t.first[node]), draw(1)
        while u > t.cum[e]:
            e += 1
        if (left_out := -math.expm1(t.logp[e])) > 0:
            row.open.append((below(total + math.log(left_out)), s, at + len(new), (e,), total))
        new.append(e)
        total += float(t.logp[e])
        node = int(t.to[e])
    so_far = np.concatenate([edges[:at], np.array(new, np.int32)])
    of = np.concatenate([words[:at], np.full(len(new), word, np.int32)])
    return so_far, of, value, total, word + 1


SCHEMA = "doc_id long, sample int, n_pieces long, ids array<int>, log_prob double, log_inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, path: str, k: int = K, seed: str = "pieces-1") -> DataFrame:
    """Up to ``k`` rows for each document, one for each sampled segmentation, best first.

    ``round_trip`` tells that the ids decode to the text again.
    """
    model = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(shared.value)
        for b in slices(batches, "text", 5 << 19):
            texts = [t.decode("utf-8", "replace") for t in b.column("text").to_pylist()]
            keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            got = sampled(texts, keys, shared.value, prefixes, k)
            flat = [(n, s, ids, lp, li) for n, row in enumerate(got) for s, (ids, lp, li) in enumerate(row)]
            ids = [f[2] for f in flat]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(all_ids))
            raw = [t.replace(SPACE, " ").encode() for t in texts]
            same = spell_alike(shared.value, all_ids, sizes, [raw[f[0]] for f in flat])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([f[0] for f in flat], pa.int64())), pa.array([f[1] for f in flat], pa.int32()), pa.array(sizes), lists,
                 pa.array([f[3] for f in flat], pa.float64()), pa.array([f[4] for f in flat], pa.float64()), pa.array(same)],
                ["doc_id", "sample", "n_pieces", "ids", "log_prob", "log_inclusion", "round_trip"],
            )

    key = F.xxhash64(joined(seed, F.col("doc_id")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), utf8("text").alias("text")).mapInArrow(lean(run), SCHEMA)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids: the model's own (unsampled) encoding of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in slices(batches, "text", 1 << 20):
            ids = sp.encode([t.decode("utf-8", "replace") for t in b.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else decode(shared.value, ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
