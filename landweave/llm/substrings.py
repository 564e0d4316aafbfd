"""Substring dedup with fixed-block anchors.

Each document is cut into non-overlapping blocks of 18 words. Any window of 35 words holds one whole
block of its own document, so if the window's words also start elsewhere, that block occurs there at
some offset. The steps:

1. Index and probe. Hashes of all blocks (with the group of their document) and of every rolling window
   of 18 words (the probes) are dealt by hash. A block that occurs anywhere else is an anchor.
2. Extend. Around each anchor all windows of 35 words that hold it are candidates. Their hashes (56 bits
   and 16 more of a second polynomial, apart from those that deal them) are dealt likewise; those that
   occur twice are repeats, and neighbouring ones are the pieces of one maximal repeat.
3. Remove every word that a repeated window covers.

Nothing is paired with anything: a passage in many documents is one hash per batch of texts, so hot
passages cost no more than others. Extending each pair of places by itself would find the same words, but
at a cost quadratic in the places of a hot passage. Hashes travel packed, sorted and without repeats within
a batch; answers are lists and bit maps for groups of documents. Groups hold about ``GROUP`` bytes of text (a
single longer text alone), ranges of hashes about ``RANGE`` entries, at any size of the corpus; each range has a
task of its own. The rows with their groups are written once, so all steps see the same groups.

* Words are compared by 64-bit hashes. A null or empty text has no words and keeps nothing. Repeated
  rows repeat each other's windows, so of a text of 35 words or more that occurs twice nothing is left.
* Windows are judged on the input. Columns other than id and text aren't read.
* Rows that repeat the same id and text are dealt to many groups (``SAME`` neighbouring rows stay together).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import WordHashes, covered, hashed, in_one, lean, lean_group, rolling, slices, utf8, written

BLOCK, WINDOW = 18, 35
GROUP = 6 << 20
RANGE = 2 << 20
SAME = 64
OTHER_BASE = 0xC2B2AE3D27D4EB4F  # odd; of the second polynomial
LOW = np.uint64((1 << 40) - 1)


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted keys, plane by plane, which compresses well."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(body: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


class Texts:
    """Words of a batch of texts: lists, counts and hashes, one after another."""

    def __init__(self, texts: list[bytes], memo: WordHashes):
        self.split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.hashes = np.concatenate([hashed(w, memo) for w in self.split]) if texts else np.zeros(0, np.uint64)
        self.begin = np.cumsum(self.counts) - self.counts

    def anchors(self, ranges: int, only_blocks: bool) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of rolling windows of BLOCK words, or of the blocks among them."""
        at = in_one(self.counts, BLOCK)
        if only_blocks and len(at):
            at = at[self.is_block(at)]
        h = rolling(self.hashes, BLOCK)[at] if len(at) else np.zeros(0, np.uint64)
        return at, (range_of(h, ranges) << np.uint64(40)) | (h & LOW)

    def is_block(self, at: np.ndarray) -> np.ndarray:
        own = np.repeat(self.begin, self.counts)[at]
        return (at - own) % BLOCK == 0

    def candidates(self, anchors: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, range, hash, second hash) of windows that hold one of the anchors of their own document."""
        fits = in_one(self.counts, WINDOW)
        near = np.zeros(len(self.hashes) + 1, np.int32)
        # an anchor at a lies in the windows that start at a - 17 to a; a start in the document before can't fit there
        np.add.at(near, np.maximum(anchors - (WINDOW - BLOCK), 0), 1)
        np.add.at(near, anchors + 1, -1)
        near = np.cumsum(near[:-1]) > 0
        starts = fits[near[fits]]
        if not len(starts):
            z = np.zeros(0, np.uint64)
            return starts, z, z, z
        h = rolling(self.hashes, WINDOW)[starts]
        return starts, range_of(h, ranges), h & np.uint64((1 << 56) - 1), rolling(self.hashes, WINDOW, OTHER_BASE)[starts] >> np.uint64(48)


def listed(rng: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first positions of distinct entries in sorted order, entry of each row, rows of each entry)."""
    order = np.lexsort((b, a, rng))
    r, x, y = rng[order], a[order], b[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.zeros(0, bool)
    entry = np.zeros(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry, np.bincount(entry, minlength=int(new.sum()))


def marked(table: pa.Table, wanted: int) -> Iterator[tuple[int, bytes]]:
    for kind, rng, body in zip(table.column("kind").to_pylist(), table.column("range").to_pylist(), table.column("body").to_pylist(), strict=True):
        if kind == wanted:
            yield rng, body


def at_once(f: Callable[[pa.Table], pa.Table]) -> Callable:
    """``f`` on all rows of a partition, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return run


def anchored(texts: Texts, answers: pa.Table, ranges: int) -> np.ndarray:
    """Positions of the anchors of a group, of the keys answered for it."""
    found = [unpack(body, 5) | np.uint64(rng << 40) for rng, body in marked(answers, 1)]
    at, keys = texts.anchors(ranges, True)
    return at[np.isin(keys, np.concatenate(found))] if found else at[:0]


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    ranges = max(1, -(-total // (6 * RANGE)))  # about one word in six bytes
    near = F.expr(f"monotonically_increasing_id() div {SAME}")  # rows of one id and text mustn't all fall into one group
    keyed = written(rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", near), F.lit(groups)).cast("int")), "texts")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes(1 << 19)
        for b in slices(batches, "text", 4 << 20):
            t = Texts(b.column("text").to_pylist(), memo)
            at, keys = t.anchors(ranges, False)
            block = t.is_block(at) if len(at) else np.zeros(0, bool)
            grp = np.repeat(b.column("grp").to_numpy(zero_copy_only=False).astype(np.uint64), t.counts)[at]
            every, of, times = np.unique(keys, return_inverse=True, return_counts=True)
            has = np.zeros(len(every), bool)
            has[of[block]] = True
            probes = every[~has]
            own = np.unique((of[block].astype(np.uint64) << np.uint64(32)) | grp[block])  # block and group, once
            entry = (own >> np.uint64(32)).astype(np.int64)
            blocks, to, twice = every[entry], (own & np.uint64(0xFFFFFFFF)).astype(np.uint32), times[entry] > 1
            out = {"range": [], "probes": [], "blocks": [], "grps": [], "twice": []}
            cuts = np.searchsorted(probes >> np.uint64(40), np.arange(ranges + 1, dtype=np.uint64))
            cuts_b = np.searchsorted(blocks >> np.uint64(40), np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                p, q, x, y = cuts[r], cuts[r + 1], cuts_b[r], cuts_b[r + 1]
                if p < q or x < y:
                    out["range"].append(r)
                    out["probes"].append(pack(probes[p:q], 5))
                    out["blocks"].append(pack(blocks[x:y], 5))
                    out["grps"].append(to[x:y].tobytes())
                    out["twice"].append(np.packbits(twice[x:y]).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("range", pa.int32())] + [(c, pa.binary()) for c in ("probes", "blocks", "grps", "twice")]))

    def match(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        probes = np.unique(np.concatenate([unpack(x, 5) for x in col["probes"]]))
        blocks = [unpack(x, 5) for x in col["blocks"]]
        grp = np.concatenate([np.frombuffer(x, np.uint32) for x in col["grps"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(col["twice"], blocks, strict=True)])
        keys, of, times = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
        again = times > 1
        again[of[twice]] = True
        if len(probes):
            near = np.minimum(np.searchsorted(probes, keys), len(probes) - 1)
            again |= probes[near] == keys
        # for each group its anchors, once
        own = np.unique((grp[again[of]].astype(np.uint64) << np.uint64(40)) | keys[of[again[of]]])
        return answers(own >> np.uint64(40), own & LOW, col["range"][0])

    def answers(grp: np.ndarray, keys: np.ndarray, rng: int) -> pa.Table:
        first = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(grp))
        return pa.table({
            "grp": grp[first].astype(np.int32), "kind": pa.array(np.ones(len(first), np.int32)), "range": pa.array(np.full(len(first), rng, np.int32)),
            "body": pa.array([pack(keys[a:b], 5) for a, b in zip(first, ends, strict=True)], pa.binary()),
        })

    answer = "grp int, kind int, range int, body binary"
    anchors = written(
        keyed.mapInArrow(lean(probe), "range int, probes binary, blocks binary, grps binary, twice binary").repartitionById(ranges, "range").mapInArrow(lean(at_once(match)), answer), "anchors"
    )

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"range": [], "grp": [], "entries": [], "more": [], "twice": []}
        if left.num_rows:
            t = Texts(left.column("text").to_pylist(), WordHashes(1 << 19))
            _, rng, a, b = t.candidates(anchored(t, right, ranges), ranges)
            first, _, times = listed(rng, a, b)
            cuts = np.searchsorted(rng[first], np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                some = first[cuts[r] : cuts[r + 1]]
                if len(some):
                    out["range"].append(r)
                    out["grp"].append(left.column("grp")[0].as_py())
                    out["entries"].append(pack(a[some], 7))
                    out["more"].append(pack(b[some], 2))
                    out["twice"].append(np.packbits(times[cuts[r] : cuts[r + 1]] > 1).tobytes())
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("grp", pa.int32())] + [(c, pa.binary()) for c in ("entries", "more", "twice")]))

    def compare(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        lists = [unpack(x, 7) for x in col["entries"]]
        a, b = np.concatenate(lists), np.concatenate([unpack(x, 2) for x in col["more"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(col["twice"], lists, strict=True)])
        _, entry, times = listed(np.zeros(len(a), np.uint64), a, b)
        again = (times > 1)[entry] | twice  # an entry is listed once in a group, so two lists are two places
        ends = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(again[e - len(x) : e]).tobytes() for x, e in zip(lists, ends, strict=True)]
        return pa.table({"grp": pa.array(col["grp"], pa.int32()), "kind": pa.array([2] * len(bits), pa.int32()), "range": pa.array(col["range"], pa.int32()), "body": pa.array(bits, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Texts(left.column("text").to_pylist(), WordHashes(1 << 19))
        starts, rng, a, b = t.candidates(anchored(t, right, ranges), ranges)
        first, entry, _ = listed(rng, a, b)
        again = np.zeros(len(first), bool)
        cuts = np.searchsorted(rng[first], np.arange(ranges + 1, dtype=np.uint64))
        for r, body in marked(right, 2):
            again[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(cuts[r + 1] - cuts[r])).astype(bool)
        gone = covered(starts[again[entry]], WINDOW, len(t.hashes))
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[t.begin + t.counts] - total[t.begin]
        kept = []
        for words, at, n, out in zip(t.split, t.begin.tolist(), t.counts.tolist(), n_removed.tolist(), strict=True):
            kept.append(b" ".join(words if not out else compress(words, (~gone[at : at + n]).tolist()) if out < n else ()))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(t.counts), "n_removed": pa.array(n_removed), "kept": pa.array(kept, pa.binary())})

    dealt = keyed.groupBy("grp")
    repeats = (
        dealt.cogroup(anchors.groupBy("grp")).applyInArrow(lean_group(extend), "range int, grp int, entries binary, more binary, twice binary").repartitionById(ranges, "range").mapInArrow(lean(at_once(compare)), answer)
    )
    done = dealt.cogroup(anchors.unionByName(repeats).groupBy("grp")).applyInArrow(lean_group(finish), "doc_id long, n_words long, n_removed long, kept binary")
    return done.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
