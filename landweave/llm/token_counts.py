"""Token counts with a whole-token shortcut.

A byte-pair tokenizer splits a text into pre-tokens and merges each alone. Most pre-tokens are
vocabulary strings, but a vocabulary string isn't always encoded as its one token: merges by rank
may lead elsewhere. ``prove`` runs the merges on every vocabulary string once, on the driver, and
keeps those that end as one token. Such a pre-token counts 1 by a look-up; only the rest is merged.

* The proven set and the merge ranks have the size of the vocabulary and are broadcast.
* Results equal the library's for whole texts, without begin, end or added special tokens. Strings
  of added tokens inside a text are cut out first and count 1 each, as the library does by default.
* A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns
  aren't read. Pre-tokens of any length are merged in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from landweave.llm.common import lean, slices, utf8

LIMIT = 1024

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Any character outside these blocks may be classed by another Unicode version here than in the
#: library; a text that has one is split by the library instead.
UNSURE = regex.compile(r"[^\u0000-\u0557\u1e00-\u1fff\u2000-\u206f\u2100-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Merge ranks over byte strings."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks

    def pieces(self, token: bytes) -> list[bytes]:
        """The pieces that ``token`` ends as: always the merge of lowest rank, leftmost first."""
        n = len(token)
        part: list[bytes | None] = [token[k : k + 1] for k in range(n)]
        if n < 2:
            return part
        ranks = self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get((part[k], part[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if part[k] != a or nxt >= n or part[nxt] != b:
                continue  # one of the two has been merged meanwhile
            part[k], part[nxt] = a + b, None
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if (r := ranks.get((part[k], part[far]))) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[far]))
            if (near := before[k]) >= 0 and (r := ranks.get((part[near], part[k]))) is not None:
                heapq.heappush(heap, (r, near, part[near], part[k]))
        return [p for p in part if p is not None]


def load(path: str) -> tuple[Merges, list[bytes], list[str]]:
    """(merges, vocabulary strings, strings of added tokens) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or spec["normalizer"] or kind.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("only plain added tokens are supported")
    letters = byte_letters()
    plain = lambda s: bytes(letters[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ranks = {(plain(a), plain(b)): k for k, (a, b) in enumerate(merges)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocabulary = [plain(v) for v in spec["model"]["vocab"] if v not in added]
    return Merges(ranks), vocabulary, sorted(added, key=len, reverse=True)


def prove(merges: Merges, vocabulary: list[bytes]) -> dict[str, int]:
    """The vocabulary strings that encode alone as one token, each with the count 1.

    Strings that aren't whole UTF-8 characters can't be pre-tokens and are left out.
    """
    proven = {}
    for v in vocabulary:
        try:
            text = v.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(merges.pieces(v)) == 1:
            proven[text] = 1
    return proven


class Counts(dict):
    """pre-token -> number of tokens: the proven ones, and at most ``limit`` merged ones."""

    def __init__(self, merges: Merges, proven: dict[str, int], limit: int = 1 << 20):
        super().__init__(proven)
        self.merges, self.proven, self.limit = merges, proven, limit + len(proven)

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.proven)
        n = len(self.merges.pieces(token.encode("utf-8")))
        if len(token) <= 64:
            self[token] = n
        return n


class Counter:
    def __init__(self, merges: Merges, proven: dict[str, int], added: list[str]):
        self.counts = Counts(merges, proven)
        self.find = regex.compile(PATTERN).findall
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            if not text.isascii() and UNSURE.search(text):
                raw = text.encode("utf-8")
                sizes = [len(t) for t, _ in self.splitter.pre_tokenize_str(text)]  # one letter for each byte
                ends = list(accumulate(sizes))
                return sum(self.counts[raw[e - n : e].decode("utf-8", "replace")] for n, e in zip(sizes, ends, strict=True))
            return sum(map(self.counts.__getitem__, self.find(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self.count(p) for p in parts if p)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    merges, vocabulary, added = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges.ranks, prove(merges, vocabulary), added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, proven, added = shared.value
        counter = Counter(Merges(ranks), proven, added)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            tokens = np.fromiter((counter.count(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
