"""Token ids in files of fixed-width bits, with random access.

``write_ids`` encodes texts with the tokenizers library, appends an end id to each document and writes all ids in
ascending order of the documents' ids. A file holds the documents of one range of that order::

    block, "\\n", block, "\\n", ..., footer, "\\n"

Blocks hold ``PER_BLOCK`` ids (the last one fewer), each in as many bits as the largest id of the vocabulary takes,
lowest bit first; a document's ids run on over the ends of blocks. Blocks of documents (id, whether it is null, number
of ids) lie between them. The footer tells the bits, the file's number, the totals and the offset, size and first number
of every block, and ends with its own size and ``MAGIC``. So id ``i`` of a file is in block ``i // PER_BLOCK`` at bit ``i % PER_BLOCK *
bits``, and a range of ids needs the blocks that it touches and nothing else (``TokenFile.ids``).

Tasks stream: a block leaves as soon as it is full, and Spark's own writer puts the blocks into the file (each is a row whose
end the writer marks with the newline) and commits it, so a lost executor leaves no half files, and any file system that Spark writes to will do.
Files are read whole by Spark's reader of binary files (2 GB at most each; they are made of ``FILE_TEXT`` bytes of text, unless one document is larger).

Encoding is by white space: no token of this kind of tokenizer spans it, so each distinct run of other bytes
goes through the library and a bounded memo holds its ids. ``write_ids`` refuses a tokenizer that can't be cut there (see ``cut_by_space``).

* A null or empty text has the end id alone. Null ids come first; rows that share an id are in the order of the MD5 of their texts, and equal rows
  follow each other. Very long texts are encoded whole, a slice of words at a time.
* Bytes that aren't UTF-8 are read as the replacement character.
* Without documents there are no files, and the result is empty. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.llm.common import data, lean, scratch, slices, utf8, written

PER_BLOCK = 1 << 16
DOCS_PER_BLOCK = 1 << 12
#: Bytes of text that stand behind a file.
FILE_TEXT = 16 << 20
MAGIC = b"bitpack1"
END_ID = 1
#: Words that a worker remembers, and the bytes of them.
MEMO_WORDS, MEMO_BYTES = 550_000, 32 << 20
#: Marks at a word's end: behind an ASCII letter they are a pre-token of their own. The apostrophe isn't one of them.
ENDS = b".,;:!?#*$%&)"


# --- packing ----------------------------------------------------------------------------------


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
    return np.packbits(np.unpackbits(each, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpacked(raw: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` of a block on, as uint32."""
    if not count:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    a, b = first * bits // 8, -(-(first + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8, b - a, a), bitorder="little")
    skip = first * bits - 8 * a
    each = np.zeros((count, 32), np.uint8)
    each[:, :bits] = flat[skip : skip + count * bits].reshape(count, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class Packer:
    """Takes documents, gives blocks of a file."""

    def __init__(self, number: int, bits: int, per_block: int = PER_BLOCK):
        self.number, self.bits, self.per_block = number, bits, per_block
        self.at = self.n_ids = self.n_docs = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: dict[str, list[tuple[int, int, int]]] = {"ids": [], "docs": []}  # offset, size, first number

    def _block(self, kind: str, raw: bytes, first: int) -> bytes:
        self.blocks[kind].append((self.at, len(raw), first))
        self.at += len(raw) + 1  # the newline
        return raw

    def _ids(self, least: int) -> Iterator[bytes]:
        if self.held < least or not self.held:
            return
        ids = np.concatenate(self.waiting)
        a = 0
        while len(ids) - a >= least and a < len(ids):
            part = ids[a : a + self.per_block]
            yield self._block("ids", packed(part, self.bits), self.n_ids)
            self.n_ids += len(part)
            a += len(part)
        self.waiting, self.held = [ids[a:]], len(ids) - a

    def _documents(self) -> Iterator[bytes]:
        if self.docs:
            key = np.array([d or 0 for d, _ in self.docs], "<i8")
            null = np.array([d is None for d, _ in self.docs], np.uint8)
            count = np.array([n for _, n in self.docs], "<u8")
            yield self._block("docs", key.tobytes() + count.tobytes() + null.tobytes(), self.n_docs)
            self.n_docs += len(self.docs)
            self.docs = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        yield from self._ids(self.per_block)
        if len(self.docs) >= DOCS_PER_BLOCK:
            yield from self._documents()

    def end(self) -> Iterator[bytes]:
        yield from self._ids(1)
        yield from self._documents()
        if self.n_docs:
            head = {"bits": self.bits, "per_block": self.per_block, "file": self.number, "ids": self.n_ids, "docs": self.n_docs, "blocks": self.blocks}
            raw = json.dumps(head).encode()
            yield raw + struct.pack("<Q", len(raw)) + MAGIC


class TokenFile:
    """A file of packed ids: its bytes, or a seekable file object, of which only what is asked for is read."""

    def __init__(self, source):
        self.source = source
        if isinstance(source, (bytes, memoryview)):
            size = len(source)
        else:
            size = source.seek(0, os.SEEK_END)
        tail = len(MAGIC) + 9
        end = self._read(size - tail, tail) if size >= tail else b""
        if end[8:-1] != MAGIC:
            raise ValueError("not a file of packed token ids")
        length = struct.unpack("<Q", end[:8])[0]
        head = json.loads(bytes(self._read(size - tail - length, length)))
        self.bits, self.per_block, self.number, self.n_ids, self.n_docs = (head[k] for k in ("bits", "per_block", "file", "ids", "docs"))
        self.blocks = head["blocks"]

    def _read(self, at: int, size: int) -> bytes:
        if isinstance(self.source, (bytes, memoryview)):
            return self.source[at : at + size]
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` (exclusive) of the file, from the blocks that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        out = []
        while start < stop:
            block, first = divmod(start, self.per_block)
            count = min(stop - start, self.per_block - first)
            a, b = first * self.bits // 8, -(-(first + count) * self.bits // 8)
            raw = self._read(self.blocks["ids"][block][0] + a, b - a)
            out.append(unpacked(raw, self.bits, 0, count) if first * self.bits % 8 == 0 else unpacked(b"\0" * a + bytes(raw), self.bits, first, count))
            start += count
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, whether null, numbers of token ids), a block at a time."""
        for k, (at, size, first) in enumerate(self.blocks["docs"]):
            n = (self.blocks["docs"][k + 1][2] if k + 1 < len(self.blocks["docs"]) else self.n_docs) - first
            raw = bytes(self._read(at, size))
            yield np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, first id's number, ids) of each document."""
        at = 0
        for keys, nulls, counts in self.documents():
            for key, null, count in zip(keys.tolist(), nulls.tolist(), counts.tolist(), strict=True):
                yield (None if null else key), at, self.ids(at, at + count)
                at += count


# --- encoding ---------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_by_space(path: str) -> bool:
    """Whether white space is dropped between words, so that no token and no rule sees across it.

    It holds where the normalizer does no more than canonical composition, lower case and replacing white space, and the first
    pre-tokenizer keeps only what matches a pattern that no white space matches.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    norm, pre = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"].get("Regex") == "\\s+" for s in steps)
    first = (pre.get("pretokenizers") or [pre or {"type": ""}])[0]
    split = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and not any(s in first["pattern"].get("Regex", " ") for s in (" ", "\\s+", "\\s*", "(?!"))
    return plain and split and not any(a.get("lstrip") or a.get("rstrip") for a in made.get("added_tokens") or [])


class Encoder:
    """Texts as little-endian 32-bit ids, words through a bounded memo.

    New words go through the library many at a time. Words of letters alone are one pre-token each, whose last token is known by the
    vocabulary's mark of word ends; between other words stands one of the library's special tokens.
    """

    def __init__(self, path: str, words: int = MEMO_WORDS, bytes_: int = MEMO_BYTES):
        self.library, self.words, self.bytes = tokenizer(path), words, bytes_
        self.memo: dict[bytes, bytes] = {}
        self.size = 0
        plain = [(k, t.content) for k, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.content = plain[0] if plain else (None, None)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab(with_added_tokens=True) if suffix else {}
        self.final = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.final[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True
        # a word of a-z is the model's own input, if nothing before the model changes it
        tried = ["a", "z", *[w for w in sorted(self.library.get_vocab()) if w.isascii() and w.isalpha() and w.islower()][::97]]
        self.direct = all(self._model(w) == x.ids for w, x in zip(tried, self.library.encode_batch_fast(tried, add_special_tokens=False), strict=True))

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word)]

    def _all(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _ids(self, words: list[str], letters: bool) -> list[np.ndarray]:
        """The ids of each of some words; ``letters``: they are of nothing else."""
        if letters and len(self.final):
            ids = self._all(" ".join(words))
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return np.split(ids, ends[:-1])
        if self.mark is None or any(self.content in w for w in words):
            return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        ids = self._all(self.content.join(words))
        cuts = np.flatnonzero(ids == self.mark)
        return [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        """Have all ``words`` in the memo. A word with marks at its end is made up of its stem and them."""
        if len(self.memo) > self.words or self.size > self.bytes:
            self.memo.clear()
            self.size = 0
        new = set(words) - self.memo.keys()
        ended = {}
        for w in new:
            stem = w.rstrip(ENDS)
            if len(stem) < len(w) and stem[-1:].isalpha() and b"<|" not in w:
                ended[w] = stem
        new.difference_update(ended)
        new.update(s for s in ended.values() if s not in self.memo)
        new.update(t for t in {w[len(s) :] for w, s in ended.items()} if t not in self.memo)
        kinds: tuple[list[bytes], list[bytes]] = [], []
        texts = {}
        tokenize = self.library.model.tokenize
        for w in new:
            t = w.decode("utf-8", "replace")
            if self.direct and w.isalpha() and w.islower():
                self.memo[w] = np.array([x.id for x in tokenize(t)], "<u4").tobytes()
            else:
                texts[w] = t
                kinds[t.isalpha()].append(w)
        for letters, some in enumerate(kinds):
            for a in range(0, len(some), 4096):
                part = some[a : a + 4096]
                for word, found in zip(part, self._ids([texts[w] for w in part], bool(letters)), strict=True):
                    self.memo[word] = found.tobytes()
        for w, s in ended.items():
            self.memo[w] = self.memo[s] + self.memo[w[len(s) :]]
        self.size += sum(map(len, new)) + sum(map(len, ended))

    def encode(self, text: bytes) -> np.ndarray:
        """A text alone, whatever is in it, its words in parts."""
        words, out = text.split(), [b""]
        for a in range(0, len(words), 1 << 16):
            part = words[a : a + (1 << 16)]
            self._learn(part)
            out.append(b"".join(map(self.memo.__getitem__, part)))
        return np.frombuffer(b"".join(out), "<u4")

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts (binary) at once: words are cut, put in lower case, and told apart by Arrow, and only distinct ones come to Python.

        Lower case is left to the library in texts where it might change something, which go alone: with strings of special tokens, or
        combining marks (U+0300 to U+036F, the ones that join ASCII letters). Very long ones go alone too.
        """
        raw, at = data(texts)
        odd = np.diff(at) > 8 << 20
        if len(raw):
            marks = np.flatnonzero((raw == 0xCC) | (raw == 0xCD) | ((raw == ord("<")) & (np.append(raw[1:], 0) == ord("|"))))
            odd[np.searchsorted(at, marks, side="right") - 1] = True
        out: list[np.ndarray] = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.encode(texts[k].as_py())
        some = np.flatnonzero(~odd)
        if not len(some):
            return out
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(some)).view(pa.string())))
        told = split.flatten().dictionary_encode()
        words, place = told.dictionary.view(pa.binary()).to_pylist(), told.indices.to_numpy()
        pieces = list(map(self.memo.get, words))
        missing = [w for w, p in zip(words, pieces, strict=True) if p is None]
        if missing:
            self._learn(missing)
            pieces = [self.memo[w] if p is None else p for w, p in zip(words, pieces, strict=True)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, starts = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(lengths) - lengths
        counts = lengths[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(starts[place] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for k, a, b in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


@functools.lru_cache(maxsize=1)
def remembered(path: str) -> Encoder:
    """The worker's encoder, whose memo serves the tasks that follow too."""
    return Encoder(path)


# --- files ------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, out: str, path: str, *, end_id: int = END_ID, file_text: int = FILE_TEXT, per_block: int = PER_BLOCK) -> None:
    """The ids of all documents as files in the folder ``out``."""
    if not cut_by_space(path):
        raise ValueError("the tokenizer's tokens may span white space")
    bits = width_of(tokenizer(path).get_vocab_size(with_added_tokens=True))
    text = F.col("text").cast("binary")
    # rows have a number, so that a document that is there very often doesn't go to one file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("tie"), F.monotonically_increasing_id().alias("row"), utf8("text").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first(), F.col("row")]
    ranged = rows.repartitionByRange(max(1, -(-total // file_text)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder, last = Packer(TaskContext.get().partitionId(), bits, per_block), remembered(path), np.array([end_id], np.uint32)
        rows = lambda blocks: pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])
        for b in slices(batches, "text"):
            for key, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_all(b.column("text")), strict=True):
                for block in packer.add(key, np.concatenate([ids, last])):
                    yield rows([block])
        yield rows(list(packer.end()))

    blocks = ranged.select("doc_id", "text").mapInArrow(lean(pack), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(out)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, at (ids before it in the file), ids, from the files alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                file = TokenFile(memoryview(raw.as_buffer()))
                for key, at, ids in file:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([file.number], pa.int64()), pa.array([at], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["doc_id", "file", "at", "ids"])

    return _files(spark, folder).mapInArrow(lean(work), "doc_id long, file long, at long, ids array<long>")


def summed(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, at, n_tokens, ids_crc32 of each document, from the files alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                file = TokenFile(memoryview(raw.as_buffer()))
                at = 0
                for keys, nulls, counts in file.documents():
                    sums, ends = np.zeros(len(keys), np.int64), at + np.cumsum(counts)
                    d = 0
                    while d < len(keys):  # as many documents at once as fill a block, or one
                        start = ends[d] - counts[d]
                        to = max(d + 1, int(np.searchsorted(ends, start + file.per_block, side="right")))
                        ids = file.ids(int(start), int(ends[to - 1])).astype("<u4")
                        for j in range(d, to):
                            sums[j] = zlib.crc32(ids[ends[j] - counts[j] - start : ends[j] - start])
                        d = to
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=nulls), pa.array(np.full(len(keys), file.number)), pa.array(ends - counts), pa.array(counts), pa.array(sums)], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])
                    at = int(ends[-1])

    return _files(spark, folder).mapInArrow(lean(work), "doc_id long, file long, at long, n_tokens long, ids_crc32 long")


def started(rows: DataFrame) -> DataFrame:
    """``rows`` (file, at, n_tokens, ...) with ``start``: ids of all documents before each, over all files.

    One row for each file goes through one task: 8 MB of ids stand behind each.
    """
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "file").withColumn("start", F.col("_base") + F.col("at")).drop("_base")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from files that are written for it."""
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    write_ids(docs, folder, path, **options)
    return started(written(summed(spark, folder), "sums")).select("doc_id", "start", "n_tokens", "ids_crc32")
