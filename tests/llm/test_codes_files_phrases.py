"""Vector codes, token files and phrases against brute force."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landweave.llm import phrases, token_files, vector_codes

# --- vector codes -----------------------------------------------------------------------------


def lloyd(rows, parts=4, entries=256, rounds=4):
    """(code, error) of each (id, vector) by Python's integers, and the codebooks' hash."""
    ints = [[math.floor(x * 1024) if abs(x) < 2.0**53 else int(x) * 1024 for x in v] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    width = len(ints[0]) // parts
    code, error, books = [b""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        mine = [tuple(v[p * width : (p + 1) * width]) for v in ints]
        book = [mine[i] for i in first]
        for r in range(rounds + 1):
            at = []
            for m in mine:
                d = [sum((a - b) ** 2 for a, b in zip(m, e, strict=True)) for e in book]
                at.append((min(d), d.index(min(d))))
            if r < rounds:
                for k in range(len(book)):
                    if own := [m for m, (_, j) in zip(mine, at, strict=True) if j == k]:
                        book[k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
        code = [c + bytes([j]) for c, (_, j) in zip(code, at, strict=True)]
        error = [e + d for e, (d, _) in zip(error, at, strict=True)]
        books.append(book)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return code, error, sha


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, salt int, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_of_odd_rows(spark, entries):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8) * (1 if i % 7 else 40))], int(i % 3) if i % 5 else None) for i in rng.permutation(300)]
    rows += [rows[0], rows[1], (7, rows[3][1], 1), (None, rows[4][1], None), (2**60, [0.5] * 8, 1), (-5, [0.0] * 8, None), (-4, [-0.0009765625 / 2] * 8, 2)]
    dropped = [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("-inf")] * 8, None)]
    code, error, sha = lloyd([r[:2] for r in rows], entries=entries)
    sums = Counter()
    for (_, _, lab), e in zip(rows, error, strict=True):
        sums[lab] += e
    want = sorted((str(i), c.hex(), e, sums[lab], sha) for (i, _, lab), c, e in zip(rows, code, error, strict=True))
    table = vectors(spark, rows + dropped).repartition(5)
    got = sorted((str(r[0]), *r[1:]) for r in vector_codes.encoded(table, entries=entries).collect())
    assert got == want


def test_bounds_save_work(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 5
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] + rng.normal(size=16) * 0.1)], 0) for i in range(600)]
    got, books = vector_codes.fitted(vectors(spark, rows), entries=64)
    code, error, sha = lloyd([r[:2] for r in rows], entries=64)
    found = sorted(got.collect(), key=lambda r: r.vec_id)
    assert [bytes(r.code) for r in found] == code and [int(r.error) for r in found] == error and books.digest() == sha
    everything = 600 * 4 * 64 * 5
    assert sum(r.compared for r in found) < 0.35 * everything  # a fifth is the first round's


def test_codes_beyond_doubles(spark):
    big = [(1, [1e30, 2.0, -3.0, 4.5], 1), (2, [1e30, 2.5, -3.0, 1e4], 1), (3, [0.25, 3e38, -3e38, 4.5], None), (4, [0.1, 0.2, 0.3, 0.4], None), (5, [1e30, 2.0, -3.0, 5.5], None), (6, [9000.0, -9000.0, 1.0, 1.0], 2)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in big]
    code, error, sha = lloyd([r[:2] for r in rows], entries=3)
    got = sorted(vector_codes.encoded(vectors(spark, rows), entries=3).collect())
    assert [(r.code, r.error, r.codebooks_sha256) for r in got] == [(c.hex(), min(e, 2**63 - 1), sha) for c, e in zip(code, error, strict=True)]


def test_codes_of_few_or_no_rows(spark):
    assert vector_codes.encoded(vectors(spark, [])).collect() == []
    assert vector_codes.encoded(vectors(spark, [(1, None, 1)])).collect() == []
    one = vector_codes.encoded(vectors(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 4, None)])).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00000000", 0, 0)] * 2  # equal entries share the lowest index
    assert [r.code for r in vector_codes.encoded(vectors(spark, [(1, [], 1)])).collect()] == ["00000000"]
    with pytest.raises(Exception, match="components"):
        vector_codes.encoded(vectors(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])).collect()


def test_decoded(spark):
    rows, books = vector_codes.fitted(vectors(spark, [(i, [i / 8, -i / 8, 0.5, 1.0], 0) for i in range(10)]), rounds=0)
    assert {r.vec_id: r.vector for r in vector_codes.decoded(rows, books).collect()} == {i: [i / 8, -i / 8, 0.5, 1.0] for i in range(10)}


# --- token files ------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.data())
@settings(max_examples=80, deadline=None)
def test_packing(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=70)), np.uint32)
    raw = token_files.packed(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    assert token_files.unpacked(raw, bits, a, len(ids) - a).tolist() == ids[a:].tolist()


@given(st.lists(st.lists(st.integers(0, 1000), max_size=40), max_size=12), st.integers(1, 17), st.data())
@settings(max_examples=60, deadline=None)
def test_files_by_random_access(docs, per_block, data):
    packer = token_files.Packer(3, 10, per_block)
    blocks = [b for k, d in enumerate(docs) for b in packer.add(None if k == 2 else k, np.array(d, np.uint32))] + list(packer.end())
    raw = b"".join(b + b"\n" for b in blocks)
    if not docs:
        assert raw == b""
        return
    flat = [x for d in docs for x in d]
    for source in (raw, io.BytesIO(raw)):
        f = token_files.TokenFile(source)
        assert (f.number, f.n_ids, f.n_docs) == (3, len(flat), len(docs))
        a = data.draw(st.integers(0, len(flat)))
        b = data.draw(st.integers(a, len(flat)))
        assert f.ids(a, b).tolist() == flat[a:b]
        assert [(k, ids.tolist()) for k, _, ids in f] == [(None if k == 2 else k, d) for k, d in enumerate(docs)]
        with pytest.raises(IndexError):
            f.ids(0, len(flat) + 1)


def test_access_reads_only_the_blocks_it_needs():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    packer = token_files.Packer(0, 16, 1000)
    raw = b"".join(b + b"\n" for b in [*packer.add(1, np.arange(60_000, dtype=np.uint32)), *packer.end()])
    source = Counting(raw)
    f = token_files.TokenFile(source)
    source.taken = 0
    assert f.ids(12_345, 12_350).tolist() == list(range(12_345, 12_350)) and source.taken == 10


@given(st.text(alphabet=st.sampled_from("aAbé ́\t\n\r\x0b\x85\xa0 'sS ΣςI.!<|endoftext|>1२ﬁİﬁ\U0001f600"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_through_the_memo_encode_as_the_whole(text):
    encoder = token_files.Encoder(PATH, words=3)
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text.encode()).tolist() == want
    other = encoder.library.encode("Other words, like these.", add_special_tokens=False).ids
    batch = pa.array([b"", b"Other words, like these.", text.encode(), b"Other words, like these."], pa.binary())
    for rows, expected in ((batch, [[], other, want, other]), (batch[2:3], [want])):
        assert [x.tolist() for x in encoder.encode_all(rows)] == expected


def by_library(rows):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text)."""
    library = token_files.tokenizer(PATH)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out, at = [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def same(a, b):
    return sorted(map(tuple, a), key=str) == sorted(b, key=str)


@pytest.mark.parametrize("file_text", [1000, 8 << 20])
def test_round_trip_of_odd_rows(spark, clashing, file_text):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    got = token_files.round_trip(clashing, PATH, file_text=file_text, per_block=64).collect()
    assert same(got, by_library(rows))


def test_round_trip_of_nothing(spark, empty):
    assert token_files.round_trip(empty, PATH).collect() == []


def test_round_trip_of_one_document_that_is_everywhere(spark):
    rows = [(5, "the same words " * 20)] * 600 + [(k, f"word {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert same(token_files.round_trip(df, PATH, file_text=2000).collect(), by_library(rows))


def test_ids_are_read_back(spark, odd):
    folder = token_files.scratch(spark, "ids")
    token_files.write_ids(odd, folder, PATH, file_text=4000)
    got = sorted(((r.doc_id, r.ids) for r in token_files.read_ids(spark, folder).collect()), key=str)
    library = token_files.tokenizer(PATH)
    assert got == sorted(((r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in odd.collect()), key=str)


def test_tokenizers_that_see_white_space_are_refused(spark, odd):
    assert token_files.cut_by_space(PATH)
    assert not token_files.cut_by_space(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="white space"):
        token_files.write_ids(odd, "unused", public_tokenizers.path("byte_bpe_50k.json"))


# --- phrases ----------------------------------------------------------------------------------


def mined(rows, longest=3, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, raw = "und" if lang is None else lang, (text or "").encode()
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", raw):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                for i in range(len(w) - d + 1):
                    f[lang][tuple(w[i : i + d])] += 1
    out = []
    for lang, count in f.items():
        candidates = {k: v for k, v in count.items() if len(k) > 1 and v >= least}
        inside = lambda k: [k[i : i + m] for m in range(2, len(k)) for i in range(len(k) - m + 1)]
        dropped = {s for k, v in candidates.items() for s in inside(k) if 100 * v >= share * count[s]}
        found = []
        for k, a in candidates.items():
            if k not in dropped:
                score, _, left, right = min((10**6 * a * a // (count[k[:j]] * count[k[j:]]), j, count[k[:j]], count[k[j:]]) for j in range(1, len(k)))
                found.append((-score, -a, b" ".join(k), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrased(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def texts_of(spark, rows):
    return spark.createDataFrame([(1, t, lang, 5, 6, 7) for lang, t in rows], "doc_id long, text string, lang string, f long, rest string, `a.b` int")


def test_phrases_of_odd_rows(spark, clashing):
    rows = [(r.lang, r.text) for r in clashing.collect()]
    assert phrased(clashing, least=3) == mined(rows, least=3)
    assert phrased(clashing, least=2, range_bytes=2000, shard_words=500, stretch=100, merge_nodes=100) == mined(rows, least=2)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_by_brute_force(spark, longest):
    rng = np.random.default_rng(longest)
    marks = [" ", " ", "  ", "\t", ". ", ",", "\n", "; "]
    rows = []
    for k in range(120):
        some = rng.zipf(1.4, 60) % 25
        rows.append((["en", "de", None, "und", ""][k % 5], "".join(f"{'Wo' if w % 3 else 'é'}{w}{marks[m]}" for w, m in zip(some, rng.integers(0, len(marks), 60), strict=True))))
    rows += [("en", "a hot phrase of words")] * 80 + [(None, None), ("fr", ""), ("fr", " . , ")]
    for options in ({}, {"range_bytes": 700, "shard_words": 300, "merge_nodes": 200}, {"range_bytes": 1500, "stretch": 64, "top": 7}):
        want = mined(rows, longest, 4, options.get("top", 2000))
        assert phrased(texts_of(spark, rows).repartition(3), longest=longest, least=4, **options) == want


def test_a_long_text_in_stretches(spark):
    words = [f"w{k % 7}" if k % 11 else "x" * 300 for k in range(4000)]
    rows = [("en", " ".join(words)), ("en", "y" * 5000 + " w1 w2"), ("en", "w1 w2 w3. " * 40)]
    want = mined(rows)
    for stretch in (40, 333, 1 << 20):
        assert phrased(texts_of(spark, rows), stretch=stretch, shard_words=700, range_bytes=3000) == want


def test_phrases_of_nothing(spark, empty):
    assert phrased(empty) == []
    assert phrased(texts_of(spark, [("en", "one two three"), (None, None)])) == []
    with pytest.raises(ValueError, match="two words"):
        phrases.collocations(empty, longest=1)


@given(st.lists(st.sampled_from(["a", "b", "aa", "."]), min_size=1, max_size=80), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_pieces_hold_the_trie(words, longest):
    known = sorted({w for w in words if w != "."})
    ids = np.array([0 if w == "." else known.index(w) + 1 for w in words] + [0], np.uint32)
    t = phrases.grown(ids, [w.encode() for w in known], longest)
    keys = [t.key(i) for i in range(len(t.count))]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    for cut in range(len(keys) + 1):
        parts = [phrases.read_piece(phrases.written_piece(t, a, b), longest) for a, b in ((0, cut), (cut, len(keys))) if a < b]
        both = phrases.merged(parts)
        assert [both.key(i) for i in range(len(both.count))] == keys and both.count.tolist() == t.count.tolist()


def test_scores_beyond_64_bits(spark):
    nodes = spark.createDataFrame([("x", 10**13, [10**13], [10**13])], "phrase string, f long, heads array<long>, tails array<long>")
    from pyspark.sql import functions as F

    big = lambda c: F.col(c).cast("decimal(15,0)") if isinstance(c, str) else c.cast("decimal(15,0)")
    got = nodes.select(F.call_function("div", big("f") * big("f") * F.lit(1_000_000).cast("decimal(7,0)"), big(F.col("heads")[0]) * big(F.col("tails")[0]))).first()[0]
    assert got == 10**6
