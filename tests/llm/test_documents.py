"""The operators on documents against brute-force versions, on odd rows and on made corpora."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.llm import mixing, near_duplicates, pieces, pii, quality_rules, sharding, substrings, token_counts
from landweave.llm.common import in_one, rolling
from landweave.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def corpus(seed, n=120):
    """Made texts with exact copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rng.random()
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if kind < 0.2 and out:
            ws = rng.choice(out).split(" ")
        elif kind < 0.5 and out:
            ws = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 6)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        elif kind < 0.6:
            a = rng.randint(0, 20)
            ws = ws + passage[a : a + rng.randint(20, 60)] + ws[:10]
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def made(spark):
    data = [(k, t, "en", f"s{k % 5 if k % 2 else 0}", len(t)) for k, t in enumerate(corpus(1))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


# --- 1 -------------------------------------------------------------------------------------------


def base(text):
    ws = WORD.findall(text)
    wins = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    hit = {j for k in range(len(ws) - 7) if wins[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": failed}


def test_quality_base(odd, made, labels):
    for docs in (odd, made):
        want = Counter((d, tuple(base(t).items())) for d, t in texts(docs))
        got = rows(quality_rules.quality_rules(docs, labels))
        assert Counter((r["doc_id"], tuple((k, r[k]) for k in base(""))) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_ratio(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    data = [(k, " ".join(word("abcde" if k % 4 else "vwxyz") for _ in range(600)), "s") for k in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in rows(quality_rules.quality_rules(docs, labels))}
    assert sum(kept[k] == (k % 4 > 0) for k in range(200)) >= 195
    left = quality_rules.filtered(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, v in kept.items() if v}
    ratio = quality_rules.fit(docs, labels)
    counts = np.zeros((2, quality_rules.BUCKETS))
    good = {r.doc_id for r in labels.collect() if r.quality}
    for k, t, _ in data:
        raw = np.frombuffer(t.encode(), np.uint8)
        found, _ = quality_rules.buckets_of(raw, np.array([0, len(raw)]), 4, quality_rules.BUCKETS)
        for b in found:
            counts[0, b] += 1
            counts[1, b] += k in good
    assert np.allclose(ratio, quality_rules.log_ratio(counts[0] + 1, counts[1]))
    assert np.allclose(quality_rules.log_ratio(counts[0] + 1, np.zeros(quality_rules.BUCKETS)), 0)


def test_scores_of_any_batch(spark, made, clashing, labels):
    """Score and verdict by brute force; how rows are dealt doesn't matter."""
    good = spark.createDataFrame([(k, 1, 0) for k in range(0, 120, 3)] + [(3, 0, 0), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    ratio = quality_rules.fit(made, good)
    found = [{r["doc_id"]: (r["score"], r["kept"]) for r in rows(quality_rules.quality_rules(d, good))} for d in (made, made.repartition(17), made.coalesce(1))]
    assert found[0] == found[1] == found[2]
    for d, t in texts(made):
        raw = t.encode()
        b = [int(quality_rules.buckets_of(np.frombuffer(raw[k : k + 4], np.uint8), np.array([0, 4]), 4, quality_rules.BUCKETS)[0][0]) for k in range(len(raw) - 3)]
        score = float(np.mean([ratio[k] for k in b])) if b else 0.0
        assert abs(found[0][d][0] - score) < 1e-9 and found[0][d][1] == (not base(t)["base_failed"] and found[0][d][0] >= quality_rules.THRESHOLD)
    target = np.zeros(quality_rules.BUCKETS)
    raw = np.ones(quality_rules.BUCKETS)
    for d, t in texts(made):  # ids 3 and 6 have labels that aren't all good
        b, _ = quality_rules.buckets_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 4, quality_rules.BUCKETS)
        np.add.at(raw, b, 1)
        if d % 3 == 0 and d not in (3, 6):
            np.add.at(target, b, 1)
    assert np.allclose(ratio, quality_rules.log_ratio(raw, target))
    left = quality_rules.filtered(clashing, labels)
    assert left.columns == clashing.columns and left.count() == sum(r["kept"] for r in rows(quality_rules.quality_rules(clashing, labels)))


# --- 2 -------------------------------------------------------------------------------------------


def test_target_ids_beside_null_ids(spark):
    """Ids that doubles can't tell apart: only the labelled one is a target, whatever lies in its batch."""
    text = lambda k: " ".join(f"w{(7 * j + k) % 53}" for j in range(4000))
    rows_ = [(2**60, "good " * 30_000), (2**60 + 1, "other " * 30_000), *[(k, text(k)) for k in range(20)]]
    labels = spark.createDataFrame([(2**60, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string").coalesce(1)
    plain_, mixed_ = quality_rules.fit(frame(rows_), labels), quality_rules.fit(frame([*rows_, (None, None)]), labels)
    assert (plain_ == mixed_).all() and quality_rules.applies(plain_, quality_rules.THRESHOLD)
    kept = {r.doc_id: (r.score, r.ratio_applies) for r in quality_rules.quality_rules(frame([*rows_, (None, None)]), labels).collect()}
    assert kept[2**60][0] > 0.5 > -0.5 > kept[2**60 + 1][0] and kept[None][1]
    assert not quality_rules.quality_rules(frame(rows_), labels.limit(0)).first().ratio_applies


def test_shards(odd, made, clashing):
    for docs in (odd, made, clashing):
        got, all_ = rows(sharding.sharded(docs)), texts(docs)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in all_)
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes[k] for k in range(24)) - min(sizes[k] for k in range(24)) <= 1
        for k in range(24):
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
        n = Counter(r["source"] for r in got)
        for k, s in ((k, s) for k in range(24) for s in n):
            assert abs(sum(r["shard"] == k and r["source"] == s for r in got) - n[s] * sizes[k] / len(got)) <= 2


# --- 3 -------------------------------------------------------------------------------------------


def shingles(text):
    ws = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text)]
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def groups(all_):
    sets = [shingles(t or "") for _, t in all_]
    parent = list(range(len(all_)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(all_)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and (100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common)) or (all_[a][0] is not None and all_[a][0] == all_[b][0]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (d, _) in enumerate(all_):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(all_))


def test_near_duplicates(odd, made, clashing):
    for docs in (made, odd, clashing):
        got = rows(near_duplicates.near_duplicates(docs))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(texts(docs))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Many texts near one another, keys and cells in many parts, ids that repeat or are extreme."""
    for name, value in (("HOT", 16), ("CHUNK", 16), ("PIECE", 40), ("STAR", 16), ("CELL_BYTES", 8000)):
        monkeypatch.setattr(near_duplicates, name, value)
    rng = random.Random(4)
    head = [str(rng.random()) for _ in range(60)]
    data = []
    for k in range(250):
        ws = list(head)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(60)] = str(rng.random())
        data.append((k, " ".join(ws)))
    data += [(1000 + k, data[7][1]) for k in range(60)] + [(-(1 << 63), data[9][1]), ((1 << 63) - 1, "last of all and alone here")]
    one, two, three = ([str(rng.random()) for _ in range(40)] for _ in range(3))
    data += [(2001, " ".join(one)), (2001, " ".join(two)), (2002, " ".join(one[1:])), (2003, " ".join(two[1:])), (2001, ""), (2002, None)]
    data += [(None, " ".join(three[1:])), (None, " ".join(three[1:])), (2005, " ".join(three)), (2004, " ".join(three[2:])), (None, " ".join(head[:30])), (None, " ".join(head[:30]))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], "doc_id long, text string, near_a int").repartition(5)
    got = rows(near_duplicates.near_duplicates(docs))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups(data)
    assert {r["component_id"] for r in got if r["doc_id"] in (2001, 2002, 2003)} == {2001}
    kept = rows(near_duplicates.one_of_each(docs))
    # texts alone decide: both texts of one id stay, an id comes before none, texts without words all stay
    best = {}
    for k, n, c in groups([(k, t) for k, (_, t) in enumerate(data)]):
        d, t = data[k]
        best[c if n else (k,)] = min(best.get(c if n else (k,), (True, 1, "")), (d is None, d or 0, t))
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((None if no else d, t) for no, d, t in best.values())
    assert {tuple(r.values()) for r in kept} <= {(*r, k) for k, r in enumerate(data)}


def test_posterior_bound():
    rng = np.random.default_rng(0)
    for n, least in near_duplicates.LEAST:
        s = rng.random(200_000)  # the prior
        m = rng.binomial(n, s)
        close = s >= 0.75
        assert (close & (m < least)).sum() <= 5 and least > n // 3
    assert near_duplicates.similar(np.array([1, 2, 3], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert not near_duplicates.similar(np.array([1, 2, 3], np.uint64), np.array([1, 2, 4, 5], np.uint64))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2080)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 4 -------------------------------------------------------------------------------------------


def test_tokens(odd, made):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (odd, made):
        want = Counter()
        for d, t in texts(docs):
            n = len(library.encode(t, add_special_tokens=False).ids)
            want[d, len(t.encode()), n, n > 1024] += 1
        assert Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect()) == want
    merges, vocabulary, added = token_counts.load(path)
    counter = token_counts.Counter(merges, token_counts.prove(merges, vocabulary), added)
    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("ab '\n\t.s1é՘ 　\x1c\x85 <|endoftext|>字Z") for _ in range(rng.randint(0, 60)))
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


# --- 5 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    m = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return m, pieces.Prefixes(m)


def segmentations(m, w):
    if not w:
        return [((), 0.0)]
    return [((m.normal[w[:j]], *r), m.logp[w[:j]] + lp) for j in range(1, len(w) + 1) if w[:j] in m.logp for r, lp in segmentations(m, w[j:])]


def test_samples_without_replacement(model):
    m, prefixes = model
    n = 6000
    every = [(a + b, x + y) for a, x in segmentations(m, "▁no") for b, y in segmentations(m, "▁dogs")]
    total = sum(np.exp(x) for _, x in every)
    p = {s: np.exp(x) / total for s, x in every}
    got = pieces.sampled(["no dogs"] * n, np.random.default_rng(0).integers(0, 1 << 62, n).astype(np.uint64), m, prefixes, 3)
    assert all(len({tuple(s[0]) for s in row}) == 3 for row in got)
    first, second = Counter(tuple(r[0][0].tolist()) for r in got), Counter(tuple(r[1][0].tolist()) for r in got)
    for s, q in p.items():
        then = sum(r * q / (1 - r) for t, r in p.items() if t != s)
        assert abs(first[s] / n - q) < 5 * (q / n) ** 0.5 + 1e-3 and abs(second[s] / n - then) < 5 * (then / n) ** 0.5 + 1e-3
    assert all(abs(lp - np.log(p[tuple(ids.tolist())])) < 1e-9 for row in got[:50] for ids, lp, _ in row)
    assert abs(np.mean([sum(np.exp(lp - li) for _, lp, li in row) for row in got]) - 1) < 0.1  # inclusion scores are unbiased


def test_all_segmentations_of_a_short_text(model):
    m, prefixes = model
    every = segmentations(m, "▁cat")
    got = pieces.sampled(["cat"], np.array([3], np.uint64), m, prefixes, 50)[0]
    assert {tuple(i.tolist()) for i, _, _ in got} == {s for s, _ in every} and all(li == 0.0 for _, _, li in got)


def test_long_words_and_bytes(model, monkeypatch):
    m, prefixes = model
    texts_ = ["a" * 300, "thing" * 40, "\U0001f600é字͸" * 5, "x\ny"]
    keys = np.arange(4, dtype=np.uint64)
    got = pieces.sampled(texts_, keys, m, prefixes, 2)
    for t, row in zip(texts_, got, strict=True):
        assert len(row) == (1 if t[0] == "\U0001f600" else 2)  # it has one segmentation only
        assert all(pieces.decode(m, i.tolist()) == t for i, _, _ in row)
    ids = [row[0][0] for row in got]
    flat, sizes, raw = np.concatenate(ids), np.array([len(i) for i in ids]), [t.encode() for t in texts_]
    assert pieces.spell_alike(m, flat, sizes, raw).all()
    assert pieces.spell_alike(m, flat, sizes, [raw[0], raw[1][:-1] + b"?", *raw[2:]]).tolist() == [True, False, True, True]
    assert pieces.spell_alike(m, flat, sizes, [raw[0], raw[1] + b"?", *raw[2:]]).tolist() == [True, False, True, True]
    monkeypatch.setattr(pieces, "NEAR", 3)  # most levels by logarithms
    again = pieces.sampled(texts_, keys, m, prefixes, 2)
    assert all((a[0] == b[0]).all() and abs(a[1] - b[1]) < 1e-8 for x, y in zip(got, again, strict=True) for a, b in zip(x, y, strict=True))


def test_pieces_of_documents(odd, made):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b = ({(r.doc_id, r.sample): r for r in pieces.sample_segmentations(d, path).collect()} for d in (made, made.repartition(5)))
    assert a.keys() == b.keys() and all(a[k].ids == b[k].ids and a[k].log_prob == b[k].log_prob and a[k].log_inclusion == b[k].log_inclusion for k in a)
    got = rows(pieces.sample_segmentations(odd, path))
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} == {d for d, _ in texts(odd)}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode(made, path)
    assert {r["doc_id"]: r["ids"] for r in rows(encoded)} == {d: sp.encode(t) for d, t in texts(made)}
    assert {r["doc_id"]: r["text"] for r in rows(pieces.decoded(encoded, path))} == dict(texts(made))


# --- 6 -------------------------------------------------------------------------------------------


def removed(all_):
    split = [WORD.findall(t) for _, t in all_]
    wins = Counter(tuple(ws[k : k + 35]) for ws in split for k in range(len(ws) - 34))
    out = Counter()
    for (d, _), ws in zip(all_, split, strict=True):
        gone = {j for k in range(len(ws) - 34) if wins[tuple(ws[k : k + 35])] > 1 for j in range(k, k + 35)}
        out[d, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)] += 1
    return out


def test_substrings(odd, made, clashing, monkeypatch):
    for docs in (odd, made, clashing):
        assert Counter(tuple(r) for r in substrings.removed(docs).collect()) == removed(texts(docs))
    monkeypatch.setattr(substrings, "GROUP", 9000)  # several groups and ranges
    monkeypatch.setattr(substrings, "RANGE", 700)
    assert Counter(tuple(r) for r in substrings.removed(made).collect()) == removed(texts(made))


def test_repeated_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 20_000)
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(8, "alone " * 20)], "doc_id long, text string"))
    sizes = []
    keep = substrings.written

    def noted(df, tag):
        if tag == "texts":
            sizes.extend(r["count"] for r in df.groupBy("grp").count().collect())
        return keep(df, tag)

    monkeypatch.setattr(substrings, "written", noted)
    got = Counter(tuple(r) for r in substrings.removed(docs).collect())
    assert got == Counter({(7, 40, 40, ""): 6000, (8, 20, 0, ("alone " * 20).strip()): 1})
    assert max(sizes) < 1000


def test_rolling_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    h[40:80] = h[:40]
    for n in (1, 2, 5, 18, 35):
        r = rolling(h, n)
        assert len(r) == 91 - n and len(set(r.tolist())) == len({tuple(h[k : k + n]) for k in range(91 - n)})
    assert in_one(np.array([3, 0, 2, 4]), 3).tolist() == [0, 5, 6]


# --- 8 -------------------------------------------------------------------------------------------


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(u, rate):
    if rate <= 0:
        return 0
    p, f, k = np.exp(-rate), np.exp(-rate), 0
    while f <= u and k < 500:
        k += 1
        p *= rate / k
        f += p
    return k


def test_mixing(made, odd, clashing):
    for docs, weights, total in ((made, {"s0": 1.0, "s1": 3.0}, 400), (made, None, 90_000), (odd, None, None), (clashing, {"a": 1, None: 2}, 60)):
        data = docs.select("doc_id", "source", "text").collect()
        n = Counter(r.source for r in data)
        w = dict.fromkeys(n, 1.0) if weights is None else {s: weights.get(s, 0) for s in n}
        t = total or len(data)
        want = Counter()
        for r in data:
            rate, i = t * w[r.source] / sum(w.values()) / n[r.source], "null" if r.doc_id is None else r.doc_id
            parts = max(1, int(np.ceil(rate / mixing.PART)))
            for part in range(parts):
                k = poisson(uniform("mix-1", i, part), rate / parts)
                want.update((r.doc_id, r.source, r.text, part, c) for c in range(1, k + 1))
        ordered = mixing.mixed_order(docs, weights=weights, total=total)
        names = [c for c in ordered.columns if c not in docs.columns]
        assert ordered.columns == [*docs.columns, *names] and [c.strip("_") for c in names] == ["mix_part", "mix_copy", "mix_place"]
        got = [(r.doc_id, r.source, r.text, *(r[c] for c in names)) for r in ordered.collect()]
        assert Counter(r[:5] for r in got) == want
        key = lambda r: hashlib.md5(f"mix-1-order:{'null' if r[0] is None else r[0]}:{r[3]}:{r[4]}".encode()).hexdigest()
        got.sort(key=lambda r: r[5])
        assert [r[5] for r in got] == list(range(len(got))) and [key(r) for r in got] == sorted(map(key, got))
        out = mixing.mixed(docs, weights=weights, total=total)
        assert out.columns == docs.columns and Counter((r.doc_id, r.source, r.text) for r in out.collect()) == Counter(r[:3] for r in got)
    rest = clashing.drop("text").schema.names[5:]
    assert {tuple(r[c] for c in rest) for r in mixing.mixed_order(clashing).collect()} == {(1,) * len(rest)}
    with pytest.raises(ValueError):
        mixing.mixed(made, weights={"s0": -1.0})


def test_output_of_mixing_is_in_ranges_of_the_order(made):
    out = mixing.mixed(made, total=20_000).groupBy(F.spark_partition_id().alias("at")).count().collect()
    assert len(out) == 4 and max(r["count"] for r in out) < 1.1 * min(r["count"] for r in out)


def test_large_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    counts = [r["count"] for r in mixing.replicated(docs, total=400 * 900).groupBy("id").count().collect()]
    assert len(counts) == 400 and abs(np.mean(counts) - 900) < 10 and 20 < np.std(counts) < 40
    one = docs.limit(1).withColumn("source", F.lit("t")).unionByName(docs)
    huge = mixing.replicated(one, {"t": 1.0}, 1_000_000).count()
    assert abs(huge - 1_000_000) < 6000


# --- 10 ------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(d[-1::-2] + [2 * x - 9 * (x > 4) for x in d[-2::-2]]) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(6)
    for _ in range(6000):
        t = "".join(rng.choice(["a", "1", ".", "@", "-", "9", " ", "2", "+", "(", ")", "4111111111111111", "@a.b", "1.2.3.4", "é"]) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_field_by_enumeration():
    """Partition function, posteriors, expected pairs and the best segmentation against all segmentations."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        size, kinds = int(rng.integers(1, 5)), int(rng.integers(1, 4))
        found = [(i, j, 0, 0) for i in range(size) for j in range(i + 1, min(size, i + 3) + 1) if rng.random() < 0.8]
        scores, trans = rng.normal(0, 2, (len(found), kinds)), rng.normal(0, 2, (kinds + 1, kinds + 1))

        def every(at, last):
            if at == size:
                yield 0.0, [], np.zeros_like(trans)
                return
            for j, k, kind, own in [(at + 1, None, kinds, 0.0), *((f[1], k, y, scores[k, y]) for k, f in enumerate(found) if f[0] == at for y in range(kinds))]:  # noqa: B023
                for score, segs, pairs in every(j, kind):  # noqa: B023
                    pairs = pairs.copy()
                    pairs[last, kind] += 1
                    yield score + own + trans[last, kind], ([] if k is None else [(k, kind)]) + segs, pairs  # noqa: B023

        all_ = list(every(0, kinds))
        weight = np.exp([s for s, _, _ in all_])
        total, posterior, pairs = pii.expected(size, found, scores, trans)
        assert np.isclose(total, np.log(weight.sum())) and posterior.shape == scores.shape
        want = np.zeros_like(scores)
        for p, (_, segs, _) in zip(weight / weight.sum(), all_, strict=True):
            for k, y in segs:
                want[k, y] += p
        assert np.allclose(posterior, want)
        assert np.allclose(pairs, sum(p * x for p, (_, _, x) in zip(weight / weight.sum(), all_, strict=True)))
        best = max(all_, key=lambda x: x[0])
        assert pii.decode(size, found, scores, trans) == best[1]
        marks = np.zeros_like(scores)
        for k, y in best[1]:
            marks[k, y] = 1
        assert (pii.observed(size, found, marks) == best[2]).all()


def test_field_looks_back_only():
    """Spans of the streaming decoder against the decoder of whole runs, and its memory on a long run."""
    w, rng = pii.trained(), random.Random(5)
    for _ in range(300):
        t = " ".join(rng.choice(["1", "12", "555-0134", "4111111111111111", "a@b.de", "1.2.3.4", "word", "key=", "+49", "9f86d081884c7d659a2f", "\"", "(415)"]) for _ in range(rng.randint(1, 25)))
        want = []
        for run, left in pii.runs(t):
            found, x = pii.segments(t, run, left)
            if found:
                want += [(pii.KINDS[kind], found[k][2], found[k][3]) for k, kind in pii.decode(len(run), found, x @ w[0].T, w[1])]
        assert pii.field_spans(t, w) == want, t
    n = 30_000
    tracemalloc.start()
    pii.all_spans("7 " * n, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n + 2_000_000


def test_field_on_other_lines():
    """Lines as people write them; none comes from the templates that the weights are fitted on."""
    w = pii.trained()
    found = [  # (line, kind and text of its entities)
        ("Please ring Ms Ortega on (415) 555-0134 before noon.", [("phone", "(415) 555-0134")]),
        ("fax: 030-555-0199, desk 12", [("phone", "030-555-0199")]),
        ("export API_KEY=9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822c", [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822c")]),
        ("password: hunter2hunter2Hunter2HUNTER22", [("secret", "hunter2hunter2Hunter2HUNTER22")]),
        ("Write to j.doe42@mail.example.org or come by.", [("email", "j.doe42@mail.example.org")]),
        ("Visa 4111 1111 1111 1111 expires soon", [("card", "4111 1111 1111 1111")]),
        ("two cards, 4111111111111111 5500000000000004, both stolen", [("card", "4111111111111111"), ("card", "5500000000000004")]),
        ("host 192.168.0.17 answered 10.1.2.3 too", [("ip", "192.168.0.17"), ("ip", "10.1.2.3")]),
    ]
    none = [
        "The battle of 1815 cost 47000 men and 300 guns.", "Chapter 12, page 345, lines 6-9.", "Version 3.11.2 was released on 2023-02-08.", "It costs $1,299.00 or 12 x 108.25 a month.",
        "The meeting is at 10:30 in room 204.", "Pi is 3.14159265 and e is 2.71828.", "ISBN 978-3-16-148410-0 is out of print.", "He ran 100 m in 10.2 s and 200 m in 20.9 s.", "Call me in 5 minutes or in 2 hours.",
    ]
    hits = sum([(k, t[a:b]) for k, a, b in pii.field_spans(t, w)] == want for t, want in found)
    assert hits >= 7 and sum(not pii.field_spans(t, w) for t in none) >= 8


def test_field_on_made_lines():
    w, rng = pii.trained(), random.Random(1234)
    cases = [pii.templates(rng) for _ in range(600)]
    right = sum(pii.field_spans(t, w) == [(k, *pii.trimmed(t, a, b)) for k, a, b in gold] for t, gold in cases)
    assert right >= 0.94 * len(cases)


def test_any_column_names(clashing, made, labels):
    dotted = made.select("*", F.lit(1).alias("a.b"), F.lit(1).alias("c1"))
    for docs, f in ((clashing, pii.redacted), (clashing, near_duplicates.one_of_each), (clashing, mixing.mixed), (dotted, lambda d: quality_rules.filtered(d, labels))):
        out = f(docs)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {(1,) * (len(docs.columns) - 5)}


def test_pii(odd, made, spark):
    lines = ["call +1 (212) 555-0100 10.0.0.1 now", "cards 4111111111111111 5500000000000004 end", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "a.b@c.example.com, version 2.0 of 2021", None]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(pii.find_pii(docs))}
    assert "phone" in got[0]["spans"] and "ip" in got[0]["spans"] and got[1]["spans"].count("card") == 2 and got[2]["spans"] == "secret:9:49" and got[3]["spans"] == "email:0:17"
    masked = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert masked[1] == "cards <CARD> <CARD> end" and masked[2] == 'token = "<SECRET>"' and masked[4] is None
    for d in (odd, made):
        want = Counter((i, hashlib.sha256(pii.text_of(plain_spans(t)).encode()).hexdigest()) for i, t in texts(d))
        assert Counter((r["doc_id"], r["base_sha256"]) for r in rows(pii.find_pii(d))) == want
        assert pii.redacted(d).columns == d.columns
    torn = spark.sql("select 1L as doc_id, cast(x'FF41' as string) as text union all select 2L, cast(x'FF20613140622E6465' as string)")
    assert {r.doc_id: r.text for r in pii.redacted(torn).collect()} == {1: "\ufffdA", 2: "\ufffd <EMAIL>"}


# --- all -----------------------------------------------------------------------------------------


def test_empty_tables(empty, labels):
    path, model_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for out in (
        quality_rules.quality_rules(empty, labels), quality_rules.filtered(empty, labels), sharding.sharded(empty), near_duplicates.near_duplicates(empty),
        token_counts.token_counts(empty, path), pieces.sample_segmentations(empty, model_path), substrings.removed(empty), mixing.mixed(empty), mixing.mixed_order(empty), pii.find_pii(empty), pii.redacted(empty),
    ):
        assert out.collect() == []
    assert quality_rules.quality_rules(empty, labels.limit(0)).collect() == []
