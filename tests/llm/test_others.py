"""Neighbours, archives, the pipeline and the registry."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.llm import neighbours, pieces, pii, quality_rules, warc

pytest.importorskip("public_tokenizers")
from test_documents import base, plain_spans, poisson, shingles, uniform  # noqa: E402


def exact(ids, x, k=20, every=20):
    """{query: its nearest (id, score), best first} by brute force."""
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            score = np.zeros(len(x))
            for d in range(x.shape[1]):
                score += x[:, d].astype(float) * float(q[d])
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
    return out


def recall(df, want):
    """Of the rows of ``df``, which must be ranked and scored as they are defined, the share of ``want`` found."""
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == len(want[q]) == len(set(found))
    known = {(q, i): s for q, found in want.items() for i, s in found}
    mine = {(q, i): s for q, found in got.items() for i, s in found}
    both = mine.keys() & known.keys()
    assert all(mine[p] == known[p] for p in both)
    return len(both) / len(known)


def vectors(spark, ids, x, kind="double"):
    return spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")


def test_neighbours_of_a_small_table(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:90] = x[50]  # one common vector: ties by id
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    bad = [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [None] * 8, 0), (1080, [1.0] * 3, 0), (None, x[0].tolist(), 0), (1100, [float("inf")] + [1.0] * 7, 0), (7, x[7].tolist(), 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(k).alias(c) for k, c in enumerate(("key", "block", "chunk", "own", "least", "kind", "spot", "_size"))])
    assert recall(neighbours.nearest(table), exact(np.arange(300), x)) >= 0.9
    assert neighbours.nearest(table.limit(0)).collect() == []
    assert len(neighbours.nearest(table.where("vec_id < 5")).collect()) == 4
    shares = neighbours.found(table).groupBy("query_id").agg(F.max("verified").alias("n")).collect()
    assert np.mean([r.n for r in shares]) < 250  # the threshold chooses, here too


def test_neighbours_in_double_precision(spark):
    x = np.ones((60, 4)) * 0.5
    x[:, 0] += np.arange(60) * 1e-13
    assert recall(neighbours.nearest(vectors(spark, np.arange(60), x)), exact(np.arange(60), x)) >= 0.9


def test_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1500)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32)) * (1 + rng.random((6000, 1)))  # lengths differ: inner products aren't distances
    keep = np.array([k for k in range(6000) if k % 20 or k < 1000])
    table = vectors(spark, keep, x[keep])
    assert recall(neighbours.nearest(table), exact(keep, x[keep])) >= 0.9
    shares = [r.verified for r in neighbours.found(table).where("verified < 1500").select("query_id", "verified").distinct().collect()]
    assert np.mean(shares) < 0.6 * 1500
    monkeypatch.setattr(neighbours, "BLOCK", 12)  # fewer vectors in a block than wanted
    few = np.arange(0, 300, 5)
    assert recall(neighbours.nearest(vectors(spark, few, x[few])), exact(few, x[few])) >= 0.9


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1000)
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 7)) for k in range(1500)] + [(None, None, None), (3, "http://x/3", "<p>3</p>" * 3), (5, None, "y"), (1499, None, "")], "page_id long, url string, html string").withColumn("place", F.lit(0))
    sound = spark.createDataFrame(warc.stored(pages).collect(), "page_id long, record_id string, archive long, offset long, length long, sha256 string")
    out = sorted(warc.audit(sound, sound).collect(), key=lambda r: (r.archive, r.record_offset))
    assert {r.status for r in out} == {"intact"} and len(out) == 1504 and out[0].record_offset == 0
    for a, b in zip(out, out[1:], strict=False):
        assert b.record_offset == (a.record_offset + a.length if a.archive == b.archive else 0)

    def differences(change):
        """Statuses by archive after ``change`` of the list of one archive's records, relaid."""
        rows = sorted((r.asDict() for r in sound.collect()), key=lambda r: (r["archive"], r["offset"]))
        other, at = [], Counter()
        for r in change(rows):
            other.append({**r, "offset": at[r["archive"]]})
            at[r["archive"]] += r["length"]
        got = warc.audit(sound, spark.createDataFrame(other, sound.schema)).collect()
        return Counter((r.archive, r.status) for r in got if r.status != "intact"), got

    found, _ = differences(lambda rows: [{**r, "sha256": "bad"} if k == 700 else r for k, r in enumerate(rows)])
    assert found == {(1, "corrupt"): 1}
    found, _ = differences(lambda rows: [{**r, "sha256": "bad", "length": r["length"] - 4} if k == 700 else r for k, r in enumerate(rows)])
    assert found == {(1, "truncated"): 1, (1, "moved"): 1023 - 700}
    found, got = differences(lambda rows: rows[:1000] + rows[1001:])
    assert found == {(1, "missing"): 1, (1, "moved"): 23} and [r.found_offset for r in got if r.status == "missing"] == [None]
    found, got = differences(lambda rows: [*rows, {**rows[-1], "sha256": "new", "record_id": "new"}])
    assert found == {(2, "extra"): 1} and sum(r.status == "intact" for r in got) == 1504
    found, got = differences(lambda rows: rows[:1022] + [rows[1023], rows[1022]] + rows[1024:])
    assert found == {(1, "moved"): 2} and all(r.found_offset != r.record_offset for r in got if r.status == "moved")
    found, _ = differences(lambda rows: [r for r in rows if r["archive"] < 2])
    assert found == {(2, "missing"): 1504 - 1024}
    assert warc.audit(sound.limit(0), sound.limit(0)).collect() == []
    assert {r.status for r in warc.audit(sound.limit(0), sound).collect()} == {"extra"}


def test_archives_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"é{k}\r\n\r\n" * k) for k in range(20)], "page_id long, url string, html string")
    raw = b"".join(r.record.encode() for r in warc.records(pages).orderBy("page_id").collect())
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[:500]) + gzip.compress(raw[500:]))  # two members
    back = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter((r.url, bytes(r.payload).decode()) for r in back) == Counter({(f"http://x/{k}", f"é{k}\r\n\r\n" * k): 2 for k in range(20)})
    for bad in (b"not an archive", raw[:-9]):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))
    assert [x[0] for x in warc.parse(raw[k : k + 7] for k in range(0, len(raw), 7))] == [x[0] for x in warc.parse([raw])]
    one = pages.where("page_id = 4")
    assert warc.stored(one).first().sha256 == hashlib.sha256(warc.records(one).first().record.encode()).hexdigest()


def by_quality(docs, labels):
    """Rows that no base rule rejects and whose mean log ratio, from plain counts, reaches the threshold."""
    def bucket(gram):
        g = 0
        for c in gram:
            g = (g * 257 + c) % 2**32
        g = (g ^ (g >> 15)) * 0x2C1B3C6D % 2**32
        return (g ^ (g >> 12)) % 2**15

    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    grams = [Counter(map(bucket, (raw[i : i + 4] for raw in [(r.text or "").encode()] for i in range(len(raw) - 3)))) for r in docs]
    raw, target = sum(grams, Counter()), sum((g for r, g in zip(docs, grams, strict=True) if r.doc_id in good), Counter())
    n, m = sum(raw.values()) + 2**15, sum(target.values())
    share = 0.02 + 0.98 * 50_000 / (50_000 + m)
    p = {k: (v + 1) / n for k, v in raw.items()}
    ratio = {k: np.log(share * p[k] + (1 - share) * target[k] / max(m, 1)) - np.log(p[k]) for k in p}
    mean = lambda g: sum(c * ratio[k] for k, c in g.items()) / max(sum(g.values()), 1)
    return [r for r, g in zip(docs, grams, strict=True) if not base(r.text or "")["base_failed"] and mean(g) >= -0.3]


def by_texts(docs):
    """Sets of rows of which one each must stay: that of the least id; rows without words all stay."""
    sets = [shingles(r.text or "") for r in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [[docs[k] for k in range(len(docs)) if group[k] == g] for g in sorted(set(group))]


def masked(text, spans):
    for kind, a, b in sorted(spans, key=lambda s: -s[1]):
        text = text[:a] + f"<{kind.upper()}>" + text[b:]
    return text


def by_copies(docs):
    n = Counter(r.source for r in docs)
    out = Counter()
    for r in docs:
        out[r] += poisson(uniform("mix-1", "null" if r.doc_id is None else r.doc_id, 0), len(docs) / len(n) / n[r.source])
    return +out


def test_pipeline(spark, odd, tmp_path):
    """Every stage against a brute-force version on its own input, and the whole against its stages."""
    import corpus_pipeline
    import public_tokenizers

    rng = random.Random(4)
    made = lambda letters, n: [("".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))) for _ in range(n)]
    good = [made("abcdefgh", 150) for _ in range(60)]
    extra = ["", " a.b@c.example.com", " call +1 (212) 555-0100 now", " at 10.0.0.1\nend", " card 4111111111111111"]
    data = [(200 + k, " ".join(w) + extra[k % 5], "en", f"s{k % 3 if k % 2 else 0}", 9) for k, w in enumerate(good)]
    data += [(300 + k, " ".join([*w[:70], "new", *w[71:]]), "en", "s1", 9) for k, w in enumerate(good[:20])]  # near copies
    data += [(400 + k, " ".join(made("vwxyz", 150)), "en", "s2", 9) for k in range(20)]  # unlike the target
    data += [data[3], (201, " ".join(made("abcdefgh", 90)), "fr", None, 9), (None, data[7][1], "en", "s0", 9), (None, " ".join(good[30][:100]), "en", "s0", 9)]
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    labels = spark.createDataFrame([(200 + k, 1, 0) for k in range(60)] + [(k, 0, 0) for k in range(400, 410)] + [(10, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, stages[-1], str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        stages.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or stages[-1].columns == docs.columns
    raw, sound, single, clean, mixture, pieced = (s.collect() for s in stages)

    assert Counter(sound) == Counter(by_quality(raw, labels.collect()))
    ids = {r.doc_id for r in sound}
    assert ids >= set(range(200, 260)) and not ids & set(range(400, 420))

    left = Counter(single)
    for group in by_texts(sound):
        mine = [r for r in group if r in left]
        if not shingles(group[0].text or ""):
            assert left[group[0]] == Counter(sound)[group[0]]
            continue
        assert sum(left[r] for r in set(mine)) == 1 and mine[0].doc_id == min((r.doc_id for r in group if r.doc_id is not None), default=None)
    assert left <= Counter(sound) and len(single) < len(sound) - 20

    weights = pii.trained()
    want = Counter()
    for r in single:
        spans = pii.all_spans(r.text, weights)[1]
        assert set(plain_spans(r.text)) <= set(map(tuple, spans))
        text = masked(r.text, spans)
        want[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    assert Counter(map(tuple, clean)) == want and sum("<EMAIL>" in r.text for r in clean) >= 10

    assert Counter(mixture) == by_copies(clean)

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.load(path)
    spelled = Counter((r.doc_id, pieces.decode(model, r.ids)) for r in pieced)
    assert spelled == Counter({(d, t): 2 * n for (d, t), n in Counter((r.doc_id, r.text) for r in mixture).items()})
    row = lambda r: (r.doc_id, r.sample, tuple(r.ids), r.log_prob)
    assert Counter(map(row, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(row, pieced))


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert all(r.round_trip for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect())


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
