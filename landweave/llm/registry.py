"""The registered queries of the training-data operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from landweave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


# Places follow from MD5, which both engines have. The checksum comes from a table of 256 entries
# made by rule, folded over the bytes of each text.
_SQL["op2_sharding"] = """
WITH RECURSIVE crc(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc WHERE k < 8
), entries AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), sums AS (
  SELECT text, xor(list_reduce(
      list_transform(range(0, octet_length(encode(text))), lambda p: ('0x' || substr(hex(encode(text)), 2 * p + 1, 2))::BIGINT),
      lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295) AS crc
  FROM texts, entries
), rows AS (
  SELECT doc_id, source, octet_length(encode(coalesce(d.text, ''))) + 8 AS size, crc, md5('shard-1:' || coalesce(doc_id::VARCHAR, 'null')) AS hash
  FROM documents d JOIN sums s ON coalesce(d.text, '') = s.text
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id, size, crc) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), hash, source) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, source, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (place * 24 // total)::INT AS shard,
  (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.mixing import mixed_order

    return mixed_order(table(spark, sf_dir, "documents"))


_SQL["op8_mixing"] = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, (SELECT count(*) FROM documents) * (1.0::DOUBLE / (SELECT count(*) FROM sizes)) / n AS mean FROM sizes),
rates AS (SELECT source, greatest(ceil(mean / 256), 1)::BIGINT AS parts, mean / greatest(ceil(mean / 256), 1) AS rate FROM means),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS p, exp(-rate) AS f FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p + ln(rate) - ln((k + 1)::DOUBLE), f + exp(p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
), steps AS (
  SELECT source, list(f ORDER BY k) AS fs FROM cdf GROUP BY source
), parted AS (
  SELECT d.*, unnest(range(parts)) AS part FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM parted
), counted AS (
  SELECT d.*, len(list_filter(fs, lambda f: f <= u)) AS copies FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
), copied AS (
  SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted
)
SELECT * EXCLUDE (part, u, copies, copy), part::BIGINT AS mix_part, copy::INT AS mix_copy,
  (row_number() OVER (ORDER BY md5('mix-1-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || part || ':' || copy), doc_id, source, text) - 1)::BIGINT AS mix_place
FROM copied
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query
def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.warc import audit, replicas

    return audit(*replicas(table(spark, sf_dir, "pages")))


# The same manifests, compared record by record.
_SQL["op9_warc_audit"] = """
WITH base AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5('record:' || coalesce(page_id::VARCHAR, 'null') || ':' || coalesce(url, '')) AS record_id,
    ('0x' || substr(md5('warc-1:' || coalesce(page_id::VARCHAR, 'null')), 1, 2))::INT AS fate
  FROM pages
), rec AS (
  SELECT page_id, record_id AS k, fate, 'WARC/1.1' || e'\\r\\nWARC-Type: resource\\r\\nWARC-Record-ID: <urn:uuid:' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12)
    || e'>\\r\\nWARC-Target-URI: ' || url || e'\\r\\nWARC-Date: 2024-01-01T00:00:00Z\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || octet_length(encode(html)) || e'\\r\\n\\r\\n' || html || e'\\r\\n\\r\\n' AS record
  FROM base
), placed AS (
  SELECT *, sha256(record) AS sha, row_number() OVER (ORDER BY md5('place:' || coalesce(page_id::VARCHAR, 'null')), page_id, sha256(record)) - 1 AS place,
    CASE WHEN fate < 4 THEN 'X' || substr(record, 2) WHEN fate = 4 THEN left(record, length(record) - 4) ELSE record END AS other
  FROM rec
), copies AS (
  SELECT *, unnest(range(CASE fate WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE 1 END)) AS copy FROM placed
), ours AS (
  SELECT page_id, k, place // 512 AS archive, octet_length(encode(record)) AS length, sha,
    coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY place // 512 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM placed
), theirs AS (
  SELECT page_id, k, place // 512 AS archive, octet_length(encode(other)) AS length, sha256(other) AS sha,
    coalesce(sum(octet_length(encode(other))) OVER (PARTITION BY place // 512 ORDER BY place, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM copies
), a AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY archive, off) AS nth FROM ours ANTI JOIN theirs USING (archive, off, length, sha)
), b AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY archive, off) AS nth FROM theirs ANTI JOIN ours USING (archive, off, length, sha)
), moved AS (
  SELECT a.archive, a.off, b.archive AS fa, b.off AS fo, 'moved' AS status FROM a JOIN b USING (sha, nth)
), a2 AS (
  SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY k ORDER BY archive, off) AS nth FROM a ANTI JOIN moved USING (archive, off)
), b2 AS (
  SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY k ORDER BY archive, off) AS nth FROM b ANTI JOIN moved m ON b.archive = m.fa AND b.off = m.fo
), harmed AS (
  SELECT a2.archive, a2.off, b2.archive AS fa, b2.off AS fo, CASE WHEN b2.length < a2.length THEN 'truncated' ELSE 'corrupt' END AS status FROM a2 JOIN b2 USING (k, nth)
), found AS (
  SELECT * FROM moved UNION ALL SELECT * FROM harmed UNION ALL SELECT archive, off, NULL, NULL, 'missing' FROM a2 ANTI JOIN harmed USING (archive, off)
)
SELECT page_id, archive::BIGINT AS archive, off::BIGINT AS record_offset, length::BIGINT AS length, sha AS sha256, coalesce(status, 'intact') AS status,
  (CASE WHEN status IS NULL THEN archive ELSE fa END)::BIGINT AS found_archive, (CASE WHEN status IS NULL THEN off ELSE fo END)::BIGINT AS found_offset
FROM ours LEFT JOIN found USING (archive, off)
UNION ALL
SELECT page_id, archive, off, length, sha, 'extra', archive, off FROM b2 ANTI JOIN harmed h ON b2.archive = h.fa AND b2.off = h.fo
"""


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from landweave.llm.pieces import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.substrings import removed

    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SQL["op6_substring_dedup"] = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35
), wins AS (
  SELECT s.doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS k FROM starts s JOIN w USING (doc_id)
), twice AS (
  SELECT doc_id, p FROM wins WHERE k IN (SELECT k FROM wins GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM twice
), lists AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(g, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL["op3_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.vector_codes import encoded

    return encoded(table(spark, sf_dir, "embeddings"))


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds written one after another; every number is an integer that doubles hold."""
    near = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
a{k} AS MATERIALIZED (SELECT row, p, min(({near})::BIGINT * {entries} + k) AS best FROM parts JOIN c{k} USING (p) GROUP BY row, p)"""
        if k < rounds:
            steps += f""",
m{k} AS (
  SELECT p, k, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (row, p), range(1, w + 1) t(i) GROUP BY 1, 2, 3
  ) GROUP BY p, k
), c{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, k))"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p, w, v[p * w + 1:p * w + w] AS v FROM kept, range({parts}) t(p)
), c0 AS (SELECT p, row - 1 AS k, v AS c FROM parts WHERE row <= {entries}){steps}
, coded AS (
  SELECT row, string_agg(lower(substr('0123456789ABCDEF', (best % {entries} // 16 + 1)::INT, 1) || substr('0123456789ABCDEF', (best % 16 + 1)::INT, 1)), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY row
), book AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS sha FROM c{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (row), book
"""


_SQL["op11_vector_codes"] = _vector_codes_sql()


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from landweave.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landweave.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


_SQL["op13_phrases"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), runs AS (
  SELECT lang, 1 AS d, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE d = 1 GROUP BY lang),
cand AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE d > 1 AND f >= 10),
cuts AS (
  SELECT lang, d, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, d)) AS k FROM cand)
), scored AS (
  SELECT c.lang, c.d, c.phrase, a, min({'s': (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f), 'k': k, 'l': x.f, 'r': y.f}) AS cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail GROUP BY ALL
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM cand WHERE d = 3) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.s DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, cut.s::BIGINT AS score
  FROM scored LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(d = 2 AND 100 * longer >= 50 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
