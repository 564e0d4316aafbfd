"""WARC records and a Merkle fixity audit of two replicas.

Pages become WARC/1.1 resource records. Each replica has a manifest of its own: archive, offset, length, id
and hash of every record as it lies there. Its tree is built from that alone: a leaf is the hash of the
(offset, length, hash) of the records that begin in one range of ``RANGE`` bytes of an archive; a node is the
hash of up to ``FANOUT`` neighbouring ranges, then of whole archives, up to one root.

An audit compares the roots. If they differ it fetches the children of differing nodes only, level by level, down
to the ranges that differ, and compares the records of these alone. A record that isn't in the same place with the
same bytes is ``moved`` (its bytes are at another place, ``found_archive`` and ``found_offset``), ``truncated`` or
``corrupt`` (its id is there with fewer, or other, bytes) or ``missing``; what is only in the replica is ``extra``.
A record lost or added shifts the offsets behind it, so the rest of its archive is reported as moved.

Everything is DataFrame functions: record bytes are hashed where they are read, and only hashes, lengths and ids
are shuffled. A node has at most FANOUT children, a leaf at most RANGE records, an archive as laid out here at most
PER_ARCHIVE; copies of one record are numbered without bringing them together.

* A null html or url counts as empty, a very long one is hashed whole. Null ids and repeated rows get records of their
  own. Copies of one record that moved (ties) are matched in the order of their places; of rows that share an id, the
  order by hash decides the layout.
* Without pages there is no tree: all records of the other replica are extra (or missing); without any the result is
  empty. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.llm.common import joined, written
from landweave.llm.ranks import bucket_count, hash_bucket, ranked

PER_ARCHIVE = 512
FANOUT = 16
RANGE = 1 << 16
SEED = "warc-1"
CRLF = "\r\n"
PLACE = ["page_id", "record_id", "archive", "offset", "length", "sha256"]


def record_id() -> Column:
    return F.md5(joined("record", F.col("page_id"), F.coalesce(F.col("url"), F.lit(""))))


def header(payload: Column) -> Column:
    uuid = F.concat_ws("-", *[F.substring(record_id(), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CRLF * 2),
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id, record_id (a hash of id and url) and the record, as a string."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), record_id().alias("record_id"), F.concat(header(payload), payload, F.lit(CRLF * 2)).alias("record"))


def hashed(record: Column) -> list[Column]:
    return [F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("sha256")]


def placed(rows: DataFrame, total: int) -> DataFrame:
    """Hashed records (page_id, length, sha256 and others) with place and archive, in the order of a hash of the id."""
    keyed = rows.withColumn("_key", F.md5(joined("place", F.col("page_id")))).withColumn("_bucket", hash_bucket("_key", bucket_count(total)))
    done = ranked(keyed, [], "_bucket", [F.col("_key"), F.col("page_id"), F.col("sha256")], "place").drop("_bucket", "_key")
    return done.withColumn("archive", F.expr(f"place div {PER_ARCHIVE}"))


def manifest(rows: DataFrame, order: list[str]) -> DataFrame:
    """The places of records laid one after another in their archives."""
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(PLACE)


def stored(pages: DataFrame) -> DataFrame:
    """The manifest of the archives that hold ``pages``."""
    rows = records(pages).select("page_id", "record_id", *hashed(F.col("record")))
    return manifest(placed(rows, pages.count()), ["place"])


def replicas(pages: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Manifests of the archives of ``pages`` and of a replica with injected faults.

    By a hash of the id, of 256 records four have another first byte, one lost its last four bytes, one is missing and
    one is there twice.
    """
    fate = F.conv(F.substring(F.md5(joined(seed, F.col("page_id"))), 1, 2), 16, 10).cast("int")
    record = F.col("record")
    theirs = F.when(fate < 4, F.concat(F.lit("X"), F.expr("substring(record, 2)"))).when(fate == 4, F.expr("left(record, length(record) - 4)"))
    times = F.when(fate == 5, 0).when(fate == 6, 2).otherwise(1)
    rows = records(pages).select("page_id", "record_id", *hashed(record), F.struct(*hashed(theirs)).alias("other"), times.alias("times"))
    rows = written(placed(rows, pages.count()), "records")
    copies = rows.where("times > 0").select(
        "page_id", "record_id", "archive", "place", F.coalesce("other.length", "length").alias("length"), F.coalesce("other.sha256", "sha256").alias("sha256"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
    )
    return manifest(rows, ["place"]), manifest(copies, ["place", "copy"])


# --- trees ----------------------------------------------------------------------------------

NODE = ["archive", "range"]


def leaves(places: DataFrame) -> DataFrame:
    """archive, range, hash: one row for each range of an archive in which a record begins."""
    row = F.struct("offset", "length", "sha256")
    found = places.groupBy("archive", F.expr(f"offset div {RANGE}").alias("range")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    text = F.transform("rows", lambda r: F.concat_ws(":", r["offset"], r["length"], r["sha256"]))
    return found.select(*NODE, F.sha2(F.concat(F.lit("leaf:"), F.concat_ws(",", text)), 256).alias("hash"))


def up(by: str) -> list[Column]:
    """The parent of a node: a run of ranges, or of archives."""
    return [F.expr(f"{c} div {FANOUT}").alias(c) if c == by else F.col(c) for c in NODE]


def parents(nodes: DataFrame, by: str) -> DataFrame:
    found = nodes.groupBy(*up(by)).agg(F.sort_array(F.collect_list(F.struct(by, "hash"))).alias("children"))
    text = F.transform("children", lambda c: F.concat_ws(":", c[by], c["hash"]))
    return found.select(*NODE, F.sha2(F.concat(F.lit("node:"), F.concat_ws(",", text)), 256).alias("hash"))


def tree(places: DataFrame, steps: list[str]) -> list[DataFrame]:
    """The levels from the leaves to the root, each written once."""
    out = [written(leaves(places), "merkle")]
    for by in steps:
        out.append(written(parents(out[-1], by), "merkle"))
    return out


def differing(ours: list[DataFrame], theirs: list[DataFrame], steps: list[str]) -> DataFrame:
    """archive, range of the leaves that differ or are on one side only, found from the roots down."""

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), NODE, "full_outer")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(NODE)

    suspects = differ(ours[-1], theirs[-1])
    for a, b, by in zip(ours[-2::-1], theirs[-2::-1], steps[::-1], strict=True):
        parent = [c.alias(f"_{k}") for k, c in zip(NODE, up(by), strict=True)]
        over = suspects.select(*[F.col(c).alias(f"_{c}") for c in NODE])
        some = lambda level: level.select("*", *parent).join(over, [f"_{c}" for c in NODE], "left_semi").select(*NODE, "hash")  # noqa: B023, E731
        suspects = differ(some(a), some(b))
    return suspects


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compare the replica ``theirs`` with ``ours``, two manifests (page_id, record_id, archive, offset, length, sha256).

    Gives page_id, archive, record_offset, length, sha256 of every record of ours, and of extra ones as they lie in the
    replica; status; and where and how the record was found: found_archive, found_offset (null if missing).
    """
    ours, theirs = written(ours.select(PLACE), "ours"), written(theirs.select(PLACE), "theirs")
    ends = ours.unionByName(theirs).agg(F.max(F.expr(f"offset div {RANGE}")), F.max("archive")).first()
    steps = []
    for by, top in zip(("range", "archive"), ends, strict=True):
        while top:
            steps.append(by)
            top //= FANOUT
    suspects = written(differing(tree(ours, steps), tree(theirs, steps), steps), "suspects")

    def unlike(a: DataFrame, b: DataFrame) -> DataFrame:
        here = a.withColumn("range", F.expr(f"offset div {RANGE}")).join(suspects, NODE, "left_semi").drop("range")
        return written(here.join(b.select("archive", "offset", "length", "sha256"), ["archive", "offset", "length", "sha256"], "left_anti").select(PLACE), "unlike")

    mine, other = unlike(ours, theirs), unlike(theirs, ours)

    def matched(by: str, status: Column) -> DataFrame:
        """Records of both sides with one value of ``by``, in the order of their places."""
        numbered = lambda df: ranked(df, [by], "archive", [F.col("offset")], "nth")
        found = numbered(other).select(F.col(by), "nth", *[F.col(c).alias(f"found_{c}") for c in ("archive", "offset", "length")])
        pairs = numbered(mine).join(found, [by, "nth"])
        return written(pairs.select("archive", "offset", status.alias("status"), "found_archive", "found_offset"), "matched")

    def without(df: DataFrame, found: DataFrame, archive: str, offset: str) -> DataFrame:
        return df.join(found.select(F.col(archive).alias("archive"), F.col(offset).alias("offset")), ["archive", "offset"], "left_anti")

    moved = matched("sha256", F.lit("moved"))
    mine, other = without(mine, moved, "archive", "offset"), without(other, moved, "found_archive", "found_offset")
    damaged = matched("record_id", F.when(F.col("found_length") < F.col("length"), "truncated").otherwise("corrupt"))
    none = F.lit(None).cast("long")
    lost = without(mine, damaged, "archive", "offset").select("archive", "offset", F.lit("missing").alias("status"), none.alias("found_archive"), none.alias("found_offset"))
    extra = without(other, damaged, "found_archive", "found_offset")
    findings = moved.unionByName(damaged).unionByName(lost)
    known = ours.join(findings, ["archive", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    intact = F.col("status") == "intact"
    known = known.withColumns({f"found_{c}": F.when(intact, F.col(c)).otherwise(F.col(f"found_{c}")) for c in ("archive", "offset")})
    more = extra.withColumns({"status": F.lit("extra"), "found_archive": F.col("archive"), "found_offset": F.col("offset")})
    out = known.unionByName(more.select(known.columns))
    return out.select("page_id", "archive", F.col("offset").alias("record_offset"), "length", "sha256", "status", "found_archive", "found_offset")


# --- reading --------------------------------------------------------------------------------


def members(raw: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive in pieces; gzip members are inflated one after another."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[k : k + piece] for k in range(0, len(raw), piece))
        return
    at = 0
    while at < len(raw):
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if at >= len(raw):
                raise ValueError("the last member of the archive is cut off")
            given = raw[at : at + piece]
            at += len(given)
            yield inflate.decompress(given)
        at -= len(inflate.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields in lower case, payload) of each record of an archive given in pieces."""
    buffer, at, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        if (piece := next(source, None)) is None:
            return False
        buffer.extend(piece)
        return True

    while buffer or more():
        if not buffer:
            continue
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0 or not buffer.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = end + 8 + int(fields["content-length"])
        while len(buffer) < size and more():
            pass
        if len(buffer) < size - 4:
            raise ValueError(f"the record at offset {at} is cut off")
        yield at, fields, bytes(buffer[end + 4 : size - 4])
        del buffer[:size]
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, record_offset (in the inflated archive), url, payload of all records of plain or gzip archives.

    An archive is read by one task, as gzip can't be split, and may have 2 GB at most (the limit of Spark's reader
    of binary files); it is inflated and parsed piece by piece.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        names = ["file", "record_offset", "url", "payload"]
        kinds = pa.schema([("file", pa.string()), ("record_offset", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for k in range(b.num_rows):
                name, raw = b.column("path")[k].as_py(), b.column("content")[k].as_py()
                rows, size = [], 0
                for offset, fields, payload in parse(members(raw)):
                    rows.append((name, offset, fields.get("warc-target-uri"), payload))
                    size += len(payload)
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=kinds)

    return files.mapInArrow(run, "file string, record_offset long, url string, payload binary")
