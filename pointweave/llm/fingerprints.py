"""Exact document fingerprints: a wide digest of the canonical text, with byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import arrow_map, stored

ROWS_PER_RANGE = 100_000
EDGES = 1024
LEAST_ID = -(2**63)
NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical_sha256 string, edited_canonical_sha256 string"


def canonical(text: str) -> str:
    """Compatibility composition, case folding, white-space runs as one space, trimmed."""
    if text.isascii():
        return " ".join(text.lower().split())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    folded = text.casefold()
    if not unicodedata.is_normalized("NFKC", folded):
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split())


def digest(canon: str, bits: int = 128) -> str:
    """xxh3 of the canonical text; fewer bits only to try out collisions."""
    return xxhash.xxh3_128_hexdigest(canon.encode())[: bits // 4]


def canonical_rows(docs: DataFrame, bits: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> list:
            canon = [canonical(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array([digest(c, bits) for c in canon], pa.string()), pa.array(canon, pa.string())]

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(arrow_map(make, ["doc_id", "fingerprint", "canonical"]), "doc_id long, fingerprint string, canonical string")


def collisions(docs: DataFrame, fingerprints: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints (column fingerprint) that stand for two or more different canonical texts.

    Only buckets of two or more documents are looked at, and in each the least and the greatest canonical text in
    byte order: where these are equal, all are. Both are aggregated before the shuffle, so a hot bucket costs a row a task.
    """
    repeated = stored(fingerprints.groupBy("fingerprint").count().where("count > 1").select(F.xxhash64("fingerprint").alias("bucket")).distinct(), "buckets")
    members = canonical_rows(docs, bits).withColumn("bucket", F.xxhash64("fingerprint")).join(repeated, "bucket", "left_semi")
    ends = members.groupBy("fingerprint").agg(F.min("canonical").alias("least"), F.max("canonical").alias("greatest"))
    return ends.where("least != greatest").select("fingerprint")


def fingerprint(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id and fingerprint of every whole text.

    Documents have equal fingerprints if and only if their canonical texts are the same bytes (a bucket that holds
    different texts gets their sha256 appended). Null text counts as empty. Repeated rows give repeated rows; an empty table
    gives none; further columns of docs are not read.
    """

    def make():
        def work(batch: pa.RecordBatch) -> list:
            canon = [canonical(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array([digest(c, bits) for c in canon], pa.string()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in canon], pa.string())]

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(source.mapInArrow(arrow_map(make, ["doc_id", "fingerprint", "sha256"]), "doc_id long, fingerprint string, sha256 string"), "fingerprints")
    return parted(rows, collisions(docs, rows, bits), {"fingerprint": "sha256"})


def parted(rows: DataFrame, clash: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows in which fingerprints (columns, the keys of names) that clash has get the sha256 in the column that names gives, which goes."""
    clash = stored(clash.distinct(), "clashes")
    if not clash.isEmpty():
        for column, sha256 in names.items():
            marked = rows.join(clash.select(F.col("fingerprint").alias(column), F.lit(True).alias("clash")), column, "left")
            rows = marked.withColumn(column, F.when(F.col("clash"), F.concat(column, F.lit("-"), sha256)).otherwise(F.col(column))).select(rows.columns)
    return rows.drop(*names.values())


def ranged(docs: DataFrame) -> DataFrame:
    """docs dealt into ranges of doc_id and sorted there; after a range's rows comes a copy (peek) of the next range's first.

    The order is circular: the first range follows the last. There are as many ranges as the number of rows asks for: EDGES
    at most by quantiles of the ids, cut evenly from there on. Rows of one doc_id are in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id")
    n, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    parts = min(EDGES, ranges)
    edges = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if low is not None and parts > 1 else []
    own = F.coalesce(_range_of(edges), F.lit(0)).cast("long")
    if low is not None and (cuts := -(-ranges // parts)) > 1:
        ends = F.array(*map(F.lit, [low, *edges, high + 1]))
        lo, hi = F.get(ends, own).cast("double"), F.get(ends, own + 1).cast("double")
        within = F.floor((F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * F.lit(cuts))
        own = own * F.lit(cuts) + F.coalesce(F.greatest(F.lit(0), F.least(within, F.lit(cuts - 1))), F.lit(0)).cast("long")
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    firsts = ids.groupBy(own.alias("range")).agg(F.min(key).alias("key"))
    # windows over a row for each range
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.last("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    peeks = firsts.select("key", before.alias("earlier"))
    sent = rows.withColumn("range", own).withColumn("key", key).join(F.broadcast(peeks), "key", "left")
    copies = F.array(F.struct("range", F.lit(0).alias("peek")))
    both = F.array(F.struct("range", F.lit(0).alias("peek")), F.struct(F.col("earlier").alias("range"), F.lit(1).alias("peek")))
    dealt = sent.withColumn("copy", F.explode(F.when(F.col("earlier").isNull(), copies).otherwise(both)))
    dealt = dealt.select("copy.range", "copy.peek", "doc_id", F.xxhash64("text").alias("tie"), "text")
    return dealt.repartition(max(1, ranges), "range").sortWithinPartitions("range", "peek", "doc_id", "tie")


def _range_of(edges: list[int]):
    """How many edges are at most doc_id, as nested halves: as many comparisons as the number's bits."""

    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= F.lit(edges[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(edges))


def with_next(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Every document's fingerprint, beside its edited text's and the next document's.

    The edited text's last floor(n_chars / 2) code points are the first as many of the next document in ascending doc_id
    (null first; equal ids by a hash of the text; after the last comes the first). An exact fingerprint's likeness is 1 for equal
    canonical bytes, else 0; fingerprints of edited texts are parted from those of other texts, too. Null text counts as empty. Repeated rows are documents of their own; an empty table gives no
    rows; further columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, doc_id, text, canonical text and whether it is still to be put out
        for batch in batches:
            out = []
            for rng, peek, doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                text = text or ""
                canon = canonical(text)
                if held is not None and held[0] == rng and held[4]:
                    n = len(held[2])
                    edited = held[2][: n - n // 2] + text[: n // 2]
                    edited_canon = canonical(edited)
                    out.append((held[1], n, hashlib.sha256(edited.encode()).hexdigest(), digest(held[3], bits), digest(edited_canon, bits), float(held[3] == edited_canon), float(held[3] == canon), hashlib.sha256(held[3].encode()).hexdigest(), hashlib.sha256(edited_canon.encode()).hexdigest()))
                held = (rng, doc_id, text, canon, not peek)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in NEIGHBOURS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = stored(ranged(docs).mapInArrow(run, NEIGHBOURS), "neighbours")
    texts = rows.select("fingerprint", F.col("canonical_sha256").alias("sha")).union(rows.select("edited_fingerprint", "edited_canonical_sha256"))
    edited = texts.groupBy("fingerprint").agg(F.min("sha").alias("least"), F.max("sha").alias("greatest")).where("least != greatest").select("fingerprint")
    return parted(rows, collisions(docs, rows, bits).union(edited), {"fingerprint": "canonical_sha256", "edited_fingerprint": "edited_canonical_sha256"})
