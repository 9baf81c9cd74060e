"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most two bits exactly if their radius-1 balls meet. Every distinct
fingerprint therefore emits its 65 variants within one bit; the variants are shuffled, and fingerprints that
share one are linked after a check of their distance. All members of one bucket lie within one bit of its
variant, so within two bits of each other: linking neighbours in the bucket's order (a path, not all pairs)
keeps every component, and a bucket never holds more than 65 distinct fingerprints however many copies exist.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows stay as
they are; rows without doc_id get a fingerprint and their group's component_id (null if the group has no id). In
`keep_first` a row is named by its doc_id and a hash of its text, so a doc_id with several texts is several documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, cut

SHINGLE, SEED, CHUNK = 3, 42, 65_536
BROADCAST_ROWS = 1_000_000  # dropped rows, of two longs each, that may be sent to every executor


def fingerprint(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of a text's word shingles, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not words:
        return 0
    if len(words) < n:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    total, ones, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while len(h := np.fromiter((digest(g, seed) for g in islice(grams, CHUNK)), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, n, seed) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int64())], ["doc_id", "text_key", "fp"])

    return run


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp) of every row; text_key is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints(n, seed), "doc_id long, text_key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints within two bits that keep every component; fps: distinct `fp`."""
    flips = F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")
    balls = fps.select("fp", F.explode(flips).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        balls.withColumn("v", before)
        .where("v is not null")
        .select(F.col("fp").alias("u"), "v")
        .distinct()
        .where("bit_count(u ^ v) <= 2")
    )


def _roots(fps: DataFrame) -> DataFrame:
    """fps (with a distinct `fp`) and the root fingerprint of each one's component."""
    roots = connected_components(links(fps.select("fp")))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    rows = cut(fingerprints(docs, n, seed))
    grouped = _roots(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, n: int = SHINGLE, seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without near copies: of each component the row with the smallest (doc_id, text_key) stays, once.

    Rows that go are named by doc_id and text_key, never by doc_id alone, so another text of the same doc_id stays.
    Of rows that repeat both, the one whose other columns hash lowest stays. Rows without doc_id cannot be named, and
    stay. Up to `broadcast_rows` names are sent to the executors, so no text is shuffled but those of repeated rows;
    with more names the last join shuffles the texts once.
    """
    rows = cut(fingerprints(docs, n, seed).where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.min("fp").alias("fp"), F.count("*").alias("times")))
    grouped = _roots(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("own")))
    of = grouped.join(grouped.groupBy("root").agg(F.min("own").alias("head")), "root").select("fp", "head")
    goes = F.col("head") != F.struct("doc_id", "text_key")
    named = rows.join(of, "fp").where(goes | (F.col("times") > 1))
    named = cut(named.select(F.col("doc_id").alias("sim_id"), F.col("text_key").alias("sim_key"), goes.alias("sim_goes")))
    few = named.limit(broadcast_rows + 1).count() <= broadcast_rows
    row = (docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")))

    def only(names: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(names) if few else names
        return docs.join(right, (row[0] == right["sim_id"]) & (row[1] == right["sim_key"]), how)

    kept, repeated = only(named, "left_anti"), named.where("not sim_goes")
    if repeated.isEmpty():
        return kept
    rank = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    once = only(repeated, "left_semi").groupBy(F.col("doc_id").cast("long").alias("sim_id"), _text_key().alias("sim_key"))
    return kept.unionByName(once.agg(F.min_by(F.struct("*"), rank).alias("sim_row")).select("sim_row.*"))
