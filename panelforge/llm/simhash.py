"""SimHash near-duplicates by one-wildcard segment variants."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import connected_components, keep_first, partitions, through_table
from .text import parts, release

#: A bucket of more fingerprints than this is linked by two-wildcard keys, which is exact and linear, not by pairs.
BUCKET = 1024
SHINGLE = 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of word shingles, ASCII lower-cased; signed. No words: 0."""
    # bytes.split() splits at exactly \x20 and \x09-\x0D, and bytes.lower() changes A-Z only
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) for each row of docs; th is a hash of the text. A null text has no words, so its fingerprint is 0."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def run(batches):
        release()
        for batch in (part for batch in batches for part in parts(batch)):
            fps = [fingerprint(b"" if t is None else t.encode(), shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those at two or fewer differing bits.

    A fingerprint is cut into two halves. If two differ in at most two bits, one half differs in at most one. So each
    half is indexed whole (slot 64 + half) and with each of its bits as the wildcard (slot = the bit's number, the bit
    cleared). A wildcard key joins the fingerprints that have the bit with those that don't; a whole-half key joins its
    own. Each pair is verified. The edges hold every pair whose bucket has at most `bucket` fingerprints. In a larger
    bucket, members are keyed once more: two wildcards in the other half under a whole half, one under a wildcard. The
    members of such a key are all within two bits, four at most, and go to the smallest: the same components, in
    linear time, and no pair of the bucket is enumerated.
    """
    half = "CASE WHEN {s} = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    slots = F.expr("concat(transform(sequence(0, 63), i -> struct(i AS slot, CAST(i / 32 AS INT) AS s)), array(struct(64 AS slot, 0 AS s), struct(65 AS slot, 1 AS s)))")
    # fingerprints are few bytes: a small table would be keyed by as few tasks as it has files
    spread = fps.repartition(partitions(fps), "fp")
    keyed = spread.select("fp", F.explode(slots).alias("k")).select("fp", F.col("k.slot").alias("slot"), F.col("k.s").alias("s"))
    keyed = keyed.select(
        "fp", "slot",
        F.expr("CASE WHEN slot < 64 THEN " + half.format(s="s") + " & ~shiftleft(1L, slot % 32) ELSE " + half.format(s="s") + " END").alias("part"),
        F.expr("CASE WHEN slot < 64 THEN CAST(shiftrightunsigned(fp, slot) & 1L AS INT) ELSE 2 END").alias("side"),
    )
    sizes = keyed.groupBy("slot", "part").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("n > 1 and (lo = 2 or lo != hi)")
    # buckets with someone to meet: far fewer than the keys
    sizes = through_table(sizes.select("slot", "part", "n"), "simhash-buckets")
    met = through_table(keyed.join(sizes, ["slot", "part"]), "simhash-met")
    small, large = met.where(F.col("n") <= bucket), met.where(F.col("n") > bucket)
    near = F.expr("bit_count(a ^ b) <= 2")
    zero = small.where("side = 0").select("slot", "part", F.col("fp").alias("a"))
    one = small.where("side = 1").select("slot", "part", F.col("fp").alias("b"))
    pairs = zero.join(one, ["slot", "part"]).where(near).select("a", "b")
    whole = small.where("side = 2").select("slot", "part", F.col("fp").alias("a"))
    other = whole.withColumnRenamed("a", "b")
    pairs = pairs.union(whole.join(other, ["slot", "part"]).where("a < b").where(near).select("a", "b"))
    rest = large.withColumn("other", F.expr("CASE WHEN (slot < 64 AND slot < 32) OR slot = 64 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"))
    single = rest.where("slot < 64").select("fp", "slot", "part", F.expr("explode(transform(sequence(0, 31), i -> struct(i AS i, other & ~shiftleft(1L, i) AS rest)))").alias("w"))
    twice = rest.where("slot >= 64").select("fp", "slot", "part", F.expr("explode(flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> struct(i * 32 + j AS i, other & ~shiftleft(1L, i) & ~shiftleft(1L, j) AS rest)))))").alias("w"))
    tight = single.union(twice).groupBy("slot", "part", "w").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    stars = tight.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, th (a hash of the text), fp, component_id (the smallest doc_id reachable over links).

    Nulls: a null text has fingerprint 0, which is linked like any other; a row with a null id keeps it, and takes
    part in links, but can't name a component unless no row of the component has an id. Repeated rows and ties share a
    fingerprint and so a component. An empty table gives an empty result. Other columns of docs are not read.
    """
    fps = through_table(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = through_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = through_table(connected_components(links(distinct.select("fp"), bucket)), "simhash-roots")
    named = roots.join(distinct, F.col("vertex") == F.col("fp")).groupBy("root").agg(F.min("least").alias("best"))
    linked = roots.join(named, "root").select(F.col("vertex").alias("fp"), "best")
    labels = through_table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("best", "least").alias("component_id")), "simhash-labels")
    return fps.join(labels, "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest id (rows without one come last,
    and equal ids are in the order of a hash of their texts); of rows that repeat an id and a text, one."""
    found = near_duplicates(docs, id_col, text_col, shingle=shingle)
    # a component has one name, or none if no row of it has an id: then its fingerprints' rows stand for themselves
    named = found.select("doc_id", "th", F.col("component_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("f"))
    return keep_first(docs, through_table(named, "simhash-found"), id_col, text_col)
