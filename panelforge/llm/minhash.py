"""MinHash fingerprints: universal hash permutations in numpy, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import broadcast_few, connected_components, keep_first, partitions, through_table
from .text import LOWER, SOLID, encoded, hash_spans, join_texts, splitmix, words

PERMUTATIONS, SHINGLE = 128, 5
#: Bands of rows: at a Jaccard of 0.8 a pair misses every band with probability (1 - 0.8^4)^32 < 1e-7.
BANDS, ROWS = 32, 4
_A = splitmix(np.arange(PERMUTATIONS) + (1 << 32)) | np.uint64(1)
_B = splitmix(np.arange(PERMUTATIONS) + (1 << 33))
#: The signature of no shingles.
EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit number for each word shingle of all texts, and where each text's begin (with the total).

    Words are split at white space, ASCII lower-cased; a text of fewer words is one shingle, one of none has none.
    """
    data, bounds = join_texts(texts)
    data = LOWER[data]
    starts, ends = words(data, SOLID)
    hashes = hash_spans(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)
    left = np.repeat(first[1:], made) - at
    mixed = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            here = np.where(left > i, hashes[np.minimum(at + i, len(hashes) - 1)], 0) if len(hashes) else mixed
            mixed = splitmix(mixed ^ here)
    return (mixed >> np.uint64(32)).astype(np.uint32), begin


def signatures(marks: np.ndarray, begin: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """One row of PERMUTATIONS 16-bit numbers for each text: the least of (a x + b) >> 32, by its low bits."""
    out = np.empty((len(begin) - 1, PERMUTATIONS), np.uint64)
    out[:] = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.flatnonzero(np.diff(begin))
    for lo in range(0, len(marks), step):  # pieces that stay in cache
        x = marks[lo : lo + step].astype(np.uint64)
        a, b = np.searchsorted(begin[full], lo, "right") - 1, np.searchsorted(begin[full], lo + len(x), "left")
        rows = full[a:b]
        cuts = np.maximum(begin[rows] - lo, 0)
        for p in range(PERMUTATIONS):
            least = np.minimum.reduceat(x * _A[p] + _B[p], cuts)
            out[rows, p] = np.minimum(out[rows, p], least)
    small = ((out >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    small[np.diff(begin) == 0] = EMPTY
    return small


def sign(texts: list[str | None]) -> np.ndarray:
    return signatures(*shingles(encoded(texts)))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of permutations on which two signatures agree: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=-1)


def groups(texts: list, most: int = 4_000_000):
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signature, text_hash) for each row; signature: 2 bytes a permutation. A null text is empty."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                rows = sign(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())], ["doc_id", "signature"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, signature binary")


#: Buckets of more classes are cut by further bands before their members are compared with each other.
SMALL = 64


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row for each row of docs: doc_id, th (a hash of the text), key (one of its shingle set), class_id (the smallest
    doc_id of its near-duplicate component), n_links.

    Rows with equal shingle sets are one class before anything is joined. Classes that share a band are compared: the
    share of equal permutations must come within four standard errors of the threshold, then the exact Jaccard of the
    shingle sets decides. Every class is compared with the first one of its bucket; those that fail are compared with all
    of the bucket if it has at most `small` classes. A larger bucket is cut by a second band, and one that is still larger
    by a third: near classes share about 13 of 32 bands (fewer than three in one case of 10^4 at a Jaccard of 0.8).
    n_links counts the classes found near. Null texts have no shingles and are alike; null ids keep their rows, and a
    class without an id has a null class_id; repeated rows are copies; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = through_table(rows.mapInArrow(signer(False), f"doc_id {dict(rows.dtypes)['doc_id']}, th long, key long, signature binary"), "minhash")
    classes = through_table(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("signature").alias("signature")), "minhash-classes")
    bands = f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {2 * ROWS} + 1, {2 * ROWS})))"
    keys = classes.repartition(partitions(classes), "key").select("key", F.explode(F.expr(bands)).alias("bucket"))
    heads = through_table(keys.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1"), "minhash-buckets")
    met = through_table(keys.join(broadcast_few(heads), "bucket"), "minhash-met")
    # the sets of classes that meet any other, from one of their texts
    wanted = through_table(met.select("key").distinct().join(classes.select("key", "th"), "key").select("th"), "minhash-wanted")
    some = rows.join(broadcast_few(wanted), "th", "left_semi").dropDuplicates(["th"])
    sets = through_table(some.mapInArrow(signer(True), f"doc_id {dict(rows.dtypes)['doc_id']}, th long, key long, signature binary, marks binary").drop("doc_id", "th"), "minhash-sets")
    links = [through_table(verified(met.where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct(), sets, threshold), "minhash-stars")]
    far = met.where("key != head").join(links[0].select(F.col("a").alias("head"), F.col("b").alias("key")), ["head", "key"], "left_anti")
    member = met.join(far.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "key")
    left = through_table(member.join(far.select("bucket", "key", F.lit(True).alias("far")), ["bucket", "key"], "left").select("bucket", "key", F.coalesce("far", F.lit(False)).alias("far")), "minhash-far")
    for last in (False, False, True):
        sized = left.join(left.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        now = sized if last else sized.where(F.col("n") <= small)
        pairs = now.where("far").select("bucket", F.col("key").alias("a")).join(now.select("bucket", F.col("key").alias("b")), "bucket").where("a != b")
        links.append(through_table(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, threshold), "minhash-links"))
        if last:
            break
        more = sized.where(F.col("n") > small).join(keys.withColumnRenamed("bucket", "band"), "key").where("band != bucket").select(F.xxhash64("bucket", "band").alias("bucket"), "key", "far")
        more = through_table(more.groupBy("bucket", "key").agg(F.max("far").alias("far")), "minhash-cut")
        left = more.join(more.groupBy("bucket").agg(F.count("*").alias("n"), F.max("far").alias("any")).where("n > 1 and any").select("bucket"), "bucket", "left_semi")
        if left.isEmpty():
            break
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    found = through_table(found.distinct(), "minhash-all")
    roots = connected_components(found)
    named = roots.join(classes.select(F.col("key").alias("vertex"), "least"), "vertex")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select(F.col("vertex").alias("key"), "class_id", F.col("root"))
    degree = found.select(F.col("a").alias("key")).union(found.select("b")).groupBy("key").agg(F.count("*").alias("n_links"))
    labels = classes.select("key", "least").join(named, "key", "left").join(degree, "key", "left")
    labels = through_table(labels.select("key", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "minhash-labels")
    return signed.select("doc_id", "th", "key").join(labels, "key").select("doc_id", "th", F.col("root").alias("key"), "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest id, as cluster.keep_first has it."""
    found = near_duplicates(docs, threshold, id_col, text_col)
    return keep_first(docs, through_table(found.select("doc_id", "th", F.col("key").alias("c"), F.lit(0).alias("f")), "minhash-found"), id_col, text_col)


def signer(sets: bool):
    """(doc_id, th, text) to (doc_id, th, key, signature), with the sorted shingle numbers if sets."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts, 1_000_000):
                marks, begin = shingles(encoded(texts[a:b]))
                held = [np.unique(marks[x:y]).astype("<u4").tobytes() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
                rows = [r.astype("<u2").tobytes() for r in signatures(marks, begin)]
                keys = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in held]
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.binary())] if sets else columns, ["doc_id", "th", "key", "signature", "marks"][: 4 + sets])

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class keys whose shingle sets have a Jaccard similarity of at least threshold."""
    left = sets.select(F.col("key").alias("a"), F.col("signature").alias("sa"), F.col("marks").alias("ma"))
    right = sets.select(F.col("key").alias("b"), F.col("signature").alias("sb"), F.col("marks").alias("mb"))
    slack = 4 * (threshold * (1 - threshold) / PERMUTATIONS) ** 0.5

    def run(batches):
        for batch in batches:
            keep = []
            for sa, sb, ma, mb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                near = (np.frombuffer(sa, "<u2") == np.frombuffer(sb, "<u2")).mean() >= threshold - slack
                if near:
                    x, y = np.frombuffer(ma, "<u4"), np.frombuffer(mb, "<u4")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near = both >= threshold * (len(x) + len(y) - both)
                keep.append(bool(near))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "ma", "mb")
    return met.mapInArrow(run, "a long, b long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, doc_id, text, extra) dealt by ranges of ids and sorted, each range closed by the row that follows it.

    The cuts between ranges are the only thing the driver sees: at most one id for each shuffle partition. The extra
    rows are copies of the first row of the next filled range (of the first one, for the last).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [c for c in (rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or [] if n > 1 else [])]
    cuts = sorted(set(cuts))
    bucket = F.expr(f"aggregate(array({','.join(f'{c}L' for c in cuts)}), 0, (s, c) -> s + IF(doc_id > c, 1, 0))") if cuts else F.lit(0)
    dealt = rows.select(F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).alias("bucket"), "doc_id", "text")
    heads = dealt.groupBy("bucket").agg(F.min("doc_id").alias("least")).orderBy("bucket").collect()  # a row for each range
    marks, least = [r.bucket for r in heads], [r.least for r in heads if r.least is not None]
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.col("text").isNotNull().alias("some"), "text"))
    firsts = dealt.where(F.col("doc_id").isin(least) | F.col("doc_id").isNull()).groupBy("bucket").agg(first.alias("first"))
    before = {b: marks[i - 1] for i, b in enumerate(marks)}
    if not marks:
        return dealt.withColumn("extra", F.lit(0))
    to = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("bucket"))
    extra = firsts.select(to.alias("bucket"), F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.lit(1).alias("extra"))
    both = dealt.withColumn("extra", F.lit(0)).unionByName(extra)
    return both.repartitionByRange(max(n, len(marks)), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter of its code points (rounded down) replaced by
    as many of the first ones of the next document in ascending id order (or all it has); the first follows the last.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (shares of equal
    permutations). A null text is empty; null ids come first; rows with equal ids are in the order of their texts; a
    table of one row follows itself; an empty table gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def signed(held):
        """held: rows that follow each other, (bucket, id, text, extra); a result for each that isn't extra."""
        rows = sign([r[2] for r in held])
        out, edited = [], []
        for r, after in zip(held, held[1:]):
            if not r[3]:
                text, quarter = r[2] or "", len(r[2] or "") // 4
                edited.append(text[: len(text) - quarter] + (after[2] or "")[:quarter])
        changed = sign(edited)
        k = 0
        for i, r in enumerate(held[:-1]):
            if not r[3]:
                out.append((r[1], len(r[2] or ""), hashlib.sha256(edited[k].encode()).hexdigest(), rows[i].astype(">u2").tobytes().hex(), changed[k].astype(">u2").tobytes().hex(), float(likeness(rows[i], changed[k])), float(likeness(rows[i], rows[i + 1]))))
                k += 1
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(r)
                size += len(r[2] or "")
                if size > 4_000_000:
                    yield signed(held)
                    held, size = held[-1:], len(r[2] or "")
        if held:
            yield signed(held)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
