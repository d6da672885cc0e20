"""Problem 5: near-duplicate records with small edits, by a grouped prefix join.

Tokens (word runs of a text, or the features of a unit) are put in one order for all records, rare ones first. Two
sets that reach the threshold share a token among the first ``size - ceil(t * size) + 1`` of each, their prefixes.
Records collapse twice before anything is joined: equal sets into one class, and classes with the same prefix and size
into one group. Group pairs are found over the prefixes and filtered by the overlap their prefixes leave possible; only
then are they expanded to classes and verified on the whole sets.

Exact for any order of the tokens; the order decides only the cost. It comes from counts over all records in a fixed
number of buckets, so the table of counts has one size for any input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.rolling import mixed, slabs, word_shingles
from twinsift.session import Scratch

#: Count buckets, and buckets of the filter that keeps only sets some candidate needs: fixed sizes, whatever the input.
BUCKETS, NEEDED = 1 << 16, 1 << 18

#: A batch of (id, payload) as pieces: first row, then the row of each token within the piece, and the tokens, distinct.
Extract = Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]


def shingles_of(words: int) -> Extract:
    """Tokens of a text column: hashes of its runs of ``words`` words."""

    def extract(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for first, texts in slabs(batch, 1):
            yield first, len(texts), *word_shingles(texts, words)

    return extract


def values_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tokens of an array<bigint> column: its distinct non-null values."""
    column = batch.column(1)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(column)), lengths)
    flat = column.flatten()
    held = ~np.asarray(flat.is_null())
    row, value = row[held], mixed(np.asarray(flat.drop_null()).astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    yield 0, len(column), row[fresh], value[fresh]


class Bounds:
    def __init__(self, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.t = Fraction(str(threshold))

    def least(self, size: np.ndarray) -> np.ndarray:
        """``ceil(t * size)``."""
        return -((-size * self.t.numerator) // self.t.denominator)


def _histogram(records: DataFrame, extract: Extract) -> np.ndarray:
    """How many records hold a token of each bucket, over all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, token in extract(batch):
                total += np.bincount((token & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = records.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def _sketches(records: DataFrame, extract: Extract, counts: np.ndarray, bounds: Bounds) -> DataFrame:
    """``(id, gid, cid, size, prefix)``: fingerprints of prefix and whole set, and the prefix, for each non-empty set."""
    ranks = records.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = ranks.value
        for batch in batches:
            for first, n, row, token in extract(batch):
                sizes = np.bincount(row, minlength=n)
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                size = sizes[there]
                begin = np.cumsum(sizes)[there] - size
                whole = np.add.reduceat(mixed(token + np.uint64(0x632BE59B)), begin) + size.astype(np.uint64)
                order = np.lexsort((token, count[(token & np.uint64(BUCKETS - 1)).astype(np.int64)], row))
                ordered = token[order]
                length = size - bounds.least(size) + 1
                keep = np.arange(len(token)) - np.repeat(begin, size) < np.repeat(length, size)
                prefix = ordered[keep].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(length)])
                gid = [xxhash.xxh3_64_intdigest(prefix[a:b].tobytes(), seed=int(s)) for a, b, s in zip(ends[:-1], ends[1:], size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + there)), pa.array(np.array(gid, np.uint64).view(np.int64)), pa.array(mixed(whole).view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix))],
                    names=["id", "gid", "cid", "size", "prefix"],
                )

    return records.mapInArrow(run, "id bigint, gid bigint, cid bigint, size int, prefix array<bigint>")


def _needed_sets(records: DataFrame, extract: Extract, wanted: DataFrame) -> DataFrame:
    """``(cid, size, tokens)`` of the wanted classes, once each; read again from the records."""
    buckets = np.zeros(NEEDED, bool)
    for row in wanted.select(F.pmod("cid", F.lit(NEEDED)).alias("b")).distinct().collect():
        buckets[row["b"]] = True
    chosen = records.sparkSession.sparkContext.broadcast(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wants = chosen.value
        for batch in batches:
            for _, n, row, token in extract(batch):
                sizes = np.bincount(row, minlength=n)
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                size = sizes[there]
                begin = np.cumsum(sizes)[there] - size
                cid = mixed(np.add.reduceat(mixed(token + np.uint64(0x632BE59B)), begin) + size.astype(np.uint64)).view(np.int64)
                hit = wants[np.mod(cid, NEEDED)]
                if not hit.any():
                    continue
                keep = np.repeat(hit, size)
                ends = np.concatenate([[0], np.cumsum(size[hit])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[hit]), pa.array(size[hit].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[keep].view(np.int64)))],
                    names=["cid", "size", "tokens"],
                )

    sets = records.mapInArrow(run, "cid bigint, size int, tokens array<bigint>")
    return sets.join(wanted, ["cid", "size"], "left_semi").groupBy("cid", "size").agg(F.first("tokens").alias("tokens"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("ta"), batch.column("tb")
        at, bt = np.asarray(a.flatten()), np.asarray(b.flatten())
        ae, be = np.concatenate([[0], np.cumsum(np.asarray(a.value_lengths()))]), np.concatenate([[0], np.cumsum(np.asarray(b.value_lengths()))])
        n = [len(np.intersect1d(at[ae[i] : ae[i + 1]], bt[be[i] : be[i + 1]], assume_unique=True)) for i in range(len(a))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ca", "na", "cb", "nb")), pa.array(n, pa.int32())], names=["ca", "na", "cb", "nb", "overlap"])


def grouped_prefix_join(records: DataFrame, extract: Extract, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``members(id, cid, size)`` and ``links(ca, na, cb, nb, overlap, similarity)`` over ``records(id, payload)``.

    Records with equal sets are members of one class, ``(cid, size)``; each pair of different classes that reaches the
    threshold is a link. Records without tokens have no row.
    """
    bounds = Bounds(threshold)
    t = bounds.t
    num, den = t.numerator, t.denominator
    scratch = Scratch(records.sparkSession, "prefixjoin")
    sketch = scratch.cut(_sketches(records, extract, _histogram(records, extract), bounds), "sketch")
    members = scratch.cut(sketch.select("id", "cid", "size").distinct(), "members")

    groups = sketch.groupBy("gid", "size").agg(F.first("prefix").alias("prefix"))
    tokens = groups.select("gid", "size", F.explode("prefix").alias("token"))
    other = tokens.select(F.col("gid").alias("gid2"), F.col("size").alias("size2"), "token")
    # the smaller set first; of equal sizes, the smaller gid
    later = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("gid") < F.col("gid2")))
    comparable = F.col("size").cast("bigint") * den >= F.col("size2").cast("bigint") * num
    need = F.ceil((F.col("size") + F.col("size2")) * num / (num + den) - F.lit(1e-9))
    beyond = F.ceil(F.col("size2") * num / den - F.lit(1e-9)) - 1  # tokens of the larger set outside its prefix
    pairs = (
        tokens.join(other, "token")
        .where(later & comparable)
        .groupBy("gid", "size", "gid2", "size2")
        .agg(F.count("*").alias("met"))
        .where(F.col("met") + beyond >= need)
        .select("gid", "size", "gid2", "size2")
    )
    classes = sketch.select("gid", "cid", "size").distinct()
    left = classes.select("gid", "size", F.col("cid").alias("ca"))
    right = classes.select(F.col("gid").alias("gid2"), F.col("size").alias("size2"), F.col("cid").alias("cb"))
    across = pairs.join(left, ["gid", "size"]).join(right, ["gid2", "size2"]).select("ca", F.col("size").alias("na"), "cb", F.col("size2").alias("nb"))
    within = left.join(right, (F.col("gid") == F.col("gid2")) & (F.col("size") == F.col("size2")) & (F.col("ca") < F.col("cb")))
    candidates = scratch.cut(across.unionByName(within.select("ca", F.col("size").alias("na"), "cb", F.col("size2").alias("nb"))), "candidates")
    scratch.drop(sketch)

    wanted = candidates.select(F.explode(F.array(F.struct(F.col("ca").alias("cid"), F.col("na").alias("size")), F.struct(F.col("cb").alias("cid"), F.col("nb").alias("size")))).alias("w")).select("w.*").distinct()
    sets = scratch.cut(_needed_sets(records, extract, wanted), "sets")
    a = sets.select(F.col("cid").alias("ca"), F.col("size").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("cid").alias("cb"), F.col("size").alias("nb"), F.col("tokens").alias("tb"))
    counted = candidates.join(a, ["ca", "na"]).join(b, ["cb", "nb"]).select("ca", "na", "ta", "cb", "nb", "tb")
    counted = counted.mapInArrow(_overlaps, "ca bigint, na int, cb bigint, nb int, overlap int")
    either = F.col("na") + F.col("nb") - F.col("overlap")
    links = counted.where(F.col("overlap").cast("bigint") * den >= either.cast("bigint") * num).withColumn("similarity", F.col("overlap") / either)
    links = scratch.cut(links, "links")
    scratch.drop(sets)
    scratch.drop(candidates)
    return members, links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of ids ``(a, b, similarity)``, ``a < b``: those of one class, and those over each link."""
    left = members.select(F.col("id").alias("a"), F.col("cid").alias("ca"), F.col("size").alias("na"))
    right = members.select(F.col("id").alias("b"), F.col("cid").alias("cb"), F.col("size").alias("nb"))
    same = left.join(right, (F.col("ca") == F.col("cb")) & (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("similarity"))
    over = links.join(left, ["ca", "na"]).join(right, ["cb", "nb"]).where(F.col("a") != F.col("b"))
    over = over.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return same.unionByName(over)


def file_records(source_files: DataFrame) -> DataFrame:
    return source_files.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select(F.col("file_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("payload"))


def unit_records(units: DataFrame) -> DataFrame:
    return units.where(F.col("unit_id").isNotNull() & (F.size("features") > 0)).select(F.col("unit_id").cast("bigint").alias("id"), F.col("features").cast("array<bigint>").alias("payload"))


def near_files(source_files: DataFrame, threshold: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    return grouped_prefix_join(file_records(source_files), shingles_of(words), threshold)


def near_units(units: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    return grouped_prefix_join(unit_records(units), values_of, threshold)


def found_pairs(source_files: DataFrame, units: DataFrame) -> DataFrame:
    """``(rec, a, b, similarity)``: pairs of files (runs of three words, 0.7) and of units (features, 0.8), ``a < b``.

    Defined cases: null or empty texts and features, texts without a run, null ids and null elements take no part;
    repeated rows of an id count once; texts are compared whole; equal records are pairs of similarity 1; empty tables
    give no rows; extra columns are ignored.
    """
    files = expand(*near_files(source_files, 0.7, 3)).select(F.lit("file").alias("rec"), "a", "b", "similarity")
    return files.unionByName(expand(*near_units(units, 0.8)).select(F.lit("unit").alias("rec"), "a", "b", "similarity"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class_id, links)``: a record's class as its smallest record, and how many other classes that is near to."""
    ends = F.array(F.struct(F.col("ca").alias("cid"), F.col("na").alias("size")), F.struct(F.col("cb").alias("cid"), F.col("nb").alias("size")))
    degree = links.select(F.explode(ends).alias("e")).select("e.*").groupBy("cid", "size").agg(F.count("*").alias("links"))
    named = members.groupBy("cid", "size").agg(F.min("id").alias("class_id")).join(degree, ["cid", "size"], "left")
    return members.join(named, ["cid", "size"]).select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
