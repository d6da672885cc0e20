"""Reachability and what it leaves behind: live files, used exports, dead files and exports, mentions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.scalar import GENERIC_NAMES
from twinsift.session import Scratch


def reachable(edges: DataFrame, entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id)`` of everything that the entries lead to over ``edges(src, dst)``, the entries included.

    Semi-naive: each round joins only the nodes found last with the edges, so every edge is followed once. Cycles are
    fine; entries outside ``nodes`` are ignored.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    start = entries.select("id").distinct()
    if nodes is not None:
        start = start.join(nodes.select("id"), "id", "left_semi")
    arcs = scratch.cut(edges.where("src <> dst").select("src", "dst").distinct(), "arcs")
    fresh = scratch.cut(start, "found")
    found, rounds = fresh, 0
    while not fresh.isEmpty():
        rounds += 1
        ahead = fresh.join(arcs, fresh.id == arcs.src).select(F.col("dst").alias("id")).distinct()
        fresh = scratch.cut(ahead.join(found, "id", "left_anti"), "found")
        found = found.unionByName(fresh)
        if rounds % 8 == 0:  # keeps the plan of a deep graph small
            found = scratch.cut(found, "all")
    return found


def used_exports(edges: DataFrame, exports: DataFrame, live: DataFrame) -> DataFrame:
    """``(path, name)`` of exports that a live file imports; ``*`` stands for every export of its target.

    ``edges(src, dst, names array)``, ``exports(path, name)``, ``live(id)``. What a dead file imports does not count.
    """
    named = edges.join(live.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("path"), F.explode("names").alias("name")).distinct()
    every = exports.join(named.where("name = '*'").select("path"), "path", "left_semi").select("path", "name")
    return named.where("name <> '*'").unionByName(every).distinct()


def dead_nodes(nodes: DataFrame, live: DataFrame) -> DataFrame:
    return nodes.join(live.select("id"), "id", "left_anti")


def dead_exports(exports: DataFrame, used: DataFrame, live: DataFrame, entries: DataFrame, own_uses: DataFrame) -> DataFrame:
    """Exports ``(path, name, line)`` of live files that are no entries, which nothing live uses.

    A name that its own file uses elsewhere (``own_uses(path, name, n)`` above one) is not dead; ``default`` has no
    such use.
    """
    kept = exports.join(live.select(F.col("id").alias("path")), "path", "left_semi").join(entries.select(F.col("id").alias("path")), "path", "left_anti")
    unused = kept.join(used, ["path", "name"], "left_anti")
    return unused.join(own_uses, ["path", "name"], "left").where((F.col("name") == "default") | (F.coalesce("n", F.lit(0)) <= 1)).select("path", "name", "line")


#: Entries of the filter over needles' grams: a fixed size, whatever the needles.
FILTER = 1 << 20


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (FILTER - 1)


def _held_grams(texts: DataFrame, least: int, wanted: np.ndarray) -> DataFrame:
    """``(tid, gram)``: the distinct runs of ``least`` characters of each text that pass the filter, in one pass over it."""
    chosen = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = chosen.value
        for batch in batches:
            tids, grams = [], []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py()
                kept = [g for g in {body[i : i + least] for i in range(len(body) - least + 1)} if bits[_bucket(g)]]
                tids += [tid] * len(kept)
                grams += kept
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(grams, pa.string())], names=["tid", "gram"])

    return texts.select("tid", "text").mapInArrow(run, "tid bigint, gram string")


def mentions(needles: DataFrame, texts: DataFrame, least: int = 4) -> DataFrame:
    """``(id, needle, path)``: the first text of another file that holds a needle.

    ``needles(id, needle, exclude)``, ``texts(path, ord, text)``. Needles of fewer than ``least`` characters and generic
    names never count alone. Each needle is looked up by the one of its runs of ``least`` characters that the fewest texts
    hold, counted over all texts; one with a run that no text holds is nowhere. So a common beginning is no hot key, and
    no text is held against every needle.
    """
    scratch = Scratch(needles.sparkSession, "mentions")
    fit = needles.where((F.length("needle") >= least) & ~F.col("needle").isin(*GENERIC_NAMES))
    starts = F.sequence(F.lit(1), F.length("needle") - least + 1)
    own = fit.select("needle").distinct().select("needle", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("needle", i, F.lit(least))))).alias("gram"))
    own = scratch.cut(own, "needles")
    wanted = np.zeros(FILTER, bool)
    for row in own.select(F.crc32(F.encode("gram", "UTF-8")).bitwiseAND(F.lit(FILTER - 1)).alias("b")).distinct().collect():  # at most FILTER rows
        wanted[row["b"]] = True
    kept = texts.select(F.xxhash64("path", "ord", "text").alias("tid"), "path", "ord", "text").where(F.length("text") >= least)
    held = scratch.cut(_held_grams(kept, least, wanted), "grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rare = own.join(counts, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    near = fit.join(rare, "needle").join(held, "gram").select("id", "needle", "exclude", "tid")
    hit = near.join(kept, "tid").where((F.col("path") != F.col("exclude")) & F.contains("text", F.col("needle")))
    return hit.groupBy("id", "needle").agg(F.min_by("path", F.struct("ord", "path")).alias("path"))
