"""Verbatim token runs that occur more than once: content-defined anchors, an equi-join, and maximal extension.

Every run of at least ``min_tokens`` tokens holds an anchor, the minimal hash of a neighbourhood, in both of its places.
The few occurrences of a rare anchor are all compared with one another. An anchor of ``CROWDED`` occurrences or more is
replaced by the whole windows of ``min_tokens`` tokens around it, at the places where a run can start (the tokens in
front differ, or a file begins); the occurrences of a window are sorted by the tokens that follow it and each is compared
with its neighbour before it. In that order all neighbours between two places share at least what these share, so
whatever two places have in common is reported whole, from each of them, in a chain of pairs: not all pairs, but no run
and no part of a run is lost. Files of equal tokens on equal lines are compared once and paired with their first.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.scalar import glob_unsafe
from twinsift.session import Scratch

_token = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|<!--.*?-->|[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]", re.S)
#: A matcher takes files and settings and returns pairs; another one can be put in its place.
Matcher = Callable[[DataFrame, int, int], DataFrame]
#: Occurrences from which an anchor's places are told apart by the windows around it.
CROWDED = 4


class MatcherError(ValueError):
    """A matcher's answer that does not fit the audit."""


def tokenize(text: str) -> tuple[list[int], list[int]]:
    """Hashes of the tokens that are neither white space nor comments, and the line of each."""
    hashes, lines, line = [], [], 1
    for m in _token.finditer(text):
        t = m.group()
        if not (t[0].isspace() or t.startswith(("//", "/*", "<!--"))):
            hashes.append(zlib.crc32(t.encode("utf-8", "surrogatepass")))
            lines.append(line)
        line += t.count("\n")
    return hashes, lines


def _gram_hashes(hashes: list[int], gram: int) -> list[int]:
    mask, base = (1 << 61) - 1, 1_000_003
    top = pow(base, gram - 1, mask)
    value, grams = 0, []
    for i, h in enumerate(hashes):
        if i >= gram:
            value = (value - hashes[i - gram] * top) % mask
        value = (value * base + h) % mask
        if i >= gram - 1:
            grams.append((value * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF)
    return grams


def anchors(hashes: list[int], min_tokens: int) -> list[tuple[int, int, int, int]]:
    """``(position, hash, first, last)`` of the leftmost minimal gram of every window of ``min_tokens``, and the windows' starts."""
    gram = max(1, min_tokens // 2)
    count = len(hashes) - gram + 1
    width = min_tokens - gram + 1
    if count < width:
        return []
    grams = _gram_hashes(hashes, gram)
    out: list[tuple[int, int, int, int]] = []
    window: deque[int] = deque()
    for i, g in enumerate(grams):
        while window and grams[window[-1]] > g:
            window.pop()
        window.append(i)
        if window[0] <= i - width:
            window.popleft()
        if i >= width - 1:
            start = i - width + 1
            first = out.pop()[2] if out and out[-1][0] == window[0] else start
            out.append((window[0], grams[window[0]], first, start))
    return out


def _common(a: bytes, b: bytes) -> int:
    """How many tokens of four bytes two contexts share from their beginning."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[4 * low : 4 * mid] == b[4 * low : 4 * mid] else (low, mid - 1)
    return low


def _linked(rows: Iterator[tuple[int, str, int, int, bytes]], min_tokens: int) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of places, for ``(key, path, pos, need, rest)`` sorted by key and rest.

    A place takes part in runs of at least ``need`` tokens (those on enough lines), so it is linked with the nearest
    place before it that may take part too, and on to those before with a smaller need. Only places whose need no later
    place undercuts are kept. Where a place overlaps the one before it in its file, that one's partner stands in.
    """
    now, last, kept = None, b"", []
    for key, path, pos, need, rest in rows:
        if key != now:
            now, kept = key, []
        elif kept:
            kept[-1][3] = min(kept[-1][3], min_tokens + _common(last, rest))
        shared, least, partner = 1 << 60, 1 << 60, None
        for place in reversed(kept):
            shared = min(shared, place[3])
            if shared < need:
                break
            if place[2] > shared or place[2] >= least:
                continue
            least, other = place[2], place[:2]
            if other[0] == path and abs(other[1] - pos) < shared:
                yield *other, path, pos
                other = place[4]
            if other is not None:
                partner = partner or other
                yield *other, path, pos
        reach = 1 << 60
        while kept and kept[-1][2] >= need:
            reach = min(reach, kept.pop()[3])
        if kept:
            kept[-1][3] = min(kept[-1][3], reach)
        kept.append([path, pos, need, 1 << 60, partner])
        last = rest


def _longest(a: list[int], b: list[int], i: int, j: int, same: bool) -> tuple[int, int, int]:
    """The maximal common run through ``a[i]`` and ``b[j]``; within one file the two places do not overlap."""
    x, y = i, j
    while x > 0 and y > 0 and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    length = 0
    while x + length < len(a) and y + length < len(b) and a[x + length] == b[y + length]:
        length += 1
    return x, y, min(length, abs(y - x)) if same else length


def match_tokens(files: DataFrame, min_tokens: int = 60, min_lines: int = 5) -> DataFrame:
    """``(path_a, start_a, end_a, path_b, start_b, end_b, tokens)`` for ``files(path, text)``; side a comes first."""
    scratch = Scratch(files.sparkSession, "tokens")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [tokenize(t or "") for t in batch["text"]]
            yield pd.DataFrame({"path": batch["path"], "hashes": [d[0] for d in done], "lines": [d[1] for d in done], "spots": [[{"pos": p, "key": h, "first": a, "last": b} for p, h, a, b in anchors(d[0], min_tokens)] for d in done]})

    schema = "path string, hashes array<bigint>, lines array<int>, spots array<struct<pos:int,key:bigint,first:int,last:int>>"
    all_files = scratch.cut(files.select("path", "text").mapInPandas(read, schema).withColumn("digest", F.sha2(F.concat_ws(",", F.concat("hashes", "lines")), 256)), "files")
    first = all_files.groupBy("digest").agg(F.min("path").alias("head"))
    read_files = scratch.cut(all_files.join(first.select(F.col("head").alias("path")), "path", "left_semi").drop("digest"), "heads")
    whole = F.struct(F.element_at("lines", 1).alias("start"), F.element_at("lines", -1).alias("end"), F.size("lines").alias("tokens"))
    copies = all_files.where(F.size("lines") >= min_tokens).select("digest", "path", whole.alias("w")).where(F.col("w.end") - F.col("w.start") + 1 >= min_lines)
    copies = copies.join(first, "digest").where("path <> head").select(F.col("head").alias("path_a"), F.col("w.start").alias("start_a"), F.col("w.end").alias("end_a"), F.col("path").alias("path_b"), F.col("w.start").alias("start_b"), F.col("w.end").alias("end_b"), F.col("w.tokens").alias("tokens"))
    spots = read_files.select("path", F.explode("spots").alias("s")).select("path", "s.*")
    held = spots.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    spots = spots.join(held, "key")
    w = Window.partitionBy("key").orderBy("path", "pos")
    here = F.struct("path", "pos")
    ordered = spots.where(F.col("held") < CROWDED).withColumn("head", F.first(here).over(w)).withColumn("last", F.lag(here).over(w)).where(F.col("last").isNotNull())
    few = ordered.select(F.explode(F.array_distinct(F.array("head", "last"))).alias("o"), F.col("path").alias("path_b"), F.col("pos").alias("pos_b"))
    few = few.select(F.col("o.path").alias("path_a"), F.col("o.pos").alias("pos_a"), "path_b", "pos_b")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, hashes, ranges in batch.itertuples(index=False):
                hashes = list(map(int, hashes))
                keys = _gram_hashes(hashes, min_tokens)
                rows += [(keys[i], path, i, hashes[i - 1] if i else -1) for r in ranges for i in range(r["first"], r["last"] + 1)]
            yield pd.DataFrame(rows, columns=["key", "path", "pos", "before"]).astype({"key": "int64", "pos": "int32", "before": "int64"})

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for hashes, lines, path, places in batch[["hashes", "lines", "path", "places"]].itertuples(index=False):
                packed, lines = np.asarray(hashes).astype(">u4").tobytes(), np.asarray(lines)
                for x in places:
                    pos = x["pos"]
                    end = int(np.searchsorted(lines, lines[pos] + min_lines - 1))
                    if end < len(lines):
                        rows.append((x["key"], path, pos, max(min_tokens, end - pos + 1), packed[4 * (pos + min_tokens) :]))
            yield pd.DataFrame(rows, columns=["key", "path", "pos", "need", "rest"]).astype({"key": "int64", "pos": "int32", "need": "int32"})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path_a", "pos_a", "path_b", "pos_b"]
        links = _linked((r for b in batches for r in b.itertuples(index=False, name=None)), min_tokens)
        while rows := list(islice(links, 10_000)):
            yield pd.DataFrame([x[:2] + x[2:] if x[:2] <= x[2:] else x[2:] + x[:2] for x in rows], columns=columns).astype({"pos_a": "int32", "pos_b": "int32"})

    crowded = spots.where(F.col("held") >= CROWDED).groupBy("path").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    around = scratch.cut(read_files.select("path", "hashes").join(crowded, "path").select("path", "hashes", "ranges").mapInPandas(windows, "key bigint, path string, pos int, before bigint"), "windows")
    begun = around.groupBy("key").agg(F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high")).where("n > 1 AND (low <> high OR low = -1)")
    places = around.join(begun.select("key"), "key", "left_semi").groupBy("path").agg(F.collect_list(F.struct("key", "pos")).alias("places"))
    placed = read_files.select("path", "hashes", "lines").join(places, "path").mapInPandas(contexts, "key bigint, path string, pos int, need int, rest binary")
    many = placed.repartition("key").sortWithinPartitions("key", "rest", "path", "pos").mapInPandas(link, "path_a string, pos_a int, path_b string, pos_b int")
    pairs = few.unionByName(many)
    grouped = pairs.groupBy("path_a", "path_b").agg(F.collect_set(F.struct("pos_a", "pos_b")).alias("spots"))
    left = read_files.select(F.col("path").alias("path_a"), F.col("hashes").alias("ha"), F.col("lines").alias("la"))
    right = read_files.select(F.col("path").alias("path_b"), F.col("hashes").alias("hb"), F.col("lines").alias("lb"))
    joined = grouped.join(left, "path_a").join(right, "path_b").select("path_a", "ha", "la", "path_b", "hb", "lb", "spots")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for pa_, ha, la, pb, hb, lb, at in batch.itertuples(index=False):
                ha, hb = list(ha), list(hb)
                seen: set[tuple[int, int, int]] = set()
                for s in sorted((s["pos_a"], s["pos_b"]) for s in at):
                    run = _longest(ha, hb, *s, pa_ == pb)
                    x, y, n = run
                    if run in seen or n < min_tokens or la[x + n - 1] - la[x] + 1 < min_lines or lb[y + n - 1] - lb[y] + 1 < min_lines:
                        continue
                    seen.add(run)
                    rows.append((pa_, int(la[x]), int(la[x + n - 1]), pb, int(lb[y]), int(lb[y + n - 1]), n))
            frame = pd.DataFrame(rows, columns=["path_a", "start_a", "end_a", "path_b", "start_b", "end_b", "tokens"])
            yield frame.astype({c: "int32" for c in ("start_a", "end_a", "start_b", "end_b", "tokens")})

    return joined.mapInPandas(extend, "path_a string, start_a int, end_a int, path_b string, start_b int, end_b int, tokens int").unionByName(copies).distinct()


def token_clones(files: DataFrame, extensions: tuple[str, ...], min_tokens: int, min_lines: int, matcher: Matcher = match_tokens, glob_safe: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Pairs, the files looked at, and notes. ``glob_safe`` leaves out paths that other matchers would read as patterns.

    A matcher that names a file it was not given, or whose pairs lack a column, is an error.
    """
    chosen = files.where(F.col("ext").isin(*extensions))
    notes: list[str] = []
    if glob_safe:
        left_out = chosen.where(glob_unsafe(F.col("path"))).count()
        chosen = chosen.where(~glob_unsafe(F.col("path")))
        if left_out:
            notes.append(f"{left_out} file(s) whose names hold pattern characters were kept from the token matcher; it does not cover them.")
    pairs = matcher(chosen, min_tokens, min_lines)
    needed = {"path_a", "start_a", "end_a", "path_b", "start_b", "end_b"}
    if not needed <= set(pairs.columns):
        raise MatcherError(f"the token matcher's pairs lack {', '.join(sorted(needed - set(pairs.columns)))}")
    stray = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path")).join(chosen.select("path"), "path", "left_anti").first()
    if stray is not None:
        raise MatcherError(f"the token matcher named a file it was not given: {stray['path']}")
    return pairs, chosen.select("path"), notes
