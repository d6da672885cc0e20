"""Problem 6: long exact spans shared between records, over compact windows.

The hashes of a text's character runs of length ``GRAM`` are its min-hash sequence. A window of ``length - GRAM + 1``
hashes has one leftmost minimum, its anchor; all sequences around an anchor that reach no smaller hash share that
minimum, and the Cartesian tree of the anchors gives these compact windows ``[left, right]``. Two texts with a common run
of ``length`` characters hold the same sequence there, so they share an anchor, and the run lies inside both compact
windows. An anchor's text context narrows it further: the run reaches between ``a`` and ``a + step`` characters to the
left of the anchor for one multiple ``a`` of ``step``, so both texts hold the same ``length - step`` characters from
``anchor - a`` on. The hash of that slice is the join key; windows that cannot hold a whole run together are dropped in
the join. A text has about ``2 n / length`` anchors, so the index is far smaller than the text.

Keys shared by many texts (a licence text somewhat shorter than ``length`` in a third of the files, say) are taken out,
and the texts that hold them are joined again by slices that are only ``FINE`` characters shorter than a run, so that nearly all their candidates
hold. Candidates are verified on the texts; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.rolling import Slices, code_points, mixed, window_least, window_minima
from twinsift.operators.lines import span_islands
from twinsift.session import Scratch

LENGTH = 300
GRAM = 16
COARSE, FINE = 100, 10
#: Distinct texts above which a key is joined by the finer slices.
CROWD = 48
#: Min-hashes of a passage, and how many of them two passages must share.
HASHES, AGREE = 3, 3


def signatures(text: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, start, end)``: the passages of a text that share ``AGREE`` of their ``HASHES`` min-hashes, by those.

    Each hash function cuts the text into compact windows: the passages of ``length`` characters that share one leftmost
    minimum begin in an interval, the width of that minimum's subtree in the Cartesian tree. Where the intervals of all
    functions overlap, the whole signature stands still; every such overlap gives one key for each choice of ``AGREE``
    hashes, with the stretch of text that its passages cover. A text has about ``2 * HASHES * n / length`` overlaps.
    """
    points = code_points(text)
    n = len(points)
    if n < length:
        nothing = np.empty(0, np.int64)
        return nothing.astype(np.uint64), nothing, nothing
    grams = Slices(points).grams(GRAM)
    least = np.stack([window_least(mixed(grams + np.uint64(k * 0x9E3779B9)) >> np.uint64(32), length - GRAM + 1) for k in range(HASHES)])
    begin = np.flatnonzero(np.concatenate([[True], (least[:, 1:] != least[:, :-1]).any(axis=0)]))
    last = np.concatenate([begin[1:] - 1, [least.shape[1] - 1]])
    own = mixed(grams[least[:, begin]] + np.arange(HASHES, dtype=np.uint64)[:, None])
    keys = []
    for k, chosen in enumerate(combinations(range(HASHES), AGREE)):
        key = np.full(len(begin), k, np.uint64)
        for j in chosen:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[j])
        keys.append(key)
    key = np.concatenate(keys)
    start, end = np.tile(begin, len(keys)), np.tile(last + length, len(keys))
    order = np.argsort(key, kind="stable")
    key, start, end = key[order], start[order], end[order]
    # overlaps of one key that follow one another are one stretch
    apart = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > end[:-1] - length + 1)])
    first = np.flatnonzero(apart)
    return key[first], start[first], np.maximum.reduceat(end, first)


def tree_bounds(values: np.ndarray, anchors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The Cartesian tree of the anchors, as each one's compact window: how far it stays the leftmost minimum."""
    left, right = np.zeros(len(anchors), np.int64), np.full(len(anchors), n - 1, np.int64)
    stack: list[int] = []
    value, place = values[anchors].tolist(), anchors.tolist()
    for i, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    return left, right


def _anchored(text: str, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Distinct keys of a text with the room that its compact windows leave left and right of the anchor."""
    points = code_points(text)
    n = len(points)
    if n < length:
        return None
    slices = Slices(points)
    grams = slices.grams(GRAM) >> np.uint64(32)
    anchors = window_minima(grams, length - GRAM + 1)
    low, high = tree_bounds(grams, anchors, len(grams))
    keys, lefts, rights = [], [], []
    for a in range(0, length - GRAM + 1, step):
        begin = anchors - a
        fits = (begin >= low) & (begin + length - step <= np.minimum(high + GRAM, n))
        begin = begin[fits]
        keys.append(slices.hash(begin, begin + length - step) + np.uint64(a))
        lefts.append(anchors[fits] - low[fits])
        rights.append(high[fits] - anchors[fits])
    key, left, right = np.concatenate(keys), np.concatenate(lefts), np.concatenate(rights)
    if not len(key):
        return None
    order = np.argsort(key, kind="stable")
    key, left, right = key[order], left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.maximum.reduceat(left, first), np.maximum.reduceat(right, first)


def _window_keys(texts: DataFrame, length: int, step: int) -> DataFrame:
    """``(key, tid, n, room_left, room_right)`` for ``texts(tid, n, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        columns: list[list[np.ndarray]] = [[], [], [], [], []]

        def flush() -> pa.RecordBatch:
            key, tid, n, left, right = (np.concatenate(c) for c in columns)
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tid), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["key", "tid", "n", "room_left", "room_right"])

        for batch in batches:
            tids, sizes, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (tid, n) in enumerate(zip(tids, sizes)):
                if (tid, n) in seen:
                    continue  # copies within a task are indexed once
                seen.add((tid, n))
                body = bodies[i].as_py()
                found = _anchored(body, length, step)
                if found is None:
                    continue
                key, left, right = found
                reach = length  # more room than a run needs tells nothing
                for column, x in zip(columns, (key, np.full(len(key), tid, np.int64), np.full(len(key), n, np.int64), np.minimum(left, reach), np.minimum(right, reach))):
                    column.append(x)
            if columns[0]:
                yield flush()

    return texts.mapInArrow(run, "key bigint, tid bigint, n int, room_left int, room_right int")


def _meet(keys: DataFrame, length: int) -> DataFrame:
    """Pairs of different texts that share a key and whose compact windows leave room for a whole run."""
    other = keys.select("key", F.col("tid").alias("tid2"), F.col("n").alias("n2"), F.col("room_left").alias("l2"), F.col("room_right").alias("r2"))
    room = F.least("room_left", "l2") + F.least("room_right", "r2") + F.lit(GRAM) >= length
    earlier = (F.col("tid") < F.col("tid2")) | ((F.col("tid") == F.col("tid2")) & (F.col("n") < F.col("n2")))
    return keys.join(other, "key").where(earlier & room).select("tid", "n", "tid2", "n2").distinct()


def _runs(length: int):
    """Verify candidate texts and report, for each side, the stretches that lie in common runs."""

    def stretches(at: np.ndarray) -> list[dict]:
        cut = np.flatnonzero(np.diff(at) > length)
        begin, end = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + length
        return [{"start": int(b), "end": int(e)} for b, e in zip(begin, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=4)  # the candidates of a second text follow one another
        def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
            grams = Slices(code_points(text)).grams(length)
            return grams, np.argsort(grams, kind="stable")

        for batch in batches:
            keep, own, theirs = [], [], []
            for i in range(batch.num_rows):
                a, b = batch.column("text")[i].as_py(), batch.column("text2")[i].as_py()
                (ga, _), (gb, order) = hashed(a), hashed(b)
                at = np.flatnonzero(np.isin(ga, gb))
                if len(at):  # compared exactly, not by hash
                    to = order[np.searchsorted(gb, ga[at], sorter=order)]
                    at = at[[a[x : x + length] == b[y : y + length] for x, y in zip(at.tolist(), to.tolist())]]
                if len(at):
                    bt = np.flatnonzero(np.isin(gb, ga[at]))
                    keep.append(i)
                    own.append(stretches(at))
                    theirs.append(stretches(bt))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("tid", "n", "tid2", "n2")), pa.array(own, span), pa.array(theirs, span)], names=["tid", "n", "tid2", "n2", "runs", "runs2"])

    return run


def text_records(files: DataFrame, length: int = LENGTH, key: str = "file_id") -> DataFrame:
    """``(id, tid, n, text)``: files long enough for a run; equal texts share ``(tid, n)``."""
    size = F.length("text")
    return files.where(F.col(key).isNotNull() & (size >= length)).select(F.col(key).cast("bigint").alias("id"), F.xxhash64("text").alias("tid"), size.alias("n"), "text")


def shared_spans(files: DataFrame, length: int = LENGTH, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """``members(id, tid, n)`` and ``links(tid, n, tid2, n2, runs, runs2)``: which different texts hold a common run.

    Equal texts share a ``(tid, n)``. ``runs`` are the stretches of the first text that lie in common runs.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}")
    coarse_step = min(COARSE, max(1, (length - GRAM) // 2))
    spark = files.sparkSession
    scratch = Scratch(spark, "spans")
    records = text_records(files, length, key)
    members = scratch.cut(records.select("id", "tid", "n").distinct(), "members")
    texts = records.select("tid", "n", "text")
    keys = scratch.cut(_window_keys(texts, length, coarse_step), "keys")
    crowded = scratch.cut(keys.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > CROWD).select("key"), "crowded")
    candidates = _meet(keys.join(crowded, "key", "left_anti"), length)
    if not crowded.isEmpty():
        if coarse_step == COARSE:
            holders = scratch.cut(keys.join(crowded, "key", "left_semi").select("tid", "n").distinct(), "holders")
            candidates = candidates.unionByName(_meet(_window_keys(texts.join(holders, ["tid", "n"], "left_semi"), length, FINE), length)).distinct()
        else:
            candidates = _meet(keys, length)
    candidates = scratch.cut(candidates, "candidates")
    scratch.drop(keys)
    involved = candidates.select("tid", "n").unionByName(candidates.select(F.col("tid2").alias("tid"), F.col("n2").alias("n"))).distinct()
    bodies = scratch.cut(texts.join(involved, ["tid", "n"], "left_semi").groupBy("tid", "n").agg(F.first("text").alias("text")), "texts")
    second = bodies.select(F.col("tid").alias("tid2"), F.col("n").alias("n2"), F.col("text").alias("text2"))
    checked = candidates.join(bodies, ["tid", "n"]).join(second, ["tid2", "n2"]).select("tid", "n", "text", "tid2", "n2", "text2")
    span = "array<struct<start:int,end:int>>"
    links = scratch.cut(checked.mapInArrow(_runs(length), f"tid bigint, n int, tid2 bigint, n2 int, runs {span}, runs2 {span}"), "links")
    scratch.drop(bodies)
    scratch.drop(candidates)
    return members, links


def file_pairs(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(file_a, file_b)``, ``file_a < file_b``: files with a common run of at least ``length`` characters.

    Defined cases: null ids, null texts and texts shorter than a run take no part; a file delivered twice counts once;
    texts are compared whole, in code points; equal texts are pairs; empty tables give no rows; extra columns are
    ignored.
    """
    members, links = shared_spans(files, length)
    left = members.select(F.col("id").alias("file_a"), "tid", "n")
    right = members.select(F.col("id").alias("file_b"), F.col("tid").alias("tid2"), F.col("n").alias("n2"))
    same = left.join(right, (F.col("tid") == F.col("tid2")) & (F.col("n") == F.col("n2"))).select("file_a", "file_b")
    over = links.select("tid", "n", "tid2", "n2").join(left, ["tid", "n"]).join(right, ["tid2", "n2"]).select(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"))
    return same.where(F.col("file_a") < F.col("file_b")).unionByName(over.where(F.col("file_a") < F.col("file_b"))).distinct()


def fragments(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(source_id, file_id, start, end, start_line, end_line)``: the merged shared stretches of each file."""
    members, links = shared_spans(files, length)
    ends = links.select("tid", "n", F.explode("runs").alias("r")).unionByName(links.select(F.col("tid2").alias("tid"), F.col("n2").alias("n"), F.explode("runs2").alias("r")))
    copied = members.groupBy("tid", "n").agg(F.count("*").alias("copies")).where("copies > 1").select("tid", "n", F.struct(F.lit(0).alias("start"), F.col("n").alias("end")).alias("r"))
    spans = ends.unionByName(copied).groupBy("tid", "n").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    merged = F.aggregate(
        "rs",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], r["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(r))),
    )
    spans = spans.select("tid", "n", merged.alias("rs"))
    rows = files.where(F.col("file_id").isNotNull() & (F.length("text") >= length)).select("file_id", "repo", "path", F.xxhash64("text").alias("tid"), F.length("text").alias("n"), "text").dropDuplicates(["file_id", "tid", "n"])
    out = rows.join(spans, ["tid", "n"]).select("file_id", F.concat_ws("/", "repo", "path").alias("source_id"), "n", "text", F.explode("rs").alias("r"))
    breaks = lambda upto: F.regexp_count(F.substring("text", F.lit(1), upto), F.lit("\r\n|\r|\n"))
    return out.select("source_id", "file_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), (breaks(F.col("r.start")) + 1).alias("start_line"), (breaks(F.col("r.end") - 1) + 1).alias("end_line"), (F.col("r.end") - F.col("r.start")).alias("chars"), "n")


def shared_part(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(file_id, shared_chars, n_chars, share)``: how much of each file with a shared stretch lies in common runs."""
    parts = fragments(files, length).groupBy("file_id", "n").agg(F.sum("chars").alias("shared_chars"))
    return parts.select("file_id", "shared_chars", F.col("n").cast("bigint").alias("n_chars"), (F.col("shared_chars") / F.col("n")).alias("share"))


def near_passages(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(file_id, start, end)``: the merged stretches of each file whose passages another file has, exactly or nearly.

    The method over the whole table: compact windows of several min-hashes, joined where enough of them agree. Two
    passages of ``length`` characters meet if they share ``AGREE`` of ``HASHES`` min-hashes of their character runs, so
    every common run of ``length`` characters is covered, and near copies are found by their similarity. Keys are counted,
    not paired: what a third of all files hold costs one row a file. Defined cases: as in ``file_pairs``; equal texts are
    shared whole.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}")
    scratch = Scratch(files.sparkSession, "passages")
    records = text_records(files, length)
    members = scratch.cut(records.select("id", "tid", "n").distinct(), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for tid, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (tid, n) in seen:
                    continue  # copies within a task are indexed once
                seen.add((tid, n))
                key, start, end = signatures(body.as_py(), length)
                for column, x in zip(columns, (key.view(np.int64), np.full(len(key), tid, np.int64), np.full(len(key), n, np.int64), start, end)):
                    column.append(x)
            if columns[0]:
                key, tid, n, start, end = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tid), *(pa.array(x.astype(np.int32)) for x in (n, start, end))], names=["key", "tid", "n", "start", "end"])

    keys = scratch.cut(records.select("tid", "n", "text").mapInArrow(run, "key bigint, tid bigint, n int, start int, end int"), "keys")
    text = F.struct("tid", "n")
    met = keys.groupBy("key").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("key")
    near = keys.join(met, "key", "left_semi").select("tid", "n", "start", "end").distinct()
    copied = members.groupBy("tid", "n").agg(F.count("*").alias("copies")).where("copies > 1").select("tid", "n", F.lit(0).alias("start"), F.col("n").alias("end"))
    lines = near.unionByName(copied).select(F.struct("tid", "n").alias("path"), (F.col("start") + 1).alias("start_line"), F.col("end").alias("end_line"))
    merged = span_islands(lines, "path").select("path.tid", "path.n", (F.col("start_line") - 1).alias("start"), F.col("end_line").alias("end"))
    out = scratch.cut(members.join(merged, ["tid", "n"]).select(F.col("id").alias("file_id"), "start", "end"), "passages")
    scratch.drop(keys)
    scratch.drop(members)
    return out
