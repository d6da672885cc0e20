"""Calibration: how many injected copies the structure detector finds, and a sample for people to judge."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import Structure
from twinsift.sources import script

MUTATIONS = ("copy", "rename", "literals", "insert-statement", "delete-statement")
#: A statement may be deleted if it is at most this share of its unit.
REMOVABLE = 0.1


def draw(frame: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """``n`` rows, the same ones for the same seed whatever the partitioning: those with the least hash of seed and key."""
    return frame.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def seeded_random(seed: int):
    """A small deterministic generator of numbers in [0, 1) (the public mulberry32 recurrence)."""
    state = seed & 0xFFFFFFFF

    def step() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ (state >> 15)) * (state | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return step


def shuffled(items, random) -> list:
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(random() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def mutate(text: str, tokens: list[script.Token], partner: dict[int, int], unit: script.Unit, kind: str, choice: float = 0.5) -> str | None:
    """The unit's text after one mutation, or None where it does not apply."""
    edits: list[tuple[int, int, str]] = []
    a, b = unit.body
    inner = range(a, b)
    if kind == "rename":
        local = script._locals(tokens, partner, unit.params, unit.body)
        for i in [*range(*unit.params), *inner]:
            t = tokens[i]
            if t.kind == "name" and t.text in local and (i == 0 or tokens[i - 1].text not in (".", "?.")) and not (i + 1 < len(tokens) and tokens[i + 1].text == ":" and tokens[i - 1].text in ("{", ",")):
                edits.append((t.at + len(t.text), t.at + len(t.text), "_renamed"))
    elif kind == "literals":
        for i in inner:
            t = tokens[i]
            if t.kind == "string":
                edits.append((t.at + len(t.text) - 1, t.at + len(t.text) - 1, "x"))
            elif t.kind == "number":
                edits.append((t.at + len(t.text), t.at + len(t.text), "0"))
    elif kind in ("insert-statement", "delete-statement"):
        if a == 0 or tokens[a - 1].text != "{":
            return None
        spans = _statements(tokens, partner, a, b)
        if kind == "insert-statement":
            if not spans:
                return None
            end = tokens[spans[0][1]].at + len(tokens[spans[0][1]].text)
            edits.append((end, end, '\n  console.log("inserted");'))
        else:
            small = [s for s in spans[:-1] if s[1] - s[0] + 1 <= REMOVABLE * unit.size]
            if not small:
                return None
            s = small[min(len(small) - 1, int(choice * len(small)))]
            edits.append((tokens[s[0]].at, tokens[s[1]].at + len(tokens[s[1]].text), ""))
    if kind != "copy" and not edits:
        return None
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    grown = sum(len(new) - (end - start) for start, end, new in edits)
    body = text[unit.start : unit.end + grown]
    if unit.form == "method":
        return f"class Holder {{\n{body}\n}}\n"
    return f"export const {unit.name} = {body};\n" if unit.form == "arrow" else body + "\n"


def _statements(tokens: list[script.Token], partner: dict[int, int], a: int, b: int) -> list[tuple[int, int]]:
    """First and last token of each statement of a block."""
    out, begin, i = [], a, a
    while i < b:
        t = tokens[i]
        if t.text in ("{", "(", "["):
            i = partner[i]
            if t.text == "{" and (i + 1 >= b or tokens[i + 1].text not in (";", ",", ")", ".", "else", "catch", "finally", "while")) and tokens[begin].text not in ("const", "let", "var", "return"):
                out.append((begin, i))
                begin = i + 1
        elif t.text == ";":
            out.append((begin, i))
            begin = i + 1
        i += 1
    if begin < b:
        out.append((begin, b - 1))
    return out


def candidates(files: DataFrame, s: Structure) -> DataFrame:
    """Units to draw mutants from, with their file's text: ``(ord, path, text, start_line, size)``."""
    units = script.script_units(files, s.minLines, s.minNodes).where(F.col("error").isNull() & (F.col("size") <= s.maxTedNodes))
    return units.select("ord", "path", "start_line", "size").join(files.select("path", "text"), "path")


def mutants(sampled: DataFrame, s: Structure, seed: int) -> DataFrame:
    """``(path, ext, text, kind, origin, origin_line)``: every mutation that applies to each sampled unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, line, size, text, ord_ in zip(batch["path"], batch["start_line"], batch["size"], batch["text"], batch["ord"]):
                tokens = script.lex(text, script.dialect_of(path))
                partner = script.match_brackets(tokens)
                unit = next(u for u in script.find_units(tokens, partner) if u.start_line == line and u.size == size)
                for kind in MUTATIONS:
                    changed = mutate(text, tokens, partner, unit, kind, seeded_random(seed * 1_000_003 + int(ord_))())
                    if changed is not None:
                        ext = posixpath.splitext(path)[1]
                        rows.append((f"~mutants/{ord_}-{kind}{ext}", ext.lower(), changed, kind, path, int(line)))
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "kind", "origin", "origin_line"]).astype({"origin_line": "int32"})

    return sampled.mapInPandas(run, "path string, ext string, text string, kind string, origin string, origin_line int")


def detected(mutated: DataFrame, members: DataFrame) -> DataFrame:
    """Mutants that share a cluster with the unit they come from."""
    left = members.select("cluster", "path")
    right = members.select("cluster", F.col("path").alias("origin"), F.col("start_line").alias("origin_line"))
    return mutated.join(left.join(right, "cluster").select("path", "origin", "origin_line").distinct(), ["path", "origin", "origin_line"], "left_semi")


def recall(mutated: DataFrame, found: DataFrame) -> DataFrame:
    """``(kind, attempted, detected, recall)`` for every kind and overall; 0 where none was attempted."""
    marked = mutated.select("path", "kind").join(found.select("path", F.lit(1).alias("hit")), "path", "left")
    rolled = marked.rollup("kind").agg(F.count("*").alias("attempted"), F.count("hit").alias("detected"), F.grouping("kind").alias("g")).select(F.when(F.col("g") == 1, "overall").otherwise(F.col("kind")).alias("kind"), "attempted", "detected")
    kinds = mutated.sparkSession.createDataFrame([(i, k) for i, k in enumerate((*MUTATIONS, "overall"))], "place int, kind string")
    joined = kinds.join(rolled, "kind", "left").select("place", "kind", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("detected", F.lit(0)).alias("detected"))
    return joined.withColumn("recall", F.coalesce(F.try_divide("detected", "attempted"), F.lit(0.0))).orderBy("place").drop("place")
