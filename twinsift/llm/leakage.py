"""Problem 8: evaluation texts leaking into training text.

``leaks`` follows the plain rule: a common run of ``RUN`` reduced characters may begin and end inside a word and be
shorter than any template, so templates of words cannot find them all; ``templates`` runs the method over the whole
table. Both texts are reduced to letters and digits, every digit becomes a number placeholder, and windows are joined
by hash: a common run holds ``RUN`` common characters of this form, and one of its windows is sure to meet. Of the
windows of a text only those are indexed whose hash is the minimum of a neighbourhood, a choice that both sides make
alike. A fixed-size filter of the items' windows keeps the corpus's other windows out of the shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.rolling import Slices, code_points, window_minima
from twinsift.session import Scratch

RUN = 60
GRAM = 30
FILTER = 1 << 20

_drop = regex.compile(r"[^\p{L}\p{N}]+").sub
_digit = regex.compile(r"\p{N}").sub


def reduced(text: str) -> str:
    """Lower-cased, decomposed (NFKD), letters and digits only."""
    return _drop("", unicodedata.normalize("NFKD", text.lower()))


def _letter_windows(text: str, run: int) -> np.ndarray:
    template = code_points(_digit("0", reduced(text)))
    gram = min(GRAM, run)
    grams = Slices(template).grams(gram)
    at = window_minima(grams >> np.uint64(32), run - gram + 1)
    return np.unique(grams[at])


def bitmap(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over 64-bit keys."""
    bits = np.zeros(FILTER, bool)
    for row in keys.select(F.col("key").bitwiseAND(F.lit(FILTER - 1)).alias("b")).distinct().collect():
        bits[row["b"]] = True
    return bits


def _letters(texts: DataFrame, run: int, only: np.ndarray | None = None) -> DataFrame:
    """``(id, key)``: the indexed letter windows of ``texts(id, text)``."""
    bits = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = _letter_windows(text.as_py(), run)
                if bits is not None and len(key):
                    key = key[bits.value[(key & np.uint64(FILTER - 1)).astype(np.int64)]]
                ids.append(np.full(len(key), ident, np.int64))
                keys.append(key)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=["id", "key"])

    return texts.mapInArrow(go, "id bigint, key bigint")


@lru_cache(maxsize=256)
def _run_hashes(text: str, run: int) -> tuple[str, np.ndarray, np.ndarray]:
    short = reduced(text)
    hashes = Slices(code_points(short)).grams(run)
    return short, hashes, np.argsort(hashes, kind="stable")


def _holds(run: int):
    """Keep the candidates whose reduced texts have a common run, compared exactly."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                doc, dh, _ = _run_hashes(batch.column("text")[i].as_py(), run)
                item, ih, order = _run_hashes(batch.column("item")[i].as_py(), run)
                at = np.flatnonzero(np.isin(dh, ih))
                to = order[np.searchsorted(ih, dh[at], sorter=order)]
                if any(doc[x : x + run] == item[y : y + run] for x, y in zip(at.tolist(), to.tolist())):
                    keep.append(i)
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("item_id").take(rows)], names=["doc_id", "item_id"])

    return go


def texts_of(table: DataFrame, key: str, text: str) -> DataFrame:
    return table.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id)``: documents and items whose reduced texts share at least ``run`` characters in a row.

    Candidates come from the windows that meet; each is then checked exactly. Defined cases: null ids, null
    and empty texts take no part; items with equal text all count; repeated rows count once; an item whose reduced
    text is shorter than a run cannot leak; whole texts are searched; extra columns are ignored.
    """
    docs, tests = texts_of(documents, "doc_id", "text"), texts_of(items, "item_id", "text")
    scratch = Scratch(documents.sparkSession, "leaks")
    letters = scratch.cut(_letters(tests, run), "item-letters")
    met = _letters(docs, run, bitmap(letters)).join(letters.select(F.col("id").alias("item_id"), "key"), "key")
    found = scratch.cut(met.select("id", "item_id").distinct(), "candidates")
    checked = (
        docs.join(found, "id")
        .select(F.col("id").alias("doc_id"), "text", "item_id")
        .join(tests.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
        .select("doc_id", "text", "item_id", "item")
    )
    return checked.mapInArrow(_holds(run), "doc_id bigint, item_id bigint").distinct()


def items_leaked(found: DataFrame) -> DataFrame:
    """``(item_id, documents)``: in how many documents each leaked item was found."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
