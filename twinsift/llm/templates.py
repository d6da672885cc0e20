"""Problem 8, the method over the whole table: template canonicalisation of evaluation items and corpus documents.

A text becomes a sequence of literals and typed placeholders. Numbers are placeholders, and so are unit words. What is a
name follows from the corpus: a word is a literal if it is common among the documents of its script, or written small in
a script with case; any other word is a name. Scripts without spaces are read by character, and a character belongs to a
name unless one of the runs of ``TRIPLE`` characters around it is common. Names that follow one another are one slot.

An item leaks as a template where both texts hold the same canonical tokens in a row, ``RUN`` words or what weighs as
much, and the slots agree: each value of the item stands for one value of the document throughout the run. Windows of ``WORDS``
tokens are joined by hash. Of the windows in any run of ``RUN`` tokens the least hash is indexed, so a run that holds a
window with enough literals is sure to meet; candidates are then verified on the token sequences.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.leakage import FILTER, bitmap, texts_of
from twinsift.llm.rolling import Slices, mixed, window_minima
from twinsift.session import Scratch

#: Tokens of an indexed window, the literals it needs, and the tokens of a run.
WORDS, LITERAL, RUN = 12, 6, 16
#: A word is common in its script if it is in this share of the script's documents; so the table of common words has at
#: most ``1 / COMMON`` times as many entries as a document has distinct words in the mean, however many documents.
COMMON = 0.03
#: Characters of the runs that tell common writing from names where words are not set apart.
TRIPLE = 3
NUMBER, NAME, UNIT = 1, 2, 3
#: What a token adds to the length of a run: five characters of writing without spaces weigh as much as two words.
WORD, CHARACTER = 5, 2
#: Codes, values and weights of a text's tokens.
Sequence = tuple[np.ndarray, list[str], np.ndarray]

_tokens = regex.compile(
    r"(?P<n>\p{N}+(?:[.,  ]?\p{N}+)*)|(?P<k>\p{Katakana}[\p{Katakana}ー・]*)|(?P<c>[\p{Han}\p{Hiragana}\p{Thai}]+)"
    r"|(?P<d>[\p{Devanagari}\p{M}]+)|(?P<a>[\p{Arabic}\p{M}]+)|(?P<l>[\p{L}\p{M}]+)"
)
#: Unit words of measures and money.
UNITS = frozenset("percent cent prozent pour ciento km kilometres kilometers kilometer kilómetros kilomètres crowns kronen couronnes coronas euro euros votes stimmen voix votos".split())


@lru_cache(maxsize=400_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 7  # never a placeholder


def pieces(text: str) -> list[tuple[str, str]]:
    """A text's ``(kind, piece)``: n number, k katakana, c writing without spaces, d, a and l words of three scripts."""
    return [(m.lastgroup, m.group()) for m in _tokens.finditer(unicodedata.normalize("NFKC", text))]


def _keys(kind: str, piece: str) -> list[int]:
    """What is counted of a piece: the word itself, or its runs of characters."""
    if kind == "n":
        return []
    if kind == "c":
        return [_hash(piece[i : i + TRIPLE]) for i in range(len(piece) - TRIPLE + 1)]
    return [_hash(piece.casefold())]


class Canon:
    """Canonical tokens of texts, given the common words of each script."""

    def __init__(self, common: np.ndarray):
        self.common = frozenset(common.tolist())

    def word(self, kind: str, piece: str) -> int:
        low = piece.casefold()
        if low in UNITS:
            return UNIT
        own = _hash(low)
        return own if own in self.common or kind == "l" and piece[0].islower() else NAME

    def tokens(self, text: str) -> Sequence:
        """Each token's hash or placeholder, its value and its weight."""
        out: list[tuple[int, str, int]] = []
        for kind, piece in pieces(text):
            if kind == "n":
                out.append((NUMBER, piece, WORD))
            elif kind == "c":
                known = [k in self.common for k in _keys(kind, piece)]
                for i, c in enumerate(piece):
                    literal = any(known[max(0, i - TRIPLE + 1) : i + 1]) or len(piece) < TRIPLE
                    out.append((_hash(c) if literal else NAME, c, CHARACTER))
            else:
                out.append((self.word(kind, piece), piece.casefold(), WORD))
        merged: list[tuple[int, str, int]] = []
        for code, run in groupby(out, key=lambda x: x[0]):
            if code == NAME:
                merged.append((NAME, " ".join(v for _, v, _ in run), WORD))
            else:
                merged += run
        return np.array([x[0] for x in merged], np.uint64), [x[1] for x in merged], np.array([x[2] for x in merged], np.int64)


def windows(codes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of the indexed windows of a token sequence: the least of each run, among those with enough literals."""
    if len(codes) < run:
        return np.empty(0, np.uint64)
    grams = Slices(mixed(codes)).grams(WORDS)
    fit = np.convolve(codes > UNIT, np.ones(WORDS, int), "valid") >= LITERAL
    at = window_minima(np.where(fit, grams >> np.uint64(33), np.uint64(0xFFFFFFFF)), run - WORDS + 1)
    return np.unique(grams[at[fit[at]]])


def agreement(doc: Sequence, item: Sequence, run: int = RUN) -> tuple[int, int] | None:
    """``(tokens, changed)`` of the longest stretch that both hold, in which each value of the item has one counterpart.

    None if none weighs as much as ``run`` words, and its literals as half of them. ``changed`` counts the values of
    the item that have another value there.
    """
    (a, av, _), (b, bv, weight) = doc, item
    if len(a) < run or len(b) < run:
        return None
    ga, gb = Slices(mixed(a)).grams(run), Slices(mixed(b)).grams(run)
    order = np.argsort(gb, kind="stable")
    low, high = np.searchsorted(gb[order], ga, "left"), np.searchsorted(gb[order], ga, "right")
    literals, heavy = (np.concatenate([[0], np.cumsum(w)]) for w in (weight * (b > UNIT), weight))
    best: tuple[int, int, int, int] | None = None
    before: set[tuple[int, int]] = set()
    for x in np.flatnonzero(high > low).tolist():
        starts = order[low[x] : high[x]].tolist()
        for y in starts:
            if (x - 1, y - 1) in before:
                continue  # the stretch that began earlier on this diagonal
            limit = min(len(a) - x, len(b) - y)
            differ = np.flatnonzero(a[x : x + limit] != b[y : y + limit])
            n = int(differ[0]) if len(differ) else limit
            start, last = 0, {}
            for k in range(n):
                if b[y + k] <= UNIT:
                    key = int(b[y + k]), bv[y + k]
                    if key in last and last[key][0] != av[x + k]:
                        start = max(start, last[key][1] + 1)  # behind the last place that says otherwise
                    last[key] = av[x + k], k
                size, to = k - start + 1, y + k + 1
                if size >= run and (best is None or size > best[0]) and heavy[to] - heavy[to - size] >= run * WORD and 2 * (literals[to] - literals[to - size]) >= run * WORD:
                    best = size, x + start, y + start, to
        before = {(x, y) for y in starts}
    if best is None:
        return None
    size, x, y, _ = best
    return size, len({(int(b[y + i]), bv[y + i]) for i in range(size) if b[y + i] <= UNIT and av[x + i] != bv[y + i]})


def common_words(texts: DataFrame, share: float = COMMON) -> np.ndarray:
    """Hashes of the words, and runs of characters, that at least ``share`` of the documents of their script hold.

    Counted over all documents, each once for each word it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            script, key = [], []
            for text in batch.column(1):
                held: dict[str, set[int]] = {}
                for kind, piece in pieces(text.as_py()):
                    held.setdefault(kind, set()).update(_keys(kind, piece))
                for kind, keys in held.items():
                    script += [kind] * (len(keys) + 1)
                    key += [0, *keys]  # 0 counts the documents
            yield pa.RecordBatch.from_arrays([pa.array(script, pa.string()), pa.array(np.array(key, np.uint64).view(np.int64))], names=["script", "key"])

    counted = texts.mapInArrow(run, "script string, key bigint").groupBy("script", "key").agg(F.count("*").alias("n"))
    counted = Scratch(texts.sparkSession, "words").cut(counted, "counts")
    whole = counted.where("key = 0").select("script", F.col("n").alias("whole"))
    rows = counted.where("key <> 0").join(F.broadcast(whole), "script").where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("whole"))).select("key").collect()  # one row of totals a script
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def _indexed(texts: DataFrame, common, run: int, only: np.ndarray | None = None) -> DataFrame:
    """``(id, key)``: the indexed windows of ``texts(id, text)``."""
    chosen = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(common.value)
        for batch in batches:
            ids, keys = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = windows(canon.tokens(text.as_py())[0], run)
                if chosen is not None:
                    key = key[chosen.value[(key & np.uint64(FILTER - 1)).astype(np.int64)]]
                ids.append(np.full(len(key), ident, np.int64))
                keys.append(key)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=["id", "key"])

    return texts.mapInArrow(go, "id bigint, key bigint")


def _verified(common, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(common.value)
        known = lru_cache(maxsize=512)(canon.tokens)
        for batch in batches:
            docs, items, tokens, changed = [], [], [], []
            for d, i, text, item in zip(*(batch.column(c) for c in ("doc_id", "item_id", "text", "item"))):
                if found := agreement(known(text.as_py()), known(item.as_py()), run):
                    docs.append(d.as_py())
                    items.append(i.as_py())
                    tokens.append(found[0])
                    changed.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(tokens, pa.int32()), pa.array(changed, pa.int32())], names=["doc_id", "item_id", "tokens", "changed"])

    return go


def template_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id, tokens, changed)``: documents that hold an item's template, verbatim or with new values.

    ``tokens`` is the longest run of canonical tokens that agree in their slots, ``changed`` how many of the item's
    values have another value there. Defined cases: null ids, null and empty texts take no part; texts of fewer than
    ``run`` tokens cannot leak; items with equal text all count; repeated rows count once; whole texts are read; empty
    tables give no rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    docs, tests = texts_of(documents, "doc_id", "text"), texts_of(items, "item_id", "text").dropDuplicates(["id"])
    scratch = Scratch(spark, "templates")
    common = spark.sparkContext.broadcast(common_words(docs))
    own = scratch.cut(_indexed(tests, common, run), "items")
    met = _indexed(docs, common, run, bitmap(own)).join(own.select(F.col("id").alias("item_id"), "key"), "key")
    found = scratch.cut(met.select("id", "item_id").distinct(), "candidates")
    pairs = docs.join(found, "id").select(F.col("id").alias("doc_id"), "text", "item_id").join(tests.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
    checked = pairs.select("doc_id", "item_id", "text", "item").mapInArrow(_verified(common, run), "doc_id bigint, item_id bigint, tokens int, changed int")
    return checked.groupBy("doc_id", "item_id").agg(F.max("tokens").alias("tokens"), F.max_by("changed", "tokens").alias("changed"))
