"""Problem 4: generated, minified or vendored source files.

``name_model`` is the learned part: for each language a character trigram model of identifiers, counted over all files.
A file whose identifiers cost a good deal more bits a character than its language's names do has mangled names; one whose
names fall into few templates, or count up within one, was written by a tool; one whose naming style is rare in its
repository is foreign.

``classify`` adds what names cannot show: banners of generators, library banners and module wrappers, third-party
folders, and the shape of data kept as code. A vendored copy may share its names with the project that took it, so the
learned part alone cannot find it; the README says more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.rolling import Slices, slabs

#: Characters of the models: letters (by case), digits, underscore, dollar, dash, and the boundary of a name.
ALPHABET = 66
TYPED, STYLES, DATA, PLAIN = range(4)
LANGUAGES = {"ts": TYPED, "tsx": TYPED, "js": PLAIN, "mjs": PLAIN, "cjs": PLAIN, "jsx": PLAIN, "css": STYLES, "json": DATA}
#: Cross-entropy of a file's names, as a multiple of that of all names of its language, from which they count as mangled.
MANGLED = 1.35
#: Share of white space up to which a text with mangled names counts as minified; a foreign language's names cost bits too.
DENSE = 0.1
#: Templates of names to names, up to which a file's names are template-like.
DIVERSITY = 0.75
#: Names needed for a judgement on them.
LEAST_NAMES = 8
#: Consecutive numbers within one name template, and their share of a file's names, from which it is a filled-in template.
STEPS, STEP_SHARE = 4, 0.1
#: A naming style held by less than this share of a repository's names is foreign to it.
FOREIGN_SHARE = 0.02

_name = {STYLES: re.compile(r"[.#]([A-Za-z_][\w-]*)(?=[^;{}]*\{)", re.A), DATA: re.compile(r'"([A-Za-z_$][\w$-]*)"\s*:', re.A)}
_counted = re.compile(r"([A-Za-z_$][\w$-]*+)(?:\s*+[:=(\[]\s*+(\d{1,6})(?![\w.]))?", re.A)
_code = np.full(128, 65, np.int64)
for _i in range(26):
    _code[97 + _i], _code[65 + _i] = 1 + _i, 27 + _i
for _i in range(10):
    _code[48 + _i] = 53 + _i
_code[95], _code[36] = 63, 64


def language(path: str | None) -> int | None:
    """The model a path belongs to, by its extension; None for paths of other kinds."""
    return LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower()) if "." in (path or "") else None


def name_source(text: str, kind: int) -> str:
    """What a text's names are read from: code as it is, the classes and ids of style rules, the keys of JSON."""
    return text if kind in (TYPED, PLAIN) else "\n".join(_name[kind].findall(text))


class Names:
    """The names of many texts at once, each distinct name of a text once: no Python loop runs over names.

    ``row`` is the text of each name, ``start`` and ``end`` its place in ``raw``; ``code`` holds the characters' codes.
    """

    def __init__(self, texts: list[str], kinds: list[int]):
        parts = [name_source(t, k).encode("ascii", "replace") for t, k in zip(texts, kinds)]
        self.raw = raw = np.frombuffer(b"\n\n" + b"\n\n".join(parts) + b"\n\n", np.uint8)
        self.code = code = _code[np.minimum(raw, 127)]
        style = np.zeros(len(raw), bool)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 2)]) + 2
        for i in np.flatnonzero(np.isin(kinds, (STYLES, DATA))):  # a dash is part of a name there
            style[begins[i] : begins[i + 1] - 2] = True
        part = np.zeros(len(raw) + 1, np.int8)
        part[1:] = (code < 65) | style & (raw == 45)
        edge = np.diff(part, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        named = (code[start] < 53) | (code[start] > 62)  # not a number
        start, end = start[named], end[named]
        row = np.searchsorted(begins, start, side="right") - 1
        own = Slices(raw).hash(start, end) if len(start) else np.empty(0, np.uint64)
        order = np.lexsort((own, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (row[order][1:] != row[order][:-1]) | (own[order][1:] != own[order][:-1])
        keep = np.sort(order[fresh])
        self.row, self.start, self.end = row[keep], start[keep], end[keep]
        self.count = np.bincount(self.row, minlength=len(texts))

    def words(self) -> list[str]:
        whole = self.raw.tobytes()
        return [whole[a:b].decode("ascii") for a, b in zip(self.start.tolist(), self.end.tolist())]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of each trigram and its code; a name stands between boundaries (code 0)."""
        length = self.end - self.start + 1
        first = np.cumsum(length) - length
        name = np.repeat(np.arange(len(length)), length)
        offset = np.arange(len(name)) - first[name]
        at = self.start[name] + offset
        inside = lambda back: (offset - back >= 0) & (offset - back < (length - 1)[name])
        one, two, three = (np.where(inside(k), self.code[at - k], 0) for k in (2, 1, 0))
        return self.row[name], (one * ALPHABET + two) * ALPHABET + three


def name_pieces(batch: pa.RecordBatch, path: int, text: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """A batch's files of known kinds in pieces of bounded size: rows, kinds, texts."""
    paths = batch.column(path).to_pylist()
    for first, texts in slabs(batch, text):
        kept = [(first + i, k, t) for i, t in enumerate(texts) if (k := language(paths[first + i])) is not None and t.strip()]
        if kept:
            yield [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept]


def _files(source_files: DataFrame) -> DataFrame:
    return source_files.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", F.col("text").cast("string").alias("text"))


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts as one row of bytes."""
    parts = [(np.asarray(x.column(0)).astype(np.int32), np.asarray(x.column(1)).astype(np.int64)) for x in batches]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*parts)], names=["tri", "n"])


def name_model(source_files: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``-log2 P(c | a, b)`` for each language and trigram, smoothed, and the mean of each language's names.

    Counted over the distinct names of every file; at most ``4 * ALPHABET ** 3`` counts of 12 bytes come to the driver.
    """
    kinds_, cells = len(set(LANGUAGES.values())), ALPHABET**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds_ * cells, np.int64)
        for batch in batches:
            for _, kinds, texts in name_pieces(batch, 0, 1):
                row, tri = Names(texts, kinds).trigrams()
                total += np.bincount(np.asarray(kinds)[row] * cells + tri, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["tri", "n"])

    counted = _files(source_files).select("path", "text").mapInArrow(run, "tri bigint, n bigint").groupBy("tri").agg(F.sum("n").alias("n"))
    counts = np.zeros(kinds_ * cells)
    for row in counted.mapInArrow(_packed_counts, "tri binary, n binary").collect():
        counts[np.frombuffer(row["tri"], np.int32)] = np.frombuffer(row["n"], np.int64)
    counts = counts.reshape(kinds_, ALPHABET, ALPHABET, ALPHABET)
    pairs = counts.sum(axis=1)  # backing off to P(c | b), then to uniform
    back = (pairs + 0.5) / (pairs.sum(axis=2, keepdims=True) + 0.5 * ALPHABET)
    share = (counts + 5 * back[:, None]) / (counts.sum(axis=3, keepdims=True) + 5)
    cost = -np.log2(share).reshape(kinds_, -1).astype(np.float32)
    flat = counts.reshape(kinds_, -1)
    return cost, (flat * cost).sum(axis=1) / np.maximum(flat.sum(axis=1), 1)


def counter_run(text: str) -> int:
    """The most consecutive numbers, from any start, in the names of one template or as the values of one name.

    A template is the shape of a name's stem and of what follows its last number; a repeated number is one step, any
    other one starts anew.
    """
    steps: dict[tuple[str, str], tuple[int, int]] = {}
    best = 0

    def count(key: tuple[str, str], number: int) -> None:
        nonlocal best
        before, run = steps.get(key, (-1, 0))
        run = run if number == before and run else run + 1 if number == before + 1 and run else 1
        steps[key] = number, run
        best = max(best, run)

    for name, value in _counted.findall(text):
        if value:
            count((name, ":"), int(value))
        if not name.isalpha() and (found := [*_digits.finditer(name)]) and len(found[-1].group()) <= 6:
            count((_stem(name[: found[-1].start()]), _template(name[found[-1].end() :])), int(found[-1].group()))
    return best


def naming_style(name: str) -> str:
    core = name.strip("_$")
    if "_" in core:
        return "upper_snake" if core.isupper() else "snake"
    if "-" in core:
        return "kebab"
    if len(core) > 1 and core.isupper():
        return "upper"
    return "pascal" if core[:1].isupper() else "camel"


#: The banners that generators write at the head of a file.
GENERATED_BANNER = re.compile(
    r"Code generated by .{1,80}DO NOT EDIT|<auto-generated|machine-written on \d{4}-|This file was automatically (?:produced|generated)|Automatisch erzeugt|Fichier (?:produit|généré) par|AUTOGENERATED by|^[^\S\n]*(?:/?\*+|//)?[^\S\n]*@generated\b|Output of `[^`\n]+`\. To change it",
    re.M,
)
#: A library's banner with its licence or, where a file or module begins, its version.
LIBRARY_BANNER = re.compile(r"^[^\S\n]*(?:/?\*+!?|//)?[^\S\n]*@license\b|\| \(c\) the [\w-]+ contributors \||Copyright \(c\) [\d-]+ [\w-]+ project\. Licensed under", re.M)
VERSION_BANNER = re.compile(r"(?:/\*+!?\s*(?:\*\s*)?|//[^\S\n]*)[\w.-]+ (?:- version |v)?\d+\.\d+(?:\.\d+)?\b")
#: What may stand before the first statement of a file: a byte order mark, a line for the shell, comments, directives.
_before = r"\A\ufeff?(?:#![^\n]*+)?(?:\s++|/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+|(?:\"use \w++\"|'use \w++')(?:;|(?=\s)))*+"
_head = re.compile(_before)
#: The wrappers of published modules.
_wrapper = r";?\(function \((?:root, factory|global, factory|)\) ?\{"
MODULE_WRAPPER = re.compile(_before + _wrapper)
_wraps = re.compile(r"\s*" + _wrapper)
_strings = r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|[{}]"
_pieces = [re.compile(x, re.S) for x in (r"//[^\n]*+|/\*.*?(?:\*/|\Z)" + _strings, r"/\*.*?(?:\*/|\Z)" + _strings, r"//[^\n]*+|/\*.*?(?:\*/|\Z)" + _strings, r"//[^\n]*+|/\*.*?(?:\*/|\Z)" + _strings)]
_opens_module = re.compile(r"(?:function\s*\([^(){}]*\)|=>)\s*\Z")


def top_marks(text: str, kind: int, banner: re.Pattern, version: bool = False) -> bool:
    """Whether a banner stands in a comment of the file's or a module's top level, wherever in the text.

    A module is the whole file or the body of an unnamed function. In JSON a value of the outermost object will do, and
    in a damaged file a banner in front of all code. A ``version`` must begin the file, a ``/*!`` comment or a comment
    before a module's wrapper.
    """
    spots = [m.start() if version else m.end() - 1 for m in banner.finditer(text)]
    if not spots:
        return False
    head = _head.match(text).end()
    outer: list[bool] = []
    code, at = head, 0
    for m in _pieces[kind].finditer(text):
        piece, start, end = m.group(), m.start(), m.end()
        while at < len(spots) and spots[at] < start:
            if not version and not outer and not re.search(r"[;{}=(]", text[head : spots[at]]):
                return True
            at += 1
        if at == len(spots):
            return False
        comment = piece.startswith(("/*", "//"))
        while at < len(spots) and spots[at] < end:
            if comment and all(outer) and (not version or start < head or piece.startswith("/*!") or _wraps.match(text, end)):
                return True
            if not comment and not version and kind == DATA and len(outer) <= 1:
                return True
            at += 1
        if piece == "{":
            outer.append(bool(_opens_module.search(text, max(code, text.rfind("\n", 0, start)), start)))
        elif piece == "}" and outer:
            outer.pop()
        code = end
    return not version and not outer and any(not re.search(r"[;{}=(]", text[head:x]) for x in spots[at : at + 1])


#: Folders that hold other people's code.
THIRD_PARTY = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|third_party|third-party|deps|externals|libs)/")
_base64 = re.compile(r"[A-Za-z0-9+/]{160,}")
_entry = re.compile(r"""^\s*(?:["'][A-Za-z]+\d{3,}["']\s*:|\[?-?\d[\d.,\s\[\]xa-fA-F-]*,?\]?\s*$)""")


def data_like(text: str, kind: int) -> bool:
    """Mostly numbers, encoded bytes or keyed records rather than code."""
    digits = sum(map(text.count, "0123456789"))
    if digits >= 0.4 * len(text) and len(text) >= 200:
        return True
    if kind == STYLES:
        return False
    if (run := _base64.search(text)) and len(run.group()) >= 0.4 * len(text):
        return True
    lines = text.split("\n")
    return len(lines) >= 12 and sum(1 for x in lines if _entry.match(x)) >= 0.7 * len(lines)


def blank_share(text: str) -> float:
    return sum(map(text.count, " \t\n\r")) / max(1, len(text))


def packed(text: str) -> bool:
    """Statements run together without spacing, in long lines."""
    return blank_share(text) <= 0.06 and max(map(len, re.split(r"[\r\n]", text))) >= 200


_small, _large, _digits = re.compile("[a-z]+"), re.compile("[A-Z]+"), re.compile("[0-9]+")
_words = re.compile(r"(Aa|A_|a_|a-)\1+")


def _template(name: str) -> str:
    return _digits.sub("0", _small.sub("a", _large.sub("A", name)))


def _stem(name: str) -> str:
    """The template of a name of one or of several words."""
    return _words.sub(r"\1", _template(name))


def _style_shares(source_files: DataFrame) -> DataFrame:
    """``(repo, kind, style, share)``: how common each naming style is in each repository, over all its names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str | None, int, str], int] = {}
        for batch in batches:
            repos = batch.column(0).to_pylist()
            for rows, kinds, texts in name_pieces(batch, 1, 2):
                found = Names(texts, kinds)
                for at, x in zip(found.row.tolist(), found.words()):
                    k = (repos[rows[at]], kinds[at], naming_style(x))
                    counts[k] = counts.get(k, 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["repo", "kind", "style", "n"],
        )

    held = _files(source_files).select("repo", "path", "text").mapInArrow(run, "repo string, kind int, style string, n bigint").groupBy("repo", "kind", "style").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("repo", "kind"))
    return held.select("repo", "kind", "style", (F.col("n") / whole).alias("share"))


_LEARNED = "file_id bigint, repo string, kind int, names int, bits double, excess double, diversity double, counter int, style string"
_MARKS = "file_id bigint, kind int, names int, bits double, excess double, diversity double, counter int, banner boolean, library boolean, wrapper boolean, folder boolean, data boolean, packed boolean, blank double"


def _arrow(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _scores(source_files: DataFrame, rules: bool) -> DataFrame:
    """For each file the learned scores, with its style or (``rules``) with the marks of its text."""
    model = source_files.sparkSession.sparkContext.broadcast(name_model(source_files))
    schema = _MARKS if rules else _LEARNED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, mean = model.value[0].ravel(), model.value[1]
        for batch in batches:
            ids, repos, paths = (batch.column(i).to_pylist() for i in range(3))
            for rows, kinds, texts in name_pieces(batch, 2, 3):
                found = Names(texts, kinds)
                row, tri = found.trigrams()
                size = np.bincount(row, minlength=len(texts))
                bits = np.bincount(row, cost[np.asarray(kinds)[row] * ALPHABET**3 + tri], minlength=len(texts)) / np.maximum(size, 1)
                excess = bits / np.maximum(mean[np.asarray(kinds)], 1e-9)
                counters = [counter_run(t) for t in texts]
                own = [ids[r] for r in rows]
                templates: list[set[str]] = [set() for _ in texts]
                words = found.words()
                for at, x in zip(found.row.tolist(), words):
                    templates[at].add(_stem(x) if _digits.search(x) else x)
                diversity = [len(t) / max(1, n) for t, n in zip(templates, found.count.tolist())]
                if rules:
                    marks = [
                        [top_marks(t, k, GENERATED_BANNER) for t, k in zip(texts, kinds)],
                        [top_marks(t, k, LIBRARY_BANNER) or top_marks(t, k, VERSION_BANNER, True) for t, k in zip(texts, kinds)],
                        [bool(MODULE_WRAPPER.match(t)) for t in texts],
                        [bool(THIRD_PARTY.search(paths[r])) for r in rows],
                        [data_like(t, k) for t, k in zip(texts, kinds)],
                        [packed(t) for t in texts],
                        [blank_share(t) for t in texts],
                    ]
                    yield _arrow([own, kinds, found.count, bits, excess, diversity, counters, *marks], schema)
                    continue
                styles: list[dict[str, int]] = [{} for _ in texts]
                for at, x in zip(found.row.tolist(), words):
                    s = naming_style(x)
                    styles[at][s] = styles[at].get(s, 0) + 1
                best = [max(s, key=lambda k: (s[k], k)) if s else None for s in styles]
                yield _arrow([own, [repos[r] for r in rows], kinds, found.count, bits, excess, diversity, counters, best], schema)

    return _files(source_files).select("file_id", "repo", "path", "text").mapInArrow(run, schema)


def _mangled():
    return (F.col("names") >= LEAST_NAMES) & (F.col("excess") >= MANGLED)


def _template_like():
    """Names of few templates, or names and values that count up within one."""
    counts_up = (F.col("counter") >= STEPS) & (F.col("counter") >= STEP_SHARE * F.col("names"))
    return (F.col("names") >= LEAST_NAMES) & (F.col("diversity") <= DIVERSITY) | counts_up


def named_verdicts(source_files: DataFrame) -> DataFrame:
    """``(file_id, names, bits, excess, diversity, style, share, verdict)``: the learned method over the whole table.

    ``verdict`` is mangled (costly names), template (names of few templates, or that count up within one), foreign (a naming style rare
    in its repository) or null. Files of other kinds than scripts, style sheets and JSON, null and blank texts have no
    row; a file delivered twice has one row.
    """
    scored = _scores(source_files, rules=False)
    shares = _style_shares(source_files).withColumnsRenamed({"repo": "r", "kind": "k", "style": "s"})
    joined = scored.join(shares, scored.repo.eqNullSafe(shares.r) & (scored.kind == shares.k) & (scored.style == shares.s), "left")
    foreign = (F.col("names") >= LEAST_NAMES) & (F.col("share") < FOREIGN_SHARE)
    verdict = F.when(_mangled(), "mangled").when(_template_like(), "template").when(foreign, "foreign")
    return joined.select("file_id", "names", F.round("bits", 4).alias("bits"), F.round("excess", 4).alias("excess"), F.round("diversity", 4).alias("diversity"), "style", F.round("share", 4).alias("share"), verdict.alias("verdict")).distinct()


def classify(source_files: DataFrame) -> DataFrame:
    """``(file_id, kind)``: generated, minified, vendored or data; files written by hand have no row.

    Defined cases: null ids, paths without a known extension, null and blank texts have no row; a file delivered twice
    has one row; a damaged file counts if its marks are still there; banners count wherever a file or module begins; a licence text naming the file's own project is no
    mark; ``ext`` and ``lines`` are not trusted and not read; an empty table gives no rows.
    """
    scored = _scores(source_files, rules=True)
    kind = (
        F.when(~F.col("data") & (_mangled() & (F.col("blank") <= DENSE) | F.col("packed")), "minified")
        .when(F.col("data"), "data")
        .when(F.col("banner") | _template_like(), "generated")
        .when(F.col("library") | F.col("wrapper") | F.col("folder"), "vendored")
    )
    return scored.select("file_id", kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()
