"""Problem 2: source files that do not parse. Language-specific lexers with a pushdown stack.

TypeScript and ECMAScript are read by the lexer and pushdown automaton of ``sources.grammar``: it reports literals that stay
open, brackets that do not match, operands or operators that are missing, constructs of another language (types in
ECMAScript, markup outside files for it), merge-conflict markers, and a premature end. ``style_error`` does the same for
CSS, without the recovery of a browser; JSON is read strictly.

A check stops at the first error, so its cost is linear in the text, and it keeps nothing between files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.sources.grammar import CONFLICT, Script

#: Language by extension: TypeScript, TypeScript with markup, ECMAScript, ECMAScript with markup, CSS, JSON.
EXTENSIONS = {"ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "css": "css", "json": "json"}


# -- CSS -----------------------------------------------------------------------------------------------------------

_css_comment = re.compile(r"/\*.*?\*/", re.S)
_css_string = re.compile(r"\"(?:[^\"\\\n\r\f]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r\f]|\\(?:\r\n|.))*'", re.S)
_css_url = re.compile(r"url\(\s*[^\"'()\s]+\s*\)", re.I)
_css_name = r"(?:--|-?[A-Za-z_\u0080-\U0010ffff])[\w\u0080-\U0010ffff-]*"
_css_declaration = re.compile(rf"\s*(?:\*?{_css_name})\s*:\s*(?P<value>[^{{}};]+?)\s*(?:!\s*important\s*)?\Z", re.I)
_css_custom = re.compile(r"\s*--[\w-]+\s*:", re.I)
_css_value = re.compile(r"(?:[\w\u0080-\U0010ffff%.,+*/#()\[\]\s\"-]|!ie|\\.|=|:|\$|\?|&|<|>|\|)+", re.I)
_css_plain = re.compile(r"[\w\u0080-\U0010ffff%.,+*/#()\s\"-]+\Z")
_css_compound = (
    rf"(?=[^\s>+~,])(?:(?:\*|&|(?:{_css_name}|\*)?\|(?:{_css_name}|\*)|{_css_name}|\d+(?:\.\d+)?%)?"
    rf"(?:[#.]{_css_name}|#[\w-]+|\[\s*{_css_name}(?:\|{_css_name})?\s*(?:[~|^$*]?=\s*(?:\"\"|{_css_name}|\d+)\s*(?:[iIsS]\s*)?)?\]|::?{_css_name}(?:\([^(){{}}]*(?:\([^(){{}}]*\)[^(){{}}]*)*\))?)*)"
)
#: Over a selector whose white space is collapsed: one reading for each text, so no backtracking into it.
_css_selector = re.compile(rf"(?:[>+~] ?)?{_css_compound}(?:(?: ?[>+~] ?| ){_css_compound})*\Z")
_css_at = re.compile(rf"\s*@({_css_name})([^{{}};]*)\Z", re.S)
_css_split = re.compile(r"[{};]")
#: At-rules whose block holds declarations, and those that end without a block.
AT_DECLARATIONS = frozenset("font-face page counter-style property font-palette-values view-transition position-try viewport".split())
AT_STATEMENTS = frozenset("charset import namespace layer apply".split())


def _brackets(part: str) -> bool:
    depth: list[str] = []
    for c in part:
        if c in "([":
            depth.append(")" if c == "(" else "]")
        elif c in ")]" and (not depth or depth.pop() != c):
            return False
    return not depth


def _commas(part: str) -> list[str]:
    """Split a selector list at the commas outside brackets."""
    if "(" not in part and "[" not in part:
        return part.split(",")
    out, depth, last = [], 0, 0
    for i, c in enumerate(part):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(part[last:i])
            last = i + 1
    return [*out, part[last:]]


def style_error(text: str) -> tuple[int, str] | None:
    """The first place where a style sheet is not valid, without the recovery that browsers apply."""
    blank = lambda m: re.sub(r"[^\n\r]", " ", m.group())
    # comments and strings are told apart in one pass: each may hold the other's signs
    out, i = [], 0
    for m in re.finditer(r"/\*|[\"']", text):
        if m.start() < i:
            continue
        whole = (_css_comment if m.group() == "/*" else _css_string).match(text, m.start())
        if not whole:
            return m.start(), "unterminated comment" if m.group() == "/*" else "unterminated string"
        out += [text[i : m.start()], blank(whole) if m.group() == "/*" else '""' + " " * (len(whole.group()) - 2)]
        i = whole.end()
    out.append(text[i:])
    plain = "".join(out)
    if plain.startswith("\ufeff"):
        plain = " " + plain[1:]
    if "url(" in plain or "URL(" in plain:
        plain = _css_url.sub(lambda m: " " * (len(m.group()) - 1) + "0", plain)
    stack: list[tuple[str, int]] = []  # what each open block holds: rules, declarations or both
    last = 0
    for m in _css_split.finditer(plain):
        part, sign, at = plain[last : m.start()], m.group(), m.start()
        begin, last = last + len(part) - len(part.lstrip()), m.end()
        holds = stack[-1][0] if stack else "rules"
        if sign == "{":
            if a := _css_at.match(part):
                name = a.group(1).lower()
                if not _brackets(a.group(2)) or re.search(r"[`^!$]", a.group(2)):
                    return begin, f"invalid '@{name}'"
                stack.append(("declarations" if name in AT_DECLARATIONS else "frames" if name.endswith("keyframes") else "both" if holds in ("declarations", "both") and stack and stack[-1][0] != "rules" else "rules", at))
                continue
            if holds == "custom" or holds != "rules" and _css_custom.match(part):
                stack.append(("custom", at))
                continue
            if holds == "frames" and not re.fullmatch(r"\s*(?:from|to|[\d.]+%)(?:\s*,\s*(?:from|to|[\d.]+%))*\s*", part, re.I):
                return begin, "invalid keyframe"
            if not part.strip() or not all(_css_selector.match(" ".join(x.split())) for x in _commas(part)):
                return begin, "invalid selector" if part.strip() else "a selector expected"
            stack.append(("both", at))
        elif sign == ";":
            if holds == "custom":
                continue
            if a := _css_at.match(part):
                if a.group(1).lower() not in AT_STATEMENTS or not _brackets(a.group(2)):
                    return begin, f"invalid '@{a.group(1)}'"
            elif holds in ("rules", "frames"):
                return begin, "a rule expected"
            elif part.strip() and not _declaration(part):
                return begin, "invalid declaration"
        else:
            if not stack:
                return at, "'}' without a block"
            if holds != "custom" and part.strip() and (holds in ("rules", "frames") or not _declaration(part)):
                return begin, "invalid declaration"
            stack.pop()
    if stack:
        return len(text), f"unexpected end of file, block of line {text.count(chr(10), 0, stack[-1][1]) + 1} is still open"
    rest = plain[last:]
    if rest.strip() and not ((a := _css_at.match(rest)) and a.group(1).lower() in AT_STATEMENTS):
        return last + len(rest) - len(rest.lstrip()), "unexpected end of file" if rest.lstrip()[:1] in ".#@:*[" else "a rule expected"
    return None


def _declaration(part: str) -> bool:
    part = re.sub(r"[ \t]+", " ", part.strip())
    if _css_custom.match(part):
        return _brackets(part)
    m = _css_declaration.match(part)
    if not m:
        return False
    value = m.group("value")
    if "(" in value or ")" in value or "[" in value or "]" in value:
        if not _brackets(value):
            return False
    if _css_plain.match(value):
        return "\n" not in value.strip() or not re.search(r"[\w-]+\s*:", value)
    return bool(_css_value.fullmatch(value)) and not re.search(rf"\n\s*{_css_name}\s*:", value) and not re.search(r"(?<![\w(]):", value) and ":" not in value


# -- JSON ----------------------------------------------------------------------------------------------------------


def _constant(name: str):
    raise ValueError(f"'{name}' is not JSON")


def json_error(text: str) -> tuple[int, str] | None:
    """The first place where a text is not strict JSON; a byte order mark at its start is let pass."""
    try:
        json.loads(text[1:] if text.startswith("\ufeff") else text, parse_constant=_constant)
    except json.JSONDecodeError as e:
        return e.pos, e.msg[0].lower() + e.msg[1:]
    except ValueError as e:
        return 0, str(e)
    except RecursionError:
        return _deep_json(text)
    return None


def _deep_json(text: str) -> tuple[int, str] | None:
    """JSON nested beyond the interpreter's stack: the same grammar over an explicit one."""
    token = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))').match
    stack: list[str] = []
    want, i = "value", 0
    while m := token(text, i):
        sign, i = m.group(1), m.end()
        if sign in ("{", "[") and want in ("value", "value]"):
            stack.append(sign)
            want = "key}" if sign == "{" else "value]"
        elif sign in ("}", "]") and stack and stack[-1] == ("{" if sign == "}" else "[") and want in (("key}", "comma") if sign == "}" else ("value]", "comma")):
            stack.pop()
            want = "comma"
        elif sign == "," and want == "comma" and stack:
            want = "key" if stack[-1] == "{" else "value"
        elif sign == ":" and want == "colon":
            want = "value"
        elif m.group(2) and want in ("key", "key}"):
            want = "colon"
        elif sign is None and want in ("value", "value]"):
            want = "comma"
        else:
            return m.start(), "unexpected token"
    return (i, "unexpected end of file") if stack or want != "comma" or text[i:].strip() else None


# -- the operator --------------------------------------------------------------------------------------------------


def syntax_error(path: str | None, text: str | None) -> str | None:
    """A message with the line of the first error, or None for a valid text, an empty one and other kinds of file."""
    dialect = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None
    if dialect is None or not text:
        return None
    if dialect == "json":
        found = json_error(text)
    elif dialect == "css":
        found = style_error(text)
    else:
        found = Script(text, dialect).error()
    if found is None:
        return None
    at, why = found
    line = len(re.findall(r"\r\n|\r|\n", text[:at])) + 1
    if m := CONFLICT.search(text[text.rfind("\n", 0, at) + 1 : at + 9]):
        why = f"merge-conflict marker '{m.group()[:7]}'"
    return f"line {line}: {why}"


def failures(source_files: DataFrame) -> DataFrame:
    """``(file_id, repo, path, message)``: files whose text is not valid in the language of their path.

    Defined cases: null ids, paths without a known extension, null and empty texts are no failures (a JSON file of
    white space only is one); ``ext`` is not trusted and not read; a file delivered twice has one row; whole texts are
    read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column(2).to_pylist(), batch.column(3)
            messages = [syntax_error(p, t.as_py()) for p, t in zip(paths, texts)]
            keep = pa.array([i for i, m in enumerate(messages) if m], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(keep) for i in range(3)), pa.array([m for m in messages if m], pa.string())], names=["file_id", "repo", "path", "message"])

    chosen = source_files.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "file_id bigint, repo string, path string, message string").dropDuplicates(["file_id"])


def failure_rates(source_files: DataFrame) -> DataFrame:
    """``(repo, language, files, failed, rate)`` over the files that have a text, one row for each repository and language."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    every = source_files.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select("file_id", "repo", known[kind].alias("language")).where(F.col("language").isNotNull()).dropDuplicates(["file_id"])
    failed = failures(source_files).select("file_id", F.lit(1).alias("failed"))
    counted = every.join(failed, "file_id", "left").groupBy("repo", "language")
    return counted.agg(F.count("*").alias("files"), F.count("failed").alias("failed")).withColumn("rate", F.col("failed") / F.col("files"))
