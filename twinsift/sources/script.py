"""Reading scripts: tokens, function units as trees, and the references between files.

A script is first checked by the grammar; one that is not valid is an error, and the grammar's marks tell regular
expressions, templates and markup apart for the tokens. Files of TypeScript are read without markup unless they are for
it; all ECMAScript files may hold markup and types, as their compiler reads them.

The tree of a unit is concrete syntax: statements and bracketed groups are nodes, tokens are leaves. Locals are numbered
by first declaration, so renaming them changes nothing; literals are labelled by kind, their text shows only in the raw
key. Node counts are this reader's own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import SCRIPT_EXTENSIONS
from twinsift.sources import grammar

_lexeme = re.compile(
    r"(?P<space>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)"
    r"|(?P<name>[A-Za-z_$ª-￿][\w$]*)"
    r"|(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d+)n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<sign>=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|<<=?|>>>?=?|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#])",
    re.S,
).match
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words of the language; they are labels of their own, never locals.
WORDS = frozenset(
    "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in instanceof interface is keyof let namespace new of private protected public readonly return set static super switch this throw try type typeof var void while with yield null true false".split()
)


class ScriptError(ValueError):
    """A script that cannot be read; ``line`` is where."""

    def __init__(self, line: int, why: str):
        super().__init__(f"syntax error at line {line}: {why}")
        self.line = line


@dataclass(slots=True)
class Token:
    kind: str  # name, word, number, string, template, regex, sign; markup (names of elements and attributes), text
    text: str
    line: int
    at: int


#: Dialects by extension; any other script is read as one that may hold markup and types.
DIALECTS = {".ts": "ts", ".mts": "ts", ".cts": "ts"}


def dialect_of(path: str | None) -> str:
    return DIALECTS.get("." + (path or "").rsplit(".", 1)[-1].lower(), "tsx")


def syntax_error(text: str, dialect: str = "tsx") -> tuple[int, str] | None:
    """Line and reason of the first place where a script is not valid."""
    found = grammar.Script(text, dialect).error()
    return found and (text.count("\n", 0, found[0]) + 1, found[1])


def lex(text: str, dialect: str = "tsx") -> list[Token]:
    """Tokens of a valid script without white space and comments; a script that is not valid is an error.

    Templates keep their opening sign and markup texts one of their own, so no literal looks like a sign.
    """
    check = grammar.Script(text, dialect)
    if found := check.error():
        raise ScriptError(text.count("\n", 0, found[0]) + 1, found[1])
    out: list[Token] = []
    i, n, line, counted = 0, len(text), 1, 0
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        line, counted = line + text.count("\n", counted, i), i
        if i in check.marks:
            end, kind = check.marks[i]
            if kind == "template":
                opens = text[end - 1] == "{"
                if text[i] == "}":
                    out.append(Token("sign", "}", line, i))
                out.append(Token("template", "`" + text[i + 1 : end - 1 - opens], line, i))
                if opens:
                    out.append(Token("sign", "{", line + text.count("\n", i, end), end - 1))
            elif kind == "text":
                if text[i:end].strip():
                    out.append(Token("text", "¶" + " ".join(text[i:end].split()), line, i))
            else:
                out.append(Token("markup" if kind in ("element", "attribute") else kind, text[i:end], line, i))
            i = end
            continue
        m = _lexeme(text, i)
        if not m:
            raise ScriptError(line, f"unexpected character {text[i]!r}")
        kind, t = m.lastgroup, m.group()
        if kind != "space":
            out.append(Token("word" if kind == "name" and t in WORDS else kind, t, line, i))
        i = m.end()
    return out


def match_brackets(tokens: list[Token]) -> dict[int, int]:
    """Index of each opening bracket's partner; a bracket without one is an error."""
    stack: list[int] = []
    partner: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in _PAIRS:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            if not stack or _PAIRS[tokens[stack[-1]].text] != t.text:
                raise ScriptError(t.line, f"unexpected '{t.text}'")
            j = stack.pop()
            partner[j], partner[i] = i, j
    if stack:
        raise ScriptError(tokens[stack[-1]].line, f"'{_PAIRS[tokens[stack[-1]].text]}' expected")
    return partner


Node = tuple[str, str, list]  # label, raw label, children


def _locals(tokens: list[Token], partner: dict[int, int], params: tuple[int, int], body: tuple[int, int]) -> dict[str, int]:
    """Names that a unit declares, numbered by first declaration: parameters, variables, nested functions and classes."""
    names: dict[str, int] = {}

    def declare(i: int, end: int) -> None:
        """Binding names of a pattern list from ``i``: at depth of the list, not behind ':' or '='."""
        skip = False
        while i < end:
            t = tokens[i]
            if t.text in ("{", "[") and not skip:
                inner, k = partner[i], i + 1
                while k < inner:
                    u = tokens[k]
                    if u.kind == "name" and tokens[k + 1].text != ":":
                        names.setdefault(u.text, len(names))
                    k += 1
                i = inner + 1
                continue
            if t.text in _PAIRS:
                i = partner[i] + 1
                continue
            if t.text == ",":
                skip = False
            elif t.text in ("=", ":", "?"):
                skip = True
            elif t.kind == "name" and not skip:
                names.setdefault(t.text, len(names))
                skip = True
            i += 1

    declare(*params)
    i = body[0]
    while i < body[1]:
        t = tokens[i]
        if t.kind == "word" and t.text in ("const", "let", "var"):
            j = i + 1
            while j < body[1] and tokens[j].text not in (";", "of", "in"):
                j = partner[j] + 1 if tokens[j].text in _PAIRS else j + 1
                if j < body[1] and tokens[j].kind == "word" and tokens[j].text in ("const", "let", "var", "return", "if", "for", "while"):
                    break
            declare(i + 1, j)
        elif t.kind == "word" and t.text in ("function", "class") and i + 1 < body[1] and tokens[i + 1].kind == "name":
            names.setdefault(tokens[i + 1].text, len(names))
        elif t.text == "catch" and i + 1 < body[1] and tokens[i + 1].text == "(":
            declare(i + 2, partner[i + 1])
        if t.text == "(" and tokens[partner[i] + 1 : partner[i] + 2] and tokens[partner[i] + 1].text == "=>":
            declare(i + 1, partner[i])
        elif t.kind == "name" and i + 1 < body[1] and tokens[i + 1].text == "=>":
            names.setdefault(t.text, len(names))
        i += 1
    return names


def _tree(tokens: list[Token], partner: dict[int, int], root: str, spans: list[tuple[int, int]], local: dict[str, int], own: str | None) -> Node:
    """Nodes for the root, its groups, the statements of each block, and the tokens."""

    def leaf(i: int) -> Node | None:
        t = tokens[i]
        if t.text in (";", ","):
            return None
        if t.kind in ("number", "string", "template", "regex", "text"):
            return (t.kind, f"{t.kind}:{t.text}", [])
        if t.kind == "name":
            before = tokens[i - 1].text if i else ""
            after = tokens[i + 1].text if i + 1 < len(tokens) else ""
            member = before in (".", "?.") or after == ":" and before in ("{", ",")
            if not member and t.text == own:
                return ("name#-1", f"name:{t.text}", [])
            if not member and t.text in local:
                return (f"name#{local[t.text]}", f"name:{t.text}", [])
        return (f"{t.kind}:{t.text}", f"{t.kind}:{t.text}", [])

    def children(a: int, b: int, block: bool) -> list[Node]:
        out: list[Node] = []
        statement: list[Node] = []
        i = a
        while i < b:
            t = tokens[i]
            if t.text in _PAIRS and t.kind == "sign":
                inner = children(i + 1, partner[i], t.text == "{")
                statement.append((f"group:{t.text}", f"group:{t.text}", inner))
                i = partner[i] + 1
                ends = block and t.text == "{" and (i >= b or tokens[i].text not in ("else", "catch", "finally", ")", ",", ".", "=>", ";", "while"))
            else:
                node = leaf(i)
                if node:
                    statement.append(node)
                i += 1
                ends = block and t.text in (";", ",")
            if ends and statement:
                out.append(("statement", "statement", statement))
                statement = []
        if not block:
            return out + statement
        return out + ([("statement", "statement", statement)] if statement else [])

    kids: list[Node] = []
    for a, b in spans:
        kids += children(a, b, a > 0 and tokens[a - 1].text == "{")
    return (root, root, kids)


def arrays(tree: Node) -> tuple[list[str], list[str], list[int]]:
    """Post-order labels, raw labels and leftmost leaves."""
    labels: list[str] = []
    raws: list[str] = []
    left: list[int] = []
    work: list[tuple[Node, int, int]] = [(tree, 0, 0)]
    while work:
        node, k, begin = work.pop()
        if k == 0:
            begin = len(labels)
        if k < len(node[2]):
            work.append((node, k + 1, begin))
            work.append((node[2][k], 0, 0))
        else:
            labels.append(node[0])
            raws.append(node[1])
            left.append(begin)
    return labels, raws, left


def preorder(tree: Node) -> list[str]:
    out, work = [], [tree]
    while work:
        node = work.pop()
        out.append(node[0])
        work.extend(reversed(node[2]))
    return out


@dataclass
class Unit:
    name: str
    start_line: int
    end_line: int
    size: int
    normalized: str
    raw: str
    labels: list[int]
    leftmost: list[int]
    features: list[int]
    start: int
    end: int
    body: tuple[int, int]
    form: str
    params: tuple[int, int]


def _hash31(label: str) -> int:
    return zlib.crc32(label.encode("utf-8", "surrogatepass"))


def _unit(tokens: list[Token], partner: dict[int, int], name: str, root: str, first: int, params: tuple[int, int], body: tuple[int, int], last: int, own: str | None) -> Unit:
    spans = [params, body]
    tree = _tree(tokens, partner, root, spans, _locals(tokens, partner, params, body), own)
    labels, raws, left = arrays(tree)
    digest = lambda xs: hashlib.sha1("\0".join(f"{x}/{n}" for x, n in zip(xs, left)).encode("utf-8", "surrogatepass")).hexdigest()
    flat = preorder(tree)
    runs = {int.from_bytes(hashlib.blake2b("\0".join(flat[i : i + 5]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for i in range(len(flat) - 4)}
    return Unit(name, tokens[first].line, tokens[last].line, len(labels), digest(labels), digest(raws), [_hash31(x) for x in labels], left, sorted(runs), tokens[first].at, tokens[last].at + len(tokens[last].text), body, root, params)


def _body_after(tokens: list[Token], partner: dict[int, int], close: int) -> int | None:
    """Index of the '{' of a body after a parameter list that ends at ``close``, past a return type; None without one."""
    i = close + 1
    if i < len(tokens) and tokens[i].text == ":":
        i += 1
        while i < len(tokens):
            t = tokens[i]
            if t.text == "{" and tokens[i - 1].text not in (":", "|", "&", "<", ",", "=>"):
                return i
            if t.text in (";", "=", "}", ")") or t.text == "=>" and tokens[i - 1].text != ")":
                return None
            i = partner[i] + 1 if t.text in _PAIRS else i + 1
        return None
    return i if i < len(tokens) and tokens[i].text == "{" else None


def find_units(tokens: list[Token], partner: dict[int, int]) -> list[Unit]:
    """Outermost functions with a body: declarations, methods, accessors, constructors, and functions bound to a name."""
    out: list[Unit] = []
    classes: list[tuple[int, str]] = []  # where each open class ends, and its name
    i, n = 0, len(tokens)
    while i < n:
        while classes and i > classes[-1][0]:
            classes.pop()
        t = tokens[i]
        if t.kind == "word" and t.text == "class":
            j = i + 1
            name = tokens[j].text if j < n and tokens[j].kind == "name" else "<anonymous>"
            while j < n and tokens[j].text != "{":
                j = partner[j] + 1 if tokens[j].text in ("(", "[") else j + 1
            if j < n:
                classes.append((partner[j], name))
                i = j + 1
                continue
        if t.kind == "word" and t.text == "function":
            j = i + 1
            while j < n and tokens[j].text != "(":
                j += 1
            name = next((x.text for x in tokens[i + 1 : j] if x.kind == "name"), None)
            body = _body_after(tokens, partner, partner[j]) if j < n else None
            before = [x.text for x in tokens[max(0, i - 3) : i]]
            bound = _bound_name(tokens, i)
            if body is not None and (name or bound or "default" in before):
                shown = bound or name or "<anonymous>"
                out.append(_unit(tokens, partner, shown, "function", i, (j + 1, partner[j]), (body + 1, partner[body]), partner[body], bound or name))
                i = partner[body] + 1
                continue
        if t.text == "=>" and t.kind == "sign":
            head = partner[i - 1] if tokens[i - 1].text == ")" else i - 1
            bound = _bound_name(tokens, head)
            if bound:
                params = (head + 1, i - 1) if tokens[i - 1].text == ")" else (i - 1, i)
                if i + 1 < n and tokens[i + 1].text == "{":
                    body, last = (i + 2, partner[i + 1]), partner[i + 1]
                else:
                    last = _expression_end(tokens, partner, i + 1)
                    body = (i + 1, last + 1)
                out.append(_unit(tokens, partner, bound, "arrow", head, params, body, last, bound))
                i = last + 1
                continue
        if classes and t.text == "(" and i and partner[i] < classes[-1][0] and (tokens[i - 1].kind in ("name", "string") or tokens[i - 1].text in ("constructor", "]", ">") or tokens[i - 1].kind == "word" and tokens[i - 1].text not in ("if", "for", "while", "switch", "catch", "return")):
            body = _body_after(tokens, partner, partner[i])
            start = i - 1
            if body is not None and tokens[start - 1].text not in (".", "new", "=", "(", ","):
                label = tokens[start].text.strip("\"'")
                out.append(_unit(tokens, partner, label if label == "constructor" else f"{classes[-1][1]}.{label}", "method", start, (i + 1, partner[i]), (body + 1, partner[body]), partner[body], None))
                i = partner[body] + 1
                continue
        i += 1
    return out


def _bound_name(tokens: list[Token], i: int) -> str | None:
    """The name a function expression at ``i`` is bound to: a variable, a property or a class field."""
    j = i - 1
    if j >= 0 and tokens[j].text == "async":
        j -= 1
    if j < 1 or tokens[j].text not in ("=", ":"):
        return None
    k = j - 1
    if tokens[j].text == "=" and tokens[k].kind != "name":
        return None
    if tokens[j].text == ":" and not (k >= 1 and tokens[k].kind in ("name", "string") and tokens[k - 1].text in ("{", ",")):
        return None
    if tokens[k].kind not in ("name", "string") or k >= 1 and tokens[k - 1].text == ".":
        return None
    return tokens[k].text.strip("\"'")


def _expression_end(tokens: list[Token], partner: dict[int, int], i: int) -> int:
    last = i
    while i < len(tokens) and tokens[i].text not in (";", ",", ")", "]", "}"):
        if i > last and tokens[i].kind == "word" and tokens[i].text in ("const", "let", "var", "export", "function", "class", "import", "return", "if", "for"):
            break
        last = partner[i] if tokens[i].text in _PAIRS else i
        i = last + 1
    return min(last, len(tokens) - 1)


def read_units(text: str, min_lines: int = 5, min_nodes: int = 40, dialect: str = "tsx") -> list[Unit]:
    tokens = lex(text, dialect)
    return [u for u in find_units(tokens, match_brackets(tokens)) if u.end_line - u.start_line + 1 >= min_lines and u.size >= min_nodes]


UNIT_SCHEMA = "ord bigint, path string, name string, start_line int, end_line int, size int, normalized string, raw string, features array<bigint>, labels array<bigint>, leftmost array<int>, error string"


def script_units(files: DataFrame, min_lines: int, min_nodes: int) -> DataFrame:
    """Units of ``files(ord, path, ext, text)``, or one row with ``error`` for a script that cannot be read.

    A unit's ``ord`` is its file's place and its own within it, so it follows the inventory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for ord_, path, text in zip(batch["ord"], batch["path"], batch["text"]):
                try:
                    for k, u in enumerate(read_units(text or "", min_lines, min_nodes, dialect_of(path))):
                        rows.append((int(ord_) * 100_000 + k, path, u.name, u.start_line, u.end_line, u.size, u.normalized, u.raw, u.features, u.labels, u.leftmost, None))
                except ScriptError as e:
                    rows.append((int(ord_) * 100_000, path, None, None, None, None, None, None, None, None, None, str(e)))
                except IndexError:
                    rows.append((int(ord_) * 100_000, path, None, None, None, None, None, None, None, None, None, "syntax error: the file ends too early"))
            frame = pd.DataFrame(rows, columns=columns)
            for c in ("start_line", "end_line", "size"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    scripts = files.where(F.col("ext").isin(*SCRIPT_EXTENSIONS)).select("ord", "path", "text")
    return scripts.mapInPandas(run, UNIT_SCHEMA)


# -- references ----------------------------------------------------------------------------------------------------


@dataclass
class Extraction:
    edges: list[tuple[str, str, list[str]]]  # specifier, kind, names
    exports: list[tuple[str, int]]
    dynamic: list[str]
    literals: list[str]
    counts: dict[str, int]


def _names_in_braces(tokens: list[Token], a: int, b: int) -> list[tuple[str, str]]:
    """``(source, public)`` of each specifier between braces."""
    out, part = [], []
    for t in [*tokens[a:b], Token("sign", ",", 0, 0)]:
        if t.text == ",":
            words = [x.text.strip("\"'") for x in part if x.text != "as"]
            if words and words[0] == "type" and len(words) > 1:
                words = words[1:]
            if words:
                out.append((words[0], words[-1]))
            part = []
        else:
            part.append(t)
    return out


def extract(text: str, dialect: str = "tsx") -> Extraction:
    """Imports, exports, computed references, other string literals and identifier counts of a script."""
    tokens = lex(text, dialect)
    partner = match_brackets(tokens)
    out = Extraction([], [], [], [], {})
    seen: set[str] = set()
    used: set[int] = set()
    quoted = lambda i: tokens[i].text[1:-1] if i < len(tokens) and tokens[i].kind == "string" else None

    def export(name: str, line: int) -> None:
        if name not in seen:
            seen.add(name)
            out.exports.append((name, line))

    n = len(tokens)
    for i, t in enumerate(tokens):
        if t.kind == "name":
            out.counts[t.text] = out.counts.get(t.text, 0) + 1
        after = tokens[i + 1] if i + 1 < n else Token("sign", "", t.line, 0)
        before = tokens[i - 1].text if i else ""
        if t.text == "import" and t.kind == "word" and before not in (".", "?."):
            if after.text == "(":
                single = partner.get(i + 1) == i + 3
                inner = quoted(i + 2) if single else None
                if inner is None and single and tokens[i + 2].kind == "template":
                    inner = tokens[i + 2].text[1:]
                if inner is not None:
                    used.add(i + 2)
                    kind = "import" if before in (":", "|", "&", "<", "=") and i + 4 < n and tokens[i + 4].text == "." and "type" in [x.text for x in tokens[max(0, i - 4) : i]] else "dynamic-import"
                    out.edges.append((inner, kind, ["*"]))
                else:
                    out.dynamic.append(text[tokens[i + 2].at : tokens[partner[i + 1]].at][:200])
                continue
            if after.kind == "string":
                used.add(i + 1)
                out.edges.append((quoted(i + 1), "import", []))
                continue
            names: list[str] = []
            j = i + 1
            while j < n and tokens[j].text not in ("from", ";") and tokens[j].kind != "string" and tokens[j].text != "=":
                u = tokens[j]
                if u.text == "{":
                    names += [a for a, _ in _names_in_braces(tokens, j + 1, partner[j])]
                    j = partner[j]
                elif u.text == "*":
                    names.append("*")
                    j += 2
                elif u.kind == "name":
                    names.append("default")
                j += 1
            if j < n and tokens[j].text == "=" and j + 3 < n and tokens[j + 1].text == "require" and (spec := quoted(j + 3)) is not None:
                used.add(j + 3)
                out.edges.append((spec, "require", ["*"]))
            elif j + 1 < n and tokens[j].text == "from" and (spec := quoted(j + 1)) is not None:
                used.add(j + 1)
                out.edges.append((spec, "import", names))
        elif t.text == "require" and after.text == "(" and before not in (".", "?.", "=") or t.text == "require" and after.text == "(" and before == "=" and not (i >= 3 and tokens[i - 3].text == "import"):
            single = partner.get(i + 1) == i + 3
            inner = quoted(i + 2) if single else None
            if inner is None and single and tokens[i + 2].kind == "template":
                inner = tokens[i + 2].text[1:]
            if inner is not None:
                used.add(i + 2)
                out.edges.append((inner, "require", ["*"]))
            elif partner.get(i + 1, i + 2) > i + 2:
                out.dynamic.append(text[tokens[i + 2].at : tokens[partner[i + 1]].at][:200])
        elif t.text == "export" and t.kind == "word":
            j = i + 1
            if after.text == "*":
                k = j + 1
                if k < n and tokens[k].text == "as":
                    export(tokens[k + 1].text, t.line)
                    k += 2
                if k + 1 < n and (spec := quoted(k + 1)) is not None:
                    used.add(k + 1)
                    out.edges.append((spec, "re-export", ["*"]))
                continue
            if after.text == "type" and j + 1 < n and tokens[j + 1].text == "{":
                j += 1
            if tokens[j : j + 1] and tokens[j].text == "{":
                pairs = _names_in_braces(tokens, j + 1, partner[j])
                for _, public in pairs:
                    export(public, t.line)
                k = partner[j] + 1
                if k + 1 < n and tokens[k].text == "from" and (spec := quoted(k + 1)) is not None:
                    used.add(k + 1)
                    out.edges.append((spec, "re-export", [a for a, _ in pairs]))
                continue
            if after.text in ("default", "="):
                export("default", t.line)
                continue
            while j < n and tokens[j].text in ("declare", "abstract", "async"):
                j += 1
            if j < n and tokens[j].text in ("function", "class", "interface", "type", "enum", "namespace", "module"):
                k = j + 1
                while k < n and tokens[k].kind != "name":
                    k += 1
                if k < n:
                    export(tokens[k].text, t.line)
            elif j < n and tokens[j].text in ("const", "let", "var"):
                if j + 1 < n and tokens[j + 1].text == "enum":
                    export(tokens[j + 2].text, t.line)
                    continue
                k, fresh = j + 1, True
                while k < n and tokens[k].text != ";":
                    u = tokens[k]
                    if fresh and u.text in ("{", "["):
                        for m in range(k + 1, partner[k]):
                            if tokens[m].kind == "name" and tokens[m + 1].text in (",", "}", "]", "="):
                                export(tokens[m].text, t.line)
                        fresh = False
                    elif fresh and u.kind == "name":
                        export(u.text, t.line)
                        fresh = False
                    elif u.text == ",":
                        fresh = True
                    elif k > j + 1 and u.kind == "word" and u.text in ("export", "import", "function", "class", "const", "let", "var"):
                        break
                    k = partner[k] + 1 if u.text in _PAIRS else k + 1
    for i, t in enumerate(tokens):
        if t.kind == "string" and i not in used and 1 <= len(t.text) - 2 <= 200:
            out.literals.append(t.text[1:-1])
    return out


EXTRACT_SCHEMA = "path string, relation string, text string, kind string, names array<string>, line int, n int"


def script_references(files: DataFrame) -> DataFrame:
    """One row for each edge, export, dynamic specifier, literal and identifier of ``files(path, ext, text)``.

    ``relation`` names which; a script that cannot be read gives what could be read of it: nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    e = extract(text or "", dialect_of(path))
                except (ScriptError, IndexError):
                    continue
                rows += [(path, "edge", s, k, names, None, None) for s, k, names in e.edges]
                rows += [(path, "export", name, None, None, line, None) for name, line in e.exports]
                rows += [(path, "dynamic", x, None, None, None, None) for x in e.dynamic]
                rows += [(path, "literal", x, None, None, None, None) for x in e.literals]
                rows += [(path, "identifier", x, None, None, None, c) for x, c in e.counts.items()]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in EXTRACT_SCHEMA.split(", ")])
            frame["line"], frame["n"] = frame["line"].astype("Int32"), frame["n"].astype("Int32")
            yield frame

    return files.where(F.col("ext").isin(*SCRIPT_EXTENSIONS)).select("path", "text").mapInPandas(run, EXTRACT_SCHEMA)
