"""Reading style sheets: rules with their at-rule context, declarations and lines, and import references."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_part = re.compile(r"/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\([^()]*\))*\)|[{};]|[^{};/\"'(]+|.", re.S)


class StyleError(ValueError):
    """A style sheet that cannot be read."""


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _value(text: str) -> str:
    flat = _flat(text)
    return flat if re.search(r"[\"']|url\(", flat, re.I) else flat.lower()


def read_rules(text: str, min_declarations: int = 3) -> list[dict]:
    """Rules, nested ones included, with at least ``min_declarations`` declarations of their own.

    A rule's key is its at-rule context and its sorted normalised declarations; the raw key keeps order and spelling;
    the features are one for each distinct normalised declaration, in its context. The selector is no part of them.
    """
    out: list[dict] = []
    stack: list[dict] = []
    buffer, began, line = "", 1, 1

    def declare(part: str) -> None:
        if not part.strip() or not stack:
            return
        name, colon, value = part.strip().partition(":")
        if not colon or part.lstrip().startswith("@"):
            return
        important = re.search(r"!\s*important\s*$", value, re.I)
        bare = value[: important.start()] if important else value
        key = name.strip() if name.strip().startswith("--") else name.strip().lower()
        stack[-1]["normalized"].append(f"{key}:{_value(bare)}{'!important' if important else ''}")
        stack[-1]["raw"].append(_flat(part))

    for m in _part.finditer(text):
        piece = m.group()
        if piece.startswith("/*"):
            line += piece.count("\n")
            continue
        if piece in "\"'" or piece == "/" and text.startswith("/*", m.start()):
            raise StyleError(f"line {line}: unterminated {'comment' if piece == '/' else 'string'}")
        if piece == "{":
            stack.append({"head": _flat(buffer), "line": began, "normalized": [], "raw": []})
            buffer = ""
        elif piece in (";", "}"):
            declare(buffer)
            buffer = ""
            if piece == "}":
                if not stack:
                    raise StyleError(f"line {line}: '}}' without a block")
                rule = stack.pop()
                if not rule["head"].startswith("@") and len(rule["normalized"]) >= min_declarations:
                    context = " ".join(re.sub(r"^@([\w-]+)", lambda w: w.group().lower(), r["head"]) for r in stack if r["head"].startswith("@"))
                    out.append(
                        {
                            "name": rule["head"][:80],
                            "start_line": rule["line"],
                            "end_line": line,
                            "raw_key": context + "|" + ";".join(rule["raw"]),
                            "normalized_key": context + "|" + ";".join(sorted(rule["normalized"])),
                            "declarations": [context + "|" + x for x in dict.fromkeys(rule["normalized"])],
                        }
                    )
        else:
            if not buffer.strip() and piece.strip():
                began = line + (len(piece) - len(piece.lstrip()) and piece[: len(piece) - len(piece.lstrip())].count("\n"))
            buffer += piece
        line += piece.count("\n")
    if stack:
        raise StyleError(f"line {stack[-1]['line']}: unclosed block")
    return sorted(out, key=lambda r: (r["start_line"], r["end_line"]))


RULE_SCHEMA = "ord bigint, path string, name string, start_line int, end_line int, raw string, normalized string, declarations array<string>, error string"


def style_rules(files: DataFrame, min_declarations: int) -> DataFrame:
    """Rules of the ``.css`` files of ``files(ord, path, ext, text)``, or one row with ``error`` for an unreadable one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for ord_, path, text in zip(batch["ord"], batch["path"], batch["text"]):
                try:
                    for k, r in enumerate(read_rules(text or "", min_declarations)):
                        rows.append((int(ord_) * 100_000 + k, path, r["name"], r["start_line"], r["end_line"], r["raw_key"], r["normalized_key"], r["declarations"], None))
                except StyleError as e:
                    rows.append((int(ord_) * 100_000, path, None, None, None, None, None, None, str(e)))
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in RULE_SCHEMA.split(", ")])
            frame["start_line"], frame["end_line"] = frame["start_line"].astype("Int32"), frame["end_line"].astype("Int32")
            yield frame

    return files.where(F.col("ext") == ".css").select("ord", "path", "text").mapInPandas(run, RULE_SCHEMA)


def imported(text: Column) -> Column:
    """Specifiers of a style sheet's imports, comments aside; a bare file name is relative."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    found = F.regexp_extract_all(plain, F.lit(r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""), 1)
    return F.transform(found, lambda s: F.when(s.rlike(r"^(\.|/|[A-Za-z][A-Za-z0-9+.-]*:)"), s).otherwise(F.concat(F.lit("./"), s)))
