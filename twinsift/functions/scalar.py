"""Scalar rules as column expressions: all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC_NAMES = ("index", "main", "config", "types", "utils", "helpers", "constants")
TEST_PATH = r"(^|/)(__tests__/.*|.*\.(test|spec)\.[^/]+)$"


def count_lines(text: Column) -> Column:
    """Lines of a text: none for an empty one; a final line feed starts no further line. Null stays null."""
    pieces = F.size(F.split(text, "\n"))
    return F.when(text.isNull(), None).when(text == "", 0).otherwise(pieces - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_value(value: Column) -> Column:
    """A declaration's value, lower-cased as a whole unless it quotes something or holds a url."""
    flat = collapse_space(value)
    return F.when(flat.rlike("(?i)[\"']|url\\("), flat).otherwise(F.lower(flat))


def normalize_property(name: Column) -> Column:
    """A property's name: custom properties keep their case."""
    flat = F.trim(name)
    return F.when(F.startswith(flat, F.lit("--")), flat).otherwise(F.lower(flat))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def glob_unsafe(path: Column) -> Column:
    """Paths with characters that some matchers read as patterns."""
    return path.rlike(r"[*?\[\]{}()!]")


def jaccard(overlap: Column, left: Column, right: Column) -> Column:
    return overlap / (left + right - overlap)


def size_ratio(left: Column, right: Column) -> Column:
    """The largest similarity two trees of these sizes can have; two empty ones are equal."""
    return F.when(F.greatest(left, right) == 0, 1.0).otherwise(F.least(left, right) / F.greatest(left, right))


def encloses(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (outer_start <= inner_start) & (outer_end >= inner_end)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def script_words(command: Column) -> Column:
    """The words of a shell command, also those behind an equals sign."""
    return F.filter(F.split(command, r"[\s&|;<>()\"'`=]+"), lambda w: w != "")


def resolve_path(folder: Column, target: Column) -> Column:
    """Join and normalise POSIX paths; null where the result would leave the root.

    ``folder`` must be normal already. A segment '..' removes the last one kept.
    """
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda p: (p != "") & (p != "."))
    empty = F.expr("cast(array() as array<string>)")
    folded = F.aggregate(
        parts,
        F.struct(empty.alias("kept"), F.lit(True).alias("inside")),
        lambda acc, p: F.struct(
            F.when(p != "..", F.concat(acc["kept"], F.array(p))).otherwise(F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).alias("kept"),
            (acc["inside"] & ((p != "..") | (F.size(acc["kept"]) > 0))).alias("inside"),
        ),
        lambda acc: F.when(acc["inside"], F.array_join(acc["kept"], "/")),
    )
    return folded


def shingles(labels: Column, width: int = 5) -> Column:
    """64-bit hashes of the runs of ``width`` labels; none for a shorter sequence."""
    last = F.size(labels) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(labels, i + 1, width)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def lines_between(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start..end`` of a text (1-based, inclusive), split at LF or CRLF and joined with LF."""
    return F.array_join(F.slice(F.split(text, "\r?\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def member_hash(path: Column, text: Column, start: Column, end: Column) -> Column:
    """What a baseline remembers of a place: its path and its lines, not their numbers. A missing file is known by its place."""
    known = F.sha2(F.concat(path, F.lit("\n"), lines_between(text, start, end)), 256)
    return F.coalesce(known, F.concat(F.lit("missing:"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value)
