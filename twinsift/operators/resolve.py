"""Which file a specifier means: an ordered list of candidates, of which the first known one wins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.scalar import directory, resolve_path

PROBED = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".css")
#: The sources that a compiled extension may come from.
SOURCES_OF = {".js": (".ts", ".tsx", ".jsx"), ".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",)}


@dataclass(frozen=True)
class CompilerOptions:
    """What resolution needs of a project's compiler settings."""

    base_url: str | None = None
    paths: dict[str, tuple[str, ...]] = field(default_factory=dict)
    out_dir: str | None = None
    root_dir: str | None = None


def _targets(base: Column) -> Column:
    """Paths a resolved specifier may stand for, best first."""
    out = [F.array(base)]
    for compiled, origins in SOURCES_OF.items():
        swapped = [F.concat(F.regexp_replace(base, re.escape(compiled) + "$", ""), F.lit(o)) for o in origins]
        out.append(F.when(F.endswith(base, F.lit(compiled)), F.array(*swapped)).otherwise(F.expr("cast(array() as array<string>)")))
    out.append(F.array(*[F.concat(base, F.lit(e)) for e in PROBED]))
    inside = F.when(base == "", F.lit("index")).otherwise(F.concat(base, F.lit("/index")))
    out.append(F.array(*[F.concat(inside, F.lit(e)) for e in PROBED]))
    return F.concat(*out)


def resolve_specifiers(edges: DataFrame, known: DataFrame, options: CompilerOptions = CompilerOptions(), scope: str | None = None) -> DataFrame:
    """``edges(src, specifier, ...)`` with ``dst``: the first candidate that exists in ``known(path)``.

    Relative specifiers are taken from the importing file's folder; ``paths`` aliases (the longest prefix first) and the
    base folder serve the rest. External packages, paths that leave the root and a file's reference to itself have no
    row. With ``scope``, a column of both tables, paths are looked up within it.
    """
    keys = [scope] if scope else []
    spec = F.regexp_replace("specifier", r"[?#].*$", "")
    bases = [F.when(spec.rlike(r"^\.\.?(/|$)"), resolve_path(directory(F.col("src")), spec)), F.when(F.startswith(spec, F.lit("/")), resolve_path(F.lit(""), spec))]
    prefix = options.base_url or ""
    for alias, targets in sorted(options.paths.items(), key=lambda kv: (-len(kv[0].split("*")[0]), kv[0])):
        head, star, tail = alias.partition("*")
        fits = F.startswith(spec, F.lit(head)) & F.endswith(spec, F.lit(tail)) if star else spec == alias
        rest = F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
        for target in targets:
            before, _, after = target.partition("*")
            bases.append(F.when(fits, resolve_path(F.lit(prefix), F.concat(F.lit(before), rest if star else F.lit(""), F.lit(after)))))
    if options.base_url is not None:
        bases.append(F.when(~spec.rlike(r"^[./]"), resolve_path(F.lit(prefix), spec)))
    asked = edges.select("src", "specifier", *keys).distinct()
    listed = asked.select("*", F.filter(F.array(*bases), lambda b: b.isNotNull()).alias("_bases"))
    tried = listed.select("*", F.posexplode(F.flatten(F.transform("_bases", _targets))).alias("_rank", "_path"))
    names = known.select(*keys, F.col("path").alias("_path")).distinct()
    hits = tried.join(names, [*keys, "_path"])
    best = hits.groupBy("src", "specifier", *keys).agg(F.min_by("_path", "_rank").alias("dst"))
    return edges.join(best, ["src", "specifier", *keys]).where(F.col("src") != F.col("dst")).select(*edges.columns, "dst")
