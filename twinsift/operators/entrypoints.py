"""Where a program begins: declared, conventional and framework entries, and files that tools load by name."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.globs import globs_to_regex
from twinsift.operators.resolve import SOURCES_OF, CompilerOptions
from twinsift.sources.project import Manifest

#: Entry points by convention, folders of compiled output, and files that tools load by their name.
CONVENTIONAL = r"^(?:src/)?(?:index|main|cli)\.[^/.]+$"
OUTPUT_DIRS = ("dist", "build", "lib", "out")
TOOL_OWNED = ("**/*.config.{js,cjs,mjs,jsx,ts,cts,mts,tsx}", "**/.*rc.{js,cjs,mjs,ts,cts,mts}", "**/.*/**")
#: Frameworks by the dependency that brings them, and the files each of them runs by convention.
FRAMEWORKS = (
    ("next", r"next", ("{src/,}pages/**", "{src/,}app/**/{page,layout,route,loading,error,global-error,not-found,template,default}.*", "{src/,}{middleware,proxy,instrumentation,instrumentation-client}.*")),
    ("astro", r"astro", ("src/pages/**", "src/middleware.*", "src/actions/index.*")),
    ("sveltekit", r"@sveltejs/kit", ("src/routes/**", "src/hooks.*", "src/params/**")),
    ("remix/react-router", r"(@remix-run/|react-router).*", ("app/routes/**", "app/routes.*", "app/root.*", "app/entry.*")),
    ("gatsby", r"gatsby", ("src/pages/**", "gatsby-{node,browser,ssr}.*")),
    ("storybook", r"storybook|@storybook/.*", ("**/*.stories.*",)),
    ("cypress", r"cypress", ("cypress/**",)),
    ("knex", r"knex", ("**/migrations/**", "**/seeds/**")),
)


@dataclass(frozen=True)
class Entries:
    """``program(path, label)`` with where each comes from, ``tool_owned(path)``, and the labels that contributed."""

    program: DataFrame
    tool_owned: DataFrame
    basis: str


def source_candidates(word: str, options: CompilerOptions) -> list[str]:
    """Source files that a declared path may be built from, the path itself first."""
    path = posixpath.normpath(word.strip())
    if path.startswith(("..", "/")) or path == ".":
        return []
    stem, ext = posixpath.splitext(path)
    out = [path]
    homes = [stem]
    for folder in dict.fromkeys([*([options.out_dir] if options.out_dir else []), *OUTPUT_DIRS]):
        if path.startswith(folder + "/"):
            inner = stem[len(folder) + 1 :]
            homes += [posixpath.join(home, inner) if home else inner for home in dict.fromkeys([options.root_dir or "", "", "src"])]
            break
    for home in homes:
        out += [home + e for e in (*SOURCES_OF.get(ext, ()), ext)] if ext else [home + e for e in (".ts", ".tsx", ".js", "/index.ts", "/index.js")]
    return list(dict.fromkeys(out))


def resolve_entries(files: DataFrame, manifest: Manifest, explicit: tuple[str, ...] = (), options: CompilerOptions = CompilerOptions()) -> Entries:
    """Entry points among ``files(path)``. An explicit list replaces everything automatic but the tools' own files."""
    spark = files.sparkSession
    paths = files.select("path").distinct()
    found: list[tuple[str, DataFrame]] = []

    def declared(words: list[str]) -> DataFrame:
        rows = sorted({(c,) for w in words for c in source_candidates(w, options)})
        return paths.join(spark.createDataFrame(rows, "path string"), "path", "left_semi")

    if explicit:
        found.append((f"the explicit list ({', '.join(explicit)})", paths.where(F.col("path").rlike(globs_to_regex(explicit)))))
    else:
        words = [w for s in manifest.scripts for w in re.split(r"[\s&|;<>()\"'`=]+", s) if w]
        found.append(("the package manifest's entry fields", declared(list(manifest.entries))))
        found.append(("the package manifest's scripts", declared(words)))
        found.append(("index, main or cli in the root or src", paths.where(F.col("path").rlike(CONVENTIONAL))))
        for name, dependency, globs in FRAMEWORKS:
            if any(re.fullmatch(dependency, d) for d in manifest.dependencies):
                found.append((f"{name} conventions", paths.where(F.col("path").rlike(globs_to_regex(globs)))))
    labelled = None
    for label, part in found:
        part = part.select("path", F.lit(label).alias("label"))
        labelled = part if labelled is None else labelled.unionByName(part)
    labels = {r["label"] for r in labelled.select("label").distinct().collect()}
    return Entries(labelled, paths.where(F.col("path").rlike(globs_to_regex(TOOL_OWNED))), " + ".join(label for label, _ in found if label in labels))
