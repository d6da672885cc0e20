"""Reading a project's folder: its tracked files, package manifest and compiler settings. Driver-side and small."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.config import Config
from twinsift.functions.globs import globs_to_regex
from twinsift.functions.scalar import count_lines, extension
from twinsift.operators.resolve import CompilerOptions

FILE_SCHEMA = "ord bigint, path string, ext string, text string, lines int, excluded boolean"
ENTRY_FIELDS = ("main", "module", "browser", "bin", "exports")
DEPENDENCY_FIELDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


class InventoryError(RuntimeError):
    """A folder that cannot be listed."""


def list_paths(root: str) -> list[str]:
    """Tracked and untracked files that version control does not ignore, relative to ``root``; NUL-separated inside."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise InventoryError(f"{root} is not inside a version-controlled folder") from e
    return list(dict.fromkeys(p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p))


def read_inventory(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """``files(ord, path, ext, text, lines, excluded)`` of a folder: code files only, the ignored ones flagged.

    Paths are listed on the driver, the texts are read by the executors. Files that vanished, and folders, are skipped.
    """
    wanted = [p for p in list_paths(root) if os.path.splitext(p)[1].lower() in config.codeExtensions]
    there = [(i, p) for i, p in enumerate(sorted(wanted)) if os.path.isfile(os.path.join(root, p))]
    if not there:
        return spark.createDataFrame([], FILE_SCHEMA)
    listed = spark.createDataFrame(there, "ord bigint, path string")

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for o, p in zip(batch["ord"], batch["path"]):
                try:
                    with open(os.path.join(root, p), encoding="utf-8", errors="replace", newline="") as f:
                        rows.append((o, p, f.read()))
                except (FileNotFoundError, IsADirectoryError):
                    continue
            yield pd.DataFrame(rows, columns=["ord", "path", "text"])

    texts = listed.mapInPandas(read, "ord bigint, path string, text string")
    return as_inventory(texts, config)


def as_inventory(table: DataFrame, config: Config) -> DataFrame:
    """``files`` from any table with ``path`` and ``text`` (and ``ord``, ``excluded`` where there are such).

    Extensions and line counts are taken from path and text, not from columns that may be wrong; a path that comes more
    than once counts once, with its last row in order; null paths and texts are dropped.
    """
    kept = table.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    place = F.col("ord") if "ord" in table.columns else F.xxhash64("path")
    flagged = F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in table.columns else F.lit(False)
    rows = kept.select(place.cast("bigint").alias("ord"), "path", extension(F.col("path")).alias("ext"), "text", (flagged | F.col("path").rlike(globs_to_regex(config.ignore))).alias("excluded"))
    rows = rows.where(F.col("ext").isin(*config.codeExtensions))
    once = rows.groupBy("path").agg(F.max_by(F.struct("ord", "ext", "text", "excluded"), F.struct("ord", "text")).alias("r")).select("path", "r.*")
    return once.select("ord", "path", "ext", "text", count_lines(F.col("text")).alias("lines"), "excluded")


@dataclass(frozen=True)
class Manifest:
    entries: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    dependencies: tuple[str, ...] = ()


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else []


def parse_manifest(text: str | None) -> Manifest:
    """Entry paths, script commands and dependency names of a package manifest; of a malformed one, nothing."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return Manifest()
    if not isinstance(data, dict):
        return Manifest()
    own = lambda key: data[key] if isinstance(data.get(key), dict) else {}
    return Manifest(
        tuple(s for key in ENTRY_FIELDS for s in _strings(data.get(key))),
        tuple(s for s in own("scripts").values() if isinstance(s, str)),
        tuple(dict.fromkeys(name for key in DEPENDENCY_FIELDS for name in own(key))),
    )


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas, as compiler settings are written; of a malformed one, an empty object."""
    quiet = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or " ", text, flags=re.S)
    quiet = re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m.group(1) or m.group(2), quiet, flags=re.S)
    try:
        data = json.loads(quiet)
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def compiler_options(root: str, name: str = "tsconfig.json", seen: tuple[str, ...] = ()) -> CompilerOptions:
    """Aliases, base folder and output folders of a project, with what its settings extend."""
    path = os.path.normpath(os.path.join(root, name))
    if path in seen or not os.path.isfile(path):
        return CompilerOptions()
    with open(path, encoding="utf-8") as f:
        data = parse_jsonc(f.read())
    parent = CompilerOptions()
    for base in [data["extends"]] if isinstance(data.get("extends"), str) else data.get("extends") or []:
        if isinstance(base, str) and base.startswith("."):
            target = os.path.join(os.path.dirname(path), base if base.endswith(".json") else base + ".json")
            parent = compiler_options(root, os.path.relpath(target, root), (*seen, path))
    own = data.get("compilerOptions") if isinstance(data.get("compilerOptions"), dict) else {}
    local = lambda key: os.path.relpath(os.path.normpath(os.path.join(os.path.dirname(path), own[key])), root) if isinstance(own.get(key), str) else None
    clean = lambda p: None if p is None else "" if p == "." else p
    paths = own.get("paths")
    aliases = {k: tuple(v) for k, v in paths.items() if isinstance(v, list)} if isinstance(paths, dict) else parent.paths
    base_url = clean(local("baseUrl")) if "baseUrl" in own else parent.base_url
    return CompilerOptions(base_url, aliases, clean(local("outDir")) or parent.out_dir, clean(local("rootDir")) or parent.root_dir)
