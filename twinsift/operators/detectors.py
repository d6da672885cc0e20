"""The four detectors of the audit, each a function of the inventory."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import TEMPLATE_EXTENSIONS, Config
from twinsift.functions.globs import globs_to_regex
from twinsift.functions.scalar import GENERIC_NAMES, base_name, directory, is_test_path, resolve_path, without_extension
from twinsift.operators import reach, tokens
from twinsift.operators.entrypoints import resolve_entries
from twinsift.operators.resolve import CompilerOptions, resolve_specifiers
from twinsift.operators.similarity import cluster_units
from twinsift.operators.ted import confirm_trees
from twinsift.session import Scratch
from twinsift.sources import css as css_source
from twinsift.sources import script
from twinsift.sources.project import Manifest

#: Paths that a note names one by one.
NOTED = 10
CLUSTERS = "cluster string, detector string, kind string, similarity double"
MEMBERS = "cluster string, member int, path string, start_line int, end_line int, name string"
FINDINGS = "kind string, path string, start_line int, end_line int, name string, reason string"


@dataclass
class Result:
    """What a detector found; every table may be empty."""

    clusters: DataFrame
    members: DataFrame
    findings: DataFrame
    analyzed: DataFrame
    failures: DataFrame
    notes: list[str] = field(default_factory=list)


class Detector(Protocol):
    id: str

    def run(self, files: DataFrame) -> Result: ...


def _empty(files: DataFrame, schema: str) -> DataFrame:
    return files.sparkSession.createDataFrame([], schema)


def _result(files: DataFrame, **parts) -> Result:
    blank = {"clusters": CLUSTERS, "members": MEMBERS, "findings": FINDINGS, "analyzed": "path string", "failures": "path string, message string"}
    return Result(**{k: parts.get(k) if parts.get(k) is not None else _empty(files, s) for k, s in blank.items()}, notes=parts.get("notes", []))


def _places(detector: str, clusters: DataFrame, members: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = lambda c: F.concat(F.lit(f"{detector}:"), c.cast("string"))
    named = clusters.select(label(F.col("cluster")).alias("cluster"), F.lit(detector).alias("detector"), "kind", "similarity")
    placed = members.join(units.select("ord", "path", "start_line", "end_line", "name"), "ord")
    return named, placed.select(label(F.col("cluster")).alias("cluster"), F.lit(None).cast("int").alias("member"), "path", "start_line", "end_line", "name")


@dataclass
class StructureDetector:
    """Copies of functions: exact, renamed and edited."""

    config: Config
    id: str = "structure"

    def run(self, files: DataFrame) -> Result:
        s = self.config.structure
        own = files.where(~F.col("excluded"))
        read = Scratch(files.sparkSession, "structure").cut(script.script_units(own, s.minLines, s.minNodes), "units")
        failed = read.where(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
        units = read.where(F.col("error").isNull()).withColumn("features", F.when(F.col("size") <= s.maxTedNodes, F.col("features")).otherwise(F.expr("cast(array() as array<bigint>)")))
        clusters, members = cluster_units(units.drop("error", "path", "name", "start_line", "end_line"), s.similarity, s.candidateJaccard, s.maxPosting, confirm_trees(s.similarity), sized=True)
        clusters, members = _places(self.id, clusters, members, units)
        oversized = units.where(F.col("size") > s.maxTedNodes).count()
        notes = [f"{oversized} function(s) of more than {s.maxTedNodes} nodes were compared for exact copies only."] if oversized else []
        scripts = own.where(F.col("ext").isin(*script.SCRIPT_EXTENSIONS)).select("path").join(failed, "path", "left_anti")
        return _result(files, clusters=clusters, members=members, analyzed=scripts, failures=failed, notes=notes)


@dataclass
class CssDetector:
    """Copies of rules: the same declarations, or nearly."""

    config: Config
    id: str = "css"

    def run(self, files: DataFrame) -> Result:
        s = self.config.css
        own = files.where(~F.col("excluded"))
        read = Scratch(files.sparkSession, "css").cut(css_source.style_rules(own, s.minDeclarations), "rules")
        failed = read.where(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
        units = read.where(F.col("error").isNull()).withColumn("features", F.transform("declarations", lambda d: F.xxhash64(d)))
        clusters, members = cluster_units(units.select("ord", "normalized", "raw", "features"), s.similarity, s.similarity)
        clusters, members = _places(self.id, clusters, members, units)
        sheets = own.where("ext = '.css'").select("path").join(failed, "path", "left_anti")
        return _result(files, clusters=clusters, members=members, analyzed=sheets, failures=failed)


@dataclass
class TokensDetector:
    """Verbatim token runs; another matcher can be given."""

    config: Config
    matcher: tokens.Matcher = tokens.match_tokens
    glob_safe: bool = False
    id: str = "tokens"

    def run(self, files: DataFrame) -> Result:
        s = self.config.tokens
        pairs, looked_at, notes = tokens.token_clones(files.where(~F.col("excluded")), s.extensions, s.minTokens, s.minLines, self.matcher, self.glob_safe)
        keyed = Scratch(files.sparkSession, "tokens").cut(pairs.withColumn("cluster", F.concat(F.lit("tokens:"), F.sha2(F.concat_ws("|", "path_a", "start_a", "end_a", "path_b", "start_b", "end_b"), 256))), "pairs")
        clusters = keyed.select("cluster", F.lit(self.id).alias("detector"), F.lit("identical").alias("kind"), F.lit(1.0).alias("similarity"))
        sides = [keyed.select("cluster", F.lit(k).alias("member"), F.col(f"path_{x}").alias("path"), F.col(f"start_{x}").alias("start_line"), F.col(f"end_{x}").alias("end_line"), F.lit(None).cast("string").alias("name")) for k, x in enumerate("ab")]
        return _result(files, clusters=clusters, members=sides[0].unionByName(sides[1]), analyzed=looked_at, notes=notes)


@dataclass
class DeadCodeDetector:
    """Files and exports that nothing live reaches."""

    config: Config
    manifest: Manifest = Manifest()
    options: CompilerOptions = CompilerOptions()
    id: str = "deadcode"

    def run(self, files: DataFrame) -> Result:
        s = self.config.deadcode
        scratch = Scratch(files.sparkSession, "deadcode")
        own = files.where(~F.col("excluded"))
        tests = files.where(F.col("excluded") & is_test_path(F.col("path"))) if s.treatTestsAsEntry else files.limit(0)
        entries = resolve_entries(own, self.manifest, s.entry, self.options)
        if entries.program.isEmpty():
            note = "dead code was not looked for: no entry point was found in the package manifest, among index, main and cli files, or by framework conventions. Name some under deadcode.entry."
            return _result(files, notes=[note])
        inputs = own.unionByName(tests)
        refs = scratch.cut(script.script_references(inputs), "references")
        nodes = inputs.where(F.col("ext").isin(*script.SCRIPT_EXTENSIONS, ".css")).select("path")
        imports = refs.where("relation = 'edge'").select(F.col("path").alias("src"), F.col("text").alias("specifier"), "names")
        sheets = inputs.where("ext = '.css'").select(F.col("path").alias("src"), F.explode(css_source.imported(F.col("text"))).alias("specifier"), F.expr("cast(array() as array<string>)").alias("names"))
        edges = scratch.cut(resolve_specifiers(imports.unionByName(sheets), nodes, self.options), "edges")
        exports = refs.where("relation = 'export'").select("path", F.col("text").alias("name"), "line")
        literal = refs.where("relation = 'literal'").select("path", "text")

        owned = entries.tool_owned
        named = literal.join(owned, "path", "left_semi").select("path", F.explode(F.array(resolve_path(F.lit(""), F.col("text")), resolve_path(directory(F.col("path")), F.col("text")))).alias("target"))
        named = named.select(F.col("target").alias("path")).distinct().join(own.select("path"), "path", "left_semi")
        start = entries.program.select("path").unionByName(owned).unionByName(named).unionByName(tests.select("path")).distinct()
        start = scratch.cut(start.select(F.col("path").alias("id")), "entries")
        live = scratch.cut(reach.reachable(edges.select("src", "dst"), start, nodes.select(F.col("path").alias("id"))), "live")
        used = reach.used_exports(edges, exports, live)
        ignored = F.col("path").rlike(globs_to_regex(s.ignore))
        audited = own.join(nodes, "path", "left_semi").select("path", "lines")

        computed = refs.where("relation = 'dynamic'").select("path", "text")
        texts = own.where(F.col("ext").isin(*TEMPLATE_EXTENSIONS)).select("path", F.lit(1).alias("ord"), "text")
        if not computed.isEmpty():  # a literal can only name a file where some reference is computed
            texts = texts.unionByName(computed.unionByName(literal).select("path", F.lit(0).alias("ord"), "text"))
        texts = scratch.cut(texts, "texts")

        dead = audited.join(live.select(F.col("id").alias("path")), "path", "left_anti").where(~ignored)
        bare, stem = without_extension(F.col("path")), base_name(without_extension(F.col("path")))
        needles = dead.select(F.col("path").alias("id"), F.col("path").alias("exclude"), F.explode(F.array(bare, stem)).alias("needle")).where(~F.col("needle").isin(*GENERIC_NAMES))
        heard = reach.mentions(needles, texts).groupBy("id").agg(F.max_by(F.struct("path", "needle"), F.length("needle")).alias("m"))
        total = start.count()
        file_rows = dead.join(heard, dead.path == heard.id, "left").select(
            F.when(F.col("m").isNull(), "dead-file").otherwise("uncertain-file").alias("kind"),
            "path",
            F.lit(1).alias("start_line"),
            F.greatest("lines", F.lit(1)).alias("end_line"),
            F.lit(None).cast("string").alias("name"),
            F.when(F.col("m").isNull(), F.lit(f"No chain of imports leads here from any of the {total} entry points ({entries.basis})."))
            .otherwise(F.concat(F.lit("No chain of imports leads here, but "), F.col("m.path"), F.lit(" holds the text '"), F.col("m.needle"), F.lit("', which may be a computed reference.")))
            .alias("reason"),
        )
        counts = refs.where("relation = 'identifier'").select("path", F.col("text").alias("name"), "n")
        alive = live.join(audited.select(F.col("path").alias("id")), "id", "left_semi")
        unused = reach.dead_exports(exports, used, alive, start, counts).where(~ignored)
        unused = scratch.cut(unused.withColumn("id", F.concat_ws("\0", "path", "name")), "unused")
        told = reach.mentions(unused.select("id", F.col("name").alias("needle"), F.col("path").alias("exclude")), texts).select("id", F.col("path").alias("by"))
        export_rows = unused.join(told, "id", "left").select(
            F.when(F.col("by").isNull(), "dead-export").otherwise("uncertain-export").alias("kind"),
            "path",
            F.col("line").alias("start_line"),
            F.col("line").alias("end_line"),
            "name",
            F.when(F.col("by").isNull(), F.concat(F.lit("No live file imports '"), F.col("name"), F.lit("', by name, as a whole or by re-export.")))
            .otherwise(F.concat(F.lit("No live file imports '"), F.col("name"), F.lit("', but "), F.col("by"), F.lit(" holds that text.")))
            .alias("reason"),
        )

        def shown(frame: DataFrame) -> str:
            """The first paths and how many more there are: a note, not a list of a whole repository."""
            paths = frame.select("path").distinct()
            first = [r["path"] for r in paths.orderBy("path").limit(NOTED).collect()]
            more = paths.count() - len(first) if len(first) == NOTED else 0
            return ", ".join(first) + (f" and {more} more" if more else "")

        notes = [f"entry points ({entries.basis}{' + test files' if not tests.isEmpty() else ''}): {shown(entries.program)}"]
        if listed := shown(named):
            notes.append(f"live because a tool's settings name them: {listed}")
        if listed := shown(owned):
            notes.append(f"live because tools load them by name: {listed}")
        return _result(files, findings=file_rows.unionByName(export_rows), analyzed=audited.select("path"), notes=notes)


def create_detectors(config: Config, manifest: Manifest = Manifest(), options: CompilerOptions = CompilerOptions()) -> list[Detector]:
    """The chosen detectors, in the order of the settings."""
    make = {"tokens": lambda: TokensDetector(config), "structure": lambda: StructureDetector(config), "css": lambda: CssDetector(config), "deadcode": lambda: DeadCodeDetector(config, manifest, options)}
    return [make[d]() for d in config.detectors]
