"""The audit: detectors, coverage, explained pairs, baseline, gates and the tables of its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.config import Config
from twinsift.operators import baseline as base
from twinsift.operators import lines
from twinsift.operators.detectors import Detector, create_detectors
from twinsift.operators.resolve import CompilerOptions
from twinsift.session import Scratch
from twinsift.sources.project import Manifest


@dataclass
class Audit:
    """Everything a report needs; the tables are written to the shared folder, the numbers are few."""

    clusters: DataFrame  # cluster, detector, kind, similarity, savable, locations, new
    findings: DataFrame
    failures: DataFrame
    uncovered: DataFrame
    fingerprints: DataFrame
    numbers: dict
    gates: list[dict]
    notes: list[str]

    @property
    def passed(self) -> bool:
        return all(g["passed"] for g in self.gates)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def gate_rows(config: Config, coverage_percent: float, duplication_percent: float, dead_files: int) -> list[dict]:
    """The three gates; the one for dead code always passes unless it is enabled."""
    g = config.gates
    return [
        {"gate": "coverage", "limit": float(g.minCoveragePercent), "actual": coverage_percent, "passed": coverage_percent >= g.minCoveragePercent},
        {"gate": "duplication", "limit": float(g.maxDuplicationPercent), "actual": duplication_percent, "passed": duplication_percent <= g.maxDuplicationPercent},
        {"gate": "deadCode", "limit": float(g.deadCode.maxFiles), "actual": float(dead_files), "passed": not g.deadCode.enabled or dead_files <= g.deadCode.maxFiles},
    ]


def drop_explained(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters without the token pairs whose two sides lie within two members of another cluster."""
    others = members.join(clusters.where("detector <> 'tokens'").select("cluster"), "cluster", "left_semi")
    outer = others.select("cluster", F.sha2(F.concat_ws("|", "path", "start_line", "end_line", F.coalesce("name", F.lit(""))), 256).alias("member"), "path", "start_line", "end_line")
    own = members.join(clusters.where("detector = 'tokens'").select("cluster"), "cluster", "left_semi")
    counted = own.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by(F.struct("path", "start_line", "end_line"), "member").alias("a"), F.max_by(F.struct("path", "start_line", "end_line"), "member").alias("b"))
    pairs = counted.where("n = 2").select(
        F.col("cluster").alias("pair"),
        *[F.col(f"{x}.{c}").alias(f"{k}_{x}") for x in "ab" for c, k in (("path", "path"), ("start_line", "start"), ("end_line", "end"))],
    )
    kept = lines.unexplained_pairs(pairs, outer).select(F.col("pair").alias("cluster"))
    gone = pairs.select(F.col("pair").alias("cluster")).join(kept, "cluster", "left_anti")
    return clusters.join(gone, "cluster", "left_anti")


def run_audit(files: DataFrame, config: Config, detectors: list[Detector] | None = None, manifest: Manifest = Manifest(), options: CompilerOptions = CompilerOptions(), baseline: DataFrame | None = None) -> Audit:
    """Run the detectors over ``files(ord, path, ext, text, lines, excluded)`` and judge the result.

    With a ``baseline(fingerprint)``, only clusters that it does not hold count against the duplication gate.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "audit")
    results = [d.run(files) for d in (create_detectors(config, manifest, options) if detectors is None else detectors)]
    clusters = scratch.cut(_union([r.clusters for r in results]), "clusters")
    members = scratch.cut(_union([r.members for r in results]), "members")
    findings = scratch.cut(_union([r.findings for r in results]), "findings")
    failures = scratch.cut(_union([r.failures for r in results]).distinct(), "failures")
    analyzed = scratch.cut(_union([r.analyzed for r in results]).distinct(), "analyzed")
    own = files.where(~F.col("excluded"))

    kept = scratch.cut(drop_explained(clusters, members), "kept")
    members = members.join(kept.select("cluster"), "cluster", "left_semi")
    prints = scratch.cut(base.cluster_fingerprints(kept, members, own.select("path", "text")), "fingerprints")
    fresh = prints if baseline is None else base.split_against(prints, baseline)[0]
    fresh = fresh.select("cluster", F.lit(True).alias("new"))
    place = F.struct("path", "start_line", "end_line", "name")
    nested = members.groupBy("cluster").agg(F.array_sort(F.collect_list(place)).alias("locations"))
    rank = F.when(F.col("detector") == "tokens", 1).otherwise(0)
    listed = kept.join(lines.savable_lines(members), "cluster", "left").join(nested, "cluster").join(fresh, "cluster", "left")
    listed = listed.select("cluster", "detector", "kind", "similarity", F.coalesce("savable", F.lit(0)).alias("savable"), rank.alias("rank"), "locations", F.coalesce("new", F.lit(False)).alias("new"))
    listed = scratch.cut(listed, "listed")

    covered = lines.coverage(own.select("path", "lines"), analyzed).first()
    every = lines.duplicated_lines(members).first()["duplicated_lines"]
    gated = members.join(listed.where("new").select("cluster"), "cluster", "left_semi")
    new_lines = every if baseline is None else lines.duplicated_lines(gated).first()["duplicated_lines"]
    percent = lambda n: n * 100.0 / covered["covered_lines"] if covered["covered_lines"] else 0.0
    counts = {r["kind"]: r["count"] for r in findings.groupBy("kind").count().collect()}
    by_detector = {r["detector"]: r["count"] for r in listed.groupBy("detector").count().collect()}
    excluded = files.where("excluded").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    total, new = sum(by_detector.values()), listed.where("new").count()
    numbers = {
        "coverage": {"percent": covered["percent"], "coveredLines": covered["covered_lines"], "totalLines": covered["total_lines"]},
        "duplication": {"percent": percent(every), "duplicatedLines": every, "clusterCount": total, "clustersByDetector": by_detector}
        | ({} if baseline is None else {"baseline": {"baselinedClusterCount": total - new, "newClusterCount": new, "newPercent": percent(new_lines)}}),
        "deadCode": {"deadFileCount": counts.get("dead-file", 0), "deadExportCount": counts.get("dead-export", 0), "uncertainFileCount": counts.get("uncertain-file", 0), "uncertainExportCount": counts.get("uncertain-export", 0)},
        "excluded": {"files": excluded["files"], "lines": excluded["lines"]},
    }
    gates = gate_rows(config, covered["percent"], percent(new_lines), counts.get("dead-file", 0))
    return Audit(listed, findings, failures, lines.uncovered_by_extension(own, analyzed), prints.select("fingerprint").distinct(), numbers, gates, [n for r in results for n in r.notes])


def by_savings(clusters: DataFrame) -> DataFrame:
    """Clusters by savable lines, the largest first; token pairs last among equals."""
    return clusters.orderBy(F.desc("savable"), "rank", F.col("locations")[0]["path"], F.col("locations")[0]["start_line"], "cluster")


def largest(clusters: DataFrame, n: int) -> DataFrame:
    return by_savings(clusters).limit(n)


def first_by(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def empty_baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "fingerprint string")
