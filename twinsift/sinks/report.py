"""Reports: JSON, SARIF, a console summary, the baseline and the calibration files."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.plans.audit import Audit, by_savings, largest

TOOL = "twinsift"
TOP = 10
RULES = {
    "tokens": "The same token sequence stands in more than one place",
    "structure": "A function is a copy of another: identical, renamed or edited",
    "css": "A rule has the same declarations as another, or nearly",
    "deadcode": "No entry point leads to a file or to the users of an export",
}


class BaselineError(ValueError):
    """A baseline file that cannot be used."""


def _write(folder: str, name: str, text: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_tables(audit: Audit, folder: str) -> None:
    """The report's tables as Parquet, for audits too large for one document."""
    for name in ("clusters", "findings", "failures", "uncovered", "fingerprints"):
        getattr(audit, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def report(audit: Audit, root: str) -> dict:
    """The whole report as one document, for audits of one project."""
    place = lambda r: {"path": r["path"], "startLine": r["start_line"], "endLine": r["end_line"]} | ({"name": r["name"]} if r["name"] else {})
    clusters = [{"detector": r["detector"], "kind": r["kind"], "similarity": r["similarity"], "locations": [place(x) for x in r["locations"]]} for r in by_savings(audit.clusters).toLocalIterator()]
    findings = [{"kind": r["kind"], "location": place(r), "reason": r["reason"]} for r in audit.findings.orderBy("kind", "path", "start_line", "name").toLocalIterator()]
    n = audit.numbers
    return {
        "root": root,
        "generatedAt": datetime.now(UTC).isoformat(),
        "coverage": n["coverage"] | {"uncoveredLinesByExtension": {r["ext"]: r["lines"] for r in audit.uncovered.orderBy("ext").collect()}},
        "duplication": n["duplication"],
        "deadCode": n["deadCode"] | {"findings": findings},
        "gates": {g["gate"]: {k: g[k] for k in ("limit", "actual", "passed")} for g in audit.gates},
        "excluded": n["excluded"],
        "clusters": clusters,
        "failures": [r.asDict() for r in audit.failures.orderBy("path").toLocalIterator()],
        "notes": audit.notes,
    }


def write_report(document: dict, folder: str) -> str:
    return _write(folder, "report.json", json.dumps(document, indent=2, ensure_ascii=False) + "\n")


def sarif(document: dict) -> dict:
    """The report as SARIF 2.1.0: clusters and dead code are warnings, what is uncertain is a note."""
    at = lambda x: {"physicalLocation": {"artifactLocation": {"uri": x["path"]}, "region": {"startLine": x["startLine"], "endLine": x["endLine"]}}}
    results = []
    for c in document["clusters"]:
        first, *rest = c["locations"]
        text = f"{c['kind']} copy in {len(c['locations'])} places, similarity {c['similarity'] * 100:.1f}%"
        results.append({"ruleId": f"{TOOL}/{c['detector']}", "level": "warning", "message": {"text": text}, "locations": [at(first)], "relatedLocations": [{"id": i} | at(x) for i, x in enumerate(rest, 1)]})
    for f in document["deadCode"]["findings"]:
        level = "note" if f["kind"].startswith("uncertain") else "warning"
        results.append({"ruleId": f"{TOOL}/deadcode", "level": level, "message": {"text": f"{f['kind']}: {f['reason']}"}, "locations": [at(f["location"])]})
    rules = [{"id": f"{TOOL}/{k}", "shortDescription": {"text": v}} for k, v in RULES.items()]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": TOOL, "rules": rules}}, "results": results}]}


def write_sarif(document: dict, folder: str) -> str:
    return _write(folder, "report.sarif", json.dumps(sarif(document), indent=2, ensure_ascii=False) + "\n")


def summary(document: dict, folder: str) -> str:
    """A console summary: percentages with one decimal, the ten largest clusters and the first ten findings."""
    cov, dup, dead, gates = (document[k] for k in ("coverage", "duplication", "deadCode", "gates"))
    mark = lambda g: "PASS" if gates[g]["passed"] else "FAIL"
    place = lambda x: f"{x['path']}:{x['startLine']}-{x['endLine']}"
    unsure = dead["uncertainFileCount"] + dead["uncertainExportCount"]
    out = [
        f"{TOOL}: {document['root']}",
        f"Coverage     {cov['percent']:.1f}% of {cov['totalLines']} lines, at least {gates['coverage']['limit']:g}%: {mark('coverage')}",
        f"Duplication  {dup['percent']:.1f}% ({dup['duplicatedLines']} lines, {dup['clusterCount']} clusters), at most {gates['duplication']['limit']:g}%: {mark('duplication')}",
        f"Dead code    {dead['deadFileCount']} files, {dead['deadExportCount']} exports, {unsure} uncertain: {mark('deadCode')}",
    ]
    out += [f"  {d}: {n}" for d, n in dup["clustersByDetector"].items()]
    if "baseline" in dup:
        b = dup["baseline"]
        out.append(f"  baseline: {b['baselinedClusterCount']} known, {b['newClusterCount']} new ({b['newPercent']:.1f}%)")
    out += [f"  not covered {ext}: {n} lines" for ext, n in cov["uncoveredLinesByExtension"].items()]
    if document["excluded"]["files"]:
        out.append(f"  left out: {document['excluded']['files']} files, {document['excluded']['lines']} lines")
    out += [f"  not read {f['path']}: {f['message']}" for f in document["failures"]]
    out += [f"  note: {n}" for n in document["notes"]]
    out += [f"  [{c['detector']} {c['kind']} {c['similarity'] * 100:.1f}%] " + " = ".join(map(place, c["locations"])) for c in document["clusters"][:TOP]]
    out += [f"  [{f['kind']}] {place(f['location'])} {f['reason']}" for f in dead["findings"][:TOP]]
    return "\n".join([*out, f"Reports in {folder}"])


def top_clusters(audit: Audit, n: int = TOP) -> DataFrame:
    return largest(audit.clusters, n)


def write_baseline(fingerprints: DataFrame, path: str) -> int:
    """A baseline file; the number of fingerprints. Large ones are better kept as a Parquet table."""
    prints = sorted(r["fingerprint"] for r in fingerprints.distinct().toLocalIterator())
    _write(os.path.dirname(path) or ".", os.path.basename(path), json.dumps({"generatedAt": datetime.now(UTC).isoformat(), "fingerprints": prints}, indent=2) + "\n")
    return len(prints)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """A baseline's fingerprints; None where there is no file, an error where it is malformed."""
    if not os.path.exists(path):
        return None
    if os.path.isdir(path):
        return spark.read.parquet(path).select("fingerprint")
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
        except ValueError as e:
            raise BaselineError(f"{path} is not JSON: {e}") from e
    prints = data.get("fingerprints") if isinstance(data, dict) else None
    if not isinstance(prints, list) or not all(isinstance(x, str) for x in prints):
        raise BaselineError(f"{path} has no list of fingerprints")
    return spark.createDataFrame([(x,) for x in prints], "fingerprint string")


def calibration_table(sampled: int, found: int, recall: DataFrame) -> str:
    rows = recall.collect()
    return "\n".join([f"Calibration: {sampled} functions drawn, {found} clusters in the code as it is", *(f"  {r['kind']:<17}{r['detected']:>5} of {r['attempted']:<5}{r['recall'] * 100:.1f}%" for r in rows)])


def precision_sample(clusters: DataFrame, files: DataFrame, limit_lines: int = 40) -> str:
    """Two places of each drawn cluster side by side, with boxes to tick."""
    texts = {r["path"]: r["text"] for r in files.join(clusters.select(F.explode("locations").alias("l")).select(F.col("l.path").alias("path")).distinct(), "path", "left_semi").select("path", "text").collect()}
    parts = ["# Precision sample", ""]
    for i, c in enumerate(clusters.collect(), 1):
        parts += [f"## {i}. {c['detector']}, {c['kind']}, {c['similarity'] * 100:.1f}%, {len(c['locations'])} places", ""]
        for x in c["locations"][:2]:
            shown = (texts.get(x["path"]) or "").split("\n")[x["start_line"] - 1 : x["end_line"]]
            parts += [f"`{x['path']}:{x['start_line']}-{x['end_line']}`", "", "```", *shown[:limit_lines], *(["..."] if len(shown) > limit_lines else []), "```", ""]
        parts += ["- [ ] a copy", "- [ ] not a copy", ""]
    return "\n".join(parts)
