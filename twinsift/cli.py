"""Commands: audit (the default), baseline and calibrate. Exit code 0: passed, 1: a gate failed, 2: it could not run."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from twinsift.config import ConfigError, load_config
from twinsift.operators import calibrate
from twinsift.operators.detectors import StructureDetector
from twinsift.operators.tokens import MatcherError
from twinsift.plans.audit import run_audit
from twinsift.session import build_session
from twinsift.sinks import report
from twinsift.sources.project import InventoryError, compiler_options, parse_manifest, read_inventory


def whole(least: int):
    def read(value: str) -> int:
        if not value.lstrip("-").isdigit() or int(value) < least:
            raise argparse.ArgumentTypeError(f"a whole number from {least} is needed, not {value!r}")
        return int(value)

    return read


def _arguments(argv: list[str]) -> argparse.Namespace:
    command = argv[0] if argv and argv[0] in ("audit", "baseline", "calibrate") else "audit"
    rest = argv[1:] if argv and argv[0] == command else argv
    parser = argparse.ArgumentParser(prog=f"twinsift {command}")
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--config")
    parser.add_argument("--out")
    parser.add_argument("--min-lines", type=whole(1))
    if command == "calibrate":
        parser.add_argument("--samples", type=whole(1), default=200)
        parser.add_argument("--precision-samples", type=whole(1), default=50)
        parser.add_argument("--seed", type=whole(0), default=1)
    out = parser.parse_args(rest)
    out.command = command
    return out


def run(argv: list[str]) -> int:
    try:
        args = _arguments(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    try:
        root = os.path.abspath(args.root)
        config = load_config(root, args.config)
        if args.min_lines:  # not for style sheets, whose rules are short
            config = replace(config, tokens=replace(config.tokens, minLines=args.min_lines), structure=replace(config.structure, minLines=args.min_lines))
        out = os.path.join(root, args.out or ".twinsift")
        os.makedirs(out, exist_ok=True)
        spark = build_session()
        files = read_inventory(spark, root, config)
        if args.command == "calibrate":
            return _calibrate(spark, files, config, args, out)
        manifest_path = os.path.join(root, "package.json")
        manifest = parse_manifest(open(manifest_path, encoding="utf-8").read() if os.path.isfile(manifest_path) else None)
        known = os.path.join(root, ".twinsift-baseline.json")
        baseline = report.load_baseline(spark, known) if args.command == "audit" and config.baseline.enabled else None
        audit = run_audit(files, config, manifest=manifest, options=compiler_options(root), baseline=baseline)
        if args.command == "baseline":
            print(f"{report.write_baseline(audit.fingerprints, known)} fingerprints in {known}")
            return 0
        document = report.report(audit, root)
        report.write_report(document, out)
        report.write_sarif(document, out)
        print(report.summary(document, out))
        return 0 if audit.passed else 1
    except (ConfigError, InventoryError, MatcherError, report.BaselineError, OSError) as e:
        print(f"twinsift: {e}", file=sys.stderr)
        return 2


def _calibrate(spark, files, config, args, out: str) -> int:
    own = files.where("not excluded")
    detector = StructureDetector(config)
    sampled = calibrate.draw(calibrate.candidates(own, config.structure), args.seed, args.samples, "path", "start_line").cache()
    changed = calibrate.mutants(sampled, config.structure, args.seed).cache()
    last = own.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).first()["m"]
    extra = changed.select((F.dense_rank().over(_by_path()) + last).cast("bigint").alias("ord"), "path", "ext", "text", F.lit(0).alias("lines"), F.lit(False).alias("excluded"))
    plain = run_audit(own, config, detectors=[detector])
    found = detector.run(own.unionByName(extra))
    rates = calibrate.recall(changed, calibrate.detected(changed, found.members))
    table = report.calibration_table(sampled.count(), plain.clusters.count(), rates)
    shown = calibrate.draw(plain.clusters, args.seed, args.precision_samples, "cluster")
    report._write(out, "calibration.json", json.dumps([r.asDict() for r in rates.collect()], indent=2) + "\n")
    report._write(out, "precision-sample.md", report.precision_sample(shown, own))
    print(table)
    return 0


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
