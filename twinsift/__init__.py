"""Duplicate and dead code audits, and set and text similarity at scale, on Spark DataFrames."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

#: The public functions, by the module that holds each; a module is imported when one of its names is first asked for.
_PUBLIC = {
    "plans.audit": ("run_audit", "drop_explained", "gate_rows"),
    "operators.detectors": ("Detector", "Result", "create_detectors"),
    "operators.baseline": ("cluster_fingerprints", "split_against"),
    "operators.lines": ("coverage", "duplicated_lines", "savable_lines", "span_islands", "unexplained_pairs"),
    "operators.similarity": ("candidate_pairs", "cluster_units", "components"),
    "operators.ted": ("edit_distance", "confirm_trees"),
    "operators.reach": ("reachable", "used_exports", "dead_nodes", "dead_exports", "mentions"),
    "operators.resolve": ("CompilerOptions", "resolve_specifiers"),
    "operators.entrypoints": ("resolve_entries",),
    "operators.calibrate": ("seeded_random", "shuffled", "draw", "mutants", "recall"),
    "operators.tokens": ("match_tokens",),
    "sources.project": ("read_inventory", "as_inventory", "parse_manifest"),
    "sources.script": ("read_units", "extract", "syntax_error"),
    "functions.scalar": ("count_lines",),
    "sinks.report": ("report", "write_tables", "sarif", "summary", "write_baseline", "load_baseline"),
    "streaming.incremental": ("watch_keys", "windowed_deliveries"),
    "config": ("Config", "load_config"),
    "session": ("build_session",),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
