"""The audit's settings: frozen dataclasses, read from JSON with a strict deep merge."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

DETECTORS = ("tokens", "structure", "css", "deadcode")
CONFIG_FILE = "twinsift.config.json"

#: What is left out, and what counts as code, unless the settings say otherwise.
IGNORE = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/coverage/**",
    "**/*.min.*",
    "**/*.d.ts",
    "**/*.generated.*",
    "**/*.test.*",
    "**/*.spec.*",
    "**/__tests__/**",
    "**/__mocks__/**",
)
CODE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".css", ".scss", ".less", ".sql", ".html", ".htm", ".vue", ".svelte")
TOKEN_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".css", ".scss", ".less", ".sql", ".html", ".htm")
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
TEMPLATE_EXTENSIONS = (".vue", ".svelte", ".html", ".htm")


class ConfigError(ValueError):
    """Settings that cannot be used; the message lists every problem."""


# The names and defaults of the settings below.


@dataclass(frozen=True)
class DeadCodeGate:
    enabled: bool = False
    maxFiles: int = 0


@dataclass(frozen=True)
class Gates:
    minCoveragePercent: float = 90
    maxDuplicationPercent: float = 5
    deadCode: DeadCodeGate = field(default_factory=DeadCodeGate)


@dataclass(frozen=True)
class Tokens:
    extensions: tuple[str, ...] = TOKEN_EXTENSIONS
    minTokens: int = 60
    minLines: int = 5


@dataclass(frozen=True)
class Structure:
    minNodes: int = 40
    minLines: int = 5
    similarity: float = 0.85
    maxTedNodes: int = 5000
    candidateJaccard: float = 0.4
    maxPosting: int = 64


@dataclass(frozen=True)
class Css:
    minDeclarations: int = 3
    similarity: float = 0.85


@dataclass(frozen=True)
class DeadCode:
    entry: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    treatTestsAsEntry: bool = True


@dataclass(frozen=True)
class BaselineSettings:
    enabled: bool = False


@dataclass(frozen=True)
class Config:
    detectors: tuple[str, ...] = DETECTORS
    ignore: tuple[str, ...] = IGNORE
    codeExtensions: tuple[str, ...] = CODE_EXTENSIONS
    gates: Gates = field(default_factory=Gates)
    tokens: Tokens = field(default_factory=Tokens)
    structure: Structure = field(default_factory=Structure)
    css: Css = field(default_factory=Css)
    deadcode: DeadCode = field(default_factory=DeadCode)
    baseline: BaselineSettings = field(default_factory=BaselineSettings)


def _same_kind(default: Any, value: Any) -> bool:
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    if isinstance(default, (int, float)):
        return isinstance(value, (int, float))
    if isinstance(default, tuple):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return isinstance(value, type(default))


def merge(base: Any, given: Any, where: str = "", problems: list[str] | None = None) -> Any:
    """Lay ``given`` (parsed JSON) over a settings object: objects merge, arrays replace, unknown keys are problems."""
    own = [] if problems is None else problems
    if not isinstance(given, dict):
        own.append(f"{where or 'the settings'} must be an object")
    else:
        known = {f.name for f in fields(base)}
        changes = {}
        for key, value in given.items():
            at = f"{where}.{key}" if where else key
            if key not in known:
                own.append(f"unknown setting {at}")
                continue
            default = getattr(base, key)
            if is_dataclass(default):
                changes[key] = merge(default, value, at, own)
            elif not _same_kind(default, value):
                own.append(f"{at} has the wrong type")
            else:
                changes[key] = tuple(value) if isinstance(value, list) else value
        base = replace(base, **changes)
    if problems is None and own:
        raise ConfigError("\n".join(own))
    return base


def validate(config: Config) -> Config:
    """Check every range at once; duplicates among the detectors collapse."""
    whole = lambda v: isinstance(v, int) or float(v).is_integer()
    positive = lambda v: whole(v) and v > 0
    share = lambda v: 0 < v <= 1
    dotted = lambda xs: all(re.fullmatch(r"\.[^./\\]+", x) for x in xs)
    rules = [
        (len(config.detectors) > 0, "detectors: at least one is needed"),
        (set(config.detectors) <= set(DETECTORS), f"detectors: only {', '.join(DETECTORS)} exist"),
        (dotted(config.codeExtensions), "codeExtensions: each must be a dot and a name"),
        (dotted(config.tokens.extensions), "tokens.extensions: each must be a dot and a name"),
        (0 <= config.gates.minCoveragePercent <= 100, "gates.minCoveragePercent: 0 to 100"),
        (0 <= config.gates.maxDuplicationPercent <= 100, "gates.maxDuplicationPercent: 0 to 100"),
        (whole(config.gates.deadCode.maxFiles) and config.gates.deadCode.maxFiles >= 0, "gates.deadCode.maxFiles: a whole number from 0"),
        *((positive(getattr(config.tokens, k)), f"tokens.{k}: a whole number from 1") for k in ("minTokens", "minLines")),
        *((positive(getattr(config.structure, k)), f"structure.{k}: a whole number from 1") for k in ("minNodes", "minLines", "maxTedNodes", "maxPosting")),
        *((share(getattr(config.structure, k)), f"structure.{k}: above 0, at most 1") for k in ("similarity", "candidateJaccard")),
        (positive(config.css.minDeclarations), "css.minDeclarations: a whole number from 1"),
        (share(config.css.similarity), "css.similarity: above 0, at most 1"),
    ]
    problems = [text for ok, text in rules if not ok]
    if problems:
        raise ConfigError("\n".join(problems))
    return replace(config, detectors=tuple(dict.fromkeys(config.detectors)))


def load_config(root: str, explicit: str | None = None) -> Config:
    """Settings of a project: defaults where the usual file is missing; a file named explicitly must exist."""
    path = os.path.join(root, explicit) if explicit else os.path.join(root, CONFIG_FILE)
    if not os.path.exists(path):
        if explicit:
            raise ConfigError(f"there is no settings file {path}")
        return validate(Config())
    with open(path, encoding="utf-8") as f:
        try:
            given = json.load(f)
        except ValueError as e:
            raise ConfigError(f"{path} is not JSON: {e}") from e
    return validate(merge(Config(), given))
