"""Settings of a workspace from a YAML file: sources, rules, severities, gate, explicit versions, ignore patterns.

Every key is known or refused, so that a misspelt setting never goes unnoticed.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from factloom.rules import FAIL_ON_RANK, IMMUTABLE_PREDICATES, SEVERITY_RANK, RuleContext


class ConfigError(ValueError):
    """Settings that cannot be used; the message says which and why."""


def read_yaml(path: str | Path) -> Any:
    """The content of a YAML file."""
    try:
        import yaml
    except ImportError as missing:
        raise ConfigError("YAML files need the package PyYAML") from missing
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"{path} is no file")
    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} is no valid YAML: {error}") from error


def mapping(raw: Any, allowed: dict[str, Any], where: str, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """``raw`` with defaults filled in; unknown, missing and mistyped keys are refused.

    ``allowed`` names for each key a type, a tuple of types, or a function that checks and converts the value.
    """
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    if unknown := sorted(set(map(str, raw)) - set(allowed)):
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    if lacking := [k for k in required if raw.get(k) in (None, "")]:
        raise ConfigError(f"{where}: {', '.join(lacking)} is missing")
    out = {}
    for key, check in allowed.items():
        value = raw.get(key)
        if value is not None:
            if isinstance(check, (type, tuple)):
                if not isinstance(value, check) or (isinstance(value, bool) and check is not bool and not (isinstance(check, tuple) and bool in check)):
                    raise ConfigError(f"{where}: {key} has a value of the wrong type")
            else:
                value = check(value, f"{where}.{key}")
        out[key] = value
    return out


def one_of(values):
    def check(value, where):
        if value not in values:
            raise ConfigError(f"{where} must be one of {', '.join(map(str, values))}")
        return value

    return check


def list_of(check=str, least: int = 0):
    def each(value, where):
        if not isinstance(value, list) or len(value) < least:
            raise ConfigError(f"{where} must be a list" + (f" of at least {least}" if least else ""))
        if isinstance(check, type):
            if not all(isinstance(v, check) for v in value):
                raise ConfigError(f"{where} has a value of the wrong type")
            return value
        return [check(v, f"{where}[{i}]") for i, v in enumerate(value)]

    return each


def days(value, where):
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ConfigError(f"{where} must be a number of days, 1 or more")
    return value


def share(value, where):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ConfigError(f"{where} must be between 0 and 1")
    return float(value)


def severities(value, where):
    if not isinstance(value, dict) or not all(isinstance(k, str) and v in SEVERITY_RANK for k, v in value.items()):
        raise ConfigError(f"{where} must map names to {', '.join(SEVERITY_RANK)}")
    return value


RULES = {"stale_after_days": days, "pricing_stale_days": days, "multi_valued_predicates": list_of(), "immutable_metadata_predicates": list_of()}
_ENDPOINT = {"provider": str, "model": str, "base_url": str, "api_key_env": str}


def context(rules: dict | None, severity: dict | None, as_of: date) -> RuleContext:
    """Rules as the detectors take them."""
    r = rules or {}
    immutable = r.get("immutable_metadata_predicates")
    return RuleContext(
        as_of=as_of,
        stale_after_days=r.get("stale_after_days") or 365,
        pricing_stale_days=r.get("pricing_stale_days"),
        severity=severity or {},
        multi_valued=frozenset(r.get("multi_valued_predicates") or ()),
        immutable=frozenset(IMMUTABLE_PREDICATES if immutable is None else immutable),
    )


@dataclass(frozen=True)
class Settings:
    """Checked settings; :meth:`rules` gives them as the detectors take them."""

    workspace: str
    sources: list[dict] = field(default_factory=list)
    rule_settings: dict = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)
    fail_on: str = "critical"
    versions: list[dict] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    extraction: dict | None = None
    embedding: dict | None = None

    def rules(self, as_of: date) -> RuleContext:
        return context(self.rule_settings, self.severity, as_of)

    def digest(self) -> str:
        """SHA-256 of the settings as canonical JSON."""
        return hashlib.sha256(json.dumps(self.__dict__, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def parse(raw: Any) -> Settings:
    """Settings from parsed YAML."""
    if raw is None:
        raise ConfigError("the settings are empty")

    def source(v, where):
        s = mapping(v, {"path": str, "authority": share, "type": str}, where, ("path", "type"))
        return {**s, "authority": 0.9 if s["authority"] is None else s["authority"]}

    def group(v, where):
        file = lambda f, at: mapping(f, {"path": str, "label": str, "supersedes": str}, at, ("path",))
        return mapping(v, {"group": str, "files": list_of(file, 1)}, where, ("group", "files"))

    endpoint = lambda v, where: mapping(v, _ENDPOINT, where, ("provider", "model"))
    vectors = lambda v, where: mapping(v, {**_ENDPOINT, "dimensions": days}, where, ("provider", "model"))
    allowed = {
        "workspace": lambda v, w: mapping(v, {"name": str}, w, ("name",)),
        "sources": list_of(source),
        "rules": lambda v, w: mapping(v, RULES, w),
        "severity": severities,
        "ci": lambda v, w: mapping(v, {"fail_on": one_of(FAIL_ON_RANK)}, w),
        "version_mapping": list_of(group),
        "ignore": list_of(),
        "extraction": endpoint,
        "embedding": vectors,
    }
    x = mapping(raw, allowed, "settings", ("workspace",))
    return Settings(
        workspace=x["workspace"]["name"],
        sources=x["sources"] or [],
        rule_settings={k: v for k, v in (x["rules"] or {}).items() if v is not None},
        severity=x["severity"] or {},
        fail_on=(x["ci"] or {}).get("fail_on") or "critical",
        versions=x["version_mapping"] or [],
        ignore=x["ignore"] or [],
        extraction=x["extraction"],
        embedding=x["embedding"],
    )


def load(path: str | Path) -> Settings:
    """Settings from a YAML file."""
    raw = read_yaml(path)
    if raw is not None and not isinstance(raw, dict):
        raise ConfigError(f"{path}: the root must be a mapping")
    return parse(raw)
