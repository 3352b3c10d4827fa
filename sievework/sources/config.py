"""Configuration files (JSON, or YAML where its parser is installed) to the engine's parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields, replace
from pathlib import Path

from sievework.operators.gate import GateConfig
from sievework.operators.score import Profile


def load(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def version(path: str) -> str:
    """A short digest of a file's content, to tell apart scores made under different settings."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:12]


def gate_config(values: dict) -> GateConfig:
    """GateConfig with the given values; lists become tuples, unknown names are an error."""
    known = {f.name for f in fields(GateConfig)}
    if odd := values.keys() - known:
        raise ValueError(f"unknown gate settings: {sorted(odd)}")
    return replace(GateConfig(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def profile(values: dict) -> Profile:
    """Profile from {"primary": {skill: weight}, "secondary": {...}, ...}."""
    return replace(Profile(), **values)
