"""Settings from files and the session: YAML or JSON, KEY=VALUE files, and where things are kept."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from pgq.plans.policies import Config, configured


def read(path: str) -> Any:
    """A YAML (.yaml, .yml) or JSON file; an empty one is {}."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as e:  # an optional library
        raise RuntimeError(f"{path}: reading YAML needs PyYAML; JSON is read without it") from e
    return yaml.safe_load(text) or {}


def generation(shared: str, regimes: str | None = None) -> Config:
    """The generator's settings from one file, and the knobs by regime from another, under its key `regimes`."""
    return configured(read(shared), read(regimes)["regimes"] if regimes else None)


def environment(path: str) -> dict[str, str]:
    """KEY=VALUE lines set in this process where the key has no value yet; # starts a comment.  Returns what the file says."""
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and key.strip() and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("'\"")
    for k, v in found.items():
        os.environ.setdefault(k, v)
    return found


@dataclass(frozen=True)
class Paths:
    """Folders of a project, all under one root."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name.replace('__', '/')}"


def paths(spark: SparkSession, default: str = "data") -> Paths:
    """Where data is kept: the session's pgq.root, the environment's PGQ_ROOT, or a folder beside the caller.  Attributes
    are folders of it: paths(spark).datasets__augmented is <root>/datasets/augmented."""
    return Paths(spark.conf.get("pgq.root", None) or os.environ.get("PGQ_ROOT", default))
