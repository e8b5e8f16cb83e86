"""Configuration: a YAML file as a plain dict with dotted look-up, paths, and the session."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import SparkSession


class Config:
    """``get("a.b.c", default)`` gives the default on any miss."""

    def __init__(self, data: dict | None = None):
        self.raw = data or {}

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.raw
        for key in dotted.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def whole(self, dotted: str, default: int) -> int:
        """An integer, or the default for what is none."""
        try:
            return int(self.get(dotted, default))
        except (TypeError, ValueError):
            return default

    def section(self, name: str) -> "Config":
        found = self.get(name, {})
        return Config(found if isinstance(found, dict) else {})

    def __getitem__(self, key: str) -> Any:
        return self.raw[key]

    def __contains__(self, key: str) -> bool:
        return key in self.raw


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as file:
        return Config(yaml.safe_load(file))


def resolve_path(base: str, path: str | None) -> str | None:
    """Absolute paths and ones with a scheme stay; relative ones are joined to ``base``; none for nothing."""
    if not path:
        return None
    return path if os.path.isabs(path) or "://" in path else os.path.normpath(os.path.join(base, path))


def session(name: str = "eventloom", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
