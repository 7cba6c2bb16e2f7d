"""Settings from YAML or a dictionary, with ${dotted.name} references."""

from __future__ import annotations

import os
import re
from typing import Any

from pulsegrid.errors import ConfigurationError

REFERENCE = re.compile(r"\$\{([^}]+)\}")


class Settings:
    """Nested settings read by dotted names. References are followed to any depth; unknown ones stay as written."""

    def __init__(self, values: dict[str, Any]):
        self.values = values

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("reading YAML needs pyyaml") from e
        try:
            with open(path) as f:
                return cls(yaml.safe_load(f) or {})
        except OSError as e:
            raise ConfigurationError(f"cannot read {path}") from e

    def _raw(self, name: str) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return None
            at = at[part]
        return at

    def _resolve(self, value: Any, seen: tuple[str, ...] = ()) -> Any:
        if not isinstance(value, str):
            return value

        def follow(m: re.Match) -> str:
            name = m.group(1)
            found = None if name in seen else self._raw(name)
            return m.group(0) if found is None else str(self._resolve(found, (*seen, name)))

        return REFERENCE.sub(follow, value)

    def get(self, name: str, default: Any = None) -> Any:
        value = self._raw(name)
        return default if value is None else self._resolve(value)

    def get_path(self, name: str, make: bool = False) -> str:
        """A path below `paths`, made if wanted; raises where there is none."""
        path = self.get(f"paths.{name}")
        if not isinstance(path, str) or not path.strip():
            raise ConfigurationError(f"no path {name}")
        if make:
            os.makedirs(path, exist_ok=True)
        return path

    def get_all_paths(self) -> dict[str, str]:
        """All texts below `paths` by dotted name, resolved."""
        out: dict[str, str] = {}

        def walk(prefix: str, at: Any) -> None:
            if isinstance(at, dict):
                for k, v in at.items():
                    walk(f"{prefix}.{k}" if prefix else k, v)
            elif isinstance(at, str):
                out[prefix] = self._resolve(at)

        walk("", self._raw("paths"))
        return out
