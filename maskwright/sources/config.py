"""Experiment configurations: missing keys are None, arguments are empty, choices expand."""

from __future__ import annotations

import copy
import itertools
import random
from pathlib import Path
from typing import Any


class Config(dict):
    """A mapping whose missing keys are None, and {} for keys that end in ``_args``; nested mappings too."""

    def __missing__(self, key: str) -> Any:
        return Config() if key.endswith("_args") else None

    def __getitem__(self, key: str) -> Any:
        value = super().__getitem__(key)
        if value is None and key.endswith("_args"):
            return Config()
        return Config(value) if isinstance(value, dict) and not isinstance(value, Config) else value

    def get(self, key: str, default: Any = None) -> Any:
        return self[key] if key in self else default if default is not None else self[key]


def find_config(name: str, folders: tuple[str, ...] = ("configs", "configs/generated")) -> Path:
    """The file: as a path, then in each folder, with and without ``.yaml``."""
    tried = [Path(f, n) for f in (".", *folders) for n in (name, f"{name}.yaml")]
    for path in tried:
        if path.is_file():
            return path
    raise FileNotFoundError(f"no configuration {name!r} in {', '.join(map(str, tried))}")


def load_config(name: str, folders: tuple[str, ...] = ("configs", "configs/generated")) -> Config:
    try:
        import yaml
    except ImportError as e:  # an optional library
        raise RuntimeError("reading configurations needs PyYAML") from e
    return Config(yaml.safe_load(find_config(name, folders).read_text()) or {})


def flatten(config: dict, before: tuple[str, ...] = ()) -> dict[tuple[str, ...], Any]:
    """Leaves by path."""
    out: dict[tuple[str, ...], Any] = {}
    for key, value in config.items():
        out |= flatten(value, (*before, key)) if isinstance(value, dict) and value else {(*before, key): value}
    return out


def unflatten(flat: dict[tuple[str, ...], Any]) -> dict:
    out: dict = {}
    for path, value in flat.items():
        node = out
        for key in path[:-1]:
            node = node.setdefault(key, {})
        node[path[-1]] = value
    return out


def _choices(config: dict) -> tuple[dict, dict]:
    fixed, open_ = {}, {}
    for path, value in flatten(config).items():
        if path[-1] == "choice":
            open_[path[:-1]] = value
        else:
            fixed[path] = value
    return fixed, open_


def grid(config: dict) -> list[dict]:
    """One configuration for every combination of the ``choice`` lists."""
    fixed, open_ = _choices(config)
    return [unflatten(copy.deepcopy(fixed) | dict(zip(open_, values, strict=True))) for values in itertools.product(*open_.values())]


def drawn(config: dict, n: int, seed: int = 0) -> list[dict]:
    """``n`` configurations with a choice drawn for each list."""
    fixed, open_ = _choices(config)
    rng = random.Random(seed)
    return [unflatten(copy.deepcopy(fixed) | {p: rng.choice(v) for p, v in open_.items()}) for _ in range(n)]
