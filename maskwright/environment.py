"""Folders and limits of a run, chosen by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

VARIABLE = "MASKWRIGHT_TEST"


@dataclass(frozen=True)
class Environment:
    """Where data and results lie, and how much of them a run takes (None: all)."""

    name: str
    root: Path
    training_documents: int | None = None
    validation_documents: int | None = None
    short_sentences: bool = False
    save_model: bool = True

    @property
    def data(self) -> Path:
        return self.root / "data"

    @property
    def work(self) -> Path:
        return self.root / "work"

    def path(self, name: str) -> Path:
        """``name`` below the data folder, unless it lies there already."""
        own = Path(name).resolve()
        return Path(name) if own.is_relative_to(self.data.resolve()) else self.data / name


def current(variables: dict[str, str] | None = None) -> Environment:
    """The unit-test environment (four training and two validation documents, short sentences) if its variable is set and not empty, else development."""
    found = os.environ if variables is None else variables
    if found.get(VARIABLE):
        return Environment("unit test", Path("tests", "fixtures"), 4, 2, True, False)
    return Environment("development", Path(found.get("HOME", "."), "maskwright"))
