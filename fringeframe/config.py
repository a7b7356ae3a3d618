"""Options of the command line, from JSON files and flags."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

#: Keys of a configuration that only a person reads begin with this.
COMMENT = "_"


def load(path: str) -> dict[str, object]:
    """The options of a JSON file, comments left out."""
    found = json.loads(Path(path).read_text())
    if not isinstance(found, dict):
        raise ValueError(f"{path}: an object of options is wanted")
    return {k: v for k, v in found.items() if not k.startswith(COMMENT)}


def as_arguments(options: dict[str, object]) -> list[str]:
    """Options as the flags that say the same, for the parser to check like any others; what is given twice refuses."""
    out: dict[str, str | None] = {}
    for key, value in options.items():
        flag = "--" + key.strip(" -").replace("_", "-")
        if flag in out:
            raise ValueError(f"{flag} is given twice")
        if value is True:
            out[flag] = flag
        elif value is None or value is False:
            out[flag] = None
        else:
            out[flag] = f"{flag}={','.join(map(str, value)) if isinstance(value, list | tuple) else value}"
    return [argument for argument in out.values() if argument]


def record(args: argparse.Namespace) -> str:
    """A configuration that runs the same again."""
    return json.dumps({k: v for k, v in sorted(vars(args).items()) if k not in ("command", "config", "run")}, indent=2, default=str)


def pair(text: str | list | tuple) -> tuple[float, float]:
    """Two numbers from "x,y" or a list of two."""
    parts = text.split(",") if isinstance(text, str) else list(text)
    if len(parts) != 2:
        raise ValueError(f"two numbers are wanted, not {text!r}")
    return float(parts[0]), float(parts[1])
