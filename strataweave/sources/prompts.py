"""Prompt templates: JSON files, or YAML ones where its package is there, looked up by dotted names, filled by plain replacement."""

from __future__ import annotations

import functools
import json
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON files are read without it
    yaml = None

SUFFIXES = (".json", ".yaml", ".yml")


@functools.cache
def load(path: str) -> dict:
    """A template file; read once."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    if yaml is None:
        raise RuntimeError(f"{path}: the YAML package is not installed")
    return yaml.safe_load(text)


def file_of(folder: str, name: str) -> str:
    """The template file of a name; JSON before YAML."""
    found = [p for p in (Path(folder) / f"{name}{s}" for s in SUFFIXES) if p.exists()]
    if not found:
        raise FileNotFoundError(f"no template file {name!r} in {folder}")
    return str(found[0])


def clear() -> None:
    load.cache_clear()


def names(folder: str) -> list[str]:
    """Names of the template files of a folder, without suffix."""
    return sorted({p.stem for p in Path(folder).iterdir() if p.suffix in SUFFIXES})


def lookup(folder: str, name: str, **values: str) -> str:
    """The template `file.section.key...` (three parts or more) with its `{name}` parts put in; other braces stay."""
    parts = name.split(".")
    if len(parts) < 3:
        raise ValueError(f"{name!r} has fewer than three parts")
    found = load(file_of(folder, parts[0]))
    for part in parts[1:]:
        if not isinstance(found, dict) or part not in found:
            raise KeyError(name)
        found = found[part]
    if not isinstance(found, str):
        raise TypeError(f"{name!r} is no text")
    for key, value in values.items():
        found = found.replace("{" + key + "}", value)
    return found


def thinking(folder: str, prompt: str, mode: str = "analytical") -> str:
    """A prompt behind the text of a mode of thinking (`core.thinking_modes.<mode>`); an unknown mode is an error."""
    try:
        prefix = lookup(folder, f"core.thinking_modes.{mode}")
    except KeyError:
        raise ValueError(f"no mode of thinking {mode!r}") from None
    return f"{prefix}\n\n{prompt}"
