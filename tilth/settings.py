"""Settings from the environment, with a file of ``NAME=value`` lines behind it."""

from __future__ import annotations

import os
from collections.abc import Mapping


def read_file(path: str) -> dict[str, str]:
    """``NAME=value`` lines; blank lines and lines from ``#`` on say nothing, ``export`` and quotes are dropped. No file, no settings."""
    found = {}
    if not os.path.isfile(path):
        return found
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if not sign or not name.strip() or name.startswith("#"):
                continue
            value = value.strip()
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "'\""
            found[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return found


def load(path: str = ".env", environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """All settings; the real environment wins over the file."""
    return {**read_file(path), **(os.environ if environ is None else environ)}


def setting(name: str, default: str | None = None, path: str = ".env", environ: Mapping[str, str] | None = None) -> str | None:
    return load(path, environ).get(name, default)
