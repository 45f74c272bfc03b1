"""Git hooks that keep an index up to date: install, uninstall and probe.

Each hook holds one section between two marker lines; what stands around it is never touched.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

BEGIN, END = "# >>> arborsim >>>", "# <<< arborsim <<<"
HOOKS = {"post-commit": "update", "post-merge": "update", "post-checkout": "update"}
SHELL = "#!/bin/sh\n"
_SECTION = re.compile(f"\n?{re.escape(BEGIN)}\n.*?{re.escape(END)}(?:\n|$)", re.DOTALL)


def section(command: str) -> str:
    """Runs the command in the background, where it is installed."""
    return f"\n{BEGIN}\nif type arborsim > /dev/null 2>&1; then (arborsim {command} > /dev/null 2>&1 &); fi\n{END}\n"


def _body(path: Path) -> str | None:
    """The file's text; None if there is none to read."""
    try:
        return path.read_text()
    except (OSError, UnicodeDecodeError):
        return None


def _files(git_dir: str) -> dict[str, Path]:
    return {name: Path(git_dir) / "hooks" / name for name in HOOKS}


def installed(git_dir: str) -> list[str]:
    return [name for name, path in _files(git_dir).items() if BEGIN in (_body(path) or "")]


def missing(git_dir: str) -> list[str]:
    have = installed(git_dir)
    return [name for name in HOOKS if name not in have]


def install(git_dir: str) -> dict[str, str]:
    """What was done for each hook: created, appended or updated. Safe to repeat."""
    did = {}
    for name, path in _files(git_dir).items():
        path.parent.mkdir(parents=True, exist_ok=True)
        old = path.read_text() if path.exists() else None
        did[name] = "created" if old is None else "updated" if BEGIN in old else "appended"
        rest = SHELL if old is None else _SECTION.sub("", old)
        path.write_text(rest + ("" if rest.endswith("\n") else "\n") + section(HOOKS[name]))
        os.chmod(path, 0o755)
    return did


def uninstall(git_dir: str) -> dict[str, str]:
    """What was done for each of our hooks: removed (nothing else was in it) or cleaned."""
    did, files = {}, _files(git_dir)
    for name in installed(git_dir):
        rest = _SECTION.sub("", files[name].read_text())
        if rest.strip() in ("", SHELL.strip()):
            files[name].unlink()
        else:
            files[name].write_text(rest)
        did[name] = "cleaned" if files[name].exists() else "removed"
    return did
