"""Settings with their defaults and rules, and the TOML file they are kept in. They live on the driver."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

TEMPLATE = """# Settings; what is left out has its default.
# max_age_days = 14
# dev_roots = ["~/work"]

# [sources."agent a"]
# dialect = "blocks"
# folder = "~/agent-a/projects"
"""


@dataclass
class Settings:
    """sources: agent to (dialect, folder). Limits of 0 switch their rule off."""

    sources: dict[str, tuple[str, str]] = field(default_factory=dict)
    max_age_days: int = 14
    disabled_repos: list[str] = field(default_factory=list)
    inject_projects: bool = True
    stale_commits: int = 30
    stale_days: int = 60
    names_in_brief: int = 20
    active_days: int = 30
    dev_roots: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("max_age_days", "stale_commits", "stale_days", "names_in_brief", "active_days"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative, got {getattr(self, name)}")
        for agent, (dialect, _) in self.sources.items():
            if dialect not in ("blocks", "rollout"):
                raise ValueError(f"unknown dialect {dialect!r} of {agent!r} (valid: blocks, rollout)")
        self.disabled_repos = [os.path.expanduser(p) for p in self.disabled_repos]
        self.dev_roots = [os.path.expanduser(p) for p in self.dev_roots]

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """The settings of a file, which is made if there is none. Unknown keys are left alone."""
        path = Path(path)
        if not path.exists():
            write_text(path, TEMPLATE)
        doc = tomllib.loads(path.read_text(encoding="utf-8"))
        known = {f.name: doc[f.name] for f in fields(cls) if f.name in doc}
        if "sources" in known:
            known["sources"] = {agent: (s["dialect"], os.path.expanduser(s["folder"])) for agent, s in known["sources"].items()}
        return cls(**known)


def write_text(path: Path, text: str) -> None:
    from .sources.stores import write_atomic

    write_atomic(path, text)


def set_dev_roots(path: str | Path, roots: list[str]) -> None:
    """Changes dev_roots in a settings file and leaves all else in it, comments included, as it is."""
    path = Path(path)
    text = path.read_text(encoding="utf-8") if path.exists() else TEMPLATE
    line = f"dev_roots = {json.dumps(roots, ensure_ascii=False)}\n"
    first = re.search(r"(?m)^\[", text)  # settings of the file itself stand before its tables
    top, table = (text[: first.start()], text[first.start() :]) if first else (text, "")
    own = re.search(r"(?ms)^dev_roots[ \t]*=[ \t]*\[.*?\][^\n]*\n?", top)
    top = top[: own.start()] + line + top[own.end() :] if own else top + ("" if top.endswith("\n") or not top else "\n") + line
    text = top + table
    tomllib.loads(text)  # whatever is written can be read
    write_text(path, text)
