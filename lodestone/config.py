"""Project settings: a JSON file, overridden by environment variables."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path

from lodestone import schemas as S

CONFIG_FILE = "rag-config.json"
PREFIX = "LODESTONE_"


@dataclass(frozen=True)
class ProjectConfig:
    """All settings; paths are relative to ``project_dir``."""

    name: str = "project"
    collection: str = "project"
    project_dir: str = "."
    data_dir: str = "data"
    pointer_index: str = "pointer_index"
    store_dir: str = "collections"
    description: str = ""
    key_terms: list[str] = field(default_factory=list)
    file_extensions: list[str] = field(default_factory=lambda: [".md"])
    min_chunk_lines: int = S.MIN_LINES
    max_chunk_lines: int = S.MAX_LINES
    code_chunk_min_lines: int = S.CODE_MIN_LINES
    code_chunk_max_lines: int = S.CODE_MAX_LINES
    enrich_chunks: bool = False
    enrichment_model: str = ""

    def path(self, name: str) -> str:
        return str(Path(self.project_dir) / getattr(self, name))


def slug(name: str) -> str:
    """Lower case, other characters than letters and digits as single dashes."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def collection_name(name: str) -> str:
    return slug(name).replace("-", "_")


def _env_file(folder: Path) -> dict[str, str]:
    path = folder / ".env"
    rows = path.read_text().splitlines() if path.exists() else []
    pairs = (r.strip().partition("=") for r in rows if r.strip() and not r.strip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in pairs if eq}


def _typed(kind: str, value: str):
    if kind.startswith("list"):
        return [x.strip() for x in value.split(",") if x.strip()]
    return {"int": int, "bool": lambda v: v.lower() in ("1", "true", "yes")}.get(kind, str)(value)


@lru_cache(maxsize=32)
def _load(folder: str, stamp: float, env: tuple[tuple[str, str], ...]) -> ProjectConfig:
    path = Path(folder) / CONFIG_FILE
    raw = json.loads(path.read_text()) if stamp else {}
    known = {f.name: str(f.type) for f in fields(ProjectConfig)}
    values = {k: v for k, v in raw.items() if k in known}
    values |= {k: _typed(known[k], v) for k, v in env}
    values.setdefault("name", Path(folder).resolve().name)
    values.setdefault("collection", collection_name(values["name"]))
    return ProjectConfig(**values | {"project_dir": folder})


def load_config(project_dir: str | None = None) -> ProjectConfig:
    """Settings of a project: the argument, else LODESTONE_PROJECT_DIR, else the working folder; variables win over the file."""
    folder = project_dir or os.environ.get(f"{PREFIX}PROJECT_DIR") or "."
    path = Path(folder) / CONFIG_FILE
    have = _env_file(Path(folder)) | dict(os.environ)
    names = [f.name for f in fields(ProjectConfig) if f.name != "project_dir"]
    env = tuple((n, have[PREFIX + n.upper()]) for n in names if PREFIX + n.upper() in have)
    return _load(folder, path.stat().st_mtime if path.exists() else 0.0, env)
