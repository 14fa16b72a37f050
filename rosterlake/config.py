"""Settings: defaults, then a profile, a TOML file, a .env file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

PREFIX = "ROSTERLAKE_"


@dataclass
class App:
    seed_file: str = "universities_seed.json"
    store_dir: str = ""
    runs_dir: str = "runs"


@dataclass
class Http:
    timeout_seconds: float = 20.0
    request_delay_seconds: float = 0.35
    user_agent: str = "rosterlake/0.1"


@dataclass
class Authors:
    base_url: str = ""
    email: str = ""
    api_key: str = ""
    api_keys: list[str] = field(default_factory=list)
    per_page: int = 10
    max_candidates: int = 5


@dataclass
class Matching:
    threshold: float = 0.82
    ambiguity_margin: float = 0.05


@dataclass
class Publications:
    start_year: int = 2021
    per_page: int = 50
    max_pages_per_author: int = 5


@dataclass
class Embeddings:
    backend: str = "hash"
    model_name: str = ""
    dimension: int = 768


@dataclass
class Search:
    result_limit: int | None = None
    work_limit: int = 5


@dataclass
class Funding:
    nih_base_url: str = ""
    nsf_base_url: str = ""
    per_page: int = 50
    max_pages: int = 5


@dataclass
class Settings:
    app: App = field(default_factory=App)
    http: Http = field(default_factory=Http)
    authors: Authors = field(default_factory=Authors)
    matching: Matching = field(default_factory=Matching)
    publications: Publications = field(default_factory=Publications)
    embeddings: Embeddings = field(default_factory=Embeddings)
    search: Search = field(default_factory=Search)
    funding: Funding = field(default_factory=Funding)


#: Named sets of changes to the defaults.
PROFILES: dict[str, dict[str, dict[str, Any]]] = {"default": {}, "portable": {"embeddings": {"backend": "hash"}}, "small": {"embeddings": {"dimension": 64}}}


def read_dotenv(path: Path) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and key.strip() and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[key.strip()] = value[1:-1] if quoted else value
    return out


def _typed(raw: Any, kind: str) -> Any:
    if not isinstance(raw, str):
        return raw
    if "list" in kind:
        return [p.strip() for p in raw.split(",") if p.strip()]
    if kind.startswith("bool"):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    return int(raw) if kind.startswith("int") else float(raw) if kind.startswith("float") else raw


def _apply(settings: Settings, changes: dict[str, Any]) -> None:
    for section in fields(settings):
        part = getattr(settings, section.name)
        for f in fields(part) if is_dataclass(part) else ():
            if f.name in (own := changes.get(section.name, {})):
                setattr(part, f.name, _typed(own[f.name], str(f.type)))


def load(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None, folder: str = ".") -> Settings:
    """Later sources win; an environment variable is ROSTERLAKE_<SECTION>_<FIELD>, and
    an empty one counts as unset."""
    env = read_dotenv(Path(folder) / ".env") | dict(os.environ if env is None else env)
    chosen = profile or env.get(PREFIX + "PROFILE") or "default"
    if chosen not in PROFILES:
        raise ValueError(f"no profile {chosen}")
    settings = Settings()
    _apply(settings, PROFILES[chosen])
    file = Path(path or env.get(PREFIX + "CONFIG_FILE") or Path(folder) / "rosterlake.toml").expanduser()
    if file.exists():
        _apply(settings, tomllib.loads(file.read_text(encoding="utf-8")))
    named = {(s.name, f.name): env.get(f"{PREFIX}{s.name}_{f.name}".upper()) for s in fields(settings) for f in fields(getattr(settings, s.name))}
    for (section, name), raw in named.items():
        if raw:
            _apply(settings, {section: {name: raw}})
    if not settings.app.store_dir:
        settings.app.store_dir = str(file.parent / "store")
    return settings
