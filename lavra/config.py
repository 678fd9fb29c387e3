"""Settings read from the environment and an ``.env`` file, with limits and fallbacks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

# What counts as true, and each setting's variable, fallback and least value.
TRUE = frozenset({"1", "true", "yes", "sim", "on"})
FORMATS = ("txt", "md")
VARIABLES = {
    "base_url": ("DEFAULT_BASE_URL", "https://example.com", None),
    "same_domain_only": ("SAME_DOMAIN_ONLY", True, None),
    "headless": ("HEADLESS", True, None),
    "max_pages": ("MAX_PAGES", 500, 1),
    "max_depth": ("MAX_DEPTH", 2, 0),
    "output_dir": ("OUTPUT_DIR", "data/0_extracao_bruta", None),
    "pdf_dir": ("PDF_OUTPUT_DIR", "pdf/originais", None),
    "output_format": ("OUTPUT_FORMAT", "txt", None),
    "navigation_timeout_ms": ("NAVIGATION_TIMEOUT_MS", 120_000, 1_000),
    "request_timeout_ms": ("REQUEST_TIMEOUT_MS", 60_000, 1_000),
    "politeness_delay": ("POLITENESS_DELAY", 0.6, 0.0),
    "respect_robots": ("RESPECT_ROBOTS_TXT", True, None),
    "user_agent": ("CRAWLER_USER_AGENT", "lavra/1.0", None),
}
REQUESTS_PER_MINUTE = 20


def read_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = env.get(name)
    return default if value is None else value.strip().lower() in TRUE


def read_number(env: Mapping[str, str], name: str, default, least=None, kind=int):
    """The number, at least ``least``; the default if it can't be read."""
    try:
        value = kind(env[name])
    except (KeyError, ValueError):
        return default
    return value if least is None else max(least, value)


def read_env_file(path: str | Path) -> dict[str, str]:
    """The ``NAME=value`` lines of a file, quotes around values taken off; comments and other lines are left out; none without a file."""
    path = Path(path)
    if not path.is_file():
        return {}
    found = {}
    for line in map(str.strip, path.read_text(encoding="utf-8").splitlines()):
        if line and line[0] != "#" and "=" in line:
            name, _, value = line.partition("=")
            found[name.strip()] = value.strip().strip('"').strip("'")
    return found


@dataclass(frozen=True)
class Settings:
    base_url: str = VARIABLES["base_url"][1]
    same_domain_only: bool = True
    headless: bool = True
    max_pages: int = 500
    max_depth: int = 2
    output_dir: str = VARIABLES["output_dir"][1]
    pdf_dir: str = VARIABLES["pdf_dir"][1]
    output_format: str = "txt"
    navigation_timeout_ms: int = 120_000
    request_timeout_ms: int = 60_000
    politeness_delay: float = 0.6
    respect_robots: bool = True
    user_agent: str = VARIABLES["user_agent"][1]

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | Path | None = None) -> Settings:
        """From ``env`` (by default the process's), whose variables win over those of ``env_file``."""
        env = {**(read_env_file(env_file) if env_file else {}), **(os.environ if env is None else env)}
        values = {}
        for f in fields(cls):
            name, default, least = VARIABLES[f.name]
            if isinstance(default, bool):
                values[f.name] = read_bool(env, name, default)
            elif isinstance(default, int | float):
                values[f.name] = read_number(env, name, default, least, type(default))
            else:
                values[f.name] = env.get(name, default).strip() or default
        form = values["output_format"].lower()
        values["output_format"] = form if form in FORMATS else "txt"
        for name in ("output_dir", "pdf_dir"):
            values[name] = os.path.expanduser(values[name])
        return cls(**values)

    def delay(self, crawl_delay: float | None) -> float:
        """The longer of the own delay and the site's."""
        return max(self.politeness_delay, crawl_delay or 0.0)


def least_interval(requests_per_minute: int = REQUESTS_PER_MINUTE) -> float:
    """Seconds between two requests to a service; 0 without a limit."""
    return 60 / requests_per_minute if requests_per_minute > 0 else 0.0
