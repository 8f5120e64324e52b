"""Settings with defaults, from files and environment, checked as a whole."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """``${X}`` and ``$X`` become values that are set and not empty; others stay."""
    env = dict(os.environ) if env is None else env
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2]) or m[0], text)


def secret(value: str) -> str:
    """``@/path`` stands for the content of that file."""
    if value.startswith("@/"):
        with open(value[1:]) as f:
            return f.read().strip()
    return value


@dataclass
class Config:
    """Limits of a run; ``validated`` names everything that is wrong at once."""

    max_depth: int = 10
    max_urls_per_host: int = 10_000
    max_total_urls: int = 100_000
    max_retries: int = 3
    max_routes: int = 50
    max_iframe_depth: int = 2
    normalize_urls: bool = True
    allowed_domains: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    iframe_skip: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, env: dict[str, str] | None = None) -> Config:
        with open(path) as f:
            got = json.loads(substitute(f.read(), env))
        known = {x.name for x in fields(cls)}
        if unknown := sorted(set(got) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**got).validated()

    def validated(self) -> Config:
        wrong = [f"{n} must be at least {least}" for n, least in (("max_depth", 0), ("max_urls_per_host", 1), ("max_total_urls", 1), ("max_retries", 0), ("max_routes", 0), ("max_iframe_depth", 0)) if getattr(self, n) < least]
        if self.max_urls_per_host > self.max_total_urls:
            wrong.append("max_urls_per_host is more than max_total_urls")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self
