"""Configuration: plugins, sites and feeds from TOML, with overrides from the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from ..operators.chain import Plugin


@dataclass(frozen=True)
class Site:
    """What a news site needs to be read."""

    plugin_name: str
    publisher_name: str = ""
    base_url: str = ""
    min_content_length: int = 400
    starter_urls: tuple = ()
    valid_url_patterns: tuple = ()
    skip_url_patterns: tuple = ()
    body_selectors: tuple = ()
    id_regexes: tuple = ()
    min_last_segment_len: int = 0
    min_path_depth: int = 0
    require_slug_hyphen: bool = False
    article_id_suffix_regex: str | None = None
    article_user_agent: str | None = None
    use_json_ld: bool = True
    feed_urls: tuple = ()
    respect_robots: bool = True


def read(path: str, prefix: str = "GLEANER_") -> dict:
    """A TOML file; an environment variable PREFIX_KEY replaces the top-level key of that name."""
    with open(path, "rb") as file:
        found = tomllib.load(file)
    return found | {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}


def plugins(config: dict) -> list[Plugin]:
    return [Plugin(p["name"], bool(p.get("enabled", True)), p.get("type", "data_processor"), int(p.get("priority", 0)), p) for p in config.get("plugins", [])]


def sites(config: dict) -> list[Site]:
    known = {f.name for f in fields(Site)}
    return [Site(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k in known}) for s in config.get("sites", [])]
