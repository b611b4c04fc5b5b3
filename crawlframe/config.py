"""Settings of a crawl and the fixed values its results depend on."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# File suffixes a crawl does not follow.
IGNORED_SUFFIXES = (
    ".mp3", ".mp4", ".jpg", ".png", ".gif", ".exe", ".zip", ".ppt", ".pptx",
    ".doc", ".docx", ".xls", ".xlsx", ".gz", ".bz2", ".7z", ".xz", ".tgz",
    ".tar", ".msi", ".pdf",
)

# Fixed value: text between two records of an HTML archive file.
ARCHIVE_SEPARATOR = "\n-----!!!----html-document----!!!-----\n"

# Ports that are left out of an address.
DEFAULT_PORTS = {"http": "80", "ws": "80", "https": "443", "wss": "443", "ftp": "21"}

# Schemes that name a host; every other scheme is opaque.
HOST_SCHEMES = ("http", "https", "ftp", "ws", "wss")


@dataclass(frozen=True)
class CrawlConfig:
    """One crawl's settings; pass it whole or use its fields as arguments."""

    target_lang: str = "ja"
    concurrency: int = 10
    agent: str = "crawlframe-bot"
    seeds: tuple[str, ...] = ("http://www.example.org/",)
    seed_files: tuple[str, ...] = ()
    ignored_suffixes: tuple[str, ...] = IGNORED_SUFFIXES
    body_cap: int = 2 * 1024 * 1024
    min_confidence: float = 0.7
    minority_share: float = 0.02
    default_wait_s: float = 5.0
    throttle_s: float = 5.0
    reconnect_above_s: float = 20.0
    skip_above_s: float = 120.0
    max_hops: int = 10
    max_failures: int = 3
    robots_max_failures: int = 4
    skip_weight: int = 100
    completion_weight: int = 20
    block_weight: int = 100
    idle_s: int = 600
    first_check_s: int = 900
    check_every_s: int = 300
    uri_lines_per_file: int = 100_000
    html_bytes_per_file: int = 200 * 1024 * 1024

    @classmethod
    def load(cls, path: str) -> "CrawlConfig":
        """Settings from a JSON object; fields it does not name keep their defaults."""
        with open(path, encoding="utf-8") as handle:
            given = json.load(handle)
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(given) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
