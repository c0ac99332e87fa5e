"""Thresholds, weights and project settings. Plain values on the driver; they become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# Enumerations in their order of rank.
SEVERITIES = ("critical", "high", "medium", "low", "informational")
CATEGORIES = ("technical", "on_page", "content", "internal_linking", "structured_data")
STATUSES = ("open", "resolved", "ignored")
FAILED_FETCHES = ("error", "too_large", "blocked_destination")

# Points and weights of scores and priorities.
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.5, "medium": 0.2, "low": 0.05, "informational": 0.0}
CATEGORY_WEIGHTS = {"technical": 30, "on_page": 30, "content": 20, "internal_linking": 10, "structured_data": 10}
SEVERITY_POINTS = {"critical": 55.0, "high": 40.0, "medium": 25.0, "low": 10.0, "informational": 2.0}
EFFORT_POINTS = {"low": 8.0, "medium": 4.0, "high": 0.0}
CONFIDENCE = {"high": 1.0, "medium": 0.85, "low": 0.7}
IMPORTANT_POINTS, GROUP_POINTS = 12.0, 6.0


@dataclass(frozen=True)
class ContentType:
    key: str
    label: str
    patterns: tuple[str, ...]
    expected_sections: tuple[str, ...] = ()
    schema_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    root_url: str = "https://example.org/"
    allowed_hosts: tuple[str, ...] = ("example.org", "www.example.org")
    important_pages: tuple[str, ...] = ()
    page_groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    content_types: tuple[ContentType, ...] = ()
    title: tuple[int, int] = (30, 60)
    description: tuple[int, int] = (70, 160)
    thin_words: int = 200
    slow_ms: int = 1000
    very_slow_ms: int = 3000
    max_links: int = 150
    min_inlinks: int = 3
    max_url: int = 115
    max_depth: int = 3
    severity_weights: dict = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))
    category_weights: dict = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
