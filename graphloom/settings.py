"""Limits and defaults, in one value that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    workspace_root: str = "./data/workspaces"
    table_root: str = "./data/tables"
    # fixed values: ceilings that must equal those of the system whose results we match
    max_archive_bytes: int = 1024 * 1024 * 1024
    max_archive_entries: int = 50_000
    max_archive_entry_bytes: int = 100 * 1024 * 1024
    max_archive_ratio: int = 100
    clone_timeout_seconds: int = 120
    max_clone_bytes: int = 1024 * 1024 * 1024
    max_source_bytes: int = 5 * 1024 * 1024
    max_upload_bytes: int = 200 * 1024 * 1024
    max_impact_depth: int = 10
    max_path_depth: int = 15
    max_limit: int = 500
    query_timeout_seconds: float = 10.0
    parse_seconds: float = 60.0
