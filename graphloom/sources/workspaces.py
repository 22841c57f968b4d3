"""Isolated folders, one per repository, below one root."""

from __future__ import annotations

import shutil
from pathlib import Path

from ..errors import WorkspaceProblem


def contained(root: str | Path, path: str | Path) -> Path:
    base, target = Path(root).resolve(), Path(path).resolve()
    if not target.is_relative_to(base):
        raise WorkspaceProblem("the path lies outside the workspaces")
    return target


def create_workspace(root: str | Path, project_id: str, repository_id: str) -> Path:
    target = contained(root, Path(root) / project_id / repository_id)
    if target.exists():
        raise WorkspaceProblem(f"{target} is in use")
    target.mkdir(parents=True)
    return target


def delete_workspace(root: str | Path, workspace: str | Path) -> None:
    """Remove a workspace; nothing happens if it is gone already."""
    shutil.rmtree(contained(root, workspace), ignore_errors=True)
