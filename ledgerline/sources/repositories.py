"""Which repository a working directory belongs to: asked of git once for each directory, on the driver."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

SCHEMA = "cwd string, kind string, repo_root string, root_exists int, resolved_via string, resolved_at string"
MOST_DIRECTORIES = 1_000_000


def git_root(path: str) -> str | None:
    """The folder whose repository holds path (a worktree's main repository), or None."""
    try:
        got = subprocess.run(["git", "-C", path, "rev-parse", "--path-format=absolute", "--git-common-dir"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    common = got.stdout.strip()
    return os.path.dirname(common) if got.returncode == 0 and common else None


def resolve(cwd: str, last_known: str | None, exists: Callable[[str], bool] = os.path.exists, ask: Callable[[str], str | None] = git_root) -> tuple[str, str | None, str]:
    """(kind, root, resolved via): a directory that is gone goes by its last known root, else its nearest living parent."""
    if exists(cwd):
        root = ask(cwd)
        return ("repo", root, "git") if root else ("not_git", None, "git")
    if last_known:
        return "missing", last_known, "last_known"
    parent = os.path.dirname(cwd)
    while parent and parent != os.path.dirname(parent) and not exists(parent):
        parent = os.path.dirname(parent)
    root = ask(parent) if parent and exists(parent) else None
    return ("missing", root, "parent") if root else ("missing", None, "none")


def repositories(lines: DataFrame, cached: list[tuple] = (), exists: Callable[[str], bool] = os.path.exists, ask: Callable[[str], str | None] = git_root) -> DataFrame:
    """A row per distinct cwd of lines: cached rows that still hold, all others resolved (again).

    Directories are as many as people have; more than MOST_DIRECTORIES are refused.
    """
    seen = [r[0] for r in lines.select("cwd").filter("cwd is not null").distinct().take(MOST_DIRECTORIES + 1)]
    if len(seen) > MOST_DIRECTORIES:
        raise ValueError("too many working directories to ask for one by one")
    old, now, rows = {r[0]: r for r in cached}, datetime.now(UTC).isoformat(timespec="milliseconds"), []
    for cwd in sorted({*seen, *old}):
        row = old.get(cwd)
        stale = row and (exists(cwd) != (row[1] != "missing") or (row[2] is not None and exists(row[2]) != (row[3] == 1)))
        if row and not stale:
            rows.append(tuple(row))
            continue
        kind, root, via = resolve(cwd, row[2] if row and row[4] in ("git", "last_known") else None, exists, ask)
        rows.append((cwd, kind, root, None if root is None else int(exists(root)), via, now))
    return lines.sparkSession.createDataFrame(rows, SCHEMA)
