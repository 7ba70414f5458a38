"""Cached indexes: listing and pruning."""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from .engine import cache_home
from .sources.workspace import CONFIG, FOLDER, mount_points


def _size(folder: Path) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def _state(root: str | None, mount: str | None, mounts: list[str]) -> str:
    """live: the workspace is there; orphaned: it is gone; unreachable: what it was mounted on is not mounted; unknown: the
    index does not say whose it is."""
    if not root:
        return "unknown"
    if (Path(root) / FOLDER / CONFIG).is_file():
        return "live"
    return "unreachable" if mount and mount not in mounts else "orphaned"


def listing(home: Path | None = None) -> list[dict]:
    """Indexes by root, those without one last."""
    home, out, mounts = home or cache_home(), [], mount_points()
    for folder in sorted(home.iterdir()) if home.is_dir() else []:
        if not folder.is_dir():
            continue
        try:
            meta = json.loads((folder / "current.json").read_text())
        except (OSError, ValueError):
            meta = {}
        root = meta.get("root")
        out.append({"folder": str(folder), "root": root, "state": _state(root, meta.get("mount"), mounts), "bytes": _size(folder)})
    return sorted(out, key=lambda x: (x["root"] is None, x["root"] or x["folder"]))


def prune(home: Path | None = None, dry_run: bool = False, include_unreachable: bool = False) -> list[dict]:
    """Remove indexes of workspaces that are gone: renamed first, so that no reader finds half of one."""
    gone = ("orphaned", "unreachable") if include_unreachable else ("orphaned",)
    out = [x for x in listing(home) if x["state"] in gone]
    for x in [] if dry_run else out:
        aside = Path(x["folder"]).with_name(f".gone-{uuid.uuid4().hex}")
        Path(x["folder"]).rename(aside)
        shutil.rmtree(aside, ignore_errors=True)
    return out
