"""Finding files of runs on a mounted file system, and paths."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path


def joined(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts]) if parts else path


def find_file(stem: str, extension: str, root: str, recursive: bool = True) -> str | None:
    """The first file ``stem.extension`` (any case) under a folder."""
    wanted = f"{stem}.{extension}".lower()
    paths = sorted(Path(root).rglob("*") if recursive else Path(root).iterdir())
    return next((str(p) for p in paths if p.is_file() and p.name.lower() == wanted), None)


def matching_files(stem: str, root: str, extension: str | None = None, selector: Callable[[str], bool] | None = None) -> list[str]:
    """All files under a folder whose name begins with the stem (or that ``selector`` takes) and has the extension."""
    fits = selector or (lambda name: name.startswith(stem))
    ending = None if extension is None else "." + extension.lstrip(".").lower()
    return sorted(str(p) for p in Path(root).rglob("*") if p.is_file() and fits(p.name) and (ending is None or p.name.lower().endswith(ending)))


def filetypes(stem: str, root: str) -> set[str]:
    """Extensions of the files of a stem in a folder."""
    return {p.name[len(stem) + 1 :] for p in Path(root).iterdir() if p.is_file() and p.name.startswith(stem + ".")}
