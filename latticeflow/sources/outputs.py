"""Where results and other artifacts go."""

from __future__ import annotations

from pathlib import Path


def scenario_prefix(path: str | Path) -> str:
    """The file's name without its last suffix."""
    return Path(path).stem


def artifact_path(scenario: str | Path, suffix: str, folder: str | Path | None = None) -> Path:
    """<folder or here>/<scenario>.<suffix>."""
    return Path(folder or ".") / f"{scenario_prefix(scenario)}.{suffix.lstrip('.')}"


def override_path(asked: str | Path | None, folder: str | Path | None) -> Path | None:
    """A path asked for: as it is if absolute, else below the folder."""
    if asked is None:
        return None
    asked = Path(asked)
    return asked if asked.is_absolute() or folder is None else Path(folder) / asked


def results_path(scenario: str | Path, folder: str | Path | None = None, asked: str | Path | None = None) -> Path:
    return override_path(asked, folder) or artifact_path(scenario, "results.json", folder)


def profiles_folder(scenario: str | Path, folder: str | Path | None = None) -> Path:
    return artifact_path(scenario, "profiles", folder)


def ensure_parent(path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    return path
