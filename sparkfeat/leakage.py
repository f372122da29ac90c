"""Guard against columns whose names suggest that they hold the label."""

from __future__ import annotations

import re
import warnings

KEYWORDS = ("target", "label", "outcome", "ground_truth", "y_true", "future", "leak")


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def leakage_columns(columns: list[str], target: str | None = None, keywords: tuple[str, ...] = KEYWORDS) -> list[str]:
    """Columns that hold a keyword, or that contain or are contained in the target's name; no keywords, no check."""
    if not keywords:
        return []
    words = [w for w in map(_plain, keywords) if w]
    t = _plain(target or "")
    out = []
    for c in columns:
        p = _plain(c)
        if p and c != target and (any(w in p for w in words) or (t and (t in p or p in t))):
            out.append(c)
    return out


def guard(columns: list[str], target: str | None, mode: str = "warn") -> list[str]:
    if mode not in ("off", "warn", "raise"):
        raise ValueError("mode is off, warn or raise")
    found = [] if mode == "off" else leakage_columns(columns, target)
    if found and mode == "raise":
        raise ValueError(f"columns may leak the target: {found}")
    if found:
        warnings.warn(f"columns may leak the target: {found}", stacklevel=2)
    return found


def sanitise(names: list[str]) -> list[str]:
    """Names of letters, digits and underscores, made unique by numbers."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[^0-9a-zA-Z_]+", "_", n).strip("_") or "col"
        name, k = base, 1
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out
