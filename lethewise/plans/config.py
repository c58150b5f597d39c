"""Settings: nested dictionaries, and the arithmetic of training lengths."""

from __future__ import annotations

from typing import Any


def unfilled(config: Any, path: str = "") -> list[str]:
    """Paths of the leaves that are still ``???``."""
    if isinstance(config, dict):
        return [p for k, v in config.items() for p in unfilled(v, f"{path}.{k}" if path else str(k))]
    if isinstance(config, (list, tuple)):
        return [p for i, v in enumerate(config) for p in unfilled(v, f"{path}[{i}]")]
    return [path] if config == "???" else []


def merged(a: dict, b: dict) -> dict:
    """Both dictionaries: within, dictionaries are merged and lists joined; of anything else b's value holds."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        else:
            out[k] = v
    return out


def warmup_steps(epochs: float, rows: int, batch: int, accumulation: int = 1, devices: int = 1) -> int:
    return int(epochs * rows // (batch * accumulation * devices))


def steps_per_epoch(rows: int, batch: int, accumulation: int = 1, devices: int = 1) -> int:
    return max(1, rows // (batch * accumulation * devices))
