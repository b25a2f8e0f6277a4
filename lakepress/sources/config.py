"""Driver-side configuration: nested mappings that extend one another."""

from __future__ import annotations

import hashlib
import json

from pathlib import Path
from typing import Any


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path) -> dict:
    """A YAML file over the one that its ``extends`` names."""
    import yaml

    path = Path(path)
    own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    base = own.pop("extends", None)
    return merge(load(path.parent / base), own) if base else own


def override(config: dict, settings: dict[str, str]) -> dict:
    """Dotted keys set to text, turned into the type that the value has; an unknown key raises."""
    out = merge(config, {})
    for dotted, text in settings.items():
        *parents, last = dotted.split(".")
        at: Any = out
        for p in parents:
            if not isinstance(at, dict) or p not in at:
                raise KeyError(dotted)
            at[p] = dict(at[p])
            at = at[p]
        if last not in at:
            raise KeyError(dotted)
        old = at[last]
        at[last] = text.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(text) if old is not None else text
    return out


def version_stamp(name: str, seed: int | str, config: dict) -> str:
    """``<name>-s<seed>-<8 hex>``: two configurations never share one, whatever order their keys are in."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
    return f"{name.split('/')[-1].lower()}-s{seed}-{digest[:8]}"
