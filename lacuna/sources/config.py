"""Configuration files and seeds, on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping

import numpy as np


def load_config(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path) as f:
        return yaml.safe_load(f) or {}


def merge_configs(base: Mapping, override: Mapping) -> dict:
    """``override`` over ``base``, mappings merged at every depth; neither is changed."""
    out = dict(base)
    for k, v in override.items():
        both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
        out[k] = merge_configs(out[k], v) if both else v
    return out


def make_seed_sequence(n: int, base_seed: int = 42) -> list[int]:
    """``n`` independent unsigned 32-bit seeds (Python ints; store them as long)."""
    return [int(s.generate_state(1)[0]) for s in np.random.SeedSequence(base_seed).spawn(n)]
