"""Experiment configs: defaults, file and command line merged; grids; caps for diffs."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists that are settings of one run, not axes.
NO_AXES = frozenset(("modes", "devices", "task_ids"))


def merge(base: dict, over: dict) -> dict:
    """base with what `over` says, mappings merged key by key."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def axes(config: dict, at: tuple[str, ...] = ()) -> dict[str, list]:
    """Dotted names and values of all lists of scalars that a grid goes over."""
    out: dict[str, list] = {}
    for k, v in config.items():
        if isinstance(v, dict):
            out |= axes(v, (*at, k))
        elif isinstance(v, list) and k not in NO_AXES and v and not any(isinstance(x, (list, dict)) for x in v):
            out[".".join((*at, k))] = v
    return out


def with_value(config: dict, path: str, value: Any) -> dict:
    head, _, rest = path.partition(".")
    return config | {head: with_value(config.get(head, {}), rest, value) if rest else value}


def expand(config: dict) -> list[dict]:
    """A config for each combination of the axes' values, in the order of the axes."""
    found = axes(config)
    out = []
    for values in itertools.product(*found.values()):
        one = config
        for path, value in zip(found, values, strict=True):
            one = with_value(one, path, value)
        out.append(one)
    return out


def layered(defaults: dict, file: dict | None, overrides: dict) -> dict:
    """Defaults, under a file's settings, under those of a command line; settings that a command line leaves at None stay."""
    return merge(merge(defaults, file or {}), {k: v for k, v in overrides.items() if v is not None})


def validated(config: dict, modes: tuple[str, ...], accelerators: int = 0) -> dict:
    """The config, if its modes are known, its devices are there and its input is named; ValueError says what is wrong."""
    unknown = [m for m in config.get("modes", ()) if m not in modes]
    if unknown:
        raise ValueError(f"no such mode: {', '.join(unknown)}; there are {', '.join(modes)}")
    devices = config.get("devices") or []
    if not devices:
        raise ValueError("no device is named")
    for d in devices:
        kind, _, number = d.partition(":")
        if kind == "cuda" and not accelerators:
            raise ValueError(f"{d} is asked for, and there is no accelerator")
        if kind == "cuda" and number and (not number.isdigit() or int(number) >= accelerators):
            raise ValueError(f"{d} is asked for, and there are {accelerators}")
    if not config.get("input"):
        raise ValueError("no input is named")
    return config


def diff_cap(spec: str | int | None) -> tuple[str, float | None]:
    """("none", None), ("chars", n), ("tokens", n) or ("adaptive", percentile)."""
    s = str(spec if spec is not None else "none").strip().lower()
    if s == "none":
        return "none", None
    if s.isdigit():
        return "chars", int(s)
    kind, _, n = s.partition(":")
    if kind == "tok" and n.isdigit():
        return "tokens", int(n)
    if kind == "adaptive" and (not n or n.replace(".", "", 1).isdigit()):
        return "adaptive", float(n or 75)
    raise ValueError(f"no such cap: {spec!r}")


def adaptive_caps(files: DataFrame, percentile: float, least: int = 200) -> DataFrame:
    """(task_id, cap): characters that bring a task's prompts to a percentile of their tokens; files: task_id, diff_chars, prompt_tokens, diff_tokens."""
    budget = files.groupBy("task_id").agg(
        F.floor(F.percentile("prompt_tokens", percentile / 100)).alias("target"), F.greatest(F.min_by("prompt_tokens", "diff_chars") - F.min("diff_chars"), F.lit(0)).alias("overhead")
    )
    room = F.greatest(F.col("target") - F.col("overhead"), F.lit(1)) * F.col("diff_chars") / F.greatest(F.col("diff_tokens"), F.lit(1))
    return files.join(budget, "task_id").groupBy("task_id").agg(F.greatest(F.max(F.floor(room)), F.lit(least)).cast("long").alias("cap"))
