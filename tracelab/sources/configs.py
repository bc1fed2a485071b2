"""Validated configs: what keys a config may have, their types and bounds, and defaults; unknown keys and wrong values are named with their path, all at once."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from tracelab.operators.checks import registry, round_limits
from tracelab.schemas import SPLITS
from tracelab.sources.backends import Backend, Scripted
from tracelab.sources.control import read_config

NEEDED = object()


@dataclass(frozen=True)
class Field:
    """A key's type (or types), its default (NEEDED: none), what its value must fulfil, and for lists and objects the spec of what is inside."""

    kind: type | tuple[type, ...]
    default: Any = NEEDED
    holds: Callable[[Any], bool] | None = None
    says: str = ""
    inside: Mapping[str, Field] | None = None


def between(low: float, high: float) -> dict[str, Any]:
    return {"holds": lambda x: low <= x <= high, "says": f"must be from {low} to {high}"}


def _fits(value: Any, kind: type | tuple[type, ...]) -> bool:
    kinds = kind if isinstance(kind, tuple) else (kind,)
    if isinstance(value, bool):
        return bool in kinds
    return isinstance(value, kinds) or (float in kinds and isinstance(value, int))


def checked(config: Mapping[str, Any], spec: Mapping[str, Field], at: str = "") -> tuple[dict[str, Any], list[str]]:
    """The config with defaults, and what is wrong with it."""
    out: dict[str, Any] = {}
    wrong = [f"{at}{k}: unknown key" for k in config if k not in spec]
    for name, field in spec.items():
        path = f"{at}{name}"
        if name not in config:
            if field.default is NEEDED:
                wrong.append(f"{path}: is missing")
            else:
                out[name] = checked({}, field.inside)[0] if field.inside and field.default == {} else field.default
            continue
        value = config[name]
        if value is None and field.default is None:
            out[name] = None
        elif not _fits(value, field.kind):
            wrong.append(f"{path}: has the wrong type")
        elif field.inside is not None and isinstance(value, list):
            out[name] = []
            for i, each in enumerate(value):
                own, more = checked(each, field.inside, f"{path}[{i}].") if isinstance(each, Mapping) else ({}, [f"{path}[{i}]: must be an object"])
                out[name].append(own)
                wrong += more
        elif field.inside is not None:
            out[name], more = checked(value, field.inside, f"{path}.")
            wrong += more
        else:
            out[name] = value
            if field.holds and not field.holds(value):
                wrong.append(f"{path}: {field.says}")
    return out, wrong


BACKEND = {
    "kind": Field(str, "scripted", lambda x: x in ("scripted", "factory"), "must be scripted or factory"),
    "replies": Field(dict, {}),
    "factory": Field(str, None),
    "attempts": Field(int, 2, **between(1, 10)),
    "cache_path": Field(str, None),
}
_UNIQUE = {"holds": lambda x: len(set(map(str, x))) == len(x), "says": "must not repeat"}
_MODEL = {"model_id": Field(str, NEEDED, lambda x: bool(x.strip()), "must not be blank"), "source": Field(str), "seed": Field(int, None), "splits": Field(list, [], **_UNIQUE)}
#: Of runs that generate and judge replies.
QUALITY = {
    "splits": Field(list, ["dev", "diagnostic_holdout"], lambda x: len(set(x)) == len(x) and set(x) <= set(SPLITS), "must be known splits, each once"),
    "standalone": Field(bool, False),
    "models": Field(list, NEEDED, inside=_MODEL),
    "backend": Field(dict, {}, inside=BACKEND),
    "judge_seed": Field(int, 4242),
    "human_seed": Field(int, 2026),
}
#: Of runs that generate conversations.
CONVERSATIONS = {
    "seed": Field(int, 42, **between(0, 2**31 - 1)),
    "min_rounds": Field(int, 1, **between(1, 1000)),
    "soft_rounds": Field(int, 8, **between(1, 1000)),
    "hard_rounds": Field(int, 12, **between(1, 1000)),
    "backend": Field(dict, {}, inside=BACKEND),
}
#: Of runs that make traces.
TEACHER = {"protocol_version": Field(str, "trace-1", lambda x: bool(x.strip()), "must not be blank"), "backend": Field(dict, {}, inside=BACKEND)}


def load(path: str | Path, spec: Mapping[str, Field]) -> dict[str, Any]:
    """A config from a file, checked; raises ValueError with all that is wrong."""
    config, wrong = checked(read_config(path), spec)
    if not wrong and "models" in spec:
        try:
            registry(config["models"], config["standalone"])
        except ValueError as error:
            wrong.append(f"models: {error}")
    if not wrong and "hard_rounds" in spec:
        try:
            round_limits(config["min_rounds"], config["soft_rounds"], config["hard_rounds"])
        except ValueError as error:
            wrong.append(str(error))
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return config


#: How each source of replies is asked, by name; ``register_source`` adds to it.
SOURCES: dict[str, Callable[[dict[str, Any]], Callable[[], Backend]]] = {}


def register_source(name: str) -> Callable:
    """Registers a function that makes a backend's factory from a backend config."""

    def add(make: Callable[[dict[str, Any]], Callable[[], Backend]]) -> Callable:
        SOURCES[name] = make
        return make

    return add


@register_source("scripted")
def _scripted(config: dict[str, Any]) -> Callable[[], Backend]:
    replies = dict(config["replies"])
    return lambda: Scripted(replies)


@register_source("factory")
def _factory(config: dict[str, Any]) -> Callable[[], Backend]:
    """The callable that ``factory`` names as module:name; it makes a backend in each task."""
    module, _, name = (config["factory"] or "").partition(":")
    if not name:
        raise ValueError("backend.factory must be module:name")
    return getattr(importlib.import_module(module), name)


def backend(config: dict[str, Any]) -> Callable[[], Backend]:
    return SOURCES[config["kind"]](config)
