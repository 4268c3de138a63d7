"""Layered YAML configuration: defaults lists, groups, interpolation and overrides (driver only)."""

from __future__ import annotations

import copy
import datetime
import os
import re
from pathlib import Path

import yaml


def merge(base, over):
    """Maps merge, scalars and lists replace."""
    if isinstance(base, dict) and isinstance(over, dict):
        out = dict(base)
        for k, v in over.items():
            out[k] = merge(base[k], v) if k in base else copy.deepcopy(v)
        return out
    return copy.deepcopy(over)


class Config:
    def __init__(self, data: dict):
        self.data = data

    def _raw(self, path: str):
        node = self.data
        for key in path.split("."):
            node = node[int(key)] if isinstance(node, list) else node[key]
        return node

    def get(self, path: str, default=None):
        try:
            return self.resolve(self._raw(path), path)
        except (KeyError, IndexError, TypeError):
            return default

    def resolve(self, value, path: str = "", active: tuple = ()):
        if isinstance(value, dict):
            return {k: self.resolve(v, f"{path}.{k}".strip("."), active) for k, v in value.items()}
        if isinstance(value, list):
            return [self.resolve(v, f"{path}.{i}".strip("."), active) for i, v in enumerate(value)]
        if not isinstance(value, str) or "${" not in value:
            return value
        whole = re.fullmatch(r"\$\{([^${}]*)\}", value)
        if whole:
            return self._expression(whole[1], path, active)
        while m := re.search(r"\$\{([^${}]*)\}", value):
            value = value[: m.start()] + str(self._expression(m[1], path, active)) + value[m.end() :]
        return value

    def _expression(self, text: str, path: str, active: tuple):
        kind, colon, rest = text.partition(":")
        if colon and kind == "now":
            return datetime.datetime.now().strftime(rest)
        if colon and kind == "oc.env":
            name, comma, default = rest.partition(",")
            if name not in os.environ and not comma:
                raise KeyError(name)
            return os.environ.get(name, default)
        if colon and kind == "oc.select":
            name, _, default = rest.partition(",")
            return self.get(name, yaml.safe_load(default) if default else None)
        if text.startswith("."):
            up = len(text) - len(text.lstrip("."))
            text = ".".join([*path.split(".")[:-up], text.lstrip(".")])
        if text in active:
            raise ValueError(f"interpolation cycle: {text}")
        return self.resolve(self._raw(text), text, (*active, text))

    def override(self, item: str) -> None:
        """``key=value`` (must exist), ``+key=value`` (must not), ``++key=value`` (either)."""
        key, _, value = item.partition("=")
        plus = len(key) - len(key.lstrip("+"))
        key = key.lstrip("+")
        try:
            self._raw(key)
            exists = True
        except (KeyError, IndexError, TypeError):
            exists = False
        if plus == 0 and not exists or plus == 1 and exists:
            raise KeyError(f"{key} {'exists' if exists else 'does not exist'}")
        node, parts = self.data, key.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = yaml.safe_load(value)

    def save(self, path: str) -> None:
        Path(path).write_text(yaml.safe_dump(self.resolve(self.data), sort_keys=False))


def load_config(path: str, overrides=()) -> Config:
    """A main file with its ``defaults`` list; groups are folders beside it."""
    root = Path(path).parent
    choices = {k: v for k, _, v in (o.partition("=") for o in overrides) if (root / k).is_dir()}
    config = Config(_compose(Path(path), root, choices, ()))
    for o in overrides:
        if o.partition("=")[0] not in choices:
            config.override(o)
    return config


def _compose(path: Path, root: Path, choices: dict, active: tuple) -> dict:
    if path in active:
        raise ValueError(f"defaults cycle: {path}")
    own = yaml.safe_load(path.read_text()) or {}
    defaults = own.pop("defaults", None) or []
    if "_self_" not in defaults:
        defaults = [*defaults, "_self_"]
    out: dict = {}
    for entry in defaults:
        if entry == "_self_":
            out = merge(out, own)
            continue
        if isinstance(entry, str):
            group, option, package = "", entry, ""
        else:
            key, option = next(iter(entry.items()))
            optional_free = re.sub(r"^(?:optional|override)\s+", "", key)
            group, _, package = optional_free.partition("@")
            option = choices.get(group, option)
            package = package or group.replace("/", ".")
        if option is None:
            continue
        file = root / group / f"{option}.yaml"
        if not file.exists():
            if isinstance(entry, dict) and next(iter(entry)).startswith("optional "):
                continue
            raise FileNotFoundError(file)
        part = _compose(file, file.parent if group else root, choices, (*active, path))
        for key in reversed([] if package in ("", "_global_") else package.split(".")):
            part = {key: part}
        out = merge(out, part)
    return out
