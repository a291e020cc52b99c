"""Feature specifications such as ``bollinger_bands(close, 8, 2)@H1``: text to a checked call."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sandpiper.sources.candles import timeframe

SHAPE = re.compile(r"^\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*(?:@\s*(\w+))?\s*$", re.S)


class SpecError(ValueError):
    """A specification that can't be used."""


@dataclass(frozen=True)
class Param:
    name: str
    kind: type = int
    default: Any = None
    aliases: tuple[str, ...] = ()
    choices: tuple = ()
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Feature:
    """What a name in a specification stands for: a transform of candles, its parameters and the columns it adds."""

    name: str
    run: Callable
    params: tuple[Param, ...]
    outputs: tuple[str, ...]
    warmup: Callable[[dict], int] = field(default=lambda p: p.get("period", 1))
    requires: tuple[str, ...] = ("close",)


@dataclass(frozen=True)
class Spec:
    feature: Feature
    tf: str | None
    args: tuple[tuple[str, Any], ...]

    @property
    def canonical(self) -> str:
        text = ",".join(f"{k}={v}" for k, v in self.args)
        return f"{self.feature.name}({text})" + (f"@{self.tf}" if self.tf else "")

    def column(self, output: str) -> str:
        """The output's column, in letters, digits and underscores."""
        parts = [output, *(str(v) for _, v in self.args), self.tf or ""]
        return re.sub(r"\W+", "_", "_".join(p for p in parts if p)).strip("_").lower()


def split_top(text: str) -> list[str]:
    """Parts between commas outside brackets and quotes."""
    parts, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                raise SpecError(f"unbalanced brackets in {text!r}")
        elif c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    if depth or quote:
        raise SpecError(f"unbalanced brackets or quotes in {text!r}")
    parts.append(text[at:])
    return [p.strip() for p in parts] if text.strip() else []


def value(token: str) -> Any:
    """A literal; true, false and none in any case; anything else is text."""
    word = token.strip()
    known = {"true": True, "false": False, "none": None, "null": None}
    if word.lower() in known:
        return known[word.lower()]
    try:
        return ast.literal_eval(word)
    except (ValueError, SyntaxError):
        if word.startswith("[") and word.endswith("]"):
            return [value(p) for p in split_top(word[1:-1])]
        return word


def check(feature: Feature, param: Param, given: Any) -> Any:
    if param.kind in (int, float) and isinstance(given, bool):
        raise SpecError(f"{feature.name}: {param.name} must be a number")
    if param.kind is int and not (isinstance(given, int) or (isinstance(given, float) and given.is_integer())):
        raise SpecError(f"{feature.name}: {param.name} must be a whole number, not {given!r}")
    if param.kind is float and not isinstance(given, (int, float)):
        raise SpecError(f"{feature.name}: {param.name} must be a number, not {given!r}")
    if param.kind is str and not isinstance(given, str):
        raise SpecError(f"{feature.name}: {param.name} must be text, not {given!r}")
    given = param.kind(given)
    if param.choices and given not in param.choices:
        raise SpecError(f"{feature.name}: {param.name} must be one of {param.choices}")
    if (param.least is not None and given < param.least) or (param.most is not None and given > param.most):
        raise SpecError(f"{feature.name}: {param.name}={given} is outside {param.least} .. {param.most}")
    return given


def parse(text: str, registry: dict[str, Feature]) -> Spec:
    """name(positional, key=value, ...)@TF, with defaults filled in; any mistake is a SpecError."""
    shape = SHAPE.match(text)
    if not shape:
        raise SpecError(f"not a specification: {text!r}")
    name, inner, tf = shape.groups()
    feature = registry.get(name.lower())
    if feature is None:
        raise SpecError(f"unknown indicator {name!r}")
    names = {a: p for p in feature.params for a in (p.name, *p.aliases)}
    given: dict[str, Any] = {}
    positional = []
    for token in split_top(inner or ""):
        key, eq, rest = token.partition("=")
        if eq and re.fullmatch(r"\w+", key.strip()):
            param = names.get(key.strip())
            if param is None:
                raise SpecError(f"{name}: unknown parameter {key.strip()!r}")
            if param.name in given:
                raise SpecError(f"{name}: {param.name} is given twice")
            given[param.name] = check(feature, param, value(rest))
        elif not token:
            raise SpecError(f"{name}: empty argument")
        else:
            positional.append(value(token))
    free = [p for p in feature.params if p.name not in given]
    if len(positional) > len(free):
        raise SpecError(f"{name}: too many arguments")
    for param, v in zip(free, positional, strict=False):
        given[param.name] = check(feature, param, v)
    for param in feature.params:
        if param.name not in given:
            if param.default is None:
                raise SpecError(f"{name}: {param.name} is required")
            given[param.name] = param.default
    try:
        code = timeframe(tf) if tf else None
    except ValueError as e:
        raise SpecError(str(e)) from e
    return Spec(feature, code, tuple((p.name, given[p.name]) for p in feature.params))


def replace_params(text: str, registry: dict[str, Feature], **updates) -> str:
    """The specification with some parameters changed."""
    spec = parse(text, registry)
    if odd := updates.keys() - {p.name for p in spec.feature.params}:
        raise SpecError(f"{spec.feature.name}: unknown parameters {sorted(odd)}")
    args = dict(spec.args) | updates
    return Spec(spec.feature, spec.tf, tuple((p.name, check(spec.feature, p, args[p.name])) for p in spec.feature.params)).canonical
