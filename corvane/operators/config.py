"""Driver-side checks of configurations, options and manifests. All problems are collected and raised at once."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
RESERVED = {"tie", "all", "a", "b"}
GENERATION_KEYS = {"temperature", "top_p", "max_tokens", "seed", "stop"}


class ConfigErrors(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def raise_all(errors: list[str]) -> None:
    if errors:
        raise ConfigErrors(errors)


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    wait: float = 1.0
    factor: float = 2.0
    longest: float = 30.0

    def __post_init__(self) -> None:
        errors = []
        if isinstance(self.attempts, bool) or not isinstance(self.attempts, int) or self.attempts < 1:
            errors.append("attempts must be a positive whole number")
        if self.wait < 0 or self.longest < self.wait:
            errors.append("waits must not be negative, the longest not below the first")
        if self.factor < 1:
            errors.append("the factor must be at least 1")
        raise_all(errors)


def named_value(option: str) -> tuple[str, str]:
    """NAME=VALUE with a safe name that isn't reserved."""
    name, sep, value = option.partition("=")
    if not sep or not NAME.fullmatch(name) or not value or name.lower() in RESERVED:
        raise ValueError(f"not NAME=VALUE: {option}")
    return name, value


def endpoint(url: str) -> str:
    """A bare http or https host, without path, query, credentials, comma or white space."""
    parts = urlsplit(url)
    if re.search(r"[\s,]", url) or parts.scheme not in ("http", "https") or not parts.hostname or parts.path not in ("", "/") or parts.query or parts.fragment or parts.username:
        raise ValueError(f"no bare endpoint: {url}")
    return url.rstrip("/")


def generation_options(options: dict[str, Any]) -> dict[str, Any]:
    if unknown := sorted(set(options) - GENERATION_KEYS):
        raise ValueError(f"unknown generation options: {', '.join(unknown)}")
    return options


def check_arms(arms: list[dict[str, Any]], personas: set[str], contract: dict[str, dict[str, Any]]) -> list[str]:
    """Problems of an evaluation's arms: repeated names, unknown personas, settings that break a name's contract."""
    names = [a.get("name") for a in arms]
    errors = [f"arm {n} is there {names.count(n)} times" for n in sorted({str(n) for n in names if names.count(n) > 1})]
    for a in arms:
        errors += [f"arm {a.get('name')}: unknown persona {p}" for p in a.get("personas", []) if p not in personas]
        for field, value in contract.get(str(a.get("name")), {}).items():
            if a.get(field) != value:
                errors.append(f"arm {a.get('name')}: {field} is {a.get(field)!r}, not {value!r}")
    return errors


def manifest_drift(a: Any, b: Any, path: str = "") -> list[str]:
    """Paths at which two nested settings differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted(set(a) | set(b)) for x in manifest_drift(a.get(k), b.get(k), f"{path}.{k}" if path else str(k))]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (p, q) in enumerate(zip(a, b)) for x in manifest_drift(p, q, f"{path}[{i}]")]
    return [] if a == b and type(a) is type(b) else [path]


def reuse_manifest(held: dict[str, Any], wanted: dict[str, Any], fields: list[str]) -> None:
    """Refuse a cached run unless all the named fields match."""
    raise_all([f"{f}: {held.get(f)!r} is not {wanted.get(f)!r}" for f in fields if held.get(f) != wanted.get(f)])


def accumulation_steps(target: int, world: int, per_device: int) -> int:
    """Batches to accumulate; the target must be a multiple."""
    if target % (world * per_device):
        raise ValueError("the target batch is no multiple of the devices' batches")
    return target // (world * per_device)


def check_pins(wanted: dict[str, str]) -> list[str]:
    """Packages that are absent or of another version than the pinned one."""
    from importlib.metadata import PackageNotFoundError, version

    errors = []
    for name, pin in wanted.items():
        try:
            if (got := version(name)) != pin:
                errors.append(f"{name} is {got}, not {pin}")
        except PackageNotFoundError:
            errors.append(f"{name} is absent")
    return errors


def cost(calls: int, tokens_in: float, tokens_out: float, price_in: float, price_out: float) -> float:
    """Price of calls from tokens and prices per million tokens."""
    return calls * (tokens_in * price_in + tokens_out * price_out) / 1e6
