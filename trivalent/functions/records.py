"""Small helpers on one JSON record; used inside Arrow-batched functions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

#: Members compared without the order of their numbers, and members that are pairs of undirected edges.
UNORDERED, EDGE_PAIRS, HASHES = {"face_size_multiset"}, {"hardest_ordered_pair"}, {"canonical_graph_hash"}
REL = 1e-9


def parse(text: str | None) -> Any:
    """The JSON value, or the text itself where it is none; null and blank are an empty object."""
    if text is None or not text.strip():
        return {}
    try:
        return json.loads(text)
    except ValueError:
        return text


def normal(name: str, value: Any) -> Any:
    """A member in its one form, by the member's name."""
    if name in HASHES and isinstance(value, str):
        return value.strip().lower()
    if isinstance(value, list):
        if name in UNORDERED:
            return sorted(value, key=lambda x: (isinstance(x, (int, float)), x if isinstance(x, (int, float)) else 0, str(x)))
        if name in EDGE_PAIRS:
            return [sorted(e, key=lambda x: (str(type(x)), x)) if isinstance(e, list) and all(isinstance(x, (int, float)) for x in e) else e for e in value]
    return value


def leaves(value: Any, path: str, name: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted path, normal value) of the innermost members that aren't objects; null is absent."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}", k)
    elif value is not None:
        yield path, normal(name, value)


def rounded(value: Any) -> Any:
    """Whole numbers below 10^9 as they are, others to ten significant digits: equal text implies equality within 1e-9."""
    kind = type(value)
    if kind is int:
        return value if -1_000_000_000 < value < 1_000_000_000 else f"{value:.9e}" if abs(value) < 10**300 else str(value)
    if kind is float:
        return int(value) if value.is_integer() and abs(value) < 1e9 else f"{value:.9e}"
    if kind is str:
        return "'" + value
    if kind is list:
        return [rounded(x) for x in value]
    if kind is dict:
        return {k: rounded(v) for k, v in value.items() if v is not None}
    return value


def canonical(text: str | None, path: str) -> str:
    return json.dumps({k: rounded(v) for k, v in leaves(parse(text), path)}, sort_keys=True)


def same(a: Any, b: Any) -> bool:
    """Equality with numbers within a relative 1e-9, member by member."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= REL * max(abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return all(same(a.get(k), b.get(k)) for k in a.keys() | b.keys())
    return type(a) is type(b) and a == b


def differing_paths(a: str | None, b: str | None, path: str) -> list[str]:
    x, y = dict(leaves(parse(a), path)), dict(leaves(parse(b), path))
    return sorted(k for k in x.keys() | y.keys() if not same(x.get(k), y.get(k)))
