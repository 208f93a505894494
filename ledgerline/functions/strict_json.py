"""JSON objects exactly as written: JSON types kept apart, repeated keys last wins, nothing after the object."""

from __future__ import annotations

import json


def _refuse(name: str):
    raise ValueError(name)


def parse_object(raw: bytes | None) -> dict | None:
    """The line's JSON object, or None: no JSON, another type, trailing text, NaN, nested too deeply."""
    if not raw:
        return None
    text = raw.decode("utf-8", "replace")
    try:
        v = json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return None
    except ValueError:
        try:  # integers too long for Python's int
            v = json.loads(text, parse_constant=_refuse, parse_int=float)
        except (ValueError, RecursionError):
            return None
    return v if type(v) is dict else None


def text(v: object) -> str | None:
    return v if type(v) is str else None


def filled(v: object) -> str | None:
    return v if type(v) is str and v else None


def member(v: object, *path: str) -> object:
    """The value at a path of objects, or None where one is missing or no object."""
    for name in path:
        if type(v) is not dict:
            return None
        v = v.get(name)
    return v


def number(v: object) -> int | float | None:
    return v if type(v) in (int, float) else None


def compact(v: object) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
