"""Tables that people enter: prices, plans, aliases; checked before they are stored."""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.dimensions import PRICE_SCHEMA

_RATES = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")
_DAY, _MONTH, _USD = re.compile(r"\d{4}-\d\d-\d\d"), re.compile(r"\d{4}-(?:0[1-9]|1[0-2])"), re.compile(r"\d+(?:\.\d+)?")


def _rate(v: object) -> bool:
    return type(v) in (int, float) and math.isfinite(v) and v >= 0


#: Each field of a price row and what it must satisfy.
CHECKS: dict[str, Callable[[object], bool]] = {
    "model_id": lambda v: isinstance(v, str) and v != "",
    "source_url": lambda v: isinstance(v, str) and v != "",
    "effective_from": lambda v: isinstance(v, str) and _DAY.fullmatch(v) is not None,
    "verified_on": lambda v: isinstance(v, str) and _DAY.fullmatch(v) is not None,
    **dict.fromkeys(_RATES, _rate),
    "fast": lambda v: v is None or (isinstance(v, dict) and all(_rate(v.get(r)) for r in _RATES)),
    "standard_rate_max_input_tokens": lambda v: v is None or (type(v) is int and v >= 1),
}


def rows(document: object) -> list[tuple]:
    """A price document's rows as PRICE_SCHEMA has them; a document with anything doubtful is refused, naming all of it."""
    given = document.get("rows") if isinstance(document, dict) else None
    if not isinstance(given, list):
        raise ValueError("a price table has a list of rows")
    faults = [f"row {i}: {name}" for i, r in enumerate(given) for name, good in CHECKS.items() if not good(r.get(name) if isinstance(r, dict) else None)]
    if not faults:
        named = Counter((r["model_id"], r["effective_from"]) for r in given)
        faults = [f"{model} from {day} stands {n} times" for (model, day), n in named.items() if n > 1]
    if faults:
        raise ValueError("; ".join(faults))
    five = lambda o: tuple(float(o[r]) if o else None for r in _RATES)
    return [(r["model_id"], r["effective_from"], *five(r), *five(r.get("fast")), r.get("standard_rate_max_input_tokens"), r["verified_on"]) for r in given]


def price_table(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(rows(json.load(f)), PRICE_SCHEMA)


def plan(month: str, usd: str | float, name: str) -> tuple[str, float, str]:
    """(month, dollars, name) of a plan entry; store it with store.upsert on the month."""
    if not _MONTH.fullmatch(month) or not _USD.fullmatch(str(usd).strip()) or not 0 < len(name.strip()) <= 100:
        raise ValueError("a plan needs a month YYYY-MM, a plain amount and a name of 1 to 100 characters")
    return month, float(str(usd).strip()), name.strip()


def alias(aliases: list[tuple[str, str]], source: str, target: str, home: str, recorded: set[str]) -> list[tuple[str, str]]:
    """The aliases with source counting under target: absolute paths, one step only, source seen before."""
    def path(p: str) -> str:
        p = p.strip()
        p = home + p[1:] if p == "~" or p.startswith("~/") else p
        if not (os.path.isabs(p) or re.match(r"[A-Za-z]:[\\/]", p)):
            raise ValueError(f"{p} is no absolute path")
        return p.rstrip("/\\") or p

    a, b = path(source), path(target)
    if a == b or a not in recorded:
        raise ValueError("an alias joins a recorded path to another one")
    if any(x == b or (y == a and x != a) for x, y in aliases):
        raise ValueError("aliases go one step")
    return [*(x for x in aliases if x[0] != a), (a, b)]


def without_alias(aliases: list[tuple[str, str]], source: str) -> list[tuple[str, str]]:
    if source not in dict(aliases):
        raise ValueError(f"there is no alias of {source}")
    return [x for x in aliases if x[0] != source]
