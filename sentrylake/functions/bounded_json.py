"""JSON texts held to bounds in one pass over their tokens, before anything is built of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(true|false|null)\b|(-?Infinity|NaN)\b|([{}\[\],:])|(\Z))', re.A)


@dataclass(frozen=True)
class Bounds:
    """Bytes of the text, depth (0 of the outermost value), values, and characters of a string or key."""

    size: int = 5 << 20
    depth: int = 32
    nodes: int = 100_000
    string: int = 100_000


def state(text: str | None, bounds: Bounds = Bounds()) -> str:
    """'ok', or the first bound that a text breaks: size, depth, nodes, string, duplicate_key, constant (not a number of
    JSON), malformed. A null is malformed."""
    if text is None:
        return "malformed"
    if len(text) > bounds.size or len(text.encode("utf-8", "surrogatepass")) > bounds.size:
        return "size"
    at, nodes = 1 if text[:1] == "﻿" else 0, 0
    open_: list[set | None] = []  # the keys of each open object; None for an array
    want = "value"  # value, first (value or end of array), key, first_key (key or end of object), colon, more, end
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            return "malformed"
        at = m.end()
        string, number, word, constant, sign, end = m.groups()
        if end is not None:
            return "ok" if want == "end" else "malformed"
        if string is not None and len(string) - 2 > bounds.string and len(json.loads(string)) > bounds.string:
            return "string"
        if want in ("key", "first_key") and string is not None:
            key = json.loads(string)
            if key in open_[-1]:
                return "duplicate_key"
            open_[-1].add(key)
            want = "colon"
            continue
        if want == "colon" and sign == ":":
            want = "value"
            continue
        if sign == "}" and want in ("first_key", "more") and open_ and open_[-1] is not None or sign == "]" and want in ("first", "more") and open_ and open_[-1] is None:
            open_.pop()
            want = "more" if open_ else "end"
            continue
        if want == "more" and sign == ",":
            want = "value" if open_[-1] is None else "key"
            continue
        if want not in ("value", "first"):
            return "malformed"
        if constant is not None:
            return "constant"
        if number is not None and any(c in number for c in ".eE") and float(number) in (float("inf"), float("-inf")):
            return "constant"
        if string is None and number is None and word is None and sign not in ("{", "["):
            return "malformed"
        nodes += 1
        if nodes > bounds.nodes:
            return "nodes"
        if len(open_) > bounds.depth:
            return "depth"
        if sign is None:
            want = "more" if open_ else "end"
        else:
            open_.append(set() if sign == "{" else None)
            want = "first_key" if sign == "{" else "first"


def bounded_state(c, bounds: Bounds = Bounds()):
    """`state` of a column's texts."""

    @F.pandas_udf(StringType())
    def states(s: pd.Series) -> pd.Series:
        return s.map(lambda x: state(x, bounds), na_action=None)

    return states(c)
