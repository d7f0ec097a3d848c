"""JSON documents in text columns: the first value in a text, values made to fit a schema, documents merged at any depth."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_START = re.compile(r"[\[{]")
_DECODER = json.JSONDecoder()


def said(value) -> str:
    """Canonical text of a value: sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def first_value(text: str | None) -> str | None:
    """The first object or list in a text that is whole, as canonical text; what can't be read is passed over. Where tries that fail
    have read the text many times over (deep nesting that never ends), the search goes on behind what failed."""
    work, behind = 0, 0
    for m in _START.finditer(text or ""):
        at, sign = m.start(), m.group()
        if at < behind or text.find("]" if sign == "[" else "}", at) < 0:
            continue
        try:
            value, _ = _DECODER.raw_decode(text, at)
            return said(value)
        except (json.JSONDecodeError, RecursionError) as e:
            end = getattr(e, "pos", at + 10_000)  # deeper than Python follows: so many brackets were read at least
            work += end - at
            if work > 16 * len(text) + 10_000:
                behind = end
    return None


def fitted(value, schema: dict, at: str = "$") -> tuple[object, list[str]]:
    """(value made to fit, problems with their paths). ``schema``: type (object, array, string, integer, number, boolean, null, or a
    list of them), enum, minimum, maximum, minLength, maxLength, pattern, properties, required, additionalProperties
    (false: others are dropped), items, minItems, maxItems, default.

    Made to fit without a problem: numbers and truth values written as strings, whole floats as integers, numbers as
    strings, a lone value as a list of one, null or nothing where there is a default. What can't be made to fit is
    left as it is and named."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if value is None and "default" in schema and (not kinds or "null" not in kinds):
        value = schema["default"]
    if kinds:
        for kind in kinds:
            if _is(value, kind):
                break
        else:
            for kind in kinds:
                ok, made = _made(value, kind)
                if ok:
                    value = made
                    break
            else:
                return value, [f"{at}: not {' or '.join(kinds)}"]
    problems = []
    if "enum" in schema and value not in schema["enum"]:
        problems.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            problems.append(f"{at}: under minimum")
        if value > schema.get("maximum", math.inf):
            problems.append(f"{at}: over maximum")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            problems.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            problems.append(f"{at}: pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            problems.append(f"{at}: number of items")
        if "items" in schema:
            done = [fitted(v, schema["items"], f"{at}[{i}]") for i, v in enumerate(value)]
            value, problems = [v for v, _ in done], problems + [p for _, ps in done for p in ps]
    if isinstance(value, dict) and ("properties" in schema or "required" in schema):
        known = schema.get("properties", {})
        out = {} if schema.get("additionalProperties") is False else {k: v for k, v in value.items() if k not in known}
        for name, inner in known.items():
            if name in value or "default" in inner:
                out[name], more = fitted(value.get(name), inner, f"{at}.{name}")
                problems += more
        problems += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in out]
        value = out
    return value, problems


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind] is type(value)


def _made(value, kind: str) -> tuple[bool, object]:
    if kind in ("integer", "number"):
        if isinstance(value, str):
            try:
                value = json.loads(value.strip())
            except (ValueError, RecursionError):
                return False, None
            if not _is(value, "number"):
                return False, None
        if kind == "integer" and isinstance(value, float) and value.is_integer():
            return True, int(value)
        return _is(value, kind), value
    if kind == "boolean" and isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return True, value.strip().lower() == "true"
    if kind == "string" and _is(value, "number"):
        return True, said(value)
    if kind == "array" and value is not None and not isinstance(value, list):
        return True, [value]
    return False, None


def merged(base, over):
    """``over`` on ``base``: objects are merged key by key at any depth, other values of ``over`` take the place of ``base``'s; a key with
    "+" at its end appends to the list of that name (a lone value is a list of one). Null takes the place too."""
    if not isinstance(base, dict) or not isinstance(over, dict):
        return over
    out = dict(base)
    for key, value in over.items():
        if key.endswith("+") and len(key) > 1:
            old, more = out.get(key[:-1]), value if isinstance(value, list) else [value]
            out[key[:-1]] = (old if isinstance(old, list) else [] if old is None else [old]) + more
        else:
            out[key] = merged(out[key], value) if key in out else merged({}, value) if isinstance(value, dict) else value
    return out


def _read(text: str | None):
    """(whether it is JSON, its value)."""
    try:
        return (False, None) if text is None else (True, json.loads(text))
    except (ValueError, RecursionError):
        return False, None


def first_json(text: Column) -> Column:
    """``first_value`` over a column; null where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_value)

    return run(text)


def fit_json(text: Column, schema: dict) -> Column:
    """(fitted, problems) of a column of JSON texts; what is no JSON has a null and the problem "$: not JSON", null has nulls."""

    @F.pandas_udf("fitted string, problems array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            ok, value = _read(text)
            if not ok:
                rows.append((None, None if text is None else ["$: not JSON"]))
                continue
            made, problems = fitted(value, schema)
            rows.append((said(made), problems))
        return pd.DataFrame(rows, columns=["fitted", "problems"])

    return run(text)


def merge_json(base: Column, over: Column) -> Column:
    """``merged`` over two columns of JSON texts; a side that is null or no JSON changes nothing, two of them give null."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, overs: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(bases, overs):
            (known, x), (said_, y) = _read(a), _read(b)
            out.append(said(merged(x, y) if known and said_ else x if known else y) if known or said_ else None)
        return pd.Series(out, dtype=object)

    return run(base, over)
