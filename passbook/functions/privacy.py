"""Detectors for secrets in text and for prohibited keys in JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import any_match


def looks_secret(c: Column) -> Column:
    return any_match(c, lexicon.SECRET_PATTERNS)


def _keys(node: object) -> Iterator[tuple[str, str]]:
    """(path, key) of every object key, each before what it holds, without recursion."""
    todo: list[tuple[str, Iterator]] = [("", iter([("", node)]))]
    while todo:
        path, items = todo[-1]
        found = next(items, None)
        if found is None:
            todo.pop()
            continue
        key, value = found
        if isinstance(key, str) and len(todo) > 1:
            yield path + key, key
        step = f"{path}[{key}]." if isinstance(key, int) else f"{path}{key}." if len(todo) > 1 else ""
        if isinstance(value, dict):
            todo.append((step, iter(value.items())))
        elif isinstance(value, list):
            todo.append((step, enumerate(value)))


def _deep_keys(text: str) -> Iterator[tuple[str, str]]:
    """The keys of a JSON text that is nested too deep for the JSON library, in order, without their paths."""
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"\s*(:?)', text):
        if m[2]:
            yield m[1], m[1]


def _first_prohibited(text: str | None) -> tuple[str, str] | None:
    if not text:
        return None
    try:
        found = _keys(json.loads(text))
    except RecursionError:
        found = _deep_keys(text)
    except ValueError:
        return None
    return next((x for x in found if re.sub("[^a-z0-9]", "", x[1].lower()) in BANNED), None)


BANNED = frozenset(lexicon.PROHIBITED_KEYS)


def prohibited_key(c: Column) -> Column:
    """The first prohibited key of a JSON text at any depth, each key before what it holds; null if none or malformed.

    Depth is unbounded, which column functions cannot follow, so it is an Arrow-batched function.
    """

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (_first_prohibited(t) or (None, None))[1])

    return find(c)


def prohibited_path(c: Column) -> Column:
    """The path of the first prohibited key, such as ``a.[0].body``; of a text nested too deep for paths the key alone."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (_first_prohibited(t) or (None, None))[0])

    return find(c)
