"""Values of mixed type, as language models return them, as text."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _parsed(value: str) -> dict | list | None:
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(value)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
        if isinstance(found, dict | list):
            return found
    return None


def _described(value: str) -> str | None:
    """The text of an object's description, else the object or list as JSON; the value itself if it is neither."""
    found = _parsed(value)
    if found is None:
        return value
    text = found.get("description") if isinstance(found, dict) else None
    if text is not None:
        return (text.strip() or None) if isinstance(text, str) else str(text)
    try:
        return json.dumps(found, ensure_ascii=False)
    except (TypeError, ValueError):
        return value


@F.pandas_udf(StringType())
def _structured(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else _described(v) for v in values], dtype=object)


def normalize_suggestion(value: Column) -> Column:
    """A suggestion as text: objects and lists, in JSON or as Python writes them, become their description or JSON.

    Blank and null values are null; all else is the text without spaces around it.  Only values that open as a structure
    go to Python.  What cannot be written as JSON (sets, bytes), or is nested too deeply to be read, stays as it is.
    """
    bare = F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    opens = bare.rlike(r"^[\[{(#\\]")
    return F.when(bare == "", None).when(opens, _structured(F.when(opens, bare))).otherwise(bare)
