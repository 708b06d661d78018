"""Small text functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_token(c: Column) -> Column:
    """Lower case, letters a to z and digits only: the key by which names of companies are compared."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All character references of HTML read; tags stay."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def contains_like(c: Column, needle: str) -> Column:
    """LIKE '%needle%' without regard to case; % and _ of the needle match as in LIKE, a backslash is itself."""
    return c.ilike("%" + needle.replace("\\", "\\\\") + "%")


def dig(json: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text as a string, empty where it is missing or null. Path parts are plain names."""
    return F.coalesce(F.get_json_object(json, "$." + path), F.lit(""))
