"""Identity of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom.functions.urls import canonical_url


def posting_id(company: Column, native_id: Column, url: Column, title: Column, location: Column, keep_params: tuple[str, ...] = ()) -> Column:
    """40 hex digits: of company and native id where there is one, else of the canonical URL, else of company, title and location. Nulls count as empty."""
    c, n, u, t, p = (F.coalesce(x, F.lit("")) for x in (company, native_id, url, title, location))
    return F.sha1(F.when(n != "", F.concat(c, F.lit(":"), n)).when(u != "", canonical_url(u, keep_params)).otherwise(F.concat_ws("|", c, t, p)))
