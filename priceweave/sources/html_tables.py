"""Rows of html tables in scraped pages."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = re.compile(r"<tr\b.*?</tr>", re.S | re.I)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.S | re.I)
_ITEM = re.compile(r"<li\b[^>]*>(.*?)(?=</li>|<li\b)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def _plain(fragment: str) -> str:
    return " ".join(html.unescape(_TAG.sub(" ", fragment)).split())


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [[_plain(c) for c in _CELL.findall(r)] for r in _ROW.findall(p or "")])


@F.pandas_udf(T.ArrayType(T.StringType()))
def list_items(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [_plain(x) for x in _ITEM.findall(p or "")])


def exploded(pages: DataFrame, key: str, rows: Column) -> DataFrame:
    return pages.select(key, F.posexplode(rows).alias("position", "row"))
