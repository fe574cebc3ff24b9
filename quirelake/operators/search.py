"""Search and text edits as columns: literal matching, never a pattern of the user's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(search: str) -> str:
    return "\\Q" + search.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def finds(text: Column, search: str, ignore_case: bool = False) -> Column:
    return F.lower(text).contains(search.lower()) if ignore_case else text.contains(search)


def occurrences(text: Column, search: str, ignore_case: bool = False, overlapping: bool = False) -> Column:
    pattern = ("(?i)" if ignore_case else "") + (f"(?={quoted(search)})" if overlapping else quoted(search))
    return F.regexp_count(text, F.lit(pattern)) if search else F.lit(0)


def replaced(text: Column, search: str, to: str, ignore_case: bool = False) -> Column:
    if not ignore_case:
        return F.replace(text, F.lit(search), F.lit(to))
    return F.regexp_replace(text, "(?i)" + quoted(search), re.sub(r"([\\$])", r"\\\1", to))


def find_text(elements: DataFrame, search: str, ignore_case: bool = False) -> DataFrame:
    return elements.where(finds(F.col("text"), search, ignore_case))


def delete_text(elements: DataFrame, search: str, ignore_case: bool = False) -> DataFrame:
    return elements.where(~F.coalesce(finds(F.col("text"), search, ignore_case), F.lit(False)))


def page_text(elements: DataFrame) -> DataFrame:
    """doc_id, page_index, text: a page's strings in order, a line each."""
    item = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    return elements.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(item, lambda x: x["text"]), "\n").alias("text"))
