"""The bounded JSON query language over a snapshot's indexed values."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from veritome.functions.unicode import is_ascii, query_value, query_value_rule

# The language's fields by kind of value, its bounds and its name.
OPAQUE = ("FILE_ID", "OBSERVATION_ID")
STATUS = ("FORMAT", "ANALYSIS_STATUS", "RESOLUTION_STATUS", "CLASSIFICATION_STATUS", "MATCHING_STATUS", "REVIEW_STATUS", "CALIBRE_STATUS", "ARCHIVE_STATUS", "CONSOLIDATION_STATUS", "QUARANTINE_STATUS")
METADATA = ("TITLE", "CONTRIBUTOR", "IDENTIFIER", "LANGUAGE", "PUBLISHER")
FIELDS = OPAQUE + STATUS + ("FINDING_CODE",) + METADATA
VERSION, DEPTH, PREDICATES, VALUE, PAGE = "collection-query/v1", 4, 16, 256, 100
METADATA_CAP, FINDING_CAP = 256, 128


class QueryError(ValueError):
    """The text isn't a query of the language."""


@dataclass(frozen=True)
class Predicate:
    field: str
    operator: str
    value: str


@dataclass(frozen=True)
class Group:
    operator: str
    children: tuple


@dataclass(frozen=True)
class Query:
    where: Predicate | Group
    limit: int
    after: str | None


def _object(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise QueryError("a key stands twice")
    return dict(pairs)


def _constant(name: str) -> None:
    raise QueryError(f"{name} isn't JSON")


def parse(text: str) -> Query:
    """The query of a JSON text; unknown or repeated keys, unknown words and exceeded bounds raise."""
    try:
        whole = json.loads(text, object_pairs_hook=_object, parse_constant=_constant)
    except json.JSONDecodeError as bad:
        raise QueryError(str(bad)) from None
    if not isinstance(whole, dict) or set(whole) - {"version", "where", "limit", "sort", "after_file_id"}:
        raise QueryError("unknown keys")
    if whole.get("version") != VERSION or whole.get("sort", "FILE_ID_ASC") != "FILE_ID_ASC":
        raise QueryError("unknown version or order")
    limit = whole.get("limit", 25)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= PAGE:
        raise QueryError("limit out of bounds")
    after = whole.get("after_file_id")
    if after is not None and not isinstance(after, str):
        raise QueryError("after_file_id is no text")
    count = 0

    def node(x, depth: int):
        nonlocal count
        if not isinstance(x, dict) or depth > DEPTH:
            raise QueryError("too deep, or no object")
        if set(x) == {"operator", "children"}:
            if x["operator"] not in ("AND", "OR") or not isinstance(x["children"], list) or not x["children"]:
                raise QueryError("bad group")
            return Group(x["operator"], tuple(node(c, depth + 1) for c in x["children"]))
        if set(x) != {"field", "operator", "value"}:
            raise QueryError("unknown keys")
        field, operator, value = x["field"], x["operator"], x["value"]
        if field not in FIELDS or operator not in ("EQ", "PREFIX", "MATCH") or not isinstance(value, str) or not value or len(value) > VALUE:
            raise QueryError("bad predicate")
        if operator != "EQ" and field not in METADATA or operator == "MATCH" and not words(value):
            raise QueryError(f"{operator} doesn't fit {field}")
        count += 1
        if count > PREDICATES:
            raise QueryError("too many predicates")
        return Predicate(field, operator, value)

    return Query(node(whole.get("where"), 1), limit, after)


def words(value: str) -> list[str]:
    """Words of a value as the index has them: marks off, case folded, split at what is neither letter nor digit."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) != "Mn").casefold()
    return re.findall(r"[^\W_]+", plain)


@F.pandas_udf(ArrayType(StringType()))
def _words(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else words(x))


def value_words(value: Column) -> Column:
    """Words of each value; none of null. ASCII stays in the JVM, only other values go to Python."""
    plain = is_ascii(value)
    native = F.array_remove(F.split(F.lower(value), "[^a-z0-9]+"), "")
    return F.coalesce(F.when(plain, native), _words(F.when(~plain, value)), F.array().cast("array<string>"))


def index(values: DataFrame, cap: int = METADATA_CAP) -> DataFrame:
    """``file_id, field, value`` to distinct normal values with their words, at most ``cap`` metadata values a file; ``left_out`` counts the rest."""
    normal = values.select("file_id", "field", query_value(F.col("value")).alias("value")).where("value <> ''").distinct()
    meta = F.col("field").isin(*METADATA)
    w = Window.partitionBy("file_id", meta)
    ranked = normal.withColumn("n", F.row_number().over(w.orderBy("field", "value"))).withColumn("left_out", F.when(meta, F.greatest(F.count("*").over(w) - cap, F.lit(0))).otherwise(F.lit(0)))
    kept = ranked.where(~meta | (F.col("n") <= cap))
    return kept.select("file_id", "field", "value", F.when(meta, value_words(F.col("value"))).alias("words"), "left_out")


def _test(p: Predicate) -> Column:
    here = F.col("field") == p.field
    if p.operator == "EQ":
        return here & (F.col("value") == query_value_rule(p.value))
    if p.operator == "PREFIX":
        return here & F.col("value").startswith(query_value_rule(p.value))
    found = here
    for word in words(p.value):
        found = found & F.array_contains("words", word)
    return F.coalesce(found, F.lit(False))


def matching_files(indexed: DataFrame, where: Predicate | Group) -> DataFrame:
    """Files for which the condition holds: every predicate is tested on each value in one pass, then one aggregate by file."""
    tests: list[Predicate] = []

    def collect(x) -> None:
        if isinstance(x, Predicate):
            if x not in tests:
                tests.append(x)
        else:
            for c in x.children:
                collect(c)

    collect(where)
    any_of = _test(tests[0])
    for t in tests[1:]:
        any_of = any_of | _test(t)
    flags = indexed.where(any_of).groupBy("file_id").agg(*(F.bool_or(_test(t)).alias(f"p{i}") for i, t in enumerate(tests)))

    def told(x) -> Column:
        if isinstance(x, Predicate):
            return F.col(f"p{tests.index(x)}")
        out = told(x.children[0])
        for c in x.children[1:]:
            out = (out & told(c)) if x.operator == "AND" else (out | told(c))
        return out

    return flags.where(told(where)).select("file_id")


def search(indexed: DataFrame, query: Query) -> DataFrame:
    """The page of files, ascending, with one row more than the limit if more follow (``place`` tells)."""
    found = matching_files(indexed, query.where)
    if query.after is not None:
        found = found.where(F.col("file_id") > query.after)
    page = found.orderBy("file_id").limit(query.limit + 1)
    return page.withColumn("place", F.row_number().over(Window.orderBy("file_id")))  # limit + 1 rows


def disclosed(page: DataFrame, indexed: DataFrame, query: Query) -> DataFrame:
    """The page's values of those metadata fields that the query itself names."""
    fields: set[str] = set()

    def collect(x) -> None:
        if isinstance(x, Predicate):
            fields.add(x.field)
        else:
            for c in x.children:
                collect(c)

    collect(query.where)
    shown = indexed.where(F.col("field").isin(*sorted(fields & set(METADATA)))) if fields & set(METADATA) else indexed.where("false")
    return shown.join(F.broadcast(page.select("file_id")), "file_id").groupBy("file_id", "field").agg(F.sort_array(F.collect_set("value")).alias("values"))
