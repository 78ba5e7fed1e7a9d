"""Rules that need Unicode tables, as Arrow-batched functions; Spark has no NFKC, case folding or category tests."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kept with what is derived, as another version may normalise otherwise.
UNICODE_VERSION = unicodedata.unidata_version


def _each(rule):
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else rule(x))

    return run


def _spaced(x: str) -> str:
    return " ".join(x.split())


def _without_marks(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")


def _given_first(x: str) -> str:
    """``Family, Given`` turned round if there is exactly one comma with text on both sides."""
    family, comma, given = x.partition(",")
    return f"{given.strip()} {family.strip()}" if comma and "," not in given and family.strip() and given.strip() else x


def query_value_rule(x: str) -> str:
    return _spaced(unicodedata.normalize("NFKC", x).casefold())


def text_rule(x: str) -> str:
    return _spaced(unicodedata.normalize("NFKC", x.removeprefix("﻿")))


def agent_key_rule(x: str) -> str:
    """For evidence: marks and punctuation go, case is folded."""
    x = _given_first(_without_marks(unicodedata.normalize("NFKC", x)).casefold())
    return _spaced("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in x))


def title_rule(x: str) -> str:
    """For candidates: folded, without marks; only ASCII letters, digits and some signs of names stay, anything else is a space."""
    return _spaced(re.sub(r"[^0-9a-zA-Z\s\-'.&]+", " ", _without_marks(x.strip().casefold()), flags=re.ASCII))


def agent_name_rule(x: str) -> str:
    """As a title: a comma is a space by then, so names aren't turned round, other than by ``agent_key_rule``."""
    return title_rule(x)


def identifier_rule(x: str) -> str:
    """Letters and digits of the title's form."""
    return re.sub(r"\W+", "", title_rule(x))


def identifier_key_rule(x: str) -> str:
    x = unicodedata.normalize("NFKC", x).strip().casefold()
    return "".join(c for c in x if unicodedata.category(c)[0] != "M" and not c.isspace() and c not in "-_()[]{}\"'`")


def classification_rule(x: str) -> str:
    return unicodedata.normalize("NFC", _spaced(x).casefold())


def is_ascii(value: Column) -> Column:
    return F.length(value) == F.octet_length(value)


#: Characters beyond ASCII that NFKC leaves as they are beside any others of them or ASCII's, and no white space: Latin letters, dashes and quotes.
_KEPT = r"\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201E"
STABLE = r"\x00-\x7F" + _KEPT


def is_stable(value: Column) -> Column:
    """Text of STABLE alone, which NFKC doesn't change."""
    # from ASCII run to ASCII run: a class with all ranges would test each of them for each character
    return is_ascii(value) | value.rlike(rf"\A[\x00-\x7F]*+(?:[{_KEPT}][\x00-\x7F]*+)*+\z")


def _plain_spaced(value: Column) -> Column:
    """``_spaced`` of ASCII text: what Python counts as white space there."""
    return F.trim(F.regexp_replace(value, r"[\x09-\x0D\x1C-\x20]+", " "))


def _applied(rule, plain=None, fits=is_ascii):
    """The rule as a column. plain: what it comes to for text that ``fits``, which then stays in the JVM; Python gets nulls in its place."""
    udf = _each(rule)

    def column(value: Column) -> Column:
        if plain is None:
            return udf(value)
        return F.coalesce(udf(F.when(~fits(value), value)), plain(value))  # Python's null tells that it fits, so that is tested once

    return column


def folded_rule(x: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold())


#: Names that are one on a file system without case and with composed characters. None of what either step changes is a slash.
folded = _applied(folded_rule, F.lower)
casefolded = _applied(str.casefold, F.lower)
query_value = _applied(query_value_rule, lambda x: _plain_spaced(F.lower(x)))
normal_text = _applied(text_rule, _plain_spaced, is_stable)
agent_key = _applied(agent_key_rule)
agent_name = _applied(agent_name_rule)
title = _applied(title_rule)
identifier = _applied(identifier_rule)
identifier_key = _applied(identifier_key_rule)
classification_value = _applied(classification_rule, lambda x: F.lower(_plain_spaced(x)))


def text_fingerprint(text: Column) -> Column:
    """SHA-256 of the normal text; null without any text."""
    return F.sha2(F.nullif(normal_text(text), F.lit("")), 256)  # names the text once, as Spark would normalise it again for each name


def title_alias(title: Column) -> Column:
    """Without a leading English article."""
    return F.regexp_replace(title, r"(?i)^(the|a|an)\s+", "")


def parenthesised(title: Column) -> Column:
    """What stands in the first brackets, or null."""
    found = F.regexp_extract(title, r"\(([^()]+)\)", 1)
    return F.when(found != "", F.trim(found))


def credited_as(name: Column) -> Column:
    """The name after a credit note, or null."""
    found = F.regexp_extract(name, r"(?i)\b(?:credited as|as)\s+([^)\]]+)", 1)
    return F.when(found != "", F.trim(found))


def without_annotations(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*[\(\[][^)\]]*[\)\]]", ""), r"\s+", " "))


#: Canonical composition alone.
composed = _applied(lambda x: unicodedata.normalize("NFC", x), lambda x: x)
