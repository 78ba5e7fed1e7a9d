"""Package metadata of books (OPF 2 and 3) by Spark's XML reader: typed elements, refinements resolved within a document, observations and candidates.

Everything is an expression over one document's row: ``from_xml`` with a schema, namespaces by local names, and functions
over its arrays, so no document is shuffled and no Python runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.scalars import MARC_ROLES

# Bounds of a document, of a value, and of what one document may tell; properties that refine; aliases of identifier namespaces; names of series metadata.
DOCUMENT_BYTES, VALUE, OBSERVATIONS, CANDIDATES = 4 << 20, 4096, 256, 1024
REFINEMENTS = ("collection-type", "file-as", "group-position", "identifier-type", "role")
NAMESPACES = (("isbn", "isbn"), ("isbn-10", "isbn"), ("isbn-13", "isbn"), ("isbn10", "isbn"), ("isbn13", "isbn"), ("mobi-asin", "asin"))
NAMED = (("calibre:rating", "rating"), ("calibre:title_sort", "title_sort"), ("calibre:series", "series"), ("calibre:series_index", "series_index"))
#: Elements with the key of their observations and, of plain ones, of their candidates.
ELEMENTS = (("title", "title"), ("creator", None), ("contributor", None), ("identifier", None), ("language", "language"), ("publisher", "publisher"), ("date", "publication_date"), ("subject", "subject"), ("description", "description"), ("rights", "rights"), ("type", "type"))
_ELEMENT = "array<struct<_VALUE:string,_id:string,_role:string,`_file-as`:string,_scheme:string>>"
_META = "array<struct<_VALUE:string,_id:string,_name:string,_property:string,_refines:string,_scheme:string,_content:string>>"
_FIELDS = ",".join([*(f"{n}:{_ELEMENT}" for n, _ in ELEMENTS), f"meta:{_META}"])
_SCHEMA = f"metadata struct<{_FIELDS},`dc-metadata`:struct<{_FIELDS}>,`x-metadata`:struct<{_FIELDS}>>, bad string"
_OPTIONS = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false"}
_KNOWN = "|".join(["package", "metadata", "dc-metadata", "x-metadata", "meta", *(n for n, _ in ELEMENTS)])
_TERM = "array<struct<value:string,scheme:string>>"
_PAIR, _TRIPLE = "array<struct<key:string,value:string>>", "array<struct<field_path:string,value:string,source_location:string>>"


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s \u0085 -     　]+", " "))


def _stripped(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _key_part(x: Column) -> Column:
    """Of a value what may stand in a key: lower case, other signs as hyphens, 64 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 64)


def _from(pairs, x: Column) -> Column:
    """The value for a key, or null."""
    return F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in pairs))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _told(path: Column, value: Column, place: Column) -> Column:
    return F.struct(path.alias("field_path"), value.alias("value"), place.alias("source_location"))


def _suffix(many: Column, i: Column) -> Column:
    return F.when(F.size(many) == 1, F.lit("")).otherwise(F.concat(F.lit("."), (i + 1).cast("string")))


def _every(kind: str, *parts: Column) -> Column:
    """Arrays one after another, nulls as none."""
    none = F.array().cast(kind)
    return F.concat(*(F.coalesce(p.cast(kind), none) for p in parts))


def _flat(kind: str, many: Column, each) -> Column:
    return F.flatten(F.transform(many, each)).cast(kind)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row: the optimiser puts no expression into others across an explosion of one element."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("made__")
    return rows.select("*", made).select(*rows.columns, "made__.*")


def parsed(documents: DataFrame, key: str, content: str) -> DataFrame:
    """``key, status, p``: a document's metadata as typed arrays, or why there is none. Markup inside an element's text is taken off, its text stays."""
    raw = F.col(content).cast("binary")
    rows = documents.select(key, raw.alias("raw__")).withColumn("x", F.regexp_replace(F.col("raw__").cast("string"), "^﻿", ""))
    root = F.regexp_extract("x", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    refused = (
        F.when(F.col("raw__").isNull(), "NO_DOCUMENT").when(F.octet_length("raw__") > DOCUMENT_BYTES, "TOO_LARGE").when(~F.is_valid_utf8(F.col("raw__").cast("string")), "NOT_UTF8")
        .when(F.upper("x").contains("<!DOCTYPE") | F.upper("x").contains("<!ENTITY"), "FORBIDDEN_DECLARATION")
    )
    rows = _once(rows, refused=refused).withColumn("x", F.when(F.col("refused").isNull(), F.col("x")))
    rows = _once(rows, first=F.from_xml("x", _SCHEMA, _OPTIONS))
    inner = F.regexp_replace("x", rf"</?(?!(?:[\w.-]+:)?(?:{_KNOWN})[\s/>])[A-Za-z_][^<>]*>", "")
    plain = F.when(F.col("x").contains("<![CDATA[") | (inner == F.col("x")), F.col("first")).otherwise(F.from_xml(inner, _SCHEMA, _OPTIONS))
    status = F.coalesce("refused", F.when(F.col("first.bad").isNotNull() | F.col("first").isNull(), "MALFORMED").when(F.lower(root) != "package", "NO_PACKAGE").when(F.col("first.metadata").isNull(), "NO_METADATA"), F.lit("OK"))
    return _once(rows, status=status, p=plain).select(key, "status", "p")


def projected(documents: DataFrame, key: str, content: str) -> DataFrame:
    """``key, status, observations (key, value), candidates (field_path, value, source_location)`` of each document.

    Creators and contributors are numbered together; roles and sorted names come from attributes and from refinements of
    the element's id, different ones once. A role is mapped where it has no scheme or a MARC one, an identifier's namespace by
    its scheme, its refined type (ONIX 02 and 15 are ISBN) or else its prefix. Documents with a type declaration or entities,
    over 4 MiB, not UTF-8, not well-formed, or that tell too much or too long values, have a status and no rows; so has null.
    """
    rows = parsed(documents, key, content)

    def of(name: str, kind: str) -> Column:
        return _every(kind, F.col(f"p.metadata.{name}"), F.col(f"p.metadata.`dc-metadata`.{name}"), F.col(f"p.metadata.`x-metadata`.{name}"))

    metas = F.transform(of("meta", _META), lambda m: F.struct(
        _stripped(m["_id"]).alias("id"), F.lower(_stripped(m["_name"])).alias("name"), F.lower(_stripped(m["_property"])).alias("property"), _stripped(m["_refines"]).alias("refines"), _stripped(m["_scheme"]).alias("scheme"),
        _spaced(F.when(_stripped(m["_content"]) != "", m["_content"]).otherwise(m["_VALUE"])).alias("value"),
    ))
    rows = _once(rows, metas=metas)
    refs = F.filter("metas", lambda m: m["refines"].startswith("#") & m["property"].isin(*REFINEMENTS) & (m["value"] != ""))
    rows = _once(rows, refs=F.transform(refs, lambda m: F.struct(F.regexp_replace(m["refines"], "^#", "").alias("target"), m["property"].alias("property"), m["value"].alias("value"), m["scheme"].alias("scheme"))))

    def refined(element_id: Column, name: str, own: Column | None = None, scheme: str = "") -> Column:
        """Terms of an element: its attribute, then its refinements; different ones once."""
        found = F.transform(F.filter("refs", lambda r: (element_id != "") & (r["target"] == element_id) & (r["property"] == name)), lambda r: F.struct(r["value"].alias("value"), r["scheme"].alias("scheme")))
        if own is None:
            return F.array_distinct(found)
        first = F.when(own != "", F.array(F.struct(own.alias("value"), F.lit(scheme).alias("scheme"))))
        return F.array_distinct(_every(_TERM, first, found))

    def elements(name: str) -> Column:
        return F.transform(of(name, _ELEMENT), lambda e, i: F.struct(F.lit(name).alias("source"), F.concat(F.lit(f"opf.{name}["), (i + 1).cast("string"), F.lit("]")).alias("place"), _spaced(e["_VALUE"]).alias("value"), _stripped(e["_id"]).alias("id"), _stripped(e["_role"]).alias("role"), _stripped(e["_file-as"]).alias("file_as"), _stripped(e["_scheme"]).alias("scheme")))

    rows = _once(rows, **{f"e_{name}": elements(name) for name, _ in ELEMENTS})
    people = F.transform(F.concat("e_creator", "e_contributor"), lambda e: F.struct(e["source"].alias("source"), e["place"].alias("place"), e["value"].alias("value"), refined(e["id"], "role", e["role"]).alias("roles"), refined(e["id"], "file-as", e["file_as"]).alias("sorts")))
    numbers = F.transform("e_identifier", lambda e: F.struct(e["place"].alias("place"), e["value"].alias("value"), refined(e["id"], "identifier-type", e["scheme"], "opf:scheme").alias("terms")))
    titles = F.transform("e_title", lambda e: F.struct(e["place"].alias("place"), e["value"].alias("value"), refined(e["id"], "file-as", e["file_as"]).alias("sorts")))
    rows = _once(rows, people=people, numbers=numbers, titles=titles)
    named = {}
    for name, _ in NAMED:
        # either attribute names it
        mine = F.filter("metas", lambda m: F.when(m["name"] != "", m["name"]).otherwise(m["property"]).eqNullSafe(F.lit(name)) & (m["value"] != ""))
        named[f"m_{name.split(':')[1]}"] = F.transform(mine, lambda m, i: F.struct(m["value"].alias("value"), F.concat(F.lit(f"opf.meta[{name}]["), (i + 1).cast("string"), F.lit("]")).alias("place")))
    collections = F.transform(F.filter("metas", lambda m: m["property"] == "belongs-to-collection"), lambda m, i: F.struct(m["value"].alias("value"), F.concat(F.lit("opf.collection["), (i + 1).cast("string"), F.lit("]")).alias("place"), refined(m["id"], "collection-type").alias("types"), refined(m["id"], "group-position").alias("positions")))
    rows = _once(rows, **named, collections=collections)
    rows = _once(rows, series=F.filter("collections", lambda c: F.exists(c["types"], lambda t: F.lower(F.trim(t["value"])) == "series")))

    def with_role(head: Column, roles: Column) -> Column:
        part = _key_part(F.coalesce(F.get(roles, F.lit(0))["value"], F.lit("")))
        return F.when(part != "", F.concat(head, F.lit(":"), part)).otherwise(head)

    observations = [_flat(_PAIR, F.col("titles"), lambda e: _every(_PAIR, F.array(_pair(F.lit("title"), e["value"])), F.transform(e["sorts"], lambda s: _pair(F.lit("title_sort"), s["value"]))))]
    observations.append(_flat(_PAIR, F.col("people"), lambda e: _every(_PAIR, F.array(_pair(with_role(e["source"], e["roles"]), e["value"])), F.transform(e["sorts"], lambda s: _pair(with_role(F.concat(e["source"], F.lit("_file_as")), e["roles"]), s["value"])))))
    observations.append(F.transform("numbers", lambda e: _pair(with_role(F.lit("identifier"), e["terms"]), e["value"])))
    observations += [F.transform(f"e_{name}", lambda e: _pair(F.lit(name), e["value"])) for name, candidate in ELEMENTS if candidate and name != "title"]
    observations += [F.transform(f"m_{name.split(':')[1]}", lambda m: _pair(F.lit(target), m["value"])) for name, target in NAMED]
    observations.append(_flat(_PAIR, F.col("series"), lambda c: _every(_PAIR, F.array(_pair(F.lit("series"), c["value"])), F.transform(c["positions"], lambda x: _pair(F.lit("series_index"), x["value"])))))

    def numbered(head: str, i: Column, tail: str) -> Column:
        return F.concat(F.lit(f"{head}."), i.cast("string"), F.lit(f".{tail}"))

    def person(e: Column, i: Column) -> Column:
        n, at = i + 1, lambda tail: F.concat(e["place"], F.lit(tail))
        marc = lambda r: F.when((F.trim(r["scheme"]) == "") | _key_part(F.trim(r["scheme"])).isin("marc", "marc-relators"), _from(MARC_ROLES, F.lower(F.trim(r["value"]))))
        roles = _flat(_TRIPLE, e["roles"], lambda r, k: F.array(
            _told(F.concat(numbered("contributor", n, "source_role"), _suffix(e["roles"], k)), r["value"], at(".role")), _told(F.concat(numbered("contributor", n, "source_role_scheme"), _suffix(e["roles"], k)), r["scheme"], at(".role.scheme")),
            _told(F.concat(numbered("contributor", n, "role"), _suffix(e["roles"], k)), marc(r), at(".role")),
        ))
        sorts = F.transform(e["sorts"], lambda s, k: _told(F.concat(numbered("contributor", n, "sort_name"), _suffix(e["sorts"], k)), s["value"], at(".file-as")))
        return _every(_TRIPLE, F.array(_told(numbered("contributor", n, "name"), e["value"], at(".text")), _told(numbered("contributor", n, "source_element"), e["source"], e["place"])), roles, sorts)

    def number(e: Column, i: Column) -> Column:
        n, at = i + 1, lambda tail: F.concat(e["place"], F.lit(tail))
        low = F.lower(F.trim(e["value"]))
        guess = F.when(low.startswith("urn:isbn:") | low.startswith("isbn:"), "isbn").when(low.startswith("urn:uuid:"), "uuid")

        def term(x: Column, k: Column) -> Column:
            own, scheme, part = x["scheme"] == "opf:scheme", _key_part(x["scheme"]), _key_part(x["value"])
            place = F.concat(e["place"], F.when(own, ".scheme").otherwise(".identifier-type"))
            alias = _from(NAMESPACES, part)
            known = F.when(scheme == "onix-codelist5", F.when(F.trim(x["value"]).isin("02", "15"), "isbn")).when(scheme == "opf-scheme", F.coalesce(alias, part)).when(scheme == "", alias)
            return F.array(
                _told(F.concat(numbered("identifier", n, "source_namespace"), _suffix(e["terms"], k)), x["value"], place), _told(F.concat(numbered("identifier", n, "source_namespace_scheme"), _suffix(e["terms"], k)), F.when(~own, x["scheme"]), F.concat(place, F.lit(".scheme"))),
                _told(F.concat(numbered("identifier", n, "namespace"), _suffix(e["terms"], k)), known, place),
            )

        inferred = F.when(F.size(e["terms"]) == 0, F.array(_told(numbered("identifier", n, "namespace"), guess, at(".text-prefix"))))
        return _every(_TRIPLE, F.array(_told(numbered("identifier", n, "value"), e["value"], at(".text"))), _flat(_TRIPLE, e["terms"], term), inferred)

    legacy = F.greatest(F.size("m_series"), F.size("m_series_index"))
    candidates = [_flat(_TRIPLE, F.col("titles"), lambda e: _every(_TRIPLE, F.array(_told(F.lit("title"), e["value"], F.concat(e["place"], F.lit(".text")))), F.transform(e["sorts"], lambda s: _told(F.lit("title_sort"), s["value"], F.concat(e["place"], F.lit(".file-as"))))))]
    candidates += [_flat(_TRIPLE, F.col("people"), person), _flat(_TRIPLE, F.col("numbers"), number)]
    candidates += [F.transform(f"e_{name}", lambda e: _told(F.lit(candidate), e["value"], F.concat(e["place"], F.lit(".text")))) for name, candidate in ELEMENTS if candidate and name != "title"]
    candidates += [F.transform(f"m_{t}", lambda m: _told(F.lit(t), m["value"], m["place"])) for t in ("rating", "title_sort")]
    candidates += [F.transform(f"m_{t}", lambda m, i: _told(numbered("series", i + 1, tail), m["value"], m["place"])) for t, tail in (("series", "name"), ("series_index", "position"))]
    candidates.append(_flat(_TRIPLE, F.col("series"), lambda c, i: _every(_TRIPLE, F.array(_told(numbered("series", legacy + i + 1, "name"), c["value"], F.concat(c["place"], F.lit(".text")))), F.transform(c["positions"], lambda x, k: _told(F.concat(numbered("series", legacy + i + 1, "position"), _suffix(c["positions"], k)), x["value"], F.concat(c["place"], F.lit(".group-position")))))))
    full = lambda x: F.coalesce(x["value"] != "", F.lit(False))
    rows = _once(rows, o=F.filter(_every(_PAIR, *observations), full), c=F.filter(_every(_TRIPLE, *candidates), full))
    long = reduce(Column.__or__, [F.exists(x, lambda v: F.length(v["value"]) > VALUE) for x in ("o", "c", "refs")])
    many = (F.size("o") > OBSERVATIONS) | (F.size("c") > CANDIDATES) | (F.size("refs") > CANDIDATES)
    status = F.when(F.col("status") != "OK", F.col("status")).when(long, "OVERSIZED_VALUE").when(many, "TOO_MANY_VALUES").otherwise("OK")
    fine = F.col("status") == "OK"
    return rows.withColumn("status", status).select(key, "status", F.when(fine, F.col("o")).otherwise(F.array().cast(_PAIR)).alias("observations"), F.when(fine, F.col("c")).otherwise(F.array().cast(_TRIPLE)).alias("candidates"))


def candidates(documents: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each candidate."""
    return projected(documents, key, content).select(key, F.explode("candidates").alias("c")).select(key, "c.*")
