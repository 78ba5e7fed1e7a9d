"""Records of a book knowledge provider, read within bounds and brought to targets that the caller has bound.

A record is read as a variant, so a number where text belongs is told from text. Its values become rows, meet their bindings in
one join, and are merged record by record: each once, in one order. A record holds a bounded number of values, so the lists
of a merge are bounded too, whatever the number of records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.unicode import composed

MOST_VALUES = 32

# Fields of each kind of record with the names that they may have in JSON and the greatest length.
TEXTS = {
    "WORK": (("title", ("title",), 512), ("first_publish_year", ("first_publish_year", "first_publish_date"), 64)),
    "EDITION": (("title", ("title",), 512), ("subtitle", ("subtitle",), 512), ("publish_date", ("publish_date",), 64)),
    "AUTHOR": (("name", ("name",), 512), ("birth_date", ("birth_date",), 64), ("death_date", ("death_date",), 64)),
}
LISTS = {
    "WORK": (("subjects", ("subjects",), 256),),
    "EDITION": (("publishers", ("publishers",), 256), ("languages", ("languages",), 64)),
    "AUTHOR": (("alternate_names", ("alternate_names",), 512),),
}
IDENTIFIERS = (("isbn10", ("isbn_10",), 64), ("isbn13", ("isbn_13", "isbn"), 64), ("oclc", ("oclc_numbers",), 64), ("lccn", ("lccn",), 64))
# What a kind of record is about, the namespace of its key, the folder and the letter of the key.
KINDS = {"WORK": ("WORK", "openlibrary.work", "/works/", "W"), "EDITION": ("EDITION", "openlibrary.edition", "/books/", "M"), "AUTHOR": ("AGENT", "openlibrary.author", "/authors/", "A")}

_FACT = "struct<role:string,field:string,most:int,raw:string,state:string>"
_PROJECTION = "struct<projection:string,target_kind:string,source_refs:array<string>,target_ref:string,name:string,value:string>"


def _type(v: Column) -> Column:
    """What JSON holds there; VOID for null and for nothing."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _at(v: Column, *names: str) -> Column:
    """The first of the names that is there, as a variant."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "variant") for n in names))


def _string(v: Column) -> Column:
    return F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _fact(role: str, field: str, most: int, raw: Column, state: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(field).alias("field"), F.lit(most).alias("most"), raw.cast("string").alias("raw"), state.cast("string").alias("state"))


def _text(v: Column, field: str, names: tuple[str, ...], most: int) -> Column:
    t = _at(v, *names)
    raw = _string(t)
    known = _type(t).isin("STRING", "VOID")
    if field == "first_publish_year":
        raw, known = F.coalesce(raw, F.when(_type(t) == "BIGINT", F.try_variant_get(t, "$", "string"))), known | (_type(t) == "BIGINT")
    return F.array(_fact("VALUE", field, most, raw, F.when(~known, "WRONG")))


def _list(t: Column, role: str, field: str, most: int, item, wrong) -> Column:
    """The first values of a list, and what is amiss with it. item: a value's text. wrong: the state of a value without any."""
    values = F.try_variant_get(t, "$", "array<variant>")
    found = F.transform(F.slice(values, 1, MOST_VALUES), lambda x: _fact(role, field, most, item(x), F.when(item(x).isNull(), wrong(x))))
    cut = F.array(_fact(role, field, most, F.lit(None), F.lit("CUT")))
    none = F.array().cast(f"array<{_FACT}>")
    listed = F.concat(F.coalesce(found, none), F.when(F.size(values) > MOST_VALUES, cut).otherwise(none))
    return F.when(_type(t).startswith("ARRAY"), listed).when(_type(t) == "VOID", none).otherwise(F.array(_fact(role, field, most, F.lit(None), F.lit("WRONG"))))


def _values(v: Column, role: str, field: str, names: tuple[str, ...], most: int) -> Column:
    """Texts; a language may be an object with a key. Null values are passed over, others are wrong."""
    item = (lambda x: F.coalesce(_string(x), _string(_at(x, "key")))) if field == "languages" else _string
    lenient = (lambda x: _type(x).startswith("OBJECT")) if field == "languages" else (lambda x: F.lit(False))
    return _list(_at(v, *names), role, field, most, item, lambda x: F.when((_type(x) != "VOID") & ~lenient(x), "WRONG"))


def _references(t: Column, field: str) -> Column:
    """Keys of other records, plain, as objects, or as the author of a contribution; what isn't one is left out and told."""
    inner = lambda x: _at(x, "author")
    item = lambda x: F.coalesce(_string(x), F.when(inner(x).isNotNull(), _string(_at(inner(x), "key"))).otherwise(_string(_at(x, "key"))))
    return _list(t, "REFERENCE", field, 64, item, lambda x: F.lit("CUT"))


def _facts(v: Column, kind: str, found: Column) -> Column:
    """All values of a record of one kind. found: whether a search told it, which names authors by their keys and no subjects."""
    key = F.array(_fact("KEY", kind, 64, _string(_at(v, "key")), F.lit(None)))
    parts = [key, *(_text(v, *x) for x in TEXTS[kind])]
    lists = [_values(v, "VALUE", *x) for x in LISTS[kind]]
    if kind == "WORK":
        none = F.array().cast(f"array<{_FACT}>")
        named = _at(v, "author_key")
        parts += [F.when(found, none).otherwise(x) for x in lists]
        parts.append(F.when(found | named.isNotNull(), _references(named, "AUTHOR")).otherwise(_references(_at(v, "authors"), "AUTHOR")))
    else:
        parts += lists
    if kind == "EDITION":
        parts += [_values(v, "IDENTIFIER", *x) for x in IDENTIFIERS]
        parts += [_references(_at(v, "works"), "WORK"), _references(_at(v, "authors"), "AUTHOR")]
    return F.concat(*parts)


def isbn10_valid(value: Column) -> Column:
    digit = lambda i: F.when(F.substring(value, i + 1, 1) == "X", 10).otherwise(F.try_to_number(F.substring(value, i + 1, 1), F.lit("9")))
    return value.rlike("^[0-9]{9}[0-9X]$") & (reduce(lambda a, b: a + b, ((10 - i) * digit(i) for i in range(10))) % 11 == 0)


def isbn13_valid(value: Column) -> Column:
    digit = lambda i: F.try_to_number(F.substring(value, i + 1, 1), F.lit("9"))
    return value.rlike("^[0-9]{13}$") & (reduce(lambda a, b: a + b, ((3 if i % 2 else 1) * digit(i) for i in range(13))) % 10 == 0)


def canonical(value: Column, most: int) -> Column:
    """Not empty, within the bound, composed, without white space around it and without line ends or nulls."""
    return (value != "") & (F.length(value) <= most) & (value == composed(value)) & ~value.rlike(r"(?U)^[\s\x1C-\x1F]|[\s\x1C-\x1F]\z|[\x00\r\n]")


def safe_reference(value: Column) -> Column:
    """Canonical, and nothing like a path or an address."""
    return canonical(value, 256) & ~value.rlike(r"[\\/]|\.\.|^(?i:file:)|^[A-Za-z]:")


def _record_key(value: Column, kind: Column) -> Column:
    """A record's key with the letter of its kind, without its folder; null if it isn't one."""
    out = F.lit(None).cast("string")
    for name, (_, _, folder, letter) in KINDS.items():
        plain = F.upper(F.when(~value.startswith("/"), value).when(value.startswith(folder), F.substring(value, len(folder) + 1, 1 << 20)))
        out = F.when(kind == name, F.when(plain.rlike(rf"^OL[0-9]+{letter}\z") & (F.length(plain) <= 64), plain)).otherwise(out)
    return out


def _by_kind(kind: Column, place: int) -> Column:
    return F.coalesce(*(F.when(kind == name, F.lit(told[place])) for name, told in KINDS.items()))


def facts(records: DataFrame) -> DataFrame:
    """``record_id, endpoint, at, kind, role, field, value, state``: every value of every record.

    records: ``record_id`` (unique), ``endpoint`` (WORK, EDITION, IDENTIFIER, AUTHOR, SEARCH) and ``body`` (JSON). A search's work stands at 0, its
    editions from 1 on, the contributors that it names at -1. state: WRONG for another type than the field has, CUT for values left out
    (beyond the first 32, too long, or no valid identifier). Null, empty and broken bodies, and unknown endpoints, give one WRONG row.
    """
    v, at, kind = F.col("v"), F.col("at"), F.col("kind")
    read = records.select("record_id", "endpoint", F.try_parse_json("body").alias("v"))
    unit = lambda at, kind, v: F.struct(F.lit(at).alias("at") if isinstance(at, int) else at.alias("at"), F.lit(kind).alias("kind"), v.alias("v"))
    docs = F.try_variant_get(v, "$.editions.docs", "array<variant>")
    children = F.transform(F.slice(docs, 1, MOST_VALUES), lambda x, i: unit((i + 1).cast("int"), "EDITION", x))
    one = lambda kind: F.array(unit(0, kind, v))
    units = F.when(~_type(v).startswith("OBJECT"), F.array(unit(0, "NONE", v)))
    for endpoint, name in (("WORK", "WORK"), ("EDITION", "EDITION"), ("IDENTIFIER", "EDITION"), ("AUTHOR", "AUTHOR")):
        units = units.when(F.col("endpoint") == endpoint, one(name))
    search = F.concat(F.array(unit(-1, "SEARCH", v), unit(0, "WORK", v)), F.coalesce(children, F.array().cast("array<struct<at:int,kind:string,v:variant>>")))
    units = units.when(F.col("endpoint") == "SEARCH", search).otherwise(F.array(unit(0, "NONE", v)))
    each = read.select("record_id", "endpoint", F.explode(units).alias("u")).select("record_id", "endpoint", "u.*")
    found = F.col("endpoint") == "SEARCH"
    wrong = F.array(_fact("KEY", "NONE", 64, F.lit(None), F.lit("WRONG")))
    names = _list(_at(v, "author_name"), "NAME", "author_name", 512, _string, lambda x: F.lit("CUT"))
    listed = _at(v, "editions.docs")
    more = F.when(~_type(listed).startswith("ARRAY") & (_type(listed) != "VOID"), F.array(_fact("DOCS", "editions", 0, F.lit(None), F.lit("WRONG")))).when(F.size(F.try_variant_get(listed, "$", "array<variant>")) > MOST_VALUES, F.array(_fact("DOCS", "editions", 0, F.lit(None), F.lit("CUT")))).otherwise(F.array().cast(f"array<{_FACT}>"))
    told = F.when(kind == "NONE", wrong).when(kind == "SEARCH", F.concat(F.array(_fact("SEARCH", "SEARCH", 0, F.lit(None), F.lit(None))), names, more))
    for name in KINDS:
        told = told.when(kind == name, _facts(v, name, found))
    long = each.select("record_id", "endpoint", "at", "kind", F.explode(told).alias("f")).select("record_id", "endpoint", "at", "kind", "f.*").withColumn("text", composed(F.col("raw")))
    text, role, field = F.col("text"), F.col("role"), F.col("field")
    valid = F.when(field == "isbn10", isbn10_valid(text)).when(field == "isbn13", isbn13_valid(text)).when(field == "oclc", text.rlike(r"^[0-9]{1,16}\z")).when(field == "lccn", text.rlike(r"^[A-Za-z0-9-]{1,32}\z"))
    value = (
        F.when(role.isin("KEY", "REFERENCE"), _record_key(text, field))
        .when(F.length(text) > F.col("most"), None)
        .when((role == "IDENTIFIER") & ~valid, None)
        .when((role == "NAME") & (text == ""), None)
        .otherwise(text)
    )
    lost = text.isNotNull() & value.isNull() & (role != "KEY")
    return long.withColumn("value", value).select("record_id", "endpoint", "at", "kind", "role", "field", "value", F.coalesce("state", F.when(lost, "CUT")).alias("state"))


def _begins(prefix: str):
    return lambda x: x.startswith(prefix)


def merged(rows: DataFrame, group: str, parts: str) -> DataFrame:
    """``group, parts``: all lists of a group as one, each entry once, in order of its fields. Doesn't depend on the order of rows."""
    return rows.groupBy(group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(parts)))).alias(parts))


def mapped(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """``record_id, status, truncated, findings, projections``, a row for each record.

    records: as for ``facts``, and ``target_id``, the target of a record whose key isn't bound (null: none). bindings: ``key`` (like
    openlibrary.work:OL1W, unique) and ``target_ref``. status: MAPPED; INVALID_RESPONSE for a record of wrong types or without key;
    NOT_BOUND if the record, a child or a reference has no target; NOT_CANONICAL for a value or a target that isn't. Only MAPPED records have
    projections: IDENTIFIER, VALUE, WORK_CANDIDATE and AGENT_CANDIDATE, sorted, each once. Of a search's equal children the one with the
    smallest values stays; its contributors are candidates by name alone, with the keys of its records. Empty tables give empty ones.
    """
    long = facts(records)
    held = F.col("role").isin("KEY", "REFERENCE") & F.col("value").isNotNull()
    # what needs no target is spread by record: null keys would all meet in one task
    wanted = F.when(held, F.concat(_by_kind(F.col("field"), 1), F.lit(":"), F.col("value"))).otherwise(F.concat(F.lit("-"), F.col("record_id").cast("string")))
    bound = long.withColumn("bound_key", wanted).join(bindings.select(F.col("key").alias("bound_key"), F.col("target_ref").alias("bound")), "bound_key", "left")
    entry = F.struct("role", "field", "value", "bound")
    good = F.col("value").isNotNull() & F.col("role").isin("VALUE", "IDENTIFIER", "REFERENCE", "NAME")
    unsound = (F.col("role").isin("VALUE", "NAME") & (F.col("value") != "") & ~canonical(F.col("value"), 512)) | (F.col("bound").isNotNull() & ~safe_reference(F.col("bound")))
    units = bound.repartition("record_id").groupBy("record_id", "endpoint", "at", "kind").agg(
        F.max(F.when(F.col("role") == "KEY", F.col("value"))).alias("own_key"),
        F.max(F.when(F.col("role") == "KEY", F.col("bound"))).alias("own_target"),
        F.coalesce(F.bool_or(F.col("state") == "WRONG"), F.lit(False)).alias("wrong"),
        F.coalesce(F.bool_or(F.col("state") == "CUT"), F.lit(False)).alias("cut"),
        F.coalesce(F.bool_or((F.col("role") == "DOCS") & (F.col("state") == "CUT")), F.lit(False)).alias("docs_cut"),
        F.coalesce(F.bool_or((F.col("role") == "REFERENCE") & F.col("value").isNotNull() & F.col("bound").isNull()), F.lit(False)).alias("loose"),
        F.coalesce(F.bool_or(unsound), F.lit(False)).alias("unsound"),
        F.array_sort(F.collect_set(F.when(good, entry))).alias("entries"),
    )
    of = lambda role, field=None: F.filter("entries", lambda e: (e["role"] == role) & (F.lit(True) if field is None else (e["field"] == field)))
    isbns = F.transform(F.concat(of("IDENTIFIER", "isbn10"), of("IDENTIFIER", "isbn13")), lambda e: e["value"])
    search = F.col("endpoint") == "SEARCH"
    keyless = (F.col("kind") == "EDITION") & F.col("endpoint").isin("SEARCH", "IDENTIFIER") & (F.size(isbns) > 0)
    units = units.withColumn("same", F.when(F.col("kind") == "SEARCH", F.lit("")).when(F.col("own_key").isNotNull(), F.col("own_key")).when(keyless, F.array_join(isbns, "|")))
    # a search's children without a key: no work, or a finding
    units = units.withColumn("malformed", F.col("same").isNull())
    unit = F.struct(*units.columns)
    one = units.groupBy("record_id", "kind", F.coalesce("same", F.concat(F.lit("?"), F.col("at").cast("string"))).alias("which")).agg(F.min_by(unit, F.to_json(F.col("entries"))).alias("unit")).select("unit.*")
    given = records.select("record_id", "target_id")
    one = one.join(given, "record_id", "left").withColumn("target", F.coalesce("own_target", F.when(~search, F.col("target_id"))))
    kind, target = F.col("kind"), F.col("target")
    about = _by_kind(kind, 0)
    made = lambda projection, about, ref, name, value: F.struct(F.lit(projection).alias("projection"), about.alias("target_kind"), F.array().cast("array<string>").alias("source_refs"), ref.alias("target_ref"), name.alias("name"), value.alias("value"))
    none = F.array().cast(f"array<{_PROJECTION}>")
    space = _by_kind(kind, 1)
    own = F.when(F.col("own_key").isNotNull(), F.array(made("IDENTIFIER", about, target, space, F.col("own_key")))).otherwise(none)
    itself = F.when((kind == "AUTHOR") & F.col("own_key").isNotNull(), F.array(made("AGENT_CANDIDATE", about, target, space, F.col("own_key")))).otherwise(none)
    ids = F.transform(of("IDENTIFIER"), lambda e: made("IDENTIFIER", about, target, e["field"], e["value"]))
    values = F.transform(F.filter(of("VALUE"), lambda e: e["value"] != ""), lambda e: made("VALUE", about, target, e["field"], e["value"]))
    works = F.transform(of("REFERENCE", "WORK"), lambda e: made("WORK_CANDIDATE", F.lit("WORK"), e["bound"], F.lit(KINDS["WORK"][1]), e["value"]))
    agents = F.transform(of("REFERENCE", "AUTHOR"), lambda e: made("AGENT_CANDIDATE", F.lit("AGENT"), e["bound"], F.lit(KINDS["AUTHOR"][1]), e["value"]))
    kept = ~F.col("malformed") & (kind != "SEARCH")
    refs = F.when(kept & search, F.concat(F.array(F.concat(space, F.lit(":"), F.col("own_key"))), F.transform(F.filter("entries", lambda e: e["field"].isin("isbn10", "isbn13")), lambda e: F.concat(e["field"], F.lit(":"), e["value"]))))
    told = one.withColumn("projections", F.when(kept, F.concat(own, itself, ids, values, works, agents)).otherwise(none)).withColumn("refs", F.filter(F.coalesce(refs, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    whole = told.groupBy("record_id", "endpoint").agg(
        F.bool_or("wrong").alias("wrong"), F.bool_or(F.col("cut")).alias("truncated"), F.count_if(kept).alias("n"),
        F.bool_or(F.col("malformed") & ~search).alias("lacking"), F.bool_or(F.col("malformed") & search & (kind == "EDITION")).alias("odd"), F.bool_or("docs_cut").alias("docs_cut"),
        F.bool_or(F.when(kept, F.col("loose") | target.isNull()).otherwise(False)).alias("loose"), F.bool_or(F.col("unsound") | F.when(kept, ~safe_reference(target)).otherwise(False)).alias("unsound"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("projections")))).alias("bound_projections"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("refs"),
        F.array_distinct(F.flatten(F.collect_list(F.when(kind == "SEARCH", F.transform(of("NAME"), lambda e: e["value"]))))).alias("names"),
    )
    ordered = F.concat(*(F.array_sort(F.filter("refs", _begins(p))) for p in (KINDS["WORK"][1] + ":", KINDS["EDITION"][1] + ":", "isbn10:", "isbn13:")))
    whole = whole.withColumn("refs", ordered)
    named = F.transform("names", lambda x: F.struct(F.lit("AGENT_CANDIDATE").alias("projection"), F.lit("AGENT").alias("target_kind"), F.col("refs").alias("source_refs"), F.lit(None).cast("string").alias("target_ref"), F.lit("author_name").alias("name"), x.alias("value")))
    status = F.when(F.col("wrong") | F.col("lacking") | (F.col("n") == 0), "INVALID_RESPONSE").when(F.col("loose"), "NOT_BOUND").when(F.coalesce("unsound", F.lit(False)), "NOT_CANONICAL").otherwise("MAPPED")
    findings = F.array_compact(F.array(F.when(F.col("odd"), "MALFORMED_SEARCH_EDITION"), F.when(F.col("docs_cut"), "SEARCH_EDITIONS_TRUNCATED")))
    out = whole.withColumn("status", status)
    return out.select("record_id", "status", "truncated", findings.alias("findings"), F.when(F.col("status") == "MAPPED", F.array_sort(F.concat("bound_projections", named))).otherwise(none).alias("projections"))


def projections(mappings: DataFrame) -> DataFrame:
    """``record_id, ordinal, projection, target_kind, source_refs, target_ref, name, value`` of mapped records."""
    return mappings.select("record_id", F.posexplode("projections").alias("ordinal", "p")).select("record_id", "ordinal", "p.*")
