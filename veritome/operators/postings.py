"""A stored inverted index of snapshots: one row for each value or word of a document, sorted so that a lookup reads little.

Documents lie in buckets by range of their place, postings within a bucket by field, term and file. A query reads the
row groups whose statistics can hold its terms, bucket by bucket in order of files, and stops when its page is full. A
snapshot's folder can be written anew without touching another's, and so can one of its buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritome.functions.unicode import query_value, query_value_rule
from veritome.operators.relational import dealt, dense_ordinals
from veritome.operators.search import METADATA, METADATA_CAP, FINDING_CAP, Group, Predicate, Query, value_words, words
from veritome.operators.state import COMPONENTS
from veritome.sources.shared import new_path, written

# Characters of an indexed value at most; metadata keys by field, as patterns; a finding's code.
LONGEST = 4096
KEYS = (("TITLE", "^title$"), ("LANGUAGE", "^language$"), ("PUBLISHER", "^publisher$"), ("CONTRIBUTOR", r"^contributor\.[0-9]+\.name$"), ("IDENTIFIER", r"^identifier\.[0-9]+\.value$"))
CODE = "^[A-Z][A-Z0-9_]{0,127}$"
#: Documents in a bucket, and buckets that a search looks into first; then four times as many, and so on.
BUCKET, FIRST = 1_000_000, 1
#: Columns of the stored postings; an empty snapshot has no file to read them from.
STORED = "field string, term string, word boolean, value string, file_id string, bucket int"


def _capped(rows: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows of each file; Spark cuts each task's share down to them before the shuffle."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
    return rows.withColumn("n__", n).where(F.col("n__") <= cap).drop("n__")


def project(items: DataFrame, metadata: DataFrame, findings: DataFrame, metadata_cap: int = METADATA_CAP, finding_cap: int = FINDING_CAP) -> tuple[DataFrame, DataFrame]:
    """Values ``file_id, field, kind, value, normalized``, and documents ``file_id, observation_id, format_name, value_count, metadata_count, finding_count, truncated_count``.

    items: file_id, observation_id, format_name and a column ``<component>_state`` for each component. metadata: file_id, key,
    value; findings: file_id, code. Of a file the first values by key and value are kept, different ones of a field up to
    the cap; ``truncated_count`` counts what lies beyond, and values that are empty or too long, or no code. Rows about
    files that aren't items go; keys of no field don't count.
    """
    known = items.select("file_id")
    field = reduce(lambda c, k: c.when(F.col("key").rlike(k[1]), k[0]), KEYS[1:], F.when(F.col("key").rlike(KEYS[0][1]), KEYS[0][0]))
    told = metadata.join(known, "file_id", "left_semi").select("file_id", field.alias("field"), "key", F.coalesce(F.col("value"), F.lit("")).alias("value")).where("field is not null").withColumn("normalized", query_value(F.col("value")))
    good = (F.length("value").between(1, LONGEST)) & (F.length("normalized").between(1, LONGEST))
    # one row for each different value, at the first key it stands under, and how many rows were bad
    each = told.withColumn("good", good).groupBy("file_id", "field", F.when(F.col("good"), F.col("value")).alias("value")).agg(F.min("key").alias("key"), F.any_value("normalized").alias("normalized"), F.count_if(~F.col("good")).alias("bad"))
    spark = items.sparkSession
    with dealt(spark, metadata.count()):
        each = written(each, "metadata")  # read for values and for counts
    meta = _capped(each.where("value is not null"), metadata_cap, "key", "value", "field")
    codes = findings.join(known, "file_id", "left_semi").select("file_id", F.upper(F.coalesce("code", F.lit(""))).alias("code"), F.length(F.coalesce("code", F.lit(""))).alias("size"))
    fits = F.col("code").rlike(CODE) & F.col("size").between(1, 128)
    coded = codes.groupBy("file_id", F.when(fits, F.col("code")).alias("code")).agg(F.count_if(~fits).alias("bad"))
    with dealt(spark, findings.count()):
        coded = written(coded, "findings")
    found = _capped(coded.where("code is not null"), finding_cap, "code")

    def beyond(rows: DataFrame, value: str, cap: int, n: str) -> DataFrame:
        kept = F.count(value)
        return rows.groupBy("file_id").agg(F.least(kept, F.lit(cap)).alias(n), (F.sum("bad") + F.greatest(kept - cap, F.lit(0))).alias(f"{n}_beyond"))

    own = [("FILE_ID", "file_id", "OPAQUE_ID"), ("OBSERVATION_ID", "observation_id", "OPAQUE_ID"), ("FORMAT", "format_name", "STATUS"), *((f"{c}_STATUS", f"{c.lower()}_state", "STATUS") for c in COMPONENTS)]
    direct = items.select("file_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for f, c, k in own))).alias("x")).select("file_id", "x.*").where("value is not null")
    values = direct.withColumn("normalized", query_value(F.col("value")))
    values = values.unionByName(found.select("file_id", F.lit("FINDING_CODE").alias("field"), F.lit("FINDING_CODE").alias("kind"), F.col("code").alias("value"), F.lower("code").alias("normalized")))
    values = values.unionByName(meta.select("file_id", "field", F.lit("METADATA_CANDIDATE").alias("kind"), "value", "normalized"))
    plain = F.lit(0)
    for _, c, _ in own:
        plain = plain + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    counted = items.join(beyond(each, "value", metadata_cap, "metadata_count"), "file_id", "left").join(beyond(coded, "code", finding_cap, "finding_count"), "file_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    documents = counted.select("file_id", "observation_id", "format_name", (plain + n("metadata_count") + n("finding_count")).alias("value_count"), n("metadata_count").alias("metadata_count"), n("finding_count").alias("finding_count"), (n("metadata_count_beyond") + n("finding_count_beyond")).alias("truncated_count"))
    return values, documents


def summary(documents: DataFrame) -> DataFrame:
    """One row: documents, values by kind, what was left out, and whether that makes the index partial."""
    total = documents.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("value_count", "metadata_count", "finding_count", "truncated_count")))
    cut = F.col("truncated_count") > 0
    return total.withColumn("coverage", F.when(cut, "PARTIAL").otherwise("COMPLETE")).withColumn("truncation", F.when(cut, "VALUE_LIMIT").otherwise("NONE"))


def postings(values: DataFrame) -> DataFrame:
    """``field, term, word, value, file_id``: each value by its normal form and, of metadata, by each of its words."""
    whole = values.select("field", F.col("normalized").alias("term"), F.lit(False).alias("word"), "value", "file_id")
    each = values.where(F.col("field").isin(*METADATA)).select("field", F.explode(F.array_distinct(value_words(F.col("value")))).alias("term"), F.lit(True).alias("word"), "value", "file_id")
    return whole.unionByName(each).distinct()


def store(values: DataFrame, documents: DataFrame, path: str, snapshot: str, bucket: int = BUCKET) -> None:
    """Writes a snapshot's index below ``path``, in place of what it had there; other snapshots stay as they are."""
    spark, held = values.sparkSession, []
    placed = dense_ordinals(documents, ["file_id"], held).withColumn("bucket", F.floor(F.col("ordinal") / bucket).cast("int"))
    at = f"{path}/snapshot={snapshot}"
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/documents")
    for frame in held:
        frame.unpersist()
    placed = spark.read.schema(placed.schema).parquet(f"{at}/documents")
    # rows of what values are taken from: those kept, and those beyond the caps
    told = placed.agg(F.coalesce(F.sum(F.col("value_count") + F.col("truncated_count")), F.lit(0))).first()[0]
    with dealt(spark, told):
        rows = written(postings(values), "postings")  # the range sort reads its rows twice
    with dealt(spark, rows.count()):
        rows = rows.join(placed.select("file_id", "bucket"), "file_id")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # by range of all of the order: a term that a third of all files have lies in several files of a bucket
        ordered = rows.repartitionByRange(parts, "bucket", "field", "term", "file_id").sortWithinPartitions("bucket", "field", "term", "file_id")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    spans = placed.groupBy("bucket").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high"), F.count("*").alias("n"))
    spans.coalesce(1).write.mode("overwrite").parquet(f"{at}/buckets")  # a row for each bucket


def refresh(values: DataFrame, documents: DataFrame, path: str, snapshot: str, number: int) -> None:
    """Writes one bucket of a stored snapshot anew from the values and documents of its files; all others' files stay."""
    at = f"{path}/snapshot={snapshot}"
    span = values.sparkSession.read.parquet(f"{at}/buckets").where(F.col("bucket") == number).first()
    if span is None:
        raise ValueError(f"no bucket {number}")
    here = F.col("file_id").between(span["low"], span["high"])
    spark = values.sparkSession
    kept = spark.read.parquet(f"{at}/documents").where(F.col("bucket") == number).select("file_id", "ordinal")
    aside = new_path(spark, "bucket")  # what is read is not written over
    documents.where(here).join(kept, "file_id").write.parquet(aside)
    fresh = spark.read.parquet(aside)
    if fresh.count() != span["n"]:
        raise ValueError("a bucket keeps its documents")
    fresh.write.mode("overwrite").parquet(f"{at}/documents/bucket={number}")
    kept = fresh
    rows = postings(values.where(here)).join(kept.select("file_id"), "file_id", "left_semi")
    rows.repartitionByRange("field", "term", "file_id").sortWithinPartitions("field", "term", "file_id").write.mode("overwrite").parquet(f"{at}/postings/bucket={number}")


def _test(p: Predicate, word: str | None = None) -> Column:
    here = (F.col("field") == p.field) & (F.col("word") == F.lit(word is not None))
    if word is not None:
        return here & (F.col("term") == word)
    term = query_value_rule(p.value)
    return here & (F.col("term").startswith(term) if p.operator == "PREFIX" else F.col("term") == term)


def _predicates(x: Predicate | Group) -> list[Predicate]:
    if isinstance(x, Predicate):
        return [x]
    return list(dict.fromkeys(p for c in x.children for p in _predicates(c)))


def matching(rows: DataFrame, where: Predicate | Group) -> DataFrame:
    """``file_id`` of postings for which the condition holds. Only postings of the query's terms are read, and met once by file.

    MATCH asks for all its words in one value.
    """
    tests = _predicates(where)
    alone = [p for p in tests if p.operator != "MATCH" or len(set(words(p.value))) == 1]
    several = [p for p in tests if p not in alone]
    of = lambda p: _test(p, words(p.value)[0] if p.operator == "MATCH" else None)
    flags = [F.coalesce(F.bool_or(of(p)), F.lit(False)).alias(f"p{tests.index(p)}") for p in alone]
    every = [of(p) for p in alone] + [_test(p, w) for p in several for w in dict.fromkeys(words(p.value))]
    read = rows.where(reduce(Column.__or__, every))
    if several:
        # a value has all words if as many different ones of them lead to it
        by_value = read.groupBy("file_id", "field", "value").agg(*flags, *(sum((F.coalesce(F.max(F.when(_test(p, w), 1)), F.lit(0)) for w in dict.fromkeys(words(p.value))), F.lit(0)).alias(f"w{tests.index(p)}") for p in several))
        flags = [F.bool_or(f"p{tests.index(p)}").alias(f"p{tests.index(p)}") for p in alone] + [F.bool_or(F.col(f"w{tests.index(p)}") == len(set(words(p.value)))).alias(f"p{tests.index(p)}") for p in several]
        read = by_value
    met = read.groupBy("file_id").agg(*flags)

    def told(x: Predicate | Group) -> Column:
        if isinstance(x, Predicate):
            return F.col(f"p{tests.index(x)}")
        return reduce(Column.__and__ if x.operator == "AND" else Column.__or__, [told(c) for c in x.children])

    return met.where(told(where)).select("file_id")


@dataclass(frozen=True)
class Page:
    """Files of a page in order, the file to go on after if more follow, and how many buckets were read."""

    files: list
    after: str | None
    buckets: int


def page(spark: SparkSession, path: str, snapshot: str, query: Query) -> Page:
    """The page of a stored snapshot: buckets in order of files, from the one that the cursor lies in, until limit + 1 files are found."""
    at = f"{path}/snapshot={snapshot}"
    spans = sorted(spark.read.parquet(f"{at}/buckets").collect(), key=lambda r: r["low"])  # a row for each million documents
    left = [r["bucket"] for r in spans if query.after is None or r["high"] > query.after]
    found, step, read = [], FIRST, 0
    rows = stored(spark, path, snapshot)
    while left and len(found) <= query.limit:
        now, left, step = left[:step], left[step:], 4 * step
        read += len(now)
        some = matching(rows.where(F.col("bucket").isin(now)), query.where)
        if query.after is not None:
            some = some.where(F.col("file_id") > query.after)
        found += [r["file_id"] for r in some.orderBy("file_id").limit(query.limit + 1 - len(found)).collect()]
    more = len(found) > query.limit
    return Page(found[: query.limit], found[query.limit - 1] if more else None, read)


def stored(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """The postings of a stored snapshot, for ``matching`` over all of it."""
    return spark.read.schema(STORED).parquet(f"{path}/snapshot={snapshot}/postings")
