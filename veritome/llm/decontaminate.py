"""Operator 4: benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item window must stand in a document whole, so the necessary prefix of its words in
order of rarity is one word: its rarest. The rarest words of all windows are joined with
the documents' words; the position of the word gives the one place where the window could
lie, which must be inside the document (positional and length bounds); there the words are
compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window; a shorter item is one window.
WINDOW = 13
#: Rows and bytes of words of the item side that are broadcast, at most; beyond either, both joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes runs of ASCII letters, digits and characters beyond ASCII; null has none."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    low = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _fits(df: DataFrame, text: Column) -> bool:
    """Whether the rows of ``df`` and the bytes of ``text`` in them, counted here, are within the bounds of a broadcast."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, window`` (array of words), each once."""
    parts = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0 and item is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return parts.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("window")).distinct()


def _measured(base: DataFrame, items: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """``base`` (key, text, h and any more) with the contract's columns in place of ``text`` and ``h``."""
    more = [c for c in base.columns if c not in ("key", "text", "h")]
    windows = item_windows(items, item_key, item_text, window)
    apart = windows.select("window").distinct().select(F.xxhash64("window").alias("wid"), "window")
    parts = apart.select("wid", F.posexplode("window").alias("at", "word"))
    # explode of one element: the optimiser would otherwise put the expression, and its work, wherever the words are used
    every = base.select("key", "h", F.explode(F.array(words(F.col("text")))).alias("w"))
    # rarity: how often the words of items stand in all documents
    vocabulary = parts.select("word").distinct()
    vocabulary = F.broadcast(vocabulary) if _fits(vocabulary, F.col("word")) else vocabulary
    counted = every.select(F.explode("w").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), "word", "at")
    rare = parts.join(counted, "word", "left").groupBy("wid").agg(F.min(order).alias("r")).select("wid", F.col("r.word").alias("word"), F.col("r.at").alias("at"))
    prefix = windows.withColumn("wid", F.xxhash64("window")).join(rare, "wid").select("word", "at", "item", "window", F.size("window").alias("n_window"))
    # a row for each window, which holds its word: counted on the windows, as the words' counts would be made once more
    prefix = F.broadcast(prefix) if _fits(windows, F.concat("item", F.array_join("window", " "))) else prefix
    found = every.select("key", "h", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(prefix, "word")
    start = F.col("pos") - F.col("at")
    placed = found.where((start >= 0) & (start + F.col("n_window") <= F.col("n"))).groupBy("key", "h").agg(F.collect_set(F.struct(start.alias("s"), F.col("n_window").alias("n"), "item", "window")).alias("c"))
    c = placed.select(F.col("key").alias("c_key"), F.col("h").alias("c_h"), "c")
    joined = base.join(c, F.col("key").eqNullSafe(F.col("c_key")) & (F.col("h") == F.col("c_h")), "left").select("key", *more, F.explode(F.array(words(F.col("text")))).alias("w"), "c")
    true = F.filter("c", lambda x: F.slice("w", x["s"] + 1, x["n"]) == x["window"])
    kept = joined.select("key", *more, F.size("w").cast("long").alias("n_words"), F.coalesce(true, F.array().cast("array<struct<s:int,n:int,item:string,window:array<string>>>")).alias("c"))
    spans = F.array_sort(F.array_distinct(F.transform("c", lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["n"]).alias("e")))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(spans, zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["total"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("total")), lambda a: a["total"])
    item_ids = F.array_sort(F.array_distinct(F.transform("c", lambda x: x["item"])))
    told = kept.select("key", *more, "n_words", covered.alias("n_hit"), item_ids.alias("i"))
    return told.select("key", *more, "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``.

    Null and empty texts have no words and are clean; items with a null key or no words
    have no windows; without items all documents are clean. Rows with equal keys and
    texts give equal rows, those with equal keys and other texts are told apart, null keys
    are kept. Other columns are left out.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    base = base.select("key", "text", "h")
    told = _measured(base, items, item_key, item_text, window)
    return told.withColumnRenamed("key", key)


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` finds clean, all columns as they are."""
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.struct("*").alias("row")).withColumn("h", F.xxhash64("text"))
    return _measured(base, items, item_key, item_text, window).where("not contaminated").select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, list_slice(w, s + 1, s + 13) AS g FROM bs
), lens AS (
  SELECT DISTINCT len(g) AS n FROM bw
), ds AS (
  SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, lens
), hits AS (
  SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, list_slice(w, s + 1, s + n) AS g FROM ds) JOIN bw USING (g)
), places AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
