"""Scalar rules, sources and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.functions import scalars, unicode
from veritome.plans.registry import OBS, observations, query, table
from veritome.sources import files
from veritome.streaming.incremental import windowed_counts


@query("""WITH t AS (SELECT p_partkey, lpad(cast(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d9, '978' || lpad(cast(p_partkey * 104729 % 1000000000 AS VARCHAR), 9, '0') AS d12 FROM part),
c AS (SELECT p_partkey, d9, d12, (11 - list_sum([cast(d9[i] AS INTEGER) * (11 - i) FOR i IN range(1, 10)]) % 11) % 11 AS k10, (10 - list_sum([cast(d12[i] AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) FOR i IN range(1, 13)]) % 10) % 10 AS k13 FROM t)
SELECT p_partkey, d9 || CASE WHEN k10 = 10 THEN 'X' ELSE cast(cast(k10 AS INTEGER) AS VARCHAR) END AS isbn10, p_partkey % 2 = 0 AS valid10, p_partkey % 3 = 0 AS valid13 FROM c""")
def isbn_checks(spark, d):
    """Check digits are computed apart from the rule under test; every second and third one is then spoilt."""
    p = table(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0").alias("d9"), F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 104729 % 1000000000).cast("string"), 9, "0")).alias("d12"))
    ten = (11 - sum((F.substring("d9", i, 1).cast("int") * (11 - i) for i in range(1, 10)), F.lit(0)) % 11) % 11
    thirteen = (10 - sum((F.substring("d12", i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0)) % 10) % 10
    made = p.select("p_partkey", F.concat("d9", F.when(ten == 10, "X").otherwise(ten.cast("string"))).alias("isbn10"), F.concat("d12", thirteen.cast("string")).alias("isbn13"))
    other10 = F.concat(F.substring("isbn10", 1, 9), F.when(F.substring("isbn10", 10, 1) == "1", "2").otherwise("1"))
    other13 = F.concat(F.substring("isbn13", 1, 12), ((F.substring("isbn13", 13, 1).cast("int") + 1) % 10).cast("string"))
    return made.select("p_partkey", "isbn10", scalars.isbn10_valid(F.when(F.col("p_partkey") % 2 == 0, F.col("isbn10")).otherwise(other10)).alias("valid10"), scalars.isbn13_valid(F.when(F.col("p_partkey") % 3 == 0, F.col("isbn13")).otherwise(other13)).alias("valid13"))


@query("""WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS a, substr(sha256(text), 17, 16) AS b FROM documents)
SELECT doc_id, cast(CASE WHEN doc_id % 10 = 0 THEN -1 ELSE bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT)) END AS INTEGER) AS distance FROM h""")
def cover_distances(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("s")).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "zz").otherwise(F.substring("s", 1, 16)).alias("a"), F.substring("s", 17, 16).alias("b"))
    return h.select("doc_id", F.coalesce(scalars.hamming64(F.col("a"), F.col("b")), F.lit(-1)).cast("int").alias("distance"))


@query("""SELECT vec_id, list_reduce([CASE WHEN cells[9 * (i // 8) + i % 8 + 1] > cells[9 * (i // 8) + i % 8 + 2] THEN '1' ELSE '0' END FOR i IN range(0, 64)], lambda x, y: x || y) AS bits FROM (SELECT vec_id, embedding || embedding AS cells FROM embeddings WHERE len(embedding) = 64)""")
def gradient_hashes(spark, d):
    """Vectors, each twice, in the role of grids of eight rows of nine cells."""
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", scalars.gradient_hash(F.concat("embedding", "embedding")).alias("bits"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(n, '^[=+\\-@\\t\\r]') THEN chr(39) || n ELSE n END AS cell FROM (SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END) || p_name AS n FROM part)""")
def guarded_cells(spark, d):
    lead = F.element_at(F.array(*(F.lit(x) for x in ("=", "+", "-", "@", "\t", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalars.guard_cell(F.concat(lead, "p_name")).alias("cell"))


@query(f"""WITH {OBS}, p AS (SELECT file_id, relative_path AS a, CASE file_id % 4 WHEN 0 THEN relative_path WHEN 1 THEN relative_path || '.bak' WHEN 2 THEN 'moved/' || relative_path ELSE 'moved/' || relative_path || '.bak' END AS b FROM obs)
SELECT file_id, coalesce(CASE WHEN a = b THEN NULL WHEN regexp_replace(a, '/?[^/]*$', '') = regexp_replace(b, '/?[^/]*$', '') THEN 'RENAMED' WHEN regexp_extract(a, '([^/]*)$', 1) = regexp_extract(b, '([^/]*)$', 1) THEN 'MOVED' ELSE 'MOVED_AND_RENAMED' END, 'SAME') AS change FROM p""")
def path_changes(spark, d):
    k = F.col("file_id") % 4
    b = F.when(k == 0, F.col("relative_path")).when(k == 1, F.concat("relative_path", F.lit(".bak"))).when(k == 2, F.concat(F.lit("moved/"), "relative_path")).otherwise(F.concat(F.lit("moved/"), "relative_path", F.lit(".bak")))
    return observations(spark, d).select("file_id", F.coalesce(scalars.path_change(F.col("relative_path"), b), F.lit("SAME")).alias("change"))


@query(f"""WITH {OBS} SELECT file_id, regexp_replace(regexp_extract(relative_path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') AS title, regexp_replace(relative_path, '/?[^/]*$', '') AS folder, CASE WHEN regexp_matches(relative_path, '[.][^./]+$') THEN lower(regexp_extract(relative_path, '([.][^./]+)$', 1)) ELSE '' END AS suffix FROM obs""")
def path_facts(spark, d):
    p = F.col("relative_path")
    return observations(spark, d).select("file_id", scalars.file_stem(p).alias("title"), scalars.parent_path(p).alias("folder"), scalars.file_suffix(p).alias("suffix"))


@query("""SELECT doc_id, sha256(concat_ws(chr(0), 'file/v1', cast(doc_id AS VARCHAR), lang, '')) AS parts, sha256('{"chars":' || cast(n_chars AS VARCHAR) || ',"lang":' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}') AS json FROM documents""")
def canonical_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.parts_digest("file/v1", F.col("doc_id"), F.col("lang"), F.lit(None)).alias("parts"), scalars.canonical_digest(lang=F.when(F.col("doc_id") % 5 != 0, F.col("lang")), chars=F.col("n_chars")).alias("json"))


@query("""WITH b AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, sha256(encode('quick/v1') || unhex(lpad(to_hex(n), 32, '0')) || c) AS quick FROM b""")
def quick_fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("c")).select("doc_id", scalars.quick_fingerprint(F.col("c"), F.octet_length("c")).alias("quick"))


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'isbn' WHEN 1 THEN 'uuid' WHEN 2 THEN 'oclc' WHEN 3 THEN 'lccn' WHEN 4 THEN 'doi' WHEN 5 THEN 'uri' WHEN 6 THEN 'doi' ELSE 'unknown' END AS namespace FROM supplier""")
def identifier_namespaces(spark, d):
    texts = ("URN:ISBN:123", "urn:uuid:x", "oclc: 9", "lccn=7", "https://doi.org/10.1/x", "http://example.org/", "10.1234/abc", "none of these")
    v = F.element_at(F.array(*(F.lit(x) for x in texts)), (F.col("s_suppkey") % 8 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", scalars.identifier_namespace(v).alias("namespace"))


@query("""SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-01-01' < o_orderdate + INTERVAL 365 DAY THEN 'FRESH' WHEN TIMESTAMP '1998-01-01' < o_orderdate + INTERVAL 1000 DAY THEN 'STALE' ELSE 'EXPIRED' END AS freshness FROM orders""")
def cache_freshness(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", scalars.freshness(F.lit("1998-01-01").cast("timestamp_ntz"), at + F.expr("INTERVAL 365 DAYS"), at + F.expr("INTERVAL 1000 DAYS")).alias("freshness"))


_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{_NAMESPACE.replace("-", "")}') || encode(sha256(text))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', cast(('0x' || substr(h, 17, 1))::INTEGER + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def named_uuids(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.name_based_uuid(F.sha2("text", 256), _NAMESPACE).alias("id"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'), ' ')) AS folded FROM documents""")
def query_values(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(unicode.query_value(F.col("text")), 256).alias("folded"))


@query("""SELECT p_partkey, t, regexp_replace(t, '(?i)^(the|a|an)\\s+', '') AS alias, trim(regexp_extract(t, '\\(([^()]+)\\)', 1)) AS inner_part FROM (SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'an ' ELSE '' END) || p_name || ' (' || p_brand || ')' AS t FROM part)""")
def title_aliases(spark, d):
    t = F.concat(F.when(F.col("p_partkey") % 3 == 0, "The ").when(F.col("p_partkey") % 3 == 1, "an ").otherwise(""), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t", unicode.title_alias(F.col("t")).alias("alias"), F.coalesce(unicode.parenthesised(F.col("t")), F.lit("")).alias("inner_part"))


@query(r"""WITH l AS (SELECT p_partkey, p_brand || ',  ' || p_name || ' [x_1]' AS l FROM part), t AS (SELECT p_partkey, l, trim(regexp_replace(regexp_replace(lower(l), '[^0-9a-z\s\-''.&]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM l)
SELECT p_partkey, title, title AS agent, regexp_replace(title, '[^0-9a-z]+', '', 'g') AS identifier, regexp_replace(lower(l), '[\s\-_()\[\]{}"''`]', '', 'g') AS identifier_key, trim(lower(regexp_replace(l, '\s+', ' ', 'g'))) AS classification FROM t""")
def name_rules(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(",  "), "p_name", F.lit(" [x_1]")).alias("l"))
    rules = {"title": unicode.title, "agent": unicode.agent_name, "identifier": unicode.identifier, "identifier_key": unicode.identifier_key, "classification": unicode.classification_value}
    return p.select("p_partkey", *(rule(F.col("l")).alias(name) for name, rule in rules.items()))


@query("""SELECT c_custkey, lower(replace(replace(c_name, '#', ' '), '  ', ' ')) AS agent FROM customer""")
def agent_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", unicode.agent_key(F.col("c_name")).alias("agent"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, cast(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def hourly_events(spark, d):
    """A Spark extension: the reference has no time windows."""
    return windowed_counts(table(spark, d, "events")).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round(F.col("total") * 100).cast("bigint").alias("cents"))


@query("SELECT event_type, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL HAVING k IS NOT NULL")
def property_counts(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END * 1000000 + l_partkey) % 1000000 AS chosen FROM lineitem GROUP BY 1""")
def routed_identifier(spark, d):
    """The smallest value of the best kind that an item has."""
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(rank.alias("kind"), F.col("l_partkey").alias("value"))).alias("m")).select("l_orderkey", F.col("m.value").alias("chosen"))


@query("""SELECT DISTINCT p_partkey, s_suppkey FROM part, supplier WHERE p_partkey % 100 = s_suppkey OR (p_size = s_suppkey % 50 AND p_brand = 'Brand#' || cast(s_nationkey % 5 + 1 AS VARCHAR) || cast(s_nationkey % 3 + 1 AS VARCHAR))""")
def provider_matches(spark, d):
    """Identifier equal, or title and author equal: two equi-joins, not one join with OR. Each tells a pair once and the second none of the first's, so pairs stream out and are never held to be made distinct."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    by_id = p.select("p_partkey").distinct().withColumn("s_suppkey", F.col("p_partkey") % 100).join(s.select("s_suppkey").distinct(), "s_suppkey").select("p_partkey", "s_suppkey")
    brand = F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_nationkey") % 3 + 1).cast("string"))
    ours = p.groupBy("p_partkey", "p_size").agg(F.collect_set("p_brand").alias("ours")).select("*", F.explode("ours").alias("brand"))
    theirs = s.groupBy("s_suppkey").agg(F.collect_set(brand).alias("theirs")).select("s_suppkey", (F.col("s_suppkey") % 50).alias("p_size"), "theirs", F.explode("theirs").alias("brand"))
    # of several brands that a part and a supplier share, the least tells the pair
    first = F.when((F.size("ours") > 1) & (F.size("theirs") > 1), F.col("brand") == F.array_min(F.array_intersect("ours", "theirs"))).otherwise(F.lit(True))
    by_name = ours.join(theirs, ["p_size", "brand"]).where(first & F.coalesce(F.col("p_partkey") % 100 != F.col("s_suppkey"), F.lit(True))).select("p_partkey", "s_suppkey")
    return by_id.unionByName(by_name)


@query("""SELECT page_id, 'title' AS kind, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS value FROM pages WHERE trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) <> '' AND NOT regexp_matches(html, '<!(ENTITY)')""")
def page_titles(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<!DOCTYPE[^>]*>", "").alias("x"))
    return files.book_metadata(pages, "page_id", "x").where("kind = 'title'").select("page_id", "kind", "value")


@query("""SELECT o_orderkey, 'Pages' AS name, cast(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'Title', o_orderpriority FROM orders""")
def tool_output_facts(spark, d):
    text = F.concat(F.lit("Title:   "), "o_orderpriority", F.lit("\nno colon here\nPages: "), F.col("o_custkey").cast("string"), F.lit("\nPages: 0\n"))
    return files.colon_lines(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("""SELECT p_partkey, cast(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS fatal, cast(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS errors FROM part""")
def validator_reports(spark, d):
    first = F.when(F.col("p_partkey") % 3 == 0, '{"ID":"A","severity":"FATAL","message":"m"},').otherwise("")
    rest = F.when(F.col("p_partkey") % 7 == 0, '{"ID":"B","severity":"WARNING"}').otherwise('{"ID":"B","severity":"ERROR"}')
    text = F.concat(F.lit('{"messages":['), first, rest, F.lit("]}"))
    return files.validator_counts(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t").select("p_partkey", "fatal", "errors")


@query("""SELECT l_orderkey, 'f' || cast(l_linenumber AS VARCHAR) || '-' || cast(l_partkey AS VARCHAR) AS path, cast(l_suppkey AS VARCHAR) AS size FROM lineitem""")
def archive_members(spark, d):
    items = table(spark, d, "lineitem").withColumn("rn", F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    lines = items.select("l_orderkey", "l_linenumber", "rn", F.posexplode(F.array(F.concat(F.lit("Path = f"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")), F.concat(F.lit("Size = "), F.col("l_suppkey").cast("string")), F.lit("----------"))).alias("at", "line"))
    return files.archive_listing(lines.withColumn("place", F.struct("l_linenumber", "rn", "at")), "l_orderkey", "place", "line").select("l_orderkey", "path", "size")
