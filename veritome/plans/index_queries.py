"""The stored inverted index over the driver's tables: suppliers in the role of documents, lines of orders in that of metadata and findings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veritome.operators import postings, search
from veritome.operators.state import COMPONENTS
from veritome.plans.registry import query, table
from veritome.sources.shared import new_path

_ITEMS = "SELECT lpad(concat('', s_suppkey), 6, '0') AS file_id, concat('o', s_suppkey) AS observation_id, CASE s_suppkey % 3 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'PDF' ELSE 'OTHER' END AS format_name, " + ", ".join(f"CASE (s_suppkey + {i}) % 4 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'STALE_CONFLICT' WHEN 2 THEN 'UNSCOPED' ELSE 'MISSING' END AS {c.lower()}_state" for i, c in enumerate(COMPONENTS)) + " FROM {supplier}"
_METADATA = "SELECT lpad(concat('', l_suppkey), 6, '0') AS file_id, CASE l_linenumber WHEN 1 THEN 'title' WHEN 2 THEN 'contributor.2.name' WHEN 3 THEN 'identifier.10.value' WHEN 4 THEN 'subject' WHEN 5 THEN 'publisher' WHEN 6 THEN 'contributor.x.name' ELSE 'language' END AS key, CASE WHEN l_orderkey % 50 = 3 THEN '' WHEN l_linenumber = 1 THEN concat('Band ', l_partkey % 300, ' der ', CASE WHEN l_partkey % 2 = 0 THEN 'Bücher' ELSE 'Books' END) WHEN l_linenumber = 7 THEN concat('L', l_partkey % 5) ELSE concat('  Value  ', l_partkey) END AS value FROM {lineitem}"
_FINDINGS = "SELECT lpad(concat('', l_suppkey), 6, '0') AS file_id, CASE WHEN l_linenumber = 1 THEN 'no code' WHEN l_linenumber = 2 THEN '1ST' ELSE concat('code_', l_partkey) END AS code FROM {lineitem}"
#: Only values within the caps are searched: a document's first 256 by key and value, and its first 128 codes.
_CAPPED = f"""WITH items AS ({_ITEMS.replace("{", "").replace("}", "")}), md AS ({_METADATA.replace("{", "").replace("}", "")}), fi AS ({_FINDINGS.replace("{", "").replace("}", "")}),
told AS (SELECT md.file_id, key, CASE WHEN key = 'title' THEN 'TITLE' WHEN key = 'publisher' THEN 'PUBLISHER' WHEN key = 'language' THEN 'LANGUAGE' WHEN regexp_full_match(key, 'contributor[.][0-9]+[.]name') THEN 'CONTRIBUTOR' WHEN regexp_full_match(key, 'identifier[.][0-9]+[.]value') THEN 'IDENTIFIER' END AS field, value FROM md JOIN items USING (file_id)),
each AS (SELECT file_id, field, value, min(key) AS key FROM told WHERE field IS NOT NULL AND value <> '' GROUP BY ALL), bad AS (SELECT file_id, count(*) AS n FROM told WHERE field IS NOT NULL AND value = '' GROUP BY 1),
meta AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY key, value, field) AS place FROM each), codes AS (SELECT DISTINCT file_id, upper(code) AS code FROM fi JOIN items USING (file_id) WHERE regexp_full_match(upper(code), '[A-Z][A-Z0-9_]*')), wrong AS (SELECT file_id, count(*) AS n FROM fi JOIN items USING (file_id) WHERE NOT regexp_full_match(upper(code), '[A-Z][A-Z0-9_]*') GROUP BY 1),
mc AS (SELECT file_id, count(*) AS n FROM each GROUP BY 1), cc AS (SELECT file_id, count(*) AS n FROM codes GROUP BY 1), kept AS (SELECT file_id, field, lower(trim(regexp_replace(value, ' +', ' ', 'g'))) AS v FROM meta WHERE place <= 256),
docs AS (SELECT file_id, observation_id, format_name, least(coalesce(mc.n, 0), 256) AS metadata_count, least(coalesce(cc.n, 0), 128) AS finding_count, coalesce(bad.n, 0) + coalesce(wrong.n, 0) + greatest(coalesce(mc.n, 0) - 256, 0) + greatest(coalesce(cc.n, 0) - 128, 0) AS truncated_count FROM items LEFT JOIN mc USING (file_id) LEFT JOIN cc USING (file_id) LEFT JOIN bad USING (file_id) LEFT JOIN wrong USING (file_id))
"""
_NAME = "one"


def _projected(spark, d):
    t = {n: table(spark, d, n) for n in ("supplier", "lineitem")}
    return postings.project(spark.sql(_ITEMS, supplier=t["supplier"]), spark.sql(_METADATA, lineitem=t["lineitem"]), spark.sql(_FINDINGS, lineitem=t["lineitem"]))


def _stored(spark, d):
    path = new_path(spark, "index")
    postings.store(*_projected(spark, d), path, _NAME, bucket=40)
    return path


@query(_CAPPED + f"SELECT file_id, observation_id, format_name, cast({3 + len(COMPONENTS)} + metadata_count + finding_count AS BIGINT) AS value_count, metadata_count, finding_count, truncated_count FROM docs")
def index_documents(spark, d):
    return _projected(spark, d)[1]


@query(_CAPPED + f"SELECT count(*) AS documents, cast(sum({3 + len(COMPONENTS)} + metadata_count + finding_count) AS BIGINT) AS value_count, cast(sum(metadata_count) AS BIGINT) AS metadata_count, cast(sum(finding_count) AS BIGINT) AS finding_count, cast(sum(truncated_count) AS BIGINT) AS truncated_count, CASE WHEN sum(truncated_count) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS coverage, CASE WHEN sum(truncated_count) > 0 THEN 'VALUE_LIMIT' ELSE 'NONE' END AS truncation FROM docs")
def index_summary(spark, d):
    return postings.summary(_projected(spark, d)[1])


_WHERE = {"operator": "OR", "children": [
    {"operator": "AND", "children": [{"field": "TITLE", "operator": "MATCH", "value": "BUCHER band 12"}, {"field": "FORMAT", "operator": "EQ", "value": "pdf"}]},
    {"operator": "AND", "children": [{"field": "CONTRIBUTOR", "operator": "PREFIX", "value": "Value  11"}, {"field": "REVIEW_STATUS", "operator": "EQ", "value": "current"}, {"field": "LANGUAGE", "operator": "EQ", "value": "l3"}]},
]}
_FOUND = """, hit AS (SELECT file_id FROM items WHERE (format_name = 'PDF' AND EXISTS (SELECT 1 FROM kept k WHERE k.file_id = items.file_id AND field = 'TITLE' AND v LIKE 'band 12 der bücher'))
 OR (review_state = 'CURRENT' AND EXISTS (SELECT 1 FROM kept k WHERE k.file_id = items.file_id AND field = 'CONTRIBUTOR' AND v LIKE 'value 11%') AND EXISTS (SELECT 1 FROM kept k WHERE k.file_id = items.file_id AND field = 'LANGUAGE' AND v = 'l3')))
"""


@query(_CAPPED + _FOUND + "SELECT file_id FROM hit")
def indexed_search(spark, d):
    parsed = search.parse(json.dumps({"version": search.VERSION, "where": _WHERE}))
    return postings.matching(postings.stored(spark, _stored(spark, d), _NAME), parsed.where)


@query(_CAPPED + "SELECT file_id, row_number() OVER (ORDER BY file_id) AS place, count(*) OVER () > 7 AS more FROM items WHERE file_id > '000005' AND review_state = 'CURRENT' QUALIFY place <= 7")
def indexed_page(spark, d):
    parsed = search.parse(json.dumps({"version": search.VERSION, "where": {"field": "REVIEW_STATUS", "operator": "EQ", "value": "CURRENT"}, "limit": 7, "after_file_id": "000005"}))
    found = postings.page(spark, _stored(spark, d), _NAME, parsed)  # a page of at most a hundred files
    return spark.createDataFrame([(f, i, found.after is not None) for i, f in enumerate(found.files, 1)], "file_id string, place long, more boolean")
