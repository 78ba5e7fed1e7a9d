"""Quality of files from the steps of their analysis over the driver's tables: documents in the role of analysed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritome.operators import quality
from veritome.plans.registry import query, table


def _steps(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    form = F.element_at(F.array(*(F.lit(x) for x in ("EPUB", "MOBI", "AZW", "PDF", "EPUB"))), (i % 5 + 1).cast("int"))
    docs = table(spark, d, "documents").select(i.alias("item_id"), "doc_id", "n_chars", form.alias("format"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    flag = lambda c: F.when(c, "true").otherwise("false")
    ran = lambda k: F.when(i % k == 0, "FAILED").otherwise("SUCCEEDED")
    text = (F.lit("text_status"), F.when((F.col("size") == 0) | (n % 41 == 0), "NO_TEXT").when(n % 37 == 0, "OTHER").otherwise("TEXT_EXTRACTED"), F.lit("normalized_character_count"), F.when(n % 41 == 0, "0").when(n % 43 == 0, "many").otherwise(F.col("size").cast("string")))
    title, author = (F.lit("title_present"), flag(n % 7 != 0)), (F.lit("author_present"), flag(n % 5 != 0))
    metadata = F.create_map(*title, *author, F.lit("contributor_present"), flag(n % 31 != 0), F.lit("language_present"), F.when(n % 29 == 0, "unknown").otherwise(flag(n % 11 != 0)), F.lit("identifier_present"), flag(n % 3 != 0), F.lit("publisher_present"), flag(n % 2 != 0), F.lit("publication_date_present"), flag(n % 3 == 0), F.lit("series_present"), flag(n % 4 != 0), F.lit("series_position_present"), flag(n % 6 == 3))
    cover = F.create_map(F.lit("cover_status"), F.when(n % 3 == 0, "NO_EMBEDDED_COVER").when(n % 23 == 0, "UNREADABLE").otherwise("COVER_EXTRACTED"))
    valid = F.create_map(F.lit("conformance_status"), F.when(n % 3 == 0, "NONCONFORMANT").otherwise("CONFORMANT"), F.lit("fatal_count"), F.when(n % 12 == 0, "2").otherwise("0"), F.lit("error_count"), F.when(n % 9 == 0, "4").when(n % 35 == 0, "1").otherwise("0"), F.lit("warning_count"), F.when(n % 53 == 0, "-1").otherwise((n % 2).cast("string")))
    sheet = F.create_map(*title, *author, *text, F.lit("page_count"), (n % 47).cast("string"), F.lit("encrypted"), F.when(n % 8 == 0, " Yes (print:yes)").when(n % 17 == 0, "maybe").otherwise("no"))

    def step(name, state, second, facts):
        return F.struct(F.lit(name).alias("step"), state.alias("state"), F.array(state, second).alias("executions"), facts.alias("facts"))

    book = (step("metadata", ran(11), F.lit(None).cast("string"), metadata), step("text", ran(13), F.lit(None).cast("string"), F.create_map(*text)), step("cover", ran(17), F.lit(None).cast("string"), cover))
    plan = F.when(F.col("format") == "PDF", F.array(step("pdf-analysis", ran(19), ran(13), sheet))).when((F.col("format") == "EPUB") & (i % 59 != 0), F.array(*book, step("structural-validation", ran(7), F.lit(None).cast("string"), valid))).otherwise(F.array(*book))
    return docs.select("item_id", "format", F.explode(plan).alias("s")).select("item_id", "format", "s.*")


_SQL = """WITH d AS (SELECT doc_id AS i, n_chars AS n, length(coalesce(text, '')) AS size, CASE doc_id % 5 WHEN 1 THEN 'MOBI' WHEN 2 THEN 'AZW' WHEN 3 THEN 'PDF' ELSE 'EPUB' END AS format FROM documents),
g AS (SELECT *, format = 'EPUB' AND i % 59 = 0 AS refused, CASE WHEN size = 0 OR n % 41 = 0 THEN 'NO_TEXT' WHEN n % 37 = 0 THEN 'OTHER' ELSE 'TEXT_EXTRACTED' END AS said, CASE WHEN n % 41 = 0 THEN 0 WHEN n % 43 = 0 THEN NULL ELSE size END AS chars,
 CASE WHEN n % 12 = 0 THEN 2 ELSE 0 END AS fatal, CASE WHEN n % 9 = 0 THEN 4 WHEN n % 35 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN n % 53 = 0 THEN NULL ELSE n % 2 END AS warnings, n % 3 = 0 AS odd FROM d),
k AS (SELECT *,
 CASE WHEN format = 'PDF' THEN CASE WHEN i % 19 = 0 THEN 'PDF_METADATA_ANALYSIS_INCOMPLETE' END WHEN i % 11 = 0 THEN 'METADATA_ANALYSIS_INCOMPLETE' WHEN n % 29 = 0 THEN 'METADATA_EVIDENCE_INCOMPLETE' WHEN (n % 5 <> 0 AND n % 31 = 0) OR (n % 6 = 3 AND n % 4 = 0) THEN 'METADATA_EVIDENCE_INCONSISTENT' END AS m_bad,
 CASE WHEN i % 13 = 0 THEN 'TEXT_ANALYSIS_INCOMPLETE' WHEN said = 'OTHER' OR chars IS NULL THEN 'TEXT_EVIDENCE_INCOMPLETE' WHEN (said = 'NO_TEXT') <> (chars = 0) THEN 'TEXT_EVIDENCE_INCONSISTENT' END AS t_bad,
 CASE WHEN i % 17 = 0 THEN 'COVER_ANALYSIS_INCOMPLETE' WHEN n % 23 = 0 AND NOT odd THEN 'COVER_EVIDENCE_INCOMPLETE' END AS c_bad,
 CASE WHEN i % 7 = 0 THEN 'STRUCTURE_ANALYSIS_INCOMPLETE' WHEN warnings IS NULL THEN 'STRUCTURE_EVIDENCE_INCOMPLETE' WHEN NOT odd AND (fatal > 0 OR errors > 0) THEN 'STRUCTURE_EVIDENCE_INCONSISTENT' END AS s_bad,
 CASE WHEN i % 19 = 0 THEN 'PDF_FORMAT_ANALYSIS_INCOMPLETE' WHEN n % 47 = 0 OR (n % 8 <> 0 AND n % 17 = 0) THEN 'PDF_FORMAT_EVIDENCE_INCOMPLETE' END AS f_bad FROM g WHERE NOT refused),
q AS (SELECT i, 'METADATA' AS dimension, m_bad AS code, 'ERROR' AS severity FROM k WHERE m_bad IS NOT NULL
UNION ALL SELECT i, 'METADATA', 'METADATA_TITLE_MISSING', 'WARNING' FROM k WHERE m_bad IS NULL AND n % 7 = 0 UNION ALL SELECT i, 'METADATA', 'METADATA_AUTHOR_MISSING', 'WARNING' FROM k WHERE m_bad IS NULL AND n % 5 = 0
UNION ALL SELECT i, 'METADATA', 'METADATA_LANGUAGE_MISSING', 'WARNING' FROM k WHERE m_bad IS NULL AND format <> 'PDF' AND n % 11 = 0 UNION ALL SELECT i, 'METADATA', 'METADATA_IDENTIFIER_MISSING', 'INFO' FROM k WHERE m_bad IS NULL AND format <> 'PDF' AND n % 3 = 0
UNION ALL SELECT i, 'METADATA', 'METADATA_PUBLICATION_CONTEXT_MISSING', 'INFO' FROM k WHERE m_bad IS NULL AND format <> 'PDF' AND n % 2 = 0 AND n % 3 <> 0 UNION ALL SELECT i, 'METADATA', 'METADATA_SERIES_POSITION_MISSING', 'INFO' FROM k WHERE m_bad IS NULL AND format <> 'PDF' AND n % 4 <> 0 AND n % 6 <> 3
UNION ALL SELECT i, 'TEXT', t_bad, 'ERROR' FROM k WHERE t_bad IS NOT NULL UNION ALL SELECT i, 'TEXT', 'TEXT_NOT_AVAILABLE', 'ERROR' FROM k WHERE t_bad IS NULL AND chars = 0 UNION ALL SELECT i, 'TEXT', 'PDF_OCR_CANDIDATE', 'INFO' FROM k WHERE t_bad IS NULL AND chars = 0 AND format = 'PDF' UNION ALL SELECT i, 'TEXT', 'TEXT_VERY_SHORT', 'WARNING' FROM k WHERE t_bad IS NULL AND chars > 0 AND chars < 2000
UNION ALL SELECT i, 'COVER', c_bad, 'ERROR' FROM k WHERE c_bad IS NOT NULL AND format <> 'PDF' UNION ALL SELECT i, 'COVER', 'COVER_MISSING', 'WARNING' FROM k WHERE c_bad IS NULL AND odd AND format <> 'PDF'
UNION ALL SELECT i, 'STRUCTURE', s_bad, 'ERROR' FROM k WHERE s_bad IS NOT NULL AND format = 'EPUB' UNION ALL SELECT i, 'STRUCTURE', 'EPUB_FATAL_ERRORS', 'ERROR' FROM k WHERE s_bad IS NULL AND fatal > 0 AND format = 'EPUB' UNION ALL SELECT i, 'STRUCTURE', 'EPUB_VALIDATION_ERRORS', 'ERROR' FROM k WHERE s_bad IS NULL AND errors > 0 AND format = 'EPUB'
UNION ALL SELECT i, 'STRUCTURE', 'EPUB_NONCONFORMANT', 'ERROR' FROM k WHERE s_bad IS NULL AND odd AND fatal = 0 AND errors = 0 AND format = 'EPUB' UNION ALL SELECT i, 'STRUCTURE', 'EPUB_VALIDATION_WARNINGS', 'WARNING' FROM k WHERE s_bad IS NULL AND warnings > 0 AND format = 'EPUB'
UNION ALL SELECT i, 'FORMAT_RISK', f_bad, 'ERROR' FROM k WHERE f_bad IS NOT NULL AND format = 'PDF' UNION ALL SELECT i, 'FORMAT_RISK', 'PDF_ENCRYPTED', 'ERROR' FROM k WHERE f_bad IS NULL AND n % 8 = 0 AND format = 'PDF' UNION ALL SELECT i, 'FORMAT_RISK', 'STRUCTURAL_VALIDATION_UNAVAILABLE', 'INFO' FROM k WHERE CASE WHEN format = 'PDF' THEN f_bad IS NULL ELSE format <> 'EPUB' END),
r AS (SELECT i, dimension, max(CASE WHEN code LIKE '%\\_INCOMPLETE' ESCAPE '\\' OR code LIKE '%\\_INCONSISTENT' ESCAPE '\\' THEN 3 WHEN severity = 'ERROR' THEN 2 WHEN severity = 'WARNING' THEN 1 ELSE 0 END) AS v FROM q GROUP BY ALL),
w AS (SELECT g.i, any_value(g.format) AS format, bool_or(refused) AS refused, coalesce(max(v) FILTER (dimension = 'METADATA'), 0) AS m, coalesce(max(v) FILTER (dimension = 'TEXT'), 0) AS t, coalesce(max(v) FILTER (dimension = 'COVER'), 0) AS c, coalesce(max(v) FILTER (dimension = 'STRUCTURE'), 0) AS s, coalesce(max(v) FILTER (dimension = 'FORMAT_RISK'), 0) AS f FROM g LEFT JOIN r ON r.i = g.i GROUP BY g.i),
words(v, word) AS (VALUES (0, 'OK'), (1, 'REVIEW'), (2, 'ACTION_REQUIRED'), (3, 'INCOMPLETE')),
"""


@query(_SQL + """e AS (SELECT i, format, refused, CASE WHEN refused THEN 'REFUSED' ELSE a.word END AS status, m, t, c, s, f FROM w JOIN words a ON a.v = greatest(m, t, c, s, f))
SELECT i AS item_id, e.format, status, coalesce(CASE WHEN NOT refused THEN wm.word END, '-') AS metadata, coalesce(CASE WHEN NOT refused THEN wt.word END, '-') AS text, coalesce(CASE WHEN NOT refused THEN CASE WHEN e.format = 'PDF' THEN 'NOT_APPLICABLE' ELSE wc.word END END, '-') AS cover,
coalesce(CASE WHEN NOT refused THEN CASE WHEN e.format <> 'EPUB' THEN 'NOT_APPLICABLE' ELSE ws.word END END, '-') AS structure, coalesce(CASE WHEN NOT refused THEN wf.word END, '-') AS format_risk FROM e JOIN words wm ON wm.v = m JOIN words wt ON wt.v = t JOIN words wc ON wc.v = c JOIN words ws ON ws.v = s JOIN words wf ON wf.v = f""")
def quality_dimensions(spark, d):
    made = quality.assess_quality(_steps(spark, d))
    return made.select("item_id", "format", "status", *(F.coalesce(x.lower(), F.lit("-")).alias(x.lower()) for x in quality.DIMENSIONS))


@query(_SQL + """z AS (SELECT 1) SELECT w.format, CASE WHEN refused THEN 'REFUSED' ELSE a.word END AS status, coalesce(q.dimension, '-') AS dimension, coalesce(q.code, '-') AS code, coalesce(q.severity, '-') AS severity, count(*) AS items
FROM w JOIN words a ON a.v = greatest(m, t, c, s, f) LEFT JOIN q ON q.i = w.i GROUP BY ALL""")
def quality_codes(spark, d):
    report = quality.quality_report(quality.assess_quality(_steps(spark, d)))
    return report.select("format", "status", *(F.coalesce(x, F.lit("-")).alias(x) for x in ("dimension", "code", "severity")), "items")
