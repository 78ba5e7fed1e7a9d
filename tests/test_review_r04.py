"""Cases from the fourth review."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veritome.functions import unicode
from veritome.plans import catalog, matching_queries


@pytest.mark.parametrize("name, n", [("match_pairs", 12), ("candidate_blocks", 25)])
def test_each_text_is_normalised_once(spark, tmp_path, monkeypatch, name, n):
    """Blocks, lists and stars go over the keys of texts, never again over the texts."""
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    monkeypatch.setattr(matching_queries, "text_fingerprint", lambda text: F.udf(told, StringType())(text))
    # two copies each of 12 texts: a pair each, from an exact group and a block of its text; and one block of a series
    files = spark.range(24).selectExpr("id AS doc_id", "concat('text ', id % 12) AS text", "'en' AS lang", "concat('s', id) AS source", "6L AS n_chars")
    files.write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.queries()[name](spark, str(tmp_path)).count() == n
    assert seen.value == 24


def test_stable_text_is_told_from_its_start_to_its_end(spark):
    """Ends of lines, long runs and what stands last count as anything else; the test stands once in a plan."""
    texts = ["é" * 300_000, "a" * 300_000 + " ", "ab\u0085", "ab\n", "é\r\n", "é ", "\ń", "x" + "é\U0001d400", "\U0001d400", "–a“b”„c", " ", " ", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = sorted(frame.select("i", unicode.is_stable(frame.x).alias("s"), unicode.normal_text(frame.x).alias("n")).collect())
    assert [r.s for r in got] == [True, False, False, True, True, False, False, False, False, True, True, False, True, None]
    assert [r.n for r in got] == [None if t is None else unicode.text_rule(t) for t in texts]
    plan = frame.select(unicode.normal_text(frame.x))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("RLIKE") == 2  # what Python gets is told, and what it runs on
