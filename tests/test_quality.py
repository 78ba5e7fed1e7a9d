"""Quality of files from their steps: every code, every status, refused plans."""

from __future__ import annotations

import pytest

from veritome.operators.quality import assess_quality, quality_report

SCHEMA = "item_id int, format string, step string, state string, executions array<string>, facts map<string,string>"
FULL = dict.fromkeys((f"{x}_present" for x in ("title", "author", "contributor", "language", "identifier", "publisher", "publication_date", "series", "series_position")), "true")
TEXT = {"text_status": "TEXT_EXTRACTED", "normalized_character_count": "2000"}
COVER = {"cover_status": "COVER_EXTRACTED"}
VALID = {"conformance_status": "CONFORMANT", "fatal_count": "0", "error_count": "0", "warning_count": "0"}
SHEET = {"title_present": "true", "author_present": "true", **TEXT, "page_count": "3", "encrypted": " No "}


def epub(failed=(), **changed):
    steps = {"metadata": FULL, "text": TEXT, "cover": COVER, "structural-validation": VALID}
    return "EPUB", [(name, "FAILED" if name in failed else "SUCCEEDED", None, {**facts, **changed.get(name.split("-")[0], {})}) for name, facts in steps.items()]


def pdf(executions=("SUCCEEDED", "SUCCEEDED"), **changed):
    return "PDF", [("pdf-analysis", "SUCCEEDED", list(executions), {**SHEET, **changed})]


CASES = [
    (epub(), "OK", "OK OK OK OK OK", []),
    (epub(failed=("metadata",)), "INCOMPLETE", "INCOMPLETE OK OK OK OK", ["METADATA_ANALYSIS_INCOMPLETE"]),
    (epub(metadata={"series_present": "True"}), "INCOMPLETE", "INCOMPLETE OK OK OK OK", ["METADATA_EVIDENCE_INCOMPLETE"]),
    (epub(metadata={"contributor_present": "false"}), "INCOMPLETE", "INCOMPLETE OK OK OK OK", ["METADATA_EVIDENCE_INCONSISTENT"]),
    (epub(metadata={"series_present": "false"}), "INCOMPLETE", "INCOMPLETE OK OK OK OK", ["METADATA_EVIDENCE_INCONSISTENT"]),
    (epub(metadata={"title_present": "false", "author_present": "false", "language_present": "false"}), "REVIEW", "REVIEW OK OK OK OK", ["METADATA_TITLE_MISSING", "METADATA_AUTHOR_MISSING", "METADATA_LANGUAGE_MISSING"]),
    (epub(metadata={"identifier_present": "false", "publisher_present": "false", "publication_date_present": "false", "series_position_present": "false"}), "OK", "OK OK OK OK OK", ["METADATA_IDENTIFIER_MISSING", "METADATA_PUBLICATION_CONTEXT_MISSING", "METADATA_SERIES_POSITION_MISSING"]),
    (epub(failed=("text",)), "INCOMPLETE", "OK INCOMPLETE OK OK OK", ["TEXT_ANALYSIS_INCOMPLETE"]),
    (epub(text={"normalized_character_count": "-1"}), "INCOMPLETE", "OK INCOMPLETE OK OK OK", ["TEXT_EVIDENCE_INCOMPLETE"]),
    (epub(text={"text_status": None}), "INCOMPLETE", "OK INCOMPLETE OK OK OK", ["TEXT_EVIDENCE_INCOMPLETE"]),
    (epub(text={"normalized_character_count": "0"}), "INCOMPLETE", "OK INCOMPLETE OK OK OK", ["TEXT_EVIDENCE_INCONSISTENT"]),
    (epub(text={"text_status": "NO_TEXT", "normalized_character_count": "0"}), "ACTION_REQUIRED", "OK ACTION_REQUIRED OK OK OK", ["TEXT_NOT_AVAILABLE"]),
    (epub(text={"normalized_character_count": "1999"}), "REVIEW", "OK REVIEW OK OK OK", ["TEXT_VERY_SHORT"]),
    (epub(failed=("cover",)), "INCOMPLETE", "OK OK INCOMPLETE OK OK", ["COVER_ANALYSIS_INCOMPLETE"]),
    (epub(cover={"cover_status": "BROKEN"}), "INCOMPLETE", "OK OK INCOMPLETE OK OK", ["COVER_EVIDENCE_INCOMPLETE"]),
    (epub(cover={"cover_status": "NO_EMBEDDED_COVER"}), "REVIEW", "OK OK REVIEW OK OK", ["COVER_MISSING"]),
    (epub(failed=("structural-validation",)), "INCOMPLETE", "OK OK OK INCOMPLETE OK", ["STRUCTURE_ANALYSIS_INCOMPLETE"]),
    (epub(structural={"warning_count": ""}), "INCOMPLETE", "OK OK OK INCOMPLETE OK", ["STRUCTURE_EVIDENCE_INCOMPLETE"]),
    (epub(structural={"error_count": "1"}), "INCOMPLETE", "OK OK OK INCOMPLETE OK", ["STRUCTURE_EVIDENCE_INCONSISTENT"]),
    (epub(structural={"conformance_status": "NONCONFORMANT"}), "ACTION_REQUIRED", "OK OK OK ACTION_REQUIRED OK", ["EPUB_NONCONFORMANT"]),
    (epub(structural={"conformance_status": "NONCONFORMANT", "fatal_count": "1", "error_count": "2", "warning_count": "3"}), "ACTION_REQUIRED", "OK OK OK ACTION_REQUIRED OK", ["EPUB_FATAL_ERRORS", "EPUB_VALIDATION_ERRORS", "EPUB_VALIDATION_WARNINGS"]),
    (epub(structural={"warning_count": "3"}), "REVIEW", "OK OK OK REVIEW OK", ["EPUB_VALIDATION_WARNINGS"]),
    (epub(failed=("cover",), text={"text_status": "NO_TEXT", "normalized_character_count": "0"}), "INCOMPLETE", "OK ACTION_REQUIRED INCOMPLETE OK OK", ["TEXT_NOT_AVAILABLE", "COVER_ANALYSIS_INCOMPLETE"]),
    (("MOBI", epub()[1][:3]), "OK", "OK OK OK NOT_APPLICABLE OK", ["STRUCTURAL_VALIDATION_UNAVAILABLE"]),
    (pdf(), "OK", "OK OK NOT_APPLICABLE NOT_APPLICABLE OK", ["STRUCTURAL_VALIDATION_UNAVAILABLE"]),
    (pdf(encrypted="YES (copy:no)"), "ACTION_REQUIRED", "OK OK NOT_APPLICABLE NOT_APPLICABLE ACTION_REQUIRED", ["PDF_ENCRYPTED", "STRUCTURAL_VALIDATION_UNAVAILABLE"]),
    (pdf(page_count="0"), "INCOMPLETE", "OK OK NOT_APPLICABLE NOT_APPLICABLE INCOMPLETE", ["PDF_FORMAT_EVIDENCE_INCOMPLETE"]),
    (pdf(text_status="NO_TEXT", normalized_character_count="0"), "ACTION_REQUIRED", "OK ACTION_REQUIRED NOT_APPLICABLE NOT_APPLICABLE OK", ["TEXT_NOT_AVAILABLE", "PDF_OCR_CANDIDATE", "STRUCTURAL_VALIDATION_UNAVAILABLE"]),
    (pdf(executions=("FAILED", "SUCCEEDED")), "INCOMPLETE", "INCOMPLETE OK NOT_APPLICABLE NOT_APPLICABLE INCOMPLETE", ["PDF_METADATA_ANALYSIS_INCOMPLETE", "PDF_FORMAT_ANALYSIS_INCOMPLETE"]),
    (pdf(executions=("SUCCEEDED",), title_present="yes"), "INCOMPLETE", "INCOMPLETE INCOMPLETE NOT_APPLICABLE NOT_APPLICABLE OK", ["PDF_METADATA_EVIDENCE_INCOMPLETE", "TEXT_ANALYSIS_INCOMPLETE", "STRUCTURAL_VALIDATION_UNAVAILABLE"]),
    (("EPUB", epub()[1][:3]), "REFUSED", None, []),
    (("EPUB", epub()[1] + epub()[1][:1]), "REFUSED", None, []),
    (("TXT", epub()[1][:3]), "REFUSED", None, []),
    ((None, epub()[1][:3]), "REFUSED", None, []),
    (("PDF", [("pdf-analysis", None, None, None)]), "INCOMPLETE", "INCOMPLETE INCOMPLETE NOT_APPLICABLE NOT_APPLICABLE INCOMPLETE", ["PDF_METADATA_ANALYSIS_INCOMPLETE", "TEXT_ANALYSIS_INCOMPLETE", "PDF_FORMAT_ANALYSIS_INCOMPLETE"]),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [(i, form, *step) for i, ((form, steps), *_) in enumerate(CASES) for step in steps]
    return assess_quality(spark.createDataFrame([*rows, (None, *rows[0][1:])], SCHEMA)).cache()


def test_every_finding_and_status(assessed):
    made = {r.item_id: r for r in assessed.collect()}
    assert len(made) == len(CASES)
    for i, (_, status, dimensions, codes) in enumerate(CASES):
        row = made[i]
        assert (i, row.status, [f.code for f in row.findings]) == (i, status, codes)
        assert [row.metadata, row.text, row.cover, row.structure, row.format_risk] == (dimensions.split() if dimensions else [None] * 5)


def test_report_counts_items(assessed):
    found = {(r.format, r.status, r.code): r["items"] for r in quality_report(assessed).collect()}
    assert found["EPUB", "OK", None] == 1 and found["EPUB", "REFUSED", None] == 2
    assert found["PDF", "OK", "STRUCTURAL_VALIDATION_UNAVAILABLE"] == 1
    assert found["EPUB", "INCOMPLETE", "METADATA_EVIDENCE_INCONSISTENT"] == 2


def test_mixed_formats_are_refused_and_empty_stays_empty(spark):
    mixed = [(1, "EPUB" if at else "MOBI", *step) for at, step in enumerate(epub()[1])]
    assert [r.status for r in assess_quality(spark.createDataFrame(mixed, SCHEMA)).collect()] == ["REFUSED"]
    assert assess_quality(spark.createDataFrame([], SCHEMA)).count() == 0
