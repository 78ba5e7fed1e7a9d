"""Quality of one observed file from the steps of its analysis: five dimensions, their findings and one status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The steps that belong to a format, the dimensions, and the facts that tell of metadata.
PDF_STEPS = ("pdf-analysis",)
BOOK_STEPS = ("cover", "metadata", "text")
EPUB_STEPS = ("cover", "metadata", "structural-validation", "text")
DIMENSIONS = ("METADATA", "TEXT", "COVER", "STRUCTURE", "FORMAT_RISK")
PRESENT = ("title", "author", "contributor", "language", "identifier", "publisher", "publication_date", "series", "series_position")
BOOK_FORMATS = ("EPUB", "MOBI", "AZW", "AZW3", "PDF")
SHORT_TEXT = 2000


def _flag(facts: Column, name: str) -> Column:
    """True or false as written, null for anything else."""
    value = F.get(F.filter(F.array(F.element_at(facts, name)), lambda x: x.isin("true", "false")), 0)
    return value == "true"


def _number(facts: Column, name: str) -> Column:
    """A number written in digits alone, null for anything else."""
    value = F.element_at(facts, name)
    return F.when(value.rlike("^[0-9]{1,38}$"), value.cast("decimal(38,0)"))


def _finding(condition: Column, dimension: str, code: str, severity: str) -> Column:
    return F.when(condition, F.array(F.struct(F.lit(dimension).alias("dimension"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))))


def _all(*found: Column) -> Column:
    none = F.expr("cast(array() as array<struct<dimension string, code string, severity string>>)")
    return F.concat(*(F.coalesce(x, none) for x in found))


def _metadata(step: str) -> Column:
    facts = F.col(f"{step}.facts")
    has = {name: _flag(facts, f"{name}_present") for name in PRESENT}
    unknown = F.lit(False)
    for value in has.values():
        unknown = unknown | value.isNull()
    contrary = (has["author"] & ~has["contributor"]) | (has["series_position"] & ~has["series"])

    def tell(condition: Column, code: str, severity: str) -> Column:
        return _finding(condition, "METADATA", code, severity)

    return (
        F.when(~F.col(f"{step}.done"), tell(F.lit(True), "METADATA_ANALYSIS_INCOMPLETE", "ERROR"))
        .when(unknown, tell(F.lit(True), "METADATA_EVIDENCE_INCOMPLETE", "ERROR"))
        .when(contrary, tell(F.lit(True), "METADATA_EVIDENCE_INCONSISTENT", "ERROR"))
        .otherwise(
            _all(
                tell(~has["title"], "METADATA_TITLE_MISSING", "WARNING"),
                tell(~has["author"], "METADATA_AUTHOR_MISSING", "WARNING"),
                tell(~has["language"], "METADATA_LANGUAGE_MISSING", "WARNING"),
                tell(~has["identifier"], "METADATA_IDENTIFIER_MISSING", "INFO"),
                tell(~has["publisher"] & ~has["publication_date"], "METADATA_PUBLICATION_CONTEXT_MISSING", "INFO"),
                tell(has["series"] & ~has["series_position"], "METADATA_SERIES_POSITION_MISSING", "INFO"),
            )
        )
    )


def _pdf_metadata(step: str) -> Column:
    facts = F.col(f"{step}.facts")
    title, author = _flag(facts, "title_present"), _flag(facts, "author_present")
    return (
        F.when(~F.col(f"{step}.first"), _finding(F.lit(True), "METADATA", "PDF_METADATA_ANALYSIS_INCOMPLETE", "ERROR"))
        .when(title.isNull() | author.isNull(), _finding(F.lit(True), "METADATA", "PDF_METADATA_EVIDENCE_INCOMPLETE", "ERROR"))
        .otherwise(_all(_finding(~title, "METADATA", "METADATA_TITLE_MISSING", "WARNING"), _finding(~author, "METADATA", "METADATA_AUTHOR_MISSING", "WARNING")))
    )


def _text(step: str, done: str, pdf: bool) -> Column:
    facts = F.col(f"{step}.facts")
    said, chars = F.element_at(facts, "text_status"), _number(facts, "normalized_character_count")
    known = F.coalesce(said.isin("TEXT_EXTRACTED", "NO_TEXT"), F.lit(False)) & chars.isNotNull()

    def tell(condition: Column, code: str, severity: str) -> Column:
        return _finding(condition, "TEXT", code, severity)

    return (
        F.when(~F.col(f"{step}.{done}"), tell(F.lit(True), "TEXT_ANALYSIS_INCOMPLETE", "ERROR"))
        .when(~known, tell(F.lit(True), "TEXT_EVIDENCE_INCOMPLETE", "ERROR"))
        .when((said == "NO_TEXT") != (chars == 0), tell(F.lit(True), "TEXT_EVIDENCE_INCONSISTENT", "ERROR"))
        .otherwise(_all(tell(chars == 0, "TEXT_NOT_AVAILABLE", "ERROR"), tell((chars == 0) & F.lit(pdf), "PDF_OCR_CANDIDATE", "INFO"), tell((chars > 0) & (chars < SHORT_TEXT), "TEXT_VERY_SHORT", "WARNING")))
    )


def _cover(step: str) -> Column:
    said = F.coalesce(F.element_at(F.col(f"{step}.facts"), "cover_status"), F.lit(""))
    return (
        F.when(~F.col(f"{step}.done"), _finding(F.lit(True), "COVER", "COVER_ANALYSIS_INCOMPLETE", "ERROR"))
        .when(~said.isin("COVER_EXTRACTED", "NO_EMBEDDED_COVER"), _finding(F.lit(True), "COVER", "COVER_EVIDENCE_INCOMPLETE", "ERROR"))
        .otherwise(_all(_finding(said == "NO_EMBEDDED_COVER", "COVER", "COVER_MISSING", "WARNING")))
    )


def _structure(step: str) -> Column:
    facts = F.col(f"{step}.facts")
    said = F.coalesce(F.element_at(facts, "conformance_status"), F.lit(""))
    fatal, errors, warnings = (_number(facts, f"{x}_count") for x in ("fatal", "error", "warning"))

    def tell(condition: Column, code: str, severity: str) -> Column:
        return _finding(condition, "STRUCTURE", code, severity)

    return (
        F.when(~F.col(f"{step}.done"), tell(F.lit(True), "STRUCTURE_ANALYSIS_INCOMPLETE", "ERROR"))
        .when(~said.isin("CONFORMANT", "NONCONFORMANT") | fatal.isNull() | errors.isNull() | warnings.isNull(), tell(F.lit(True), "STRUCTURE_EVIDENCE_INCOMPLETE", "ERROR"))
        .when((said == "CONFORMANT") & ((fatal > 0) | (errors > 0)), tell(F.lit(True), "STRUCTURE_EVIDENCE_INCONSISTENT", "ERROR"))
        .otherwise(
            _all(
                tell(fatal > 0, "EPUB_FATAL_ERRORS", "ERROR"),
                tell(errors > 0, "EPUB_VALIDATION_ERRORS", "ERROR"),
                tell((said == "NONCONFORMANT") & (fatal == 0) & (errors == 0), "EPUB_NONCONFORMANT", "ERROR"),
                tell(warnings > 0, "EPUB_VALIDATION_WARNINGS", "WARNING"),
            )
        )
    )


def _pdf_format(step: str) -> Column:
    facts = F.col(f"{step}.facts")
    locked = F.lower(F.trim(F.coalesce(F.element_at(facts, "encrypted"), F.lit(""))))
    pages = F.coalesce(_number(facts, "page_count"), F.lit(0))
    return (
        F.when(~F.col(f"{step}.first"), _finding(F.lit(True), "FORMAT_RISK", "PDF_FORMAT_ANALYSIS_INCOMPLETE", "ERROR"))
        .when((pages == 0) | ~((locked == "no") | locked.startswith("yes")), _finding(F.lit(True), "FORMAT_RISK", "PDF_FORMAT_EVIDENCE_INCOMPLETE", "ERROR"))
        .otherwise(_all(_finding(locked.startswith("yes"), "FORMAT_RISK", "PDF_ENCRYPTED", "ERROR"), _finding(F.lit(True), "FORMAT_RISK", "STRUCTURAL_VALIDATION_UNAVAILABLE", "INFO")))
    )


def assess_quality(steps: DataFrame) -> DataFrame:
    """``item_id, format, status, metadata, text, cover, structure, format_risk, findings`` for each item.

    steps: item_id, format, step, state, executions (states of the runs in it, in order), facts (from string to string).
    An item's steps meet in one aggregate. A PDF's first run tells of metadata and format, its second of text; cover and
    structure are NOT_APPLICABLE to it, structure to all but EPUB. A dimension without whole and consistent evidence is
    INCOMPLETE, which isn't the file's fault; else an error makes it ACTION_REQUIRED, a warning REVIEW. The item's status is
    the first of INCOMPLETE, ACTION_REQUIRED, REVIEW that a dimension has. A format that isn't a book's, formats that differ within an item, and steps that
    aren't exactly those of the format are REFUSED, with null dimensions and no findings; a repeated step is one too many.
    Null states and facts count as not there, rows without an item are left out, an empty table gives an empty one.
    """
    here = steps.where(F.col("item_id").isNotNull())
    good = lambda x: F.coalesce(x == "SUCCEEDED", F.lit(False))
    facts = F.coalesce(F.col("facts"), F.expr("cast(map() as map<string, string>)"))
    told = F.struct(good(F.col("state")).alias("done"), good(F.get("executions", F.lit(0))).alias("first"), good(F.get("executions", F.lit(1))).alias("second"), facts.alias("facts"))
    names = ("metadata", "text", "cover", "structural-validation", "pdf-analysis")
    row = here.select("item_id", "format", "step", told.alias("told")).groupBy("item_id").agg(
        F.min("format").alias("format"), F.max("format").alias("other"), F.count("*").alias("n"), F.count("format").alias("n_formats"),
        *(F.first(F.when(F.col("step") == name, F.col("told")), ignorenulls=True).alias(name.split("-")[0]) for name in names),
    )

    def exactly(wanted: tuple[str, ...]) -> Column:
        fits = F.col("n") == len(wanted)
        for name in wanted:
            fits = fits & F.col(name.split("-")[0]).isNotNull()
        return fits

    pdf, epub = F.col("format") == "PDF", F.col("format") == "EPUB"
    fits = (F.col("format") == F.col("other")) & (F.col("n") == F.col("n_formats")) & F.col("format").isin(*BOOK_FORMATS) & F.when(pdf, exactly(PDF_STEPS)).when(epub, exactly(EPUB_STEPS)).otherwise(exactly(BOOK_STEPS))
    fits = F.coalesce(fits, F.lit(False))
    book = _all(_metadata("metadata"), _text("text", "done", pdf=False), _cover("cover"), F.when(epub, _structure("structural")), _finding(~epub, "FORMAT_RISK", "STRUCTURAL_VALIDATION_UNAVAILABLE", "INFO"))
    sheet = _all(_pdf_metadata("pdf"), _text("pdf", "second", pdf=True), _pdf_format("pdf"))
    found = row.select("item_id", "format", fits.alias("fits"), _all(F.when(fits & pdf, sheet).when(fits, book)).alias("findings"))

    def status(name: str) -> Column:
        mine = F.filter("findings", lambda x: x.dimension == name)
        judged = (
            F.when(F.exists(mine, lambda x: x.code.rlike("_IN(COMPLETE|CONSISTENT)$")), F.lit("INCOMPLETE"))
            .when(F.exists(mine, lambda x: x.severity == "ERROR"), F.lit("ACTION_REQUIRED"))
            .when(F.exists(mine, lambda x: x.severity == "WARNING"), F.lit("REVIEW"))
            .otherwise(F.lit("OK"))
        )
        absent = {"COVER": pdf, "STRUCTURE": ~epub}.get(name)
        return F.when(F.col("fits"), judged if absent is None else F.when(absent, F.lit("NOT_APPLICABLE")).otherwise(judged))

    dimensions = found.select("*", *(status(name).alias(name.lower()) for name in DIMENSIONS))
    states = F.array(*(F.col(name.lower()) for name in DIMENSIONS))
    whole = F.when(~F.col("fits"), F.lit("REFUSED"))
    for word in ("INCOMPLETE", "ACTION_REQUIRED", "REVIEW"):
        whole = whole.when(F.array_contains(states, word), F.lit(word))
    return dimensions.select("item_id", "format", whole.otherwise(F.lit("OK")).alias("status"), *(name.lower() for name in DIMENSIONS), "findings")


def quality_report(assessed: DataFrame) -> DataFrame:
    """``format, status, dimension, code, severity, items``: how many items of a format and status have each finding; without findings, nulls."""
    each = assessed.select("item_id", "format", "status", F.explode_outer("findings").alias("f"))
    return each.groupBy("format", "status", F.col("f.dimension").alias("dimension"), F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("items"))
