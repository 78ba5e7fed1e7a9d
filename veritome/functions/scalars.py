"""Scalar rules as Spark columns; all stay inside code generation unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Book formats in the order in which a suffix is tried, and the kinds of media files scanned.
FORMATS = ("EPUB", "MOBI", "AZW", "AZW3", "PDF")
# Magic bytes in hex, and the container they open.
SIGNATURES = (
    ("504B0304", "ZIP"),
    ("504B0506", "ZIP"),
    ("526172211A0700", "RAR4"),
    ("526172211A070100", "RAR5"),
    ("377ABCAF271C", "SEVEN_Z"),
    ("1F8B", "GZIP"),
    ("425A68", "BZIP2"),
    ("FD377A585A00", "XZ"),
    ("28B52FFD", "ZSTD"),
)
# MARC relator codes.
MARC_ROLES = (("aut", "author"), ("bkp", "book_producer"), ("ctb", "contributor"), ("edt", "editor"), ("ill", "illustrator"), ("nrt", "narrator"), ("oth", "other"), ("trl", "translator"))


def file_suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def book_format(path: Column) -> Column:
    """Format by suffix; OTHER for another suffix, UNKNOWN for none."""
    suffix = file_suffix(path)
    known = reduce(lambda acc, f: acc.when(suffix == f".{f.lower()}", F.lit(f)), FORMATS[1:], F.when(suffix == f".{FORMATS[0].lower()}", F.lit(FORMATS[0])))
    return known.when(suffix == "", F.lit("UNKNOWN")).otherwise(F.lit("OTHER"))


def is_book(path: Column) -> Column:
    return file_suffix(path).isin(*(f".{f.lower()}" for f in FORMATS))


def parts_digest(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain tag and parts, joined by zero characters; null parts count as empty."""
    return F.sha2(F.concat_ws("\u0000", F.lit(domain), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the fields, keys in order, nulls written."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def quick_fingerprint(content: Column, size: Column, domain: str = "quick/v1", edge: int = 65536) -> Column:
    """SHA-256 of domain, 16-byte size, head and tail of a binary column; the whole of what is no longer than both edges."""
    n = F.octet_length(content)
    sample = F.when(n <= 2 * edge, content).otherwise(F.concat(F.substring(content, 1, edge), F.substring(content, -edge, edge)))
    return F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lpad(F.hex(size), 32, "0")), sample), 256)


def hamming64(left: Column, right: Column) -> Column:
    """Differing bits of two 64-bit values in hex; null unless both are 16 hex digits."""
    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")

    fine = left.rlike("^[0-9a-fA-F]{16}$") & right.rlike("^[0-9a-fA-F]{16}$")
    return F.when(fine, sum((F.bit_count(half(left, at).bitwiseXOR(half(right, at))) for at in (1, 9)), F.lit(0)))


def gradient_hash(cells: Column, rows: int = 8, columns: int = 8) -> Column:
    """Bits left > right along the rows of a grid of numbers, as a bit string: a row of nine cells makes eight bits."""
    def bit(i: Column) -> Column:
        at = F.floor(i / columns).cast("int") * (columns + 1) + i % columns
        return F.when(F.get(cells, at) > F.get(cells, at + 1), F.lit("1")).otherwise(F.lit("0"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), bit), "")


def _digit_sum(digits: Column, weight) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weight(i) * F.when(F.substring(digits, i, F.lit(1)) == "X", F.lit(10)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))


def isbn10_valid(value: Column) -> Column:
    """Ten digits, the last maybe X, whose sum weighted 10 to 1 is divisible by 11."""
    return F.when(value.rlike("^[0-9]{9}[0-9X]$"), _digit_sum(value, lambda i: 11 - i) % 11 == 0).otherwise(F.lit(False))


def isbn13_valid(value: Column) -> Column:
    """Thirteen digits whose sum weighted 1, 3, 1, .. is divisible by 10."""
    return F.when(value.rlike("^[0-9]{13}$"), _digit_sum(value, lambda i: F.when(i % 2 == 1, 1).otherwise(3)) % 10 == 0).otherwise(F.lit(False))


def identifier_namespace(value: Column) -> Column:
    """Namespace that an identifier's prefix or shape names."""
    low = F.lower(F.trim(value))
    bare = F.regexp_replace(F.upper(value), "[^0-9X]", "")
    return (
        F.when(low.rlike("^urn:isbn:|^isbn[:= ]"), F.lit("isbn"))
        .when(low.startswith("urn:uuid:"), F.lit("uuid"))
        .when(low.rlike("^(urn:)?oclc[:= ]"), F.lit("oclc"))
        .when(low.rlike("^(urn:)?lccn[:= ]"), F.lit("lccn"))
        .when(low.rlike(r"^(https?://(dx\.)?doi\.org/|doi:|10\.[0-9]{4,})"), F.lit("doi"))
        .when(low.rlike("^https?://"), F.lit("uri"))
        .when(isbn10_valid(bare) | isbn13_valid(bare), F.lit("isbn"))
        .otherwise(F.lit("unknown"))
    )


def marc_role(code: Column) -> Column:
    """The role that a relator code names, blanks and case aside; null for an unknown one."""
    found = F.create_map(*(F.lit(x) for pair in MARC_ROLES for x in pair))
    return F.element_at(found, F.lower(F.trim(code)))


def guard_cell(value: Column) -> Column:
    """Prefixes an apostrophe to text that a spreadsheet would take for a formula."""
    return F.when(value.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_change(before: Column, after: Column) -> Column:
    """RENAMED, MOVED, both, or null if the path is the same."""
    name = F.regexp_extract(before, "([^/]*)$", 1) == F.regexp_extract(after, "([^/]*)$", 1)
    parent = parent_path(before) == parent_path(after)
    return F.when(before == after, F.lit(None).cast("string")).when(parent, F.lit("RENAMED")).when(name, F.lit("MOVED")).otherwise(F.lit("MOVED_AND_RENAMED"))


def change_state(known_presence: Column, same_size: Column, same_time: Column) -> Column:
    """State of a discovered file against its record: NEW without one, REAPPEARED if it was not present, MODIFIED or UNCHANGED."""
    return (
        F.when(known_presence.isNull(), F.lit("NEW"))
        .when(known_presence != "PRESENT", F.lit("REAPPEARED"))
        .when(same_size & same_time, F.lit("UNCHANGED"))
        .otherwise(F.lit("MODIFIED"))
    )


def deletion_confirmed(misses: Column, missing_since: Column, now: Column, least: int = 3, hours: int = 24) -> Column:
    return F.coalesce((misses >= least) & (now >= missing_since + F.expr(f"INTERVAL {hours} HOURS")), F.lit(False))


def archive_signature(content: Column, path: Column) -> Column:
    """Struct of format by magic bytes, suffix, and how both agree."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit(None).cast("string")
    for magic, name in SIGNATURES:
        kind = F.when(head.startswith(magic), F.lit(name)).otherwise(kind)
    suffix = F.regexp_extract(F.lower(path), r"(\.tar\.(?:gz|bz2|xz|zst)|\.[a-z0-9]+)$", 1)
    by_suffix = (
        F.when(suffix.isin(".zip", ".cbz", ".epub"), F.lit("ZIP"))
        .when(suffix.isin(".rar", ".cbr"), F.lit("RAR"))
        .when(suffix == ".7z", F.lit("SEVEN_Z"))
        .when(suffix.isin(".tar.gz", ".tgz", ".gz"), F.lit("GZIP"))
        .when(suffix.isin(".tar.bz2", ".bz2"), F.lit("BZIP2"))
        .when(suffix.isin(".tar.xz", ".xz"), F.lit("XZ"))
        .when(suffix.isin(".tar.zst", ".zst"), F.lit("ZSTD"))
    )
    family = F.when(kind.isin("RAR4", "RAR5"), F.lit("RAR")).otherwise(kind)
    status = F.when(kind.isNull(), F.lit("UNKNOWN_SIGNATURE")).when(family == by_suffix, F.lit("MATCHED")).otherwise(F.lit("SIGNATURE_SUFFIX_MISMATCH"))
    return F.struct(kind.alias("format"), suffix.alias("suffix"), status.alias("status"))


def freshness(now: Column, fresh_until: Column, expires_at: Column) -> Column:
    return F.when(now < fresh_until, F.lit("FRESH")).when(now < expires_at, F.lit("STALE")).otherwise(F.lit("EXPIRED"))


def name_based_uuid(name: Column, namespace: str) -> Column:
    """The version 5 UUID of a name: from the SHA-1 of the namespace's 16 bytes and the name in UTF-8."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
