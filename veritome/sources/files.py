"""Scans of folders and of the formats in which evidence arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY_PAGE = "id long, title string, authors array<string>, formats array<string>, identifiers map<string,string>, uuid string, last_modified timestamp"
CATEGORIES = "category string, name string, count int"
# Fields of the web knowledge records.
EDITION = "key string, title string, subtitle string, publish_date string, publishers array<string>, languages array<struct<key:string>>, isbn_10 array<string>, isbn_13 array<string>, oclc_numbers array<string>, lccn array<string>, works array<struct<key:string>>, authors array<struct<key:string>>"
VALIDATOR = "messages array<struct<ID:string, severity:string, message:string>>"


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``relative_path, size_bytes, modified_at`` of files with a suffix; contents aren't read. A missing root raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/")
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    low = F.lower("path")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | low.endswith(s.lower())
    return found.where(wanted).select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def library_page(spark: SparkSession, path: str) -> DataFrame:
    """A library's list page; anything malformed fails."""
    return spark.read.schema(LIBRARY_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORIES).option("header", True).option("mode", "FAILFAST").csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; other lines fail the cast."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").cast("long").alias("id"))


def colon_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``Name: value`` lines of tool output, the first of each name."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    parts = lines.select(key, "at", F.regexp_extract("line", "^([A-Za-z][A-Za-z ]*):\\s*(.*)$", 1).alias("name"), F.trim(F.regexp_extract("line", "^([A-Za-z][A-Za-z ]*):\\s*(.*)$", 2)).alias("value"))
    return parts.where("name <> ''").groupBy(key, "name").agg(F.min_by("value", "at").alias("value"))


def validator_counts(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Messages of a validator's JSON report by severity; reports that don't parse have none and are told."""
    parsed = reports.select(key, F.from_json(text, VALIDATOR).alias("r"))
    each = parsed.select(key, F.explode_outer("r.messages").alias("m"))
    s = F.upper("m.severity")
    return each.groupBy(key).agg(F.count_if(s == "FATAL").alias("fatal"), F.count_if(s == "ERROR").alias("errors"), F.count_if(s == "WARNING").alias("warnings"), F.count_if(F.col("m").isNull()).alias("empty"))


def knowledge_editions(pages: DataFrame, text: str) -> DataFrame:
    """Identifiers, titles and links of edition records in long form; unparsable text gives a finding instead."""
    r = pages.select(F.col(text).alias("raw"), F.from_json(text, EDITION).alias("e"))
    def each(column: str, kind: str) -> DataFrame:
        return r.select("e.key", F.lit(kind).alias("kind"), F.explode(f"e.{column}").alias("value"))

    bad = r.where("e is null or e.key is null").select(F.lit(None).cast("string").alias("key"), F.lit("MALFORMED_RECORD").alias("kind"), F.sha2("raw", 256).alias("value"))
    title = r.where("e.title is not null").select("e.key", F.lit("title").alias("kind"), F.col("e.title").alias("value"))
    links = r.select("e.key", F.lit("work").alias("kind"), F.explode("e.works.key").alias("value"))
    return title.unionByName(each("isbn_10", "isbn10")).unionByName(each("isbn_13", "isbn13")).unionByName(each("oclc_numbers", "oclc")).unionByName(each("lccn", "lccn")).unionByName(links).unionByName(bad)


def book_metadata(xml: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, value`` of package metadata; documents with a type declaration or entities, or over 4 MiB, are refused.

    Names count without their prefixes; what stands between the tags is told as it is, but for spaces around it.
    """
    safe = ~F.col(text).rlike("<!(DOCTYPE|ENTITY)") & (F.octet_length(text) <= 4 << 20)
    kinds = ("title", "creator", "language", "identifier", "publisher")
    rows = xml.where(safe).select(key, F.col(text).alias("x"))
    out = None
    for kind in kinds:
        part = rows.select(key, F.lit(kind).alias("kind"), F.explode(F.transform(F.regexp_extract_all("x", F.lit(f"<(?:[A-Za-z]+:)?{kind}[^>]*>([^<]*)</(?:[A-Za-z]+:)?{kind}>"), 1), lambda v: F.trim(v))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where("value <> ''")


def archive_listing(lines: DataFrame, key: str, place: str, line: str) -> DataFrame:
    """Blocks of ``Name = value`` lines to one row for each member: a block begins at its Path."""
    from pyspark.sql import Window

    parts = lines.select(key, place, F.regexp_extract(line, r"^([A-Za-z][A-Za-z ]*) = ?(.*)$", 1).alias("name"), F.regexp_extract(line, r"^([A-Za-z][A-Za-z ]*) = ?(.*)$", 2).alias("value")).where("name <> ''")
    block = F.sum(F.when(F.col("name") == "Path", 1).otherwise(0)).over(Window.partitionBy(key).orderBy(place))
    named = parts.withColumn("block", block).where("block > 0")
    return named.groupBy(key, "block").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(a) for n, a in (("Path", "path"), ("Size", "size"), ("Packed Size", "packed"), ("Attributes", "attributes"), ("CRC", "crc"))))


TAR_MEMBERS = "key string, ordinal long, path string, size long, kind string, finding string"


# Kinds of entries by the type flag of their header.
TAR_KINDS = {"0": "REGULAR_FILE", "": "REGULAR_FILE", "5": "DIRECTORY", "2": "SYMLINK", "1": "HARDLINK", "6": "FIFO", "3": "CHARACTER_DEVICE", "4": "BLOCK_DEVICE"}


def tar_frames(stream, length: int):
    """``ordinal, path, size, kind, finding`` for each header of a TAR stream of ``length`` bytes that can seek; contents are passed over."""
    at, n = 0, 0
    while at + 512 <= length:
        stream.seek(at)
        head = stream.read(512)
        if not any(head):
            return
        text = lambda a, b: head[a:b].split(b"\0")[0].decode("utf-8", "replace").strip()  # noqa: B023, E731
        try:
            size, told = int(text(124, 136) or "0", 8), int(text(148, 156).rstrip() or "0", 8)
        except ValueError:
            yield n, text(0, 100), None, "UNKNOWN", "HEADER_INVALID"
            return
        if told != sum(head) - sum(head[148:156]) + 8 * 32:
            yield n, text(0, 100), size, "UNKNOWN", "CHECKSUM_MISMATCH"
            return
        at += 512 + -(-size // 512) * 512
        prefix = text(345, 500) if head[257:262] == b"ustar" else ""
        yield n, f"{prefix}/{text(0, 100)}" if prefix else text(0, 100), size, TAR_KINDS.get(text(156, 157), "UNKNOWN"), "TRUNCATED" if at > length else None
        n += 1
    if at < length:
        yield n, None, None, "UNKNOWN", "TRUNCATED"


def tar_members(archives: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each header of TAR files, with a finding where the stream breaks off or a checksum is wrong; contents aren't kept.

    A stream is a chain of frames, so each file is read from its start, by itself. For files in a folder use the source
    ``tar_members`` of ``datasources``, which doesn't load them.
    """
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [(k, *f) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in tar_frames(io.BytesIO(x or b""), len(x or b""))]
            if found:
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[x.split()[0] for x in TAR_MEMBERS.split(", ")])

    return archives.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInArrow(run, TAR_MEMBERS)
