"""Library reconciliation, archives, and plans that are never executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritome.functions.unicode import casefolded, folded
from veritome.sources.shared import written

# Limits of an archive that is accepted, and sidecar kinds by file name.
MEMBERS, TOTAL_BYTES, MEMBER_BYTES, RATIO = 10_000, 8 << 30, 2 << 30, 1000
WORKSPACE_BYTES, RESERVE_BYTES = 8 << 30, 1 << 30
PATH_CHARACTERS, PATH_BYTES, PATH_PARTS, NAME_CHARACTERS = 1024, 4096, 128, 1024
SIDECAR_NAMES = (("readme read.me", "README"), ("password passwort pass pw", "PASSWORD"))
SIDECARS = (("nfo", "NFO"), ("txt", "TEXT"), ("diz", "DIZ"), ("info", "INFO"), ("url", "URL"), ("html", "HTML"), ("htm", "HTML"), ("sfv", "SFV"))

# Names of devices.
DEVICES = ("CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)))


def library_findings(files: DataFrame, records: DataFrame, formats: DataFrame, metadata: DataFrame | None = None, authority: DataFrame | None = None, sidecar: DataFrame | None = None) -> DataFrame:
    """``code, subject_id``: files without a record, records without a file, records that share contents, and records of several formats.

    files: path, sha256. records: record_id. formats: record_id, path. Records of ``metadata_conflicts``, ``authority_conflicts``
    and ``sidecar_dependencies``, where given, are findings too, if they are among ``records``.
    """
    joined = formats.join(files, "path", "left_semi")
    alone = files.join(formats, "path", "left_anti").select(F.lit("FILESYSTEM_ONLY").alias("code"), F.col("path").alias("subject_id"))
    lost = records.join(joined, "record_id", "left_anti").select(F.lit("RECORD_WITHOUT_FILE").alias("code"), F.col("record_id").cast("string").alias("subject_id"))
    hashed = formats.join(files, "path")
    shared = hashed.groupBy("sha256").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).where("a <> b").select("sha256")
    double = hashed.join(shared, "sha256", "left_semi").select(F.lit("DUPLICATE_RECORD_CANDIDATE").alias("code"), F.col("record_id").cast("string").alias("subject_id")).distinct()
    several = joined.groupBy("record_id").agg(F.countDistinct("path").alias("n")).where("n > 1").select(F.lit("MULTI_FORMAT_RECORD").alias("code"), F.col("record_id").cast("string").alias("subject_id"))
    found = alone.unionByName(lost).unionByName(double).unionByName(several)
    for code, more in (("METADATA_CONFLICT", metadata), ("AUTHORITY_CONFLICT", authority), ("SIDECAR_DEPENDENCY", sidecar)):
        if more is not None:
            found = found.unionByName(records.join(more, "record_id", "left_semi").select(F.lit(code).alias("code"), F.col("record_id").cast("string").alias("subject_id")))
    return found


def metadata_conflicts(records: DataFrame, observed: DataFrame) -> DataFrame:
    """``record_id, field`` where the library's value isn't the one observed in the file."""
    left, right = records.select("record_id", "field", F.col("value").alias("library")), observed.select("record_id", "field", F.col("value").alias("seen"))
    return left.join(right, ["record_id", "field"]).where("library <> seen").select("record_id", "field").distinct()


def authority_conflicts(contributors: DataFrame, candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """``record_id, candidate_id``: agents awaiting review whose name is none of the record's contributors; records without contributors have none.

    contributors: record_id, name. candidates: record_id, candidate_id, kind, name, disposition. reviews: candidate_id, state.
    """
    undecided = reviews.where(F.col("state").isin("PENDING", "DEFERRED")).select("candidate_id")
    waiting = candidates.where("kind = 'AGENT' and disposition = 'REVIEW_REQUIRED' and name is not null").join(undecided, "candidate_id", "left_semi").select("record_id", "candidate_id", "name")
    named = contributors.where("name is not null").select("record_id", "name")
    return waiting.join(named, ["record_id", "name"], "left_anti").join(named, "record_id", "left_semi").select("record_id", "candidate_id").distinct()


def sidecar_dependencies(formats: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """``record_id, path, kind, observed``: sidecars in the place that their kind asks for, of records whose formats share one folder.

    formats: record_id, path. sidecars: record_id, path, kind. files: path. A sidecar that is a format itself is none;
    ``observed`` tells whether it is among the files.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    homes = formats.groupBy("record_id").agg(F.min(folder).alias("home"), F.max(folder).alias("other")).where("home = other").select("record_id", F.when(F.col("home") == "", "").otherwise(F.concat("home", F.lit("/"))).alias("home"))
    rest = F.when(F.startswith(F.col("path"), F.col("home")), F.expr("substring(path, length(home) + 1)"))
    placed = F.when(F.col("kind") == "METADATA_OPF", rest == "metadata.opf").when(F.col("kind") == "COVER", rest == "cover.jpg").when(F.col("kind") == "EXTRA_DATA", rest.startswith("data/")).otherwise(rest != "")
    found = sidecars.select("record_id", "path", "kind").distinct().join(homes, "record_id").where(placed).join(formats.select("record_id", "path"), ["record_id", "path"], "left_anti")
    seen = files.select("path").distinct().withColumn("observed", F.lit(True))
    return found.join(seen, "path", "left").select("record_id", "path", "kind", F.coalesce("observed", F.lit(False)).alias("observed"))


# How parts of an archive are named, the suffix of a head or rival, the first number, whether the head belongs to the parts, and what a whole set is.
VOLUMES = (
    ("NEW_RAR", r"(?i)^(.+)\.part([0-9]{1,6})\.rar$", ".rar", 1, False, "LISTED"),
    ("SEVEN_Z", r"(?i)^(.+)\.7z\.([0-9]{3,6})$", ".7z", 1, False, "LISTED"),
    ("OLD_RAR", r"(?i)^(.+)\.r([0-9]{2})$", ".rar", 0, True, "LISTED"),
    ("SPLIT_ZIP", r"(?i)^(.+)\.z([0-9]{2})$", ".zip", 1, True, "UNSUPPORTED_FORMAT"),
)
MOST_VOLUMES = 256
ARCHIVE_SUFFIX = r"\.(epub|cbz|cbr|zip|rar|r[0-9]{2}|7z|7z\.[0-9]{3,6}|tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz|tar\.zst|tzst|arj|cab|exe|iso|wim|gz|bz2|xz|zst|z01|z02)$"


def volume_sets(names: DataFrame) -> DataFrame:
    """``parent, logical, status, entry, members``: each set of volumes, each finding, and each archive of one file, from ``parent, name``.

    Names equal but for case are a NAME_COLLISION and no more. A stem with parts of several kinds, or with parts and a
    rival of one file, is an AMBIGUOUS_VOLUME, as are parts whose stems differ in case or whose numbers differ in width;
    parts that need a head are an ORPHAN_VOLUME without it; a gap, or another first number, is a MISSING_VOLUME; more
    than MOST_VOLUMES files are an UNSUPPORTED_VOLUME. Sets are counts, minima and maxima, so none is held in a list.
    """
    every = names.select("parent", "name", casefolded(F.col("name")).alias("fold"))
    # read for collisions, heads, parts and single files: folded and counted once
    each = written(every.groupBy("parent", "fold").agg(F.count("*").alias("n"), F.min("name").alias("name")), "names")
    collisions = each.where("n > 1").select("parent", F.col("fold").alias("logical"), F.lit("NAME_COLLISION").alias("status"), F.lit(None).cast("string").alias("entry"), F.col("n").alias("members"))
    free = each.where("n = 1").drop("n")

    def matched(group: int) -> Column:
        return F.coalesce(*(F.when(F.col("name").rlike(p), F.regexp_extract("name", p, group)) for _, p, *_ in VOLUMES))

    family = F.coalesce(*(F.when(F.col("name").rlike(p), F.lit(f)) for f, p, *_ in VOLUMES))
    told = free.withColumn("family", family).withColumn("stem", matched(1)).withColumn("digits", matched(2))
    parts = written(told.where("family is not null").withColumn("logical", casefolded(F.col("stem"))).withColumn("number", F.col("digits").cast("int")), "parts")
    sets = parts.groupBy("parent", "logical", "family").agg(
        F.count("*").alias("members"), F.min("number").alias("low"), F.max("number").alias("high"), F.min("stem").alias("stem"), F.max("stem").alias("other_stem"),
        F.min(F.length("digits")).alias("width"), F.max(F.length("digits")).alias("other_width"), F.min_by("name", "number").alias("first"),
    )
    facts = {f: (suffix, start, headed, whole) for f, _, suffix, start, headed, whole in VOLUMES}
    of = lambda i: F.coalesce(*(F.when(F.col("family") == f, F.lit(x[i])) for f, x in facts.items()))
    heads = free.select("parent", F.col("fold").alias("head_fold"), F.col("name").alias("head"))
    sets = written(sets.withColumn("head_fold", F.concat("logical", of(0))).join(heads, ["parent", "head_fold"], "left"), "sets")
    headed, has = of(2), F.col("head").isNotNull()
    # a file beside parts that need none is a kind of its own
    kinds = sets.groupBy("parent", "logical").agg((F.count("*") + F.count_if(~headed & has)).alias("kinds"))
    sets = sets.join(kinds, ["parent", "logical"])
    total = F.col("members") + F.when(headed & has, 1).otherwise(0)
    uneven = (F.col("stem") != F.col("other_stem")) | F.when(headed, F.lower(F.col("head")).isNull() | (F.expr("substring(head, 1, length(head) - 4)") != F.col("stem"))).otherwise(F.col("width") != F.col("other_width"))
    gap = (F.col("low") != of(1)) | (F.col("high") - F.col("low") + 1 != F.col("members"))
    status = F.when(F.col("kinds") > 1, "AMBIGUOUS_VOLUME").when(headed & ~has, "ORPHAN_VOLUME").when(total > MOST_VOLUMES, "UNSUPPORTED_VOLUME").when(uneven, "AMBIGUOUS_VOLUME").when(gap, "MISSING_VOLUME").otherwise(of(3))
    fine = status.isin("LISTED", "UNSUPPORTED_FORMAT")
    # a stem of several kinds is one finding
    judged = sets.select("parent", "logical", status.alias("status"), F.when(fine, F.when(headed, F.col("head")).otherwise(F.col("first"))).alias("entry"), total.alias("members"))
    judged = judged.groupBy("parent", "logical", "status").agg(F.max("entry").alias("entry"), F.sum("members").cast("long").alias("members"))
    used = parts.select("parent", "fold").unionByName(sets.where(has).select("parent", F.col("head_fold").alias("fold"))).distinct()
    alone = free.where(F.col("fold").rlike(ARCHIVE_SUFFIX)).join(used, ["parent", "fold"], "left_anti").select("parent", F.col("fold").alias("logical"), F.lit("LISTED").alias("status"), F.col("name").alias("entry"), F.lit(1).cast("long").alias("members"))
    return collisions.unionByName(judged).unionByName(alone)


def safe_locator(path: Column) -> Column:
    """A member's path is relative, of bounded length and depth, without control characters, colons, backslashes, empty, ``.`` or ``..`` parts, parts that end with a dot or space, or device names."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda x: x.isin("", ".", "..") | x.rlike("[. ]$") | F.upper(F.substring_index(x, ".", 1)).isin(*DEVICES))
    return (F.length(path) <= PATH_CHARACTERS) & (F.octet_length(path) <= PATH_BYTES) & ~path.rlike(r"[\x00-\x1F\x7F:\\\\]") & (F.size(parts) <= PATH_PARTS) & ~bad


def archive_safety(members: DataFrame) -> DataFrame:
    """``archive_id, violation``: the first rule that an archive's listing breaks, member by member in its order; null if none.

    members: archive_id, ordinal, path, size, packed, kind; and, if there, nested (an archive itself) and special (sparse, streams, rights).
    Paths are equal whatever their case and however their characters are composed. An archive with too many members is settled by their count, so no window holds more than MEMBERS rows.
    """
    for name in ("nested", "special"):
        if name not in members.columns:
            members = members.withColumn(name, F.lit(False))
    counts = members.groupBy("archive_id").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > MEMBERS).select("archive_id", F.lit("MEMBER_COUNT_LIMIT").alias("violation"))
    rows = members.join(large.select("archive_id"), "archive_id", "left_anti").withColumn("key", folded(F.col("path")))
    in_order = Window.partitionBy("archive_id").orderBy("ordinal")
    before = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("total", F.sum("size").over(before)).withColumn("all_packed", F.sum("packed").over(before)).withColumn("again", F.row_number().over(Window.partitionBy("archive_id", "key").orderBy("ordinal")) > 1)
    # a file and something below its path: the later of the two breaks the rule
    parts = F.split("key", "/")
    above = rows.where("size(split(key, '/')) > 1").select("archive_id", F.col("ordinal").alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("key"))
    conflicts = rows.where("kind = 'REGULAR_FILE'").select("archive_id", "key", "ordinal").join(above, ["archive_id", "key"]).groupBy("archive_id", F.greatest("ordinal", "below").alias("ordinal")).agg(F.lit(True).alias("conflict"))
    rows = rows.join(conflicts, ["archive_id", "ordinal"], "left")

    def ratio(size: str, packed: str) -> Column:
        return (F.col(size) > 0) & (F.col(size) > F.col(packed) * RATIO)

    rules = (
        (~F.col("kind").isin("REGULAR_FILE", "DIRECTORY"), "MEMBER_KIND_REJECTED"), (~F.coalesce(safe_locator(F.col("path")), F.lit(False)), "PATH_INVALID"), (F.col("size").isNull() | F.col("packed").isNull(), "UNKNOWN_SIZE"),
        ((F.col("size") < 0) | (F.col("packed") < 0), "NEGATIVE_SIZE"), (F.col("size") > MEMBER_BYTES, "MEMBER_SIZE_LIMIT"), (ratio("size", "packed"), "COMPRESSION_RATIO_LIMIT"), (F.col("nested"), "NESTED_ARCHIVE_REJECTED"), (F.col("special"), "METADATA_REJECTED"),
        (F.col("total") > TOTAL_BYTES, "TOTAL_UNCOMPRESSED_LIMIT"), (ratio("total", "all_packed"), "COMPRESSION_RATIO_LIMIT"), (F.col("again"), "PATH_COLLISION"), (F.col("conflict"), "PARENT_CHILD_CONFLICT"),
    )
    first = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        first = F.when(condition, F.lit(name)).otherwise(first)
    told = rows.withColumn("violation", first).groupBy("archive_id").agg(F.min_by("violation", F.when(F.col("violation").isNotNull(), F.col("ordinal"))).alias("violation"))
    return told.unionByName(large)


def archive_admission(archives: DataFrame, members: DataFrame) -> DataFrame:
    """``archive_id, status, violation, member_count``: whether an archive may be unpacked into its workspace.

    archives: archive_id, volumes, capacity (the workspace's bytes), free (bytes left), overlaps (the workspace meets the
    source). members as for ``archive_safety``. In this order: too many members, volumes, the workspace as it is, the
    members' own rules, then the workspace against what the members unpack to, with RESERVE_BYTES to spare. A violated
    limit is LIMIT_EXCEEDED, any other rule POLICY_REJECTED, none ACCEPTED. Nulls in an archive's facts violate their rules;
    an archive without members unpacks to nothing; members without an archive, and rows of a null archive_id, are left out;
    member_count is 0 where a rule about the archive itself is violated.
    """
    listed = members.where("archive_id is not null").join(archives.select("archive_id").distinct(), "archive_id", "left_semi")
    inside = archive_safety(listed).join(listed.groupBy("archive_id").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("decimal(20,0)")).alias("bytes")), "archive_id")
    each = archives.where("archive_id is not null").select("archive_id", "volumes", "capacity", "free", "overlaps").join(inside, "archive_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    within = lambda value, low, high: F.coalesce(F.col(value).between(low, high), F.lit(False))
    fixed = (
        F.when(F.col("violation") == "MEMBER_COUNT_LIMIT", F.lit("MEMBER_COUNT_LIMIT"))
        .when(~within("volumes", 1, MOST_VOLUMES), F.lit("VOLUME_COUNT_LIMIT"))
        .when(~within("capacity", 0, WORKSPACE_BYTES), F.lit("WORKSPACE_LIMIT"))
        .when(F.col("free").isNull() | (F.col("free") < 0), F.lit("WORKSPACE_RESERVE"))
        .when(F.coalesce("overlaps", F.lit(True)), F.lit("WORKSPACE_OVERLAP"))
    )
    then = F.when(F.col("violation").isNotNull(), F.col("violation")).when(F.col("bytes") > F.col("capacity"), F.lit("WORKSPACE_LIMIT")).when(F.col("free") - RESERVE_BYTES < F.col("bytes"), F.lit("WORKSPACE_RESERVE"))
    told = each.withColumn("itself", fixed).withColumn("violation", F.coalesce("itself", then))
    status = F.when(F.col("violation").isNull(), F.lit("ACCEPTED")).when(F.col("violation").rlike("LIMIT$|^WORKSPACE_RESERVE$"), F.lit("LIMIT_EXCEEDED")).otherwise(F.lit("POLICY_REJECTED"))
    return told.select("archive_id", status.alias("status"), "violation", F.when(F.col("itself").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("member_count"))


def sidecars(files: DataFrame) -> DataFrame:
    """``parent, name, kind`` of files that describe an archive beside them: by whole name, else by suffix."""
    low = F.lower("name")
    kind = F.when((F.length("name") > NAME_CHARACTERS) | F.col("name").rlike(r"[\x00-\x1F\x7F/:\\\\]"), F.lit(None).cast("string"))
    for names, found in SIDECAR_NAMES:
        kind = kind.when(low.isin(*names.split()), F.lit(found))
    for suffix, found in SIDECARS:
        kind = kind.when(low.endswith(f".{suffix}"), F.lit(found))
    return files.withColumn("kind", kind).where("kind is not null")


def equal_source_sets(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``wanted_id, stored_id``: for each wanted set the smallest stored one with exactly the same members. Sets meet by their sorted members, never member by member, and a set that is stored often joins once."""
    w = wanted.groupBy("wanted_id").agg(F.sort_array(F.collect_set("member")).alias("members"))
    s = stored.groupBy("stored_id").agg(F.sort_array(F.collect_set("member")).alias("members"))
    first = s.groupBy("members").agg(F.min("stored_id").alias("stored_id"))
    return w.join(first, "members").select("wanted_id", "stored_id")


def plan_status(plans: DataFrame) -> DataFrame:
    """``plan_id, blockers, status`` from identity, preconditions, quality, preference and reviews; no plan is ever executable."""
    rules = (
        (F.col("identity_status") != "CONFIRMED", "IDENTITY_NOT_CONFIRMED"), (~F.col("preconditions_complete"), "PRECONDITION_INCOMPLETE"), (F.col("root_protected"), "PROTECTED_SOURCE_ROOT"),
        (~F.col("quality_complete"), "QUALITY_EVIDENCE_INCOMPLETE"), (F.col("preference") != "PREFERRED", "KEEP_PREFERENCE_UNRESOLVED"), (F.col("review") == "REJECTED", "CONSOLIDATION_REVIEW_REJECTED"),
    )
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())
    status = F.when(F.size("blockers") > 0, F.lit("BLOCKED")).when(F.col("review") == "ACCEPTED", F.lit("APPROVED_NON_EXECUTABLE")).otherwise(F.lit("REVIEW_REQUIRED"))
    return plans.withColumn("blockers", found).select("plan_id", "blockers", status.alias("status"))


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each run: by number, not by time."""
    return events.groupBy("run_id").agg(F.max_by("status", "sequence_no").alias("status"), F.max("sequence_no").alias("sequence_no"))


def verification(checks: DataFrame) -> DataFrame:
    """The worst state of all checks and its exit code: INVALID 2, PENDING 3, DEGRADED 1, COMPLETE 0."""
    rank = F.when(F.col("state") == "INVALID", 3).when(F.col("state") == "PENDING", 2).when(F.col("state") == "DEGRADED", 1).otherwise(0)
    worst = checks.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"))
    return worst.select(F.element_at(F.array(*(F.lit(x) for x in ("COMPLETE", "DEGRADED", "PENDING", "INVALID"))), F.col("r") + 1).alias("state"), F.element_at(F.array(*(F.lit(x) for x in (0, 1, 3, 2))), F.col("r") + 1).alias("exit_code"))


def archive_plan(files: DataFrame, k: int) -> DataFrame:
    """The first ``k`` archives of each parent in order of name, with their place."""
    n = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    return files.withColumn("n", n).where(F.col("n") <= k).withColumn("ordinal", F.col("n") - 1).drop("n")  # a filter on the number itself is cut to k rows a task before the shuffle


def sidecar_inventory(archives: DataFrame, files: DataFrame, most: int = 32) -> DataFrame:
    """``archive_path, status, name, kind, n_sidecars`` of sidecars directly beside each archive. With more than ``most`` of them none is listed, and one row tells LIMIT_EXCEEDED."""
    beside = files.withColumn("parent", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    found = sidecars(beside.select("parent", "name"))
    # a folder's sidecars are counted once, whatever the number of archives beside them
    counts = found.groupBy("parent").agg(F.count("*").alias("n_sidecars"))
    over = F.col("n_sidecars") > most
    listed = found.join(counts.where(~over), "parent").select("parent", F.lit("LISTED").alias("status"), "name", "kind", "n_sidecars")
    exceeded = counts.where(over).select("parent", F.lit("LIMIT_EXCEEDED").alias("status"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), "n_sidecars")
    places = archives.select(F.col("path").alias("archive_path"), F.regexp_replace("path", "/?[^/]*$", "").alias("parent")).distinct()
    return places.join(listed.unionByName(exceeded), "parent").select("archive_path", "status", "name", "kind", "n_sidecars")


def archive_dependencies(files: DataFrame, sources: DataFrame, members: DataFrame) -> DataFrame:
    """``file_id, state``: KNOWN_PRESENT for a file that is a source of an archive or equals a member, UNKNOWN where its folder's archives aren't listed, else KNOWN_NONE.

    files: file_id, parent, sha256. sources: file_id. members: parent, sha256 (null if not listed).
    """
    used = sources.select("file_id", F.lit(True).alias("source")).distinct()
    same = members.where("sha256 is not null").select("sha256", F.lit(True).alias("member")).distinct()
    blind = members.where("sha256 is null").select("parent", F.lit(True).alias("unlisted")).distinct()
    joined = files.join(used, "file_id", "left").join(same, "sha256", "left").join(blind, "parent", "left")
    state = F.when(F.col("source").isNotNull() | F.col("member").isNotNull(), F.lit("KNOWN_PRESENT")).when(F.col("unlisted").isNotNull(), F.lit("UNKNOWN")).otherwise(F.lit("KNOWN_NONE"))
    return joined.select("file_id", state.alias("state"))


def correction_status(plans: DataFrame) -> DataFrame:
    """``plan_id, blockers, status`` of metadata corrections; like all plans they aren't executable."""
    rules = (
        (~F.col("same_lineage"), "LINEAGE_MISMATCH"), (~F.col("evidence_complete"), "SOURCE_EVIDENCE_INCOMPLETE"), (F.col("old_value").eqNullSafe(F.col("new_value")), "FIELD_SELECTION_INVALID"),
        (F.col("dependency") == "UNKNOWN", "DEPENDENCY_EVIDENCE_INCOMPLETE"), (F.col("review") == "MISSING", "REVIEW_MISSING"), (F.col("review") == "REJECTED", "REVIEW_REJECTED"), (F.col("review") == "STALE", "REVIEW_STALE"),
    )
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())
    status = F.when(F.size("blockers") > 0, F.lit("BLOCKED")).when(F.col("review") == "ACCEPTED", F.lit("APPROVED_NON_EXECUTABLE")).otherwise(F.lit("REVIEW_REQUIRED"))
    return plans.withColumn("blockers", found).select("plan_id", "blockers", status.alias("status"))


def correction_blockers(plans: DataFrame) -> DataFrame:
    """``plan_id, blockers, status`` of metadata corrections by all eleven codes, in order of name; no correction is ever executable.

    Beside the columns of ``correction_status``: carrier_valid, writer_valid, preconditions_complete, verification_complete and
    review_compatible (made of the evidence as it stands). A flag that is null counts as false, a review that is null as missing.
    """
    lacks = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    review = F.coalesce("review", F.lit("MISSING"))
    reviewed = F.when(review == "MISSING", F.lit("REVIEW_MISSING")).when(lacks("review_compatible") | (review == "STALE"), F.lit("REVIEW_STALE")).when(review == "REJECTED", F.lit("REVIEW_REJECTED"))
    rules = (
        (F.coalesce("dependency", F.lit("UNKNOWN")) == "UNKNOWN", "DEPENDENCY_EVIDENCE_INCOMPLETE"), (F.col("old_value").eqNullSafe(F.col("new_value")), "FIELD_SELECTION_INVALID"), (lacks("same_lineage"), "LINEAGE_MISMATCH"),
        (lacks("preconditions_complete"), "PRECONDITION_INCOMPLETE"), (lacks("evidence_complete"), "SOURCE_EVIDENCE_INCOMPLETE"), (lacks("carrier_valid"), "TARGET_CARRIER_INVALID"),
        (lacks("verification_complete"), "VERIFICATION_CONTRACT_INCOMPLETE"), (lacks("writer_valid"), "WRITER_REQUIREMENT_INVALID"),
    )
    found = F.array_sort(F.array_compact(F.array(reviewed, *(F.when(c, F.lit(name)) for c, name in rules))))
    status = F.when(F.size("blockers") > 0, F.lit("BLOCKED")).when(review == "ACCEPTED", F.lit("APPROVED_NON_EXECUTABLE")).otherwise(F.lit("REVIEW_REQUIRED"))
    return plans.withColumn("blockers", found).select("plan_id", "blockers", status.alias("status"))


def quarantine_eligibility(plans: DataFrame, now) -> DataFrame:
    """``plan_id, status, blockers`` for approved plans of exact duplicates within their window, without dependencies."""
    rules = (
        (F.col("plan_status") != "APPROVED_NON_EXECUTABLE", "PLAN_NOT_APPROVED"), (F.col("relation") != "EXACT_DUPLICATE", "IDENTITY_NOT_EXACT_DUPLICATE"),
        (F.col("dependency") != "KNOWN_NONE", "DEPENDENCY_NOT_KNOWN_NONE"), ((now < F.col("valid_from")) | (now >= F.col("valid_until")), "AUTHORIZATION_WINDOW_INVALID"),
    )
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())
    return plans.withColumn("blockers", found).select("plan_id", F.when(F.size("blockers") > 0, F.lit("BLOCKED")).otherwise(F.lit("ELIGIBLE")).alias("status"), "blockers")
