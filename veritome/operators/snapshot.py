"""Collection-state snapshots from typed evidence: loaders of nine components, one timeline of runs, one reduction by file.

Every loader gives rows of one shape, whatever its tables: what the evidence is about (a file or one of its observations),
the run that it belongs to, whether it is a conflict, what it says as JSON, and the profiles it was made by. They are
stacked, brought to files by one join, scoped by one table of runs, and summed up. Sums, flags and digests are algebraic,
so rows are combined before each shuffle, and a file that holds a third of all evidence is no task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.operators.relational import dealt, ordered_digest
from veritome.operators.state import COMPONENTS
from veritome.sources.shared import written

Tables = Mapping[str, DataFrame]

# Profile versions that a component lists, statuses of a quarantine's steps that are no conflict, and counters of an archive plan that are one.
PROFILES = 128
SAFE_STEPS = ("PREPARED", "MOVED", "VERIFIED", "COMPLETED")
PLAN_COUNTERS = ("missing_volume_count", "unsupported_volume_count", "ambiguous_volume_count", "name_collision_count", "orphan_volume_count")
FORMATS = ("AZW", "AZW3", "EPUB", "MOBI", "OTHER", "PDF")
FILE, OBSERVATION = "FILE", "FILE_OBSERVATION"
_LANES = 8


def _rows(
    found: DataFrame, component: str, source: str, *, kind: Column | str, subject: str, run: str | None = None, bound: bool = False, conflict: Column | None = None, choice: tuple[str, Column] | None = None, profiles: Sequence[Column] = (), without: Sequence[str] = ()
) -> DataFrame:
    """Evidence in the common shape. run: a column with its run, else that of the observation it is about. bound: current only if about the item's own observation. choice: a key and a value that must be the only one under it in a file and scope."""
    said = F.to_json(F.struct(*(F.col(c) for c in sorted(found.columns) if c not in without)))
    # the digest goes through joins in place of what it is of, as bytes
    told = F.unhex(F.sha2(F.concat_ws("\u001f", F.lit(source), said), 256))
    key, value = choice or (None, F.lit(None))
    return found.select(
        F.lit(component).alias("component"), F.lit(source).alias("source"), (F.lit(kind) if isinstance(kind, str) else kind).alias("subject_kind"), F.col(subject).cast("string").alias("subject_id"),
        (F.col(run) if run else F.lit(None)).cast("string").alias("run_id"), F.lit(bound).alias("bound"), F.coalesce(conflict if conflict is not None else F.lit(False), F.lit(False)).alias("conflict"),
        (F.col(key) if key else F.lit(None)).cast("string").alias("choice_key"), value.cast("string").alias("choice"), F.array(*profiles).cast("array<string>").alias("profiles"), told.alias("told"),
    )


def _under(child: DataFrame, parent: DataFrame, by: str, how: str = "inner", key: str = "id", prefix: str = "") -> DataFrame:
    """``child`` with the columns of ``parent`` that it hasn't got; ``child.by`` names the parent."""
    taken = {c.lower() for c in child.columns}
    named = parent.select(F.col(key).alias("parent__"), *(F.col(c).alias(prefix + c) for c in parent.columns if c != key and (prefix + c).lower() not in taken))
    return child.join(named, F.col(by) == F.col("parent__"), how).drop("parent__")


def _tagged(tag: str, name: str, version: str | None = None) -> Column:
    """``tag:name`` or ``tag:name@version``; null without either."""
    return F.concat(F.lit(f"{tag}:"), F.col(name).cast("string"), *((F.lit("@"), F.col(version).cast("string")) if version else ()))


def technical(t: Tables) -> DataFrame:
    """What identifies a file's content: its observation, events of the run, and fingerprints that no tool made. All of it counts as current."""
    events = _rows(t["file_scan_events"], "TECHNICAL", "file_scan_event", kind=FILE, subject="file_id", run="scan_run_id")
    plain = t["fingerprints"].where("tool_execution_id is null")
    return events.unionByName(_rows(plain, "TECHNICAL", "technical_fingerprint", kind=F.col("target_kind"), subject="target_id"))


def analysis(t: Tables) -> DataFrame:
    """Items, findings and executions of collection runs; results and fingerprints of tools. Metadata candidates of the current run conflict where a key has several values."""
    items = _under(t["collection_items"], t["collection_runs"].withColumnRenamed("status", "run_status"), "run_id")
    profiles = [F.col("profile"), F.col("analysis_profile")]
    found = [_rows(items, "ANALYSIS", "ebook_collection_item", kind=OBSERVATION, subject="observation_id", run="source_scan_run_id", bound=True, profiles=profiles)]
    parents = items.select("id", "observation_id", "source_scan_run_id", "profile", "analysis_profile")
    hidden = ("source_scan_run_id", "profile", "analysis_profile", "observation_id")
    for name, source in (("collection_findings", "ebook_collection_finding"), ("collection_executions", "ebook_collection_execution")):
        found.append(_rows(_under(t[name], parents, "item_id"), "ANALYSIS", source, kind=OBSERVATION, subject="observation_id", run="source_scan_run_id", bound=True, profiles=profiles, without=hidden))
    results = _under(t["tool_results"], t["tool_executions"].withColumnRenamed("status", "execution_status"), "execution_id")
    tool = [_tagged("tool", "provider_id", "tool_version"), _tagged("adapter", "adapter_version")]
    observed, candidate = results.where(F.col("target_kind") == OBSERVATION), F.col("result_type") == "ebook_metadata_candidate"
    observed = observed.withColumn("candidate_key", F.when(candidate, F.col("key")))
    found.append(_rows(observed, "ANALYSIS", "tool_result", kind=OBSERVATION, subject="target_id", choice=("candidate_key", F.col("value")), profiles=[*tool, _tagged("capability", "capability")], without=("candidate_key",)))
    found.append(_rows(results.where(F.col("target_kind") == FILE), "ANALYSIS", "file_tool_result", kind=FILE, subject="target_id", profiles=tool))
    made = _under(t["fingerprints"].where(F.col("tool_execution_id").isNotNull() & (F.col("target_kind") == OBSERVATION)), t["tool_executions"].drop("status"), "tool_execution_id", "left")
    found.append(_rows(made, "ANALYSIS", "analysis_fingerprint", kind=OBSERVATION, subject="target_id", profiles=[*tool, _tagged("fingerprint", "algorithm", "algorithm_version")]))
    return reduce(DataFrame.unionByName, found)


def resolution(t: Tables) -> DataFrame:
    """Candidates with each piece of their evidence; conflicts are a second entity of one kind, and evidence that contradicts."""
    proof = t["resolution_evidence"].withColumnRenamed("id", "evidence_link_id")
    found = t["resolution_candidates"].withColumnRenamed("id", "candidate_id")
    found = found.join(proof.withColumnRenamed("resolution_candidate_id", "candidate_id"), "candidate_id", "left")
    profiles = [_tagged("resolver", "resolver_name", "resolver_version"), _tagged("decision", "decision_compatibility_version")]
    return _rows(found, "RESOLUTION", "resolution_candidate", kind=F.col("subject_kind"), subject="subject_id", conflict=F.col("evidence_role") == "CONTRADICTS", choice=("candidate_kind", F.col("candidate_entity_id")), profiles=profiles)


def classification(t: Tables) -> DataFrame:
    """Projections of the entities that a subject resolves to, with each value; conflicts are those to be reviewed and values with a conflict code."""
    subject = t["resolution_candidates"].select(F.col("id").alias("resolution_candidate_id"), "subject_kind", "subject_id", F.col("candidate_kind").alias("target_kind"), F.col("candidate_entity_id").alias("target_id"))
    found = subject.join(t["projections"].withColumnRenamed("id", "projection_id"), ["target_kind", "target_id"]).join(t["projection_values"], "projection_id", "left")
    return _rows(found, "CLASSIFICATION", "classification_projection", kind=F.col("subject_kind"), subject="subject_id", conflict=(F.col("status") == "REVIEW_REQUIRED") | F.col("conflict_code").isNotNull(), profiles=[F.col("assertion_profile_version"), F.col("projection_profile_version")], without=("subject_kind", "subject_id"))


def matching(t: Tables) -> DataFrame:
    """Relation candidates at each file they relate, with each feature; a contradictory feature that is present is a conflict."""
    found = t["relation_candidates"].withColumnRenamed("id", "candidate_id").join(t["relation_evidence"].withColumnRenamed("relation_candidate_id", "candidate_id").withColumnRenamed("id", "evidence_link_id"), "candidate_id", "left")
    ends = [F.when(F.col(f"{side}_kind") == FILE, F.col(f"{side}_id").cast("string")) for side in ("left", "right")]
    found = found.withColumn("end__", F.explode(F.array_distinct(F.array_compact(F.array(*ends)))))
    profiles = [_tagged("matcher", "matcher_name", "matcher_version"), _tagged("decision", "decision_compatibility_version")]
    return _rows(found, "MATCHING", "relation_candidate", kind=FILE, subject="end__", run="source_scan_run_id", conflict=F.col("feature_code").endswith("CONTRADICTORY") & (F.col("feature_state") == "PRESENT"), profiles=profiles, without=("end__",))


def review(t: Tables) -> DataFrame:
    """Review items with each decision; never a conflict."""
    found = t["review_items"].withColumnRenamed("id", "review_item_id").join(t["review_decisions"].withColumnRenamed("id", "decision_id"), "review_item_id", "left")
    profiles = [_tagged("review", "producer_name", "producer_version"), _tagged("decision", "decision_compatibility_version")]
    return _rows(found, "REVIEW", "review_item", kind=F.col("subject_kind"), subject="subject_id", profiles=profiles, without=("subject_kind", "subject_id"))


def calibre(t: Tables) -> DataFrame:
    """Formats and sidecars of library records, and references of findings; a finding with CONFLICT in its code is one."""
    snapshots = t["calibre_snapshots"].withColumnRenamed("status", "snapshot_status")
    profiles = [F.col("profile"), _tagged("adapter", "adapter_version"), F.concat(F.lit("tool:calibre@"), F.col("tool_version").cast("string")), _tagged("parser", "parser_version")]
    records = _under(t["calibre_records"], snapshots, "snapshot_id").select("id", "snapshot_id", *(c for c in snapshots.columns if c != "id"))
    found = [_rows(_under(t[name].where("observation_id is not null"), records, "record_snapshot_id"), "CALIBRE", source, kind=OBSERVATION, subject="observation_id", run="source_scan_run_id", bound=True, profiles=profiles) for name, source in (("calibre_formats", "calibre_format"), ("calibre_sidecars", "calibre_sidecar"))]
    findings = _under(t["calibre_findings"], snapshots, "snapshot_id")
    refs = _under(t["calibre_finding_refs"].where(F.col("ref_kind") == OBSERVATION), findings, "finding_id")
    found.append(_rows(refs, "CALIBRE", "calibre_finding", kind=OBSERVATION, subject="ref_id", run="source_scan_run_id", bound=True, conflict=F.col("code").contains("CONFLICT"), profiles=profiles))
    return reduce(DataFrame.unionByName, found)


def archive(t: Tables) -> DataFrame:
    """Sources of archive observations, sidecars, and sources of collection runs; conflicts are failed integrity, unclear recognition and counters of a plan's findings."""
    def profiles_of(table: DataFrame) -> list[Column]:
        return [F.col(c) for c in table.columns if c == "profile" or c.endswith("_profile")]

    broken = F.col("integrity_status").isin("FAILED", "CORRUPT") | F.col("recognition_status").isin("UNSUPPORTED", "AMBIGUOUS")
    sources = _under(t["archive_sources"], t["archive_observations"], "archive_observation_id")
    found = [_rows(sources, "ARCHIVE", "archive_observation", kind=OBSERVATION, subject="file_observation_id", run="source_scan_run_id", bound=True, conflict=broken, profiles=profiles_of(sources))]
    sidecars = _under(t["sidecar_items"], t["sidecar_inventories"], "inventory_id")
    found.append(_rows(sidecars, "ARCHIVE", "archive_sidecar_inventory", kind=OBSERVATION, subject="sidecar_file_observation_id", run="source_scan_run_id", bound=True, profiles=[F.col("profile")]))
    planned = _under(t["archive_run_sources"], t["archive_runs"].withColumnRenamed("status", "run_status"), "run_id")
    counted = reduce(Column.__or__, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in PLAN_COUNTERS])
    found.append(_rows(planned, "ARCHIVE", "archive_collection_item", kind=OBSERVATION, subject="file_observation_id", run="source_scan_run_id", bound=True, conflict=counted, profiles=[F.col("profile"), F.col("plan_profile")]))
    return reduce(DataFrame.unionByName, found)


def _plan_ends() -> Column:
    return F.explode(F.array_distinct(F.array_compact(F.array(F.col("keeper_file_id").cast("string"), F.col("candidate_file_id").cast("string")))))


def consolidation(t: Tables) -> DataFrame:
    """Plans at both their files, with each blocker, and quality evidence; conflicts are blockers, and quality to be reviewed or acted on."""
    plans = t["plans"].withColumnRenamed("id", "plan_id").join(t["plan_blockers"].select("plan_id", F.col("ordinal").alias("blocker_ordinal"), F.col("code").alias("blocker_code")), "plan_id", "left").withColumn("end__", _plan_ends())
    found = _rows(plans, "CONSOLIDATION", "consolidation_plan", kind=FILE, subject="end__", run="source_scan_run_id", conflict=F.col("blocker_code").isNotNull(), profiles=[F.col("profile"), _tagged("plan", "plan_version"), _tagged("serializer", "serializer_version")], without=("end__",))
    quality = _rows(t["quality_evidence"], "CONSOLIDATION", "consolidation_quality_evidence", kind=OBSERVATION, subject="observation_id", run="source_scan_run_id", bound=True, conflict=F.col("aggregate_quality_status").isin("REVIEW", "ACTION_REQUIRED"), profiles=[F.col(c) for c in ("profile", "collection_profile", "analysis_profile", "quality_profile")])
    return found.unionByName(quality)


def quarantine(t: Tables) -> DataFrame:
    """Authorizations of plans at both files, with each run and step; a step with another status than SAFE_STEPS is a conflict."""
    runs = t["quarantine_runs"].select(F.col("id").alias("run_id"), "authorization_id", F.col("profile").alias("run_profile"), "created_at")
    steps = t["quarantine_events"].select("run_id", "sequence_no", F.col("status").alias("event_status"), "occurred_at", "finding_code")
    allowed = t["authorizations"].select(F.col("id").alias("authorization_id"), "plan_id", F.col("profile").alias("authorization_profile"), "content_hash", "authorized_at", "expires_at")
    found = _under(allowed, t["plans"].select("id", "source_scan_run_id", "keeper_file_id", "candidate_file_id"), "plan_id").join(runs, "authorization_id", "left").join(steps, "run_id", "left").withColumn("end__", _plan_ends())
    unsafe = F.col("event_status").isNotNull() & ~F.col("event_status").isin(*SAFE_STEPS)
    return _rows(found, "QUARANTINE", "quarantine_execution", kind=FILE, subject="end__", run="source_scan_run_id", conflict=unsafe, profiles=[F.col("authorization_profile"), F.col("run_profile")], without=("end__",))


LOADERS: dict[str, Callable[[Tables], DataFrame]] = {
    "ANALYSIS": analysis, "RESOLUTION": resolution, "CLASSIFICATION": classification, "MATCHING": matching, "REVIEW": review, "CALIBRE": calibre, "ARCHIVE": archive, "CONSOLIDATION": consolidation, "QUARANTINE": quarantine,
}


def timeline(runs: DataFrame, source_run: str) -> DataFrame:
    """``run_id, scope``: the source run is CURRENT, completed ones of its root before it are STALE, others are left out. A source run that is unknown or not completed raises."""
    source = runs.where(F.col("id") == source_run).limit(1).collect()
    if not source or source[0]["status"] != "COMPLETED" or source[0]["completed_at"] is None:
        raise ValueError("the source run isn't a completed one")
    root, done = source[0]["scan_root_id"], F.lit(source[0]["completed_at"])
    current = F.col("id") == source_run
    earlier = (F.col("status") == "COMPLETED") & (F.col("completed_at") < done)
    return runs.where((F.col("scan_root_id") == root) & (current | earlier)).select(F.col("id").cast("string").alias("run_id"), F.when(current, "CURRENT").otherwise("STALE").alias("scope"))


def at_files(evidence: DataFrame, observations: DataFrame, scopes: DataFrame) -> DataFrame:
    """Evidence with ``file_id`` and ``scope``: by its own run, else that of the observation it is about; UNSCOPED about a file without a run. What belongs to other runs or unknown observations goes."""
    seen = observations.select(F.col("id").cast("string").alias("subject_id"), F.lit(OBSERVATION).alias("subject_kind"), F.col("file_id").cast("string").alias("of__"), F.col("scan_run_id").cast("string").alias("in__"))
    about = evidence.join(seen, ["subject_kind", "subject_id"], "left")
    about = about.withColumn("file_id", F.when(F.col("subject_kind") == FILE, F.col("subject_id")).otherwise(F.col("of__"))).withColumn("run_id", F.coalesce("run_id", "in__")).where("file_id is not null")
    known = about.join(scopes.withColumnRenamed("scope", "known__"), "run_id", "left")
    scope = F.when(F.col("run_id").isNull() & (F.col("subject_kind") == FILE), "UNSCOPED").otherwise(F.col("known__"))
    return known.withColumn("scope", scope).where("scope is not null").drop("of__", "in__", "known__")


def _lanes(digest: Column) -> list[Column]:
    """A digest as numbers that can be summed up: sums of rows' numbers tell sets of rows apart, in whatever order."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"lane{i}") for i in range(_LANES)]


def item_evidence(items: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each item: its columns and, by component, ``state, n, digest``.

    found: rows of ``load``. Current evidence about another observation than the item's is stale. The best scope
    that there is names the state, any conflict in any scope marks it, items without evidence are MISSING with a null
    digest. Evidence is summed up by file, component, scope and observation, combined before that shuffle; those sums
    meet the items in one more by file.
    """
    keys = ["file_id", "component", "scope", F.when(F.col("bound"), F.col("subject_id")).alias("bound_id"), "choice_key"]
    hashed = found.select("file_id", "component", "scope", "bound", "subject_id", "choice_key", "choice", "conflict", *_lanes(F.hex("told")))
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or("conflict").alias("c"), F.min("choice").alias("low"), F.max("choice").alias("high"), *(F.sum(f"lane{i}").alias(f"lane{i}") for i in range(_LANES)))
    several = F.col("choice_key").isNotNull() & (F.col("low") != F.col("high"))
    # only the component of analysis asks for one value in current evidence alone
    sums = sums.withColumn("c", F.col("c") | F.coalesce(several & ((F.col("component") != "ANALYSIS") | (F.col("scope") == "CURRENT")), F.lit(False)))
    own = items.withColumn("item_observation__", F.col("observation_id").cast("string")).withColumn("file__", F.col("file_id").cast("string"))
    met = own.join(sums.withColumnRenamed("file_id", "of__"), F.col("file__") == F.col("of__"), "left")
    scope = F.when((F.col("scope") == "CURRENT") & F.col("bound_id").isNotNull() & (F.col("bound_id") != F.col("item_observation__")), "STALE").otherwise(F.col("scope"))
    met = met.withColumn("scope", scope)

    def of(component: str) -> list[Column]:
        here = F.col("component") == component
        number = lambda s: F.coalesce(F.sum(F.when(here & (F.col("scope") == s), F.col("n"))), F.lit(0))
        lanes = F.concat_ws(":", *(F.sum(F.when(here, F.col(f"lane{i}"))).cast("string") for i in range(_LANES)))
        counts = [number(s) for s in ("CURRENT", "STALE", "UNSCOPED")]
        name = F.when(counts[0] > 0, "CURRENT").when(counts[1] > 0, "STALE").when(counts[2] > 0, "UNSCOPED").otherwise("MISSING")
        state = F.when(F.coalesce(F.bool_or(F.when(here, F.col("c"))), F.lit(False)), F.concat(name, F.lit("_CONFLICT"))).otherwise(name)
        n = counts[0] + counts[1] + counts[2]
        digest = F.when(n > 0, F.sha2(F.concat_ws("|", F.lit(component), *(c.cast("string") for c in counts), lanes), 256))
        return [F.struct(state.alias("state"), n.alias("n"), digest.alias("digest")).alias(component)]

    names = list(dict.fromkeys([*COMPONENTS, "TECHNICAL"]))
    kept = [c for c in items.columns if c not in ("file_id",)]
    wide = met.groupBy("file__").agg(*(F.any_value(c).alias(c) for c in ["file_id", *kept]), *(x for c in names for x in of(c)))
    return wide.drop("file__")


def items_written(items: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """``item_evidence`` as a table, made by tasks whose number follows the ``rows`` of the largest table of evidence."""
    with dealt(items.sparkSession, rows):
        return written(item_evidence(items, found), "items")


def item_rows(wide: DataFrame) -> DataFrame:
    """``file_id, component, state, n, digest`` for each item and component; the input of ``state.item_findings`` and ``state.diffable``."""
    return wide.select("file_id", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), f"{c}.state", f"{c}.n", f"{c}.digest") for c in COMPONENTS))).alias("x")).select("file_id", "x.*")


def summaries(wide: DataFrame) -> DataFrame:
    """A row for each component: items by scope, evidence, coverage, freshness, conflicts. No items are COMPLETE and CURRENT.

    Coverage is COMPLETE if all items are current, PARTIAL if any is current or unscoped. Freshness is MIXED if stale items
    stand beside current or unscoped ones, STALE if they stand alone, UNKNOWN if unscoped ones are left or none, else CURRENT.
    """
    states = item_rows(wide)
    names = wide.sparkSession.createDataFrame([(i, c) for i, c in enumerate(COMPONENTS)], "ordinal int, component string")
    starts = {s.lower(): F.count_if(F.col("state").startswith(s)) for s in ("CURRENT", "STALE", "UNSCOPED", "MISSING")}
    counted = states.groupBy("component").agg(F.count("*").alias("items"), F.sum("n").alias("evidence"), *(n.alias(s) for s, n in starts.items()), F.count_if(F.col("state").endswith("_CONFLICT")).alias("conflicts"))
    every = names.join(counted, "component", "left").na.fill(0)
    coverage = F.when(F.col("current") == F.col("items"), "COMPLETE").when(F.col("current") + F.col("unscoped") > 0, "PARTIAL").otherwise("NONE")
    fresh = F.when(F.col("items") == 0, "CURRENT").when((F.col("stale") > 0) & (F.col("current") + F.col("unscoped") > 0), "MIXED").when(F.col("stale") > 0, "STALE").when(F.col("unscoped") > 0, "UNKNOWN").when(F.col("current") > 0, "CURRENT").otherwise("UNKNOWN")
    return every.withColumn("coverage", coverage).withColumn("freshness", fresh).withColumn("conflict", F.when(F.col("conflicts") > 0, "PRESENT").otherwise("NONE"))


def profiles(found: DataFrame, items: DataFrame, most: int = PROFILES) -> DataFrame:
    """``component, profiles, truncation``: the profile versions of evidence about items, the first ``most`` in order; PROFILE_VERSIONS if there are more."""
    held = found.join(items.select(F.col("file_id").cast("string").alias("file_id")), "file_id", "left_semi")
    # grouped twice: different ones first, so a component's list holds each once
    each = held.select("component", F.explode("profiles").alias("p")).select("component", F.trim("p").alias("p")).where("p <> ''").distinct()
    listed = each.groupBy("component").agg(F.sort_array(F.collect_set("p")).alias("every"))
    return listed.select("component", F.slice("every", 1, most).alias("profiles"), F.when(F.size("every") > most, "PROFILE_VERSIONS").otherwise("NONE").alias("truncation"))


def counts(wide: DataFrame, summary: DataFrame) -> DataFrame:
    """``count_key, count_value``: items and bytes, items by format, and the numbers of each component."""
    total = wide.agg(F.count("*").alias("physical.item_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("physical.byte_count"), *(F.count_if(F.col("format_name") == f).alias(f"physical.format.{f.lower()}") for f in FORMATS))
    pairs = lambda names: F.explode(F.array(*(F.struct(F.lit(n).alias("count_key"), F.col(f"`{n}`").cast("long").alias("count_value")) for n in names))).alias("x")
    physical = total.select(pairs(total.columns)).select("x.*")
    of = (("conflict_items", "conflicts"), ("current_items", "current"), ("evidence_links", "evidence"), ("missing_items", "missing"), ("stale_items", "stale"), ("unscoped_items", "unscoped"))
    each = summary.select(F.explode(F.array(*(F.struct(F.concat(F.lower("component"), F.lit(f".{key}")).alias("count_key"), F.col(c).cast("long").alias("count_value")) for key, c in of))).alias("x")).select("x.*")
    return physical.unionByName(each)


@dataclass(frozen=True)
class Snapshot:
    """Items with their components, the components' summaries, counts, and one digest over all of it."""

    items: DataFrame
    components: DataFrame
    counts: DataFrame
    seal: DataFrame


def items_of(observations: DataFrame, files: DataFrame, source_run: str) -> DataFrame:
    """``file_id, observation_id, format_name, size_bytes`` of the book files seen in the source run. Two observations of one file there raise."""
    from veritome.functions.scalars import book_format

    label = book_format(F.regexp_replace("relative_path", r"\\", "/"))
    seen = observations.where(F.col("scan_run_id") == source_run).join(files.where("media_type = 'EBOOK'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    one = seen.groupBy("file_id").agg(F.count("*").alias("n"), F.any_value("id").alias("observation_id"), F.any_value("relative_path").alias("relative_path"), F.any_value("size_bytes").alias("size_bytes"))
    twice = F.raise_error(F.lit("two observations of one file in the source run"))
    return one.select("file_id", F.when(F.col("n") > 1, twice).otherwise(F.col("observation_id")).alias("observation_id"), F.when(label == "UNKNOWN", "OTHER").otherwise(label).alias("format_name"), "size_bytes")


def build(t: Tables, source_run: str, components: Sequence[str] = COMPONENTS) -> Snapshot:
    """The snapshot of the source run from all typed tables ``t`` (``runs, observations, files`` and those of the loaders)."""
    items = items_of(t["observations"], t["files"], source_run)
    found = written(load(t, source_run, components), "evidence")  # read for sums and for profiles; the loaders run once
    wide = written(item_evidence(items, found), "items")
    summary = summaries(wide).join(profiles(found, items), "component", "left").withColumn("profiles", F.coalesce("profiles", F.array().cast("array<string>"))).withColumn("truncation", F.coalesce("truncation", F.lit("NONE")))
    counted = counts(wide, summary)
    chained = wide.select("file_id", F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(wide.columns))), {"ignoreNullFields": "false"}), 256).alias("item_digest"))
    return Snapshot(wide, summary, counted, ordered_digest(chained, ["file_id"]))


def load(t: Tables, source_run: str, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """The evidence of some components, and what is technical, at files and in scope; ``told`` is a digest of source and material, as bytes."""
    rows = [technical(t), *(LOADERS[c](t) for c in components)]
    scopes = timeline(t["runs"], source_run)
    found = at_files(reduce(DataFrame.unionByName, rows), t["observations"], scopes)
    # events and fingerprints of the content are the item's own or none
    return found.where((F.col("component") != "TECHNICAL") | (F.col("scope") != "STALE"))
