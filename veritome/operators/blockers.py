"""What stands in the way of a consolidation plan: seventeen codes from plans, preconditions, quality, dependencies and reviews.

Each table is reduced to a row for each plan by aggregates that combine before the shuffle; nothing is listed but codes of a fixed vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles of files, what each must meet, and the codes.
ROLES = ("KEEPER", "CANDIDATE")
FILE_CONDITIONS = ("FILE_RECORD_UNCHANGED", "FILE_OBSERVATION_CURRENT", "PRESENCE_IS_PRESENT", "FULL_SHA256_MATCHES", "SIZE_MATCHES", "MODIFIED_AT_MATCHES")
RELATION_CONDITIONS = {"CALIBRE": "CALIBRE_RELATIONSHIP_UNCHANGED", "SIDECAR": "SIDECAR_RELATIONSHIP_UNCHANGED", "ARCHIVE": "ARCHIVE_RELATIONSHIP_UNCHANGED"}
REVIEW_CONDITION, KEEPER_CONDITION = "REVIEW_APPROVALS_UNCHANGED", "KEEPER_READABLE"
DEPENDENCY_CODES = {
    "CALIBRE": ("CALIBRE_RELATIONSHIP_UNKNOWN", "CALIBRE_OWNERSHIP_PRESENT"),
    "SIDECAR": ("SIDECAR_RELATIONSHIP_UNKNOWN", "SIDECAR_DEPENDENCY_PRESENT"),
    "ARCHIVE": ("ARCHIVE_RELATIONSHIP_UNKNOWN", "ARCHIVE_MEMBERSHIP_PRESENT"),
}
# The review of each role, its codes, who must have asked for it and by which version.
REVIEWS = {
    "KEEPER": ("KEEP_PREFERENCE", "KEEP_PREFERENCE_REVIEW_MISSING", "KEEP_PREFERENCE_REVIEW_REJECTED", "ebook-keep-preference"),
    "CANDIDATE": ("CONSOLIDATION_CANDIDATE", "CONSOLIDATION_REVIEW_MISSING", "CONSOLIDATION_REVIEW_REJECTED", "ebook-consolidation-candidate"),
}

_PLAN = ("plan_id", "relation", "left_kind", "right_kind", "left_file_id", "right_file_id", "match_status", "scan_root_id", "scan_run_id", "run_completed", "sha_equal", "lineage_matches", "root_protected", "preference")
_SIGNATURE = ("file_id", "observation_id", "scan_root_id", "scan_run_id", "presence", "sha256", "size_bytes", "modified_at", "observed_at")
_DEPENDENCY = ("state", "fingerprint", "snapshot_kind", "snapshot_id")
_REVIEW = ("review_item_id", "decision_id", "sequence_no", "version", "evidence", "candidates")


def _same(low: Column, high: Column) -> Column:
    """There is one value and no other."""
    return low.isNotNull() & (low == high)


def _conditions(preconditions: DataFrame) -> DataFrame:
    """Of each plan: each role's file as all its conditions expect it, whether its codes are as required, and the review that it names."""
    role, code = F.col("role"), F.col("code")
    signature, named = F.struct(*(F.col(c) for c in _SIGNATURE)), F.struct(*(F.col(c) for c in _REVIEW))
    made = [F.count(F.lit(1)).alias("n")]
    for r in ROLES:
        required = {*FILE_CONDITIONS, *RELATION_CONDITIONS.values(), REVIEW_CONDITION} | ({KEEPER_CONDITION} if r == "KEEPER" else set())
        # one row of each required code, and no other row
        made.append(sum((F.count_if((role == r) & (code == c)) == 1).cast("int") for c in sorted(required)).alias(f"met_{r}"))
        made += [F.min(F.when(role == r, signature)).alias(f"file_{r}"), F.max(F.when(role == r, signature)).alias(f"high_{r}")]
        made.append(F.min(F.when((role == r) & (code == REVIEW_CONDITION), named)).alias(f"named_{r}"))
    one = preconditions.groupBy("plan_id").agg(*made)
    required = 2 * (len(FILE_CONDITIONS) + len(RELATION_CONDITIONS) + 1) + 1
    signed = _same(F.col("file_KEEPER"), F.col("high_KEEPER")) & _same(F.col("file_CANDIDATE"), F.col("high_CANDIDATE"))
    whole = (F.col("n") == required) & (F.col("met_KEEPER") + F.col("met_CANDIDATE") == required)
    return one.select("plan_id", signed.alias("signed"), whole.alias("whole"), *(f"{x}_{r}" for r in ROLES for x in ("file", "named")))


def _relations(dependencies: DataFrame, preconditions: DataFrame) -> DataFrame:
    """Of each plan: the codes of its dependencies, and whether all six stand once and as the preconditions expect."""
    found = F.struct(*(F.col(c) for c in _DEPENDENCY))
    kind = F.coalesce(*(F.when(F.col("code") == c, F.lit(k)) for k, c in RELATION_CONDITIONS.items()))
    expected = F.struct(F.col("dependency_kind"), *(F.col(f"dependency_{c}").alias(c) for c in _DEPENDENCY))
    none = F.lit(None)
    there = dependencies.select("plan_id", "role", "kind", found.alias("found"), none.cast(f"struct<dependency_kind:string,{','.join(f'{c}:string' for c in _DEPENDENCY)}>").alias("expected"))
    asked = preconditions.select("plan_id", "role", kind.alias("kind"), none.cast(f"struct<{','.join(f'{c}:string' for c in _DEPENDENCY)}>").alias("found"), expected.alias("expected")).where("kind is not null")
    each = there.unionByName(asked).groupBy("plan_id", "role", "kind").agg(F.count("found").alias("n"), F.min("found").alias("found"), F.min("expected").alias("expected"))
    f, e = F.col("found"), F.col("expected")
    state = F.when(F.col("n") != 1, "UNKNOWN").when((f["state"] == "NOT_APPLICABLE") & (f["snapshot_kind"].isNull() | f["snapshot_id"].isNull()), "UNKNOWN").otherwise(F.coalesce(f["state"], F.lit("UNKNOWN")))
    fits = (F.col("n") == 1) & F.coalesce(e["dependency_kind"] == F.col("kind"), F.lit(False))
    for c in _DEPENDENCY:
        fits = fits & e[c].eqNullSafe(f[c])
    told = each.select("plan_id", "role", "kind", state.alias("state"), fits.alias("fits"))
    made = []
    for k, (unknown, present) in DEPENDENCY_CODES.items():
        known = [F.coalesce(F.max(F.when((F.col("role") == r) & (F.col("kind") == k), F.col("state"))), F.lit("UNKNOWN")) for r in ROLES]
        made += [F.when((known[0] == "UNKNOWN") | (known[1] == "UNKNOWN"), F.lit(unknown)).alias(unknown), F.when(known[1] == "KNOWN_PRESENT", F.lit(present)).alias(present)]
    expected_pairs = F.col("role").isin(*ROLES) & F.col("kind").isin(*DEPENDENCY_CODES)
    return told.groupBy("plan_id").agg((F.count_if(expected_pairs & F.col("fits")) == 6).alias("as_expected"), *made)


def _reviews(reviews: DataFrame) -> DataFrame:
    """Of each plan the one review of each kind; two of a kind count as none."""
    made = []
    for r, (kind, *_) in REVIEWS.items():
        mine = F.col("review_type") == kind
        made += [F.count_if(mine).alias(f"reviews_{r}"), F.min(F.when(mine, F.struct("state", "producer", *_REVIEW))).alias(f"review_{r}")]
    return reviews.groupBy("plan_id").agg(*made)


def _quality(quality: DataFrame) -> DataFrame:
    made = [F.count(F.lit(1)).alias("qualities")]
    for r in ROLES:
        made.append(F.min(F.when(F.col("role") == r, F.struct("scan_root_id", "scan_run_id", "observation_id"))).alias(f"quality_{r}"))
    return quality.groupBy("plan_id").agg(*made)


def consolidation_blockers(plans: DataFrame, preconditions: DataFrame, quality: DataFrame, dependencies: DataFrame, reviews: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``plan_id, blockers, status``: the codes in order of name, and BLOCKED, REVIEW_REQUIRED or APPROVED_NON_EXECUTABLE. No plan is ever executable.

    plans: plan_id (unique), relation, left_kind, right_kind, left_file_id, right_file_id, match_status (null relation: no identity),
    scan_root_id, scan_run_id, run_completed, sha_equal, lineage_matches, root_protected, preference.
    preconditions: plan_id, role, code, the file as expected, dependency_* and what is expected of reviews. quality: plan_id, role, scan_root_id,
    scan_run_id, observation_id. dependencies: plan_id, role, kind, state, fingerprint, snapshot_kind, snapshot_id. reviews: plan_id,
    review_type, state, producer and decision. versions: the version that each review's decision must be made by.

    Null flags count against a plan. Pending and deferred reviews are no blockers, only preconditions that aren't complete. A plan that the other
    tables don't name lacks what they would tell; rows of other plans are passed over; an empty table of plans gives an empty one.
    """
    all_ = plans.select(*_PLAN)  # whatever else the plans hold may be named like a column on the way
    for part in (_conditions(preconditions), _quality(quality), _relations(dependencies, preconditions), _reviews(reviews)):
        all_ = all_.join(part, "plan_id", "left")
    no = F.lit(False)
    true = lambda name: F.coalesce(F.col(name), no)
    keeper, candidate = F.col("file_KEEPER"), F.col("file_CANDIDATE")
    known = F.col("relation").isNotNull()
    signed = true("signed")
    exact = (F.col("relation") == "EXACT_DUPLICATE") & (F.col("left_kind") == "FILE") & (F.col("right_kind") == "FILE") & true("sha_equal") & signed & keeper["sha256"].eqNullSafe(candidate["sha256"])
    actionable = F.coalesce(exact, no)
    confirmed = F.coalesce(F.col("match_status") == "CONFIRMED", no) & true("run_completed")
    at_home = lambda x: x["scan_root_id"].eqNullSafe(F.col("scan_root_id")) & x["scan_run_id"].eqNullSafe(F.col("scan_run_id"))
    rated = known & signed & (F.coalesce("qualities", F.lit(0)) == 2)
    ready = known & true("whole") & signed & at_home(keeper) & at_home(candidate) & true("as_expected")
    left, right = F.col("left_file_id"), F.col("right_file_id")
    ready = ready & ((keeper["file_id"].eqNullSafe(left) & candidate["file_id"].eqNullSafe(right)) | (keeper["file_id"].eqNullSafe(right) & candidate["file_id"].eqNullSafe(left)))
    codes = []
    accepted = F.lit(True)
    for r, (kind, missing, rejected, producer) in REVIEWS.items():
        q, v, named = F.col(f"quality_{r}"), F.col(f"review_{r}"), F.col(f"named_{r}")
        rated = rated & q.isNotNull() & at_home(q) & q["observation_id"].eqNullSafe(F.col(f"file_{r}")["observation_id"])
        one = F.coalesce(F.col(f"reviews_{r}"), F.lit(0)) == 1
        good = F.coalesce(one & (v["producer"] == producer) & (v["version"] == versions[kind]) & ~v["state"].isin("MISSING", "STALE"), no)
        codes += [F.when(~good, F.lit(missing)), F.when(good & (v["state"] == "REJECTED"), F.lit(rejected))]
        agreed = F.coalesce(one & (v["state"] == "ACCEPTED"), no)
        accepted = accepted & agreed
        for c in _REVIEW:
            agreed = agreed & v[c].eqNullSafe(named[c])
        ready = ready & agreed
    rated, ready = F.coalesce(rated, no), F.coalesce(ready, no)
    codes += [
        F.when(~actionable, F.lit("IDENTITY_NOT_ACTIONABLE")).when(~confirmed, F.lit("IDENTITY_NOT_CONFIRMED")),
        F.when(F.coalesce("root_protected", F.lit(True)), F.lit("PROTECTED_SOURCE_ROOT")),
        F.when(~true("lineage_matches"), F.lit("LINEAGE_MISMATCH")),
        F.when(~rated, F.lit("QUALITY_EVIDENCE_INCOMPLETE")),
        F.when(~ready, F.lit("PRECONDITION_INCOMPLETE")),
        F.when(F.coalesce(F.col("preference") != "PREFERRED", F.lit(True)), F.lit("KEEP_PREFERENCE_UNRESOLVED")),
    ]
    for unknown, present in DEPENDENCY_CODES.values():
        # a plan without any dependency row knows of none
        codes += [F.when(F.col("as_expected").isNull(), F.lit(unknown)).otherwise(F.col(unknown)), F.col(present)]
    found = all_.withColumn("blockers", F.array_sort(F.array_compact(F.array(*codes)))).withColumn("accepted", accepted)
    status = F.when(F.size("blockers") > 0, "BLOCKED").when(F.col("accepted"), "APPROVED_NON_EXECUTABLE").otherwise("REVIEW_REQUIRED")
    return found.select("plan_id", "blockers", status.alias("status"))
