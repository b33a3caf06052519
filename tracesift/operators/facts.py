"""Facts over runs: merging observations, what every run or any run saw, and how a candidate differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: from weakest to strongest.
MODES = ("provenance", "verbatim")
CONFIDENCES = ("heuristic", "content_mined", "nested", "explicit")
#: Fixed: how bad each difference is, those that may be made worse, and those that only say what could not be seen.
SEVERITY = {
    "new_fact_unguarded": "fail", "new_fact_guarded": "warn", "guard_removed": "fail", "guard_swap": "fail", "mode_escalation": "fail", "mode_deescalation": "info", "required_fact_missing": "warn",
    "allowed_fact_missing": "info", "new_uncataloged_tool": "warn", "coverage_below_floor": "insufficient_evidence", "compare_skew": "insufficient_evidence",
}
WORSE = {"new_uncataloged_tool": "fail"}
EVIDENTIARY = ("new_uncataloged_tool", "coverage_below_floor", "compare_skew")


def _rank(column, order):
    return F.array_position(F.array(*map(F.lit, order)), column)


def merge(facts: DataFrame, identity: list[str]) -> DataFrame:
    """Strongest mode, all roles, and the best witness: by confidence, then length, then order. Commutative."""
    best = F.min(F.struct((-_rank(F.col("confidence"), CONFIDENCES)).alias("c"), F.size("witness").alias("n"), F.col("witness").alias("w"), F.col("confidence").alias("confidence")))
    roles = F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles"))))
    rows = facts.groupBy(*identity).agg(F.max_by("mode", _rank(F.col("mode"), MODES)).alias("mode"), roles.alias("roles"), best.alias("b"), F.count(F.lit(1)).alias("observations"))
    return rows.select(*identity, "mode", "roles", F.col("b.confidence").alias("confidence"), F.col("b.w").alias("witness"), "observations")


def baseline(facts: DataFrame, identity: list[str], run: str = "run") -> DataFrame:
    """Facts seen in any run, those of every run marked required."""
    runs = facts.agg(F.countDistinct(run).alias("runs"))
    seen = facts.groupBy(*identity).agg(F.countDistinct(run).alias("n"), F.max(_rank(F.col("mode"), MODES)).alias("mode_rank"))
    return seen.join(F.broadcast(runs)).select(*identity, "mode_rank", (F.col("n") == F.col("runs")).alias("required"))


def differences(base: DataFrame, candidate: DataFrame, identity: list[str]) -> DataFrame:
    """A full outer join on identity: new facts, missing required ones, and modes that grew stronger."""
    c = candidate.groupBy(*identity).agg(F.max(_rank(F.col("mode"), MODES)).alias("new_rank"))
    rows = base.join(c, identity, "full_outer")
    kind = F.when(F.col("mode_rank").isNull(), "new_fact_unguarded").when(F.col("new_rank").isNull() & F.col("required"), "required_fact_missing").when(F.col("new_rank") > F.col("mode_rank"), "mode_escalation")
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select(*identity, "kind", severity[F.col("kind")].alias("severity"))


def severities(worse: tuple[str, ...] = ()) -> dict[str, str]:
    """How bad each kind is for one run; only kinds that may be are made worse, and the shared table stays."""
    if set(worse) - set(WORSE):
        raise ValueError(f"cannot be made worse: {sorted(set(worse) - set(WORSE))}")
    return SEVERITY | {k: WORSE[k] for k in worse}


def guarded(base: DataFrame, candidate: DataFrame, identity: list[str], known_tools: list[str], worse: tuple[str, ...] = ()) -> DataFrame:
    """All kinds of difference where facts have a `guard` (null: none) and a mode: kind, severity, attribution.

    A new fact counts as guarded if it has a guard; tools that no catalog knows are named beside; a fact that only lost
    a guard, changed it, or changed its mode is told by the strongest of these.
    """
    c = candidate.groupBy(*identity).agg(F.max(_rank(F.col("mode"), MODES)).alias("new_rank"), F.max("guard").alias("new_guard"))
    rows = base.select(*identity, "mode_rank", "required", "guard", F.lit(True).alias("old")).join(c.withColumn("new", F.lit(True)), identity, "full_outer")
    kind = F.when(F.col("old").isNull(), F.when(F.col("new_guard").isNull(), "new_fact_unguarded").otherwise("new_fact_guarded"))
    kind = kind.when(F.col("new").isNull(), F.when(F.col("required"), "required_fact_missing").otherwise("allowed_fact_missing"))
    kind = kind.when(F.col("guard").isNotNull() & F.col("new_guard").isNull(), "guard_removed").when(F.col("guard") != F.col("new_guard"), "guard_swap")
    kind = kind.when(F.col("new_rank") > F.col("mode_rank"), "mode_escalation").when(F.col("new_rank") < F.col("mode_rank"), "mode_deescalation")
    found = rows.withColumn("kind", kind).filter("kind IS NOT NULL").select(*identity, "kind")
    strange = candidate.filter(~F.col(identity[0]).isin(*known_tools)).select(*identity).distinct().withColumn("kind", F.lit("new_uncataloged_tool"))
    table = F.create_map(*[F.lit(x) for kv in severities(worse).items() for x in kv])
    out = found.unionByName(strange)
    return out.withColumns({"severity": table[F.col("kind")], "attribution": F.when(F.col("kind").isin(*EVIDENTIARY), "evidentiary").otherwise("behavioral")})


def trust(candidate_coverage: DataFrame, floor_bp: int, digests: list[str]) -> DataFrame:
    """Why a comparison cannot be trusted: coverage (trace_id, eligible_bp) below a floor, or parts made under different tables."""
    low = candidate_coverage.filter(F.col("eligible_bp") < floor_bp).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    rows = low.select(F.lit("coverage_below_floor").alias("kind"))
    skew = low.sparkSession.createDataFrame([("compare_skew",)] if len(set(digests)) > 1 else [], "kind string")
    return rows.unionByName(skew).withColumns({"severity": F.lit("insufficient_evidence"), "attribution": F.lit("evidentiary")})


def captured(allowed: DataFrame, accepted: DataFrame, identity: list[str]) -> DataFrame:
    """What was allowed because it was seen: all that is allowed but what a person accepted."""
    return allowed.join(accepted.select(*identity).distinct(), identity, "left_anti")


def exit_code(deltas: DataFrame) -> DataFrame:
    """3 if the comparison cannot be trusted, else 1 if any difference fails, else 0."""
    rank = F.when(F.col("severity") == "insufficient_evidence", 3).when(F.col("severity") == "fail", 1).otherwise(0)
    return deltas.agg(F.max(rank).alias("exit_code")).select(F.coalesce("exit_code", F.lit(0)).alias("exit_code"))


def unsound(allowed: DataFrame, required: DataFrame, accepted: DataFrame, counts: DataFrame, runs: int, identity: list[str]) -> DataFrame:
    """Constraints of a baseline across its parts, as rows with a reason. `counts` has identity and n; allowed and required have mode.

    Accepted facts are allowed; counts cover exactly what was captured and lie within the runs; required facts are
    allowed as the same fact, and were seen in every run unless a person accepted them.
    """
    row = lambda rows, reason: rows.select(*identity, F.lit(reason).alias("reason"))
    seen = captured(allowed, accepted, identity)
    full = required.join(accepted.select(*identity), identity, "left_anti").join(counts, identity, "left")
    parts = [
        row(accepted.join(allowed.select(*identity), identity, "left_anti"), "accepted_not_allowed"),
        row(seen.join(counts, identity, "left_anti"), "count_missing"), row(counts.join(seen.select(*identity), identity, "left_anti"), "count_of_nothing"),
        row(counts.filter((F.col("n") < 1) | (F.col("n") > runs)), "count_out_of_range"),
        row(required.join(allowed, [*identity, "mode"], "left_anti"), "required_not_allowed"), row(full.filter(F.coalesce("n", F.lit(0)) != runs), "required_not_in_all_runs"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(base: DataFrame, identity: list[str]) -> DataFrame:
    """Constraints of a baseline as rows: one fact for each identity, no null in it, known mode."""
    twice = base.groupBy(*identity).count().filter("count > 1").select(*identity, F.lit("duplicate_fact").alias("reason"))
    null = base.filter(" OR ".join(f"{c} IS NULL" for c in identity)).select(*identity, F.lit("null_identity").alias("reason"))
    mode = base.filter(f"mode_rank IS NULL OR mode_rank NOT BETWEEN 1 AND {len(MODES)}").select(*identity, F.lit("unknown_mode").alias("reason"))
    return twice.unionByName(null).unionByName(mode)
