"""Set-based upserts: current state and incoming rows give the next state and an outcome for each row.

Each is a join by key and a ladder of conditions; nothing is read row by row. The next state overwrites
its table under a new path, so that a job that fails leaves the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], seen: str, newer: Column | None = None) -> DataFrame:
    """(keys, values, seen, outcome): created, updated, unchanged (seen moves all the same), stale (where `newer`,
    over columns cur and inc, is false) or absent (no incoming row)."""
    c = current.select(*keys, F.struct(*values, seen).alias("cur"))
    i = incoming.select(*keys, F.struct(*values, seen).alias("inc"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"cur.{v}").eqNullSafe(F.col(f"inc.{v}"))
    outcome = F.when(F.col("inc").isNull(), "absent").when(F.col("cur").isNull(), "created")
    if newer is not None:
        outcome = outcome.when(~newer, "stale")
    outcome = outcome.when(same, "unchanged").otherwise("updated")
    joined = c.join(i, keys, "full").withColumn("outcome", outcome)
    use_new = F.col("outcome").isin("created", "updated")
    return joined.select(*keys, *(F.when(use_new, F.col(f"inc.{v}")).otherwise(F.col(f"cur.{v}")).alias(v) for v in values), F.when(F.col("outcome").isin("created", "updated", "unchanged"), F.greatest(F.col(f"cur.{seen}"), F.col(f"inc.{seen}"))).otherwise(F.col(f"cur.{seen}")).alias(seen), "outcome")


def enriched_scores(items: DataFrame, scores: DataFrame, today: Column) -> DataFrame:
    """items(id, item_type, score, score_date) with scores(id, score, score_date): future scores are rejected, scores
    without an item or of another type skipped, older ones stale."""
    s = scores.select("id", F.col("score").alias("_score"), F.col("score_date").alias("_date"))
    j = s.join(items, "id", "left")
    outcome = (
        F.when(F.col("_date") > today, "rejected")
        .when(F.col("item_type").isNull(), "skipped")
        .when(F.col("item_type") != "vulnerability", "skipped")
        .when(F.col("score_date") > F.col("_date"), "stale")
        .when(F.col("score").eqNullSafe(F.col("_score")) & F.col("score_date").eqNullSafe(F.col("_date")), "unchanged")
        .otherwise("updated")
    )
    return j.withColumn("outcome", outcome).select("id", F.when(F.col("outcome") == "updated", F.col("_score")).otherwise(F.col("score")).alias("score"), F.when(F.col("outcome") == "updated", F.col("_date")).otherwise(F.col("score_date")).alias("score_date"), "outcome")


def reconciled_listing(identifiers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items with exactly one usable id, and whether the catalog lists it; others are skipped."""
    one = identifiers.groupBy("item_id").agg(F.min("value").alias("value"), F.max("value").alias("_top"))
    keys = catalog.select(F.col("value").alias("_listed")).distinct()
    j = one.join(keys, one["value"] == keys["_listed"], "left")
    return j.select("item_id", F.when(F.col("value") != F.col("_top"), "skipped").when(F.col("_listed").isNotNull(), "listed").otherwise("not_listed").alias("outcome"))


def widened(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows(keys, first_seen, last_seen, confidence, context) of both sides in one: the earliest first,
    the latest last, the highest confidence with its context. Evidence only widens."""
    return old.unionByName(new).groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("confidence").alias("confidence"),
        F.max_by("context", F.struct("confidence", "context")).alias("context"),
    )


def version_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versioned objects(id, modified, payload, revoked): stale, unchanged, conflict (another payload of one time, or
    a change after a revocation), created or updated."""
    s = stored.select("id", F.col("modified").alias("_m"), F.col("payload").alias("_p"), F.col("revoked").alias("_r"))
    j = incoming.join(s, "id", "left")
    return j.withColumn(
        "outcome",
        F.when(F.col("_m").isNull(), "created")
        .when(F.col("modified") < F.col("_m"), "stale")
        .when((F.col("modified") == F.col("_m")) & (F.col("payload") == F.col("_p")), "unchanged")
        .when((F.col("modified") == F.col("_m")) | F.col("_r"), "conflict")
        .otherwise("updated"),
    ).select("id", "modified", "outcome")


#: Fixed: the edges that may join two kinds of entity.
APPROVED_EDGES = [
    ("intrusion-set", "uses", "attack-pattern"),
    ("intrusion-set", "uses", "malware"),
    ("malware", "uses", "attack-pattern"),
    ("campaign", "uses", "attack-pattern"),
    ("campaign", "uses", "malware"),
    ("campaign", "attributed-to", "intrusion-set"),
]


def checked_edges(edges: DataFrame, entities: DataFrame, approved: list[tuple[str, str, str]] = APPROVED_EDGES) -> DataFrame:
    """edges(source, kind, target): accepted, or missing_end, self_edge, not_approved."""
    types = entities.select("id", "type")
    spark = edges.sparkSession
    triples = spark.createDataFrame(approved, "_s string, kind string, _t string").withColumn("_ok", F.lit(True))
    j = edges.join(types.select(F.col("id").alias("source"), F.col("type").alias("_s")), "source", "left").join(types.select(F.col("id").alias("target"), F.col("type").alias("_t")), "target", "left")
    j = j.join(F.broadcast(triples), ["_s", "kind", "_t"], "left")  # a fixed table of six rows
    return j.select("source", "kind", "target", F.when(F.col("_s").isNull() | F.col("_t").isNull(), "missing_end").when(F.col("source") == F.col("target"), "self_edge").when(F.col("_ok").isNull(), "not_approved").otherwise("accepted").alias("outcome"))


def dangling(references: DataFrame, *known: DataFrame) -> DataFrame:
    """References(id, ref) to objects that none of the known tables(id) has."""
    ids = known[0].select(F.col("id").alias("ref"))
    for k in known[1:]:
        ids = ids.unionByName(k.select(F.col("id").alias("ref")))
    return references.join(ids.distinct(), "ref", "left_anti")


def inserted(existing: DataFrame, incoming: DataFrame, key: str, facts: list[str], order: str | None = None) -> DataFrame:
    """Idempotent inserts: inserted, reused (the same facts), or conflict (other facts under the key). Of new rows that
    share a key the first by `order` is inserted and the rest are held against it; without an order keys do not repeat."""
    e = existing.select(F.col(key), F.struct(*facts).alias("_old"))
    j = incoming.join(e, key, "left")
    same = F.struct(*facts)
    if order is None:
        return j.withColumn("outcome", F.when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(same), "reused").otherwise("conflict")).drop("_old")
    firsts = incoming.groupBy(key).agg(F.min_by(same, order).alias("_first"), F.min(order).alias("_at"))
    j = j.join(firsts, key)
    outcome = F.when(F.col("_old").isNull() & (F.col(order) == F.col("_at")), "inserted").when(F.coalesce("_old", "_first").eqNullSafe(same), "reused").otherwise("conflict")
    return j.withColumn("outcome", outcome).drop("_old", "_first", "_at")


def acquired_cycles(existing: DataFrame, incoming: DataFrame, key: str, facts: list[str], order: str) -> DataFrame:
    """Cycles(key, facts, trigger, status) asked for by incoming(key, facts, trigger, order): reused or conflict where the
    key is known, else acquired; a scheduled one only if no other scheduled cycle runs, else it is an overlap. Incoming rows
    are taken in order: the first new scheduled one runs, and those after it overlap."""
    found = inserted(existing, incoming, key, facts, order)
    scheduled = F.col("trigger") == "scheduled"
    busy = not existing.where("trigger = 'scheduled' and status = 'running'").isEmpty()
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    j = found.join(known, key, "left")
    # one number: when the cycle that may run was asked for
    first = None if busy else j.where(scheduled & F.col("_known").isNull()).agg(F.min(order)).first()[0]
    wins = F.min(order).over(Window.partitionBy(key)) == F.lit(first) if first is not None else F.lit(False)
    refused = scheduled & F.col("_known").isNull() & ~wins
    return j.withColumn("outcome", F.when(refused, "overlap").when(F.col("outcome") == "inserted", "acquired").otherwise(F.col("outcome"))).drop("_known")


def advanced(state: DataFrame, proposals: DataFrame, keys: list[str], value: str, monotone: bool = False) -> DataFrame:
    """Progress state(keys, version, value) with proposals(keys, status, result, expected_version, value) of runs, one for
    each key: advanced to the next version; unchanged, an equal value, which only a run without changes may propose;
    not_pending, from a run that awaits no progress; stale, with another version than the state's (0 if there is none);
    else conflict, as is, of monotone values such as watermarks, one that goes back."""
    s = state.select(*keys, F.col("version").alias("_v"), F.col(value).alias("_old"))
    version, new = F.coalesce("_v", F.lit(0)), F.col(value)
    outcome = (
        F.when(F.col("status") != "checkpoint_pending", "not_pending")
        .when(F.col("expected_version") != version, "stale")
        .when(F.col("_old") == new, F.when(F.col("result") == "no_change", "unchanged").otherwise("conflict"))
        .when(F.lit(monotone) & (new < F.col("_old")), "conflict")
        .otherwise("advanced")
    )
    j = proposals.join(s, keys, "left").withColumn("outcome", outcome)
    won = F.col("outcome") == "advanced"
    return j.select(*keys, F.when(won, version + 1).otherwise(F.col("_v")).alias("version"), F.when(won, new).otherwise(F.col("_old")).alias(value), "outcome")


def compared_and_set(state: DataFrame, updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Versioned updates(keys, expected_version, value): created needs no expected version, an update the exact one,
    and an equal value is no change."""
    s = state.select(*keys, F.col("version").alias("_v"), F.col(value).alias("_old"))
    j = updates.join(s, keys, "left")
    outcome = (
        F.when(F.col("_v").isNull() & F.col("expected_version").isNull(), "created")
        .when(F.col("_v").isNull() | F.col("expected_version").isNull() | (F.col("_v") != F.col("expected_version")), "conflict")
        .when(F.col("_old").eqNullSafe(F.col(value)), "unchanged")
        .otherwise("updated")
    )
    j = j.withColumn("outcome", outcome)
    return j.select(*keys, F.when(F.col("outcome") == "created", 1).when(F.col("outcome") == "updated", F.col("_v") + 1).otherwise(F.col("_v")).alias("version"), F.when(F.col("outcome").isin("created", "updated"), F.col(value)).otherwise(F.col("_old")).alias(value), "outcome")


def appended(events: DataFrame, existing: DataFrame, group: str, order: str) -> DataFrame:
    """New events with sequence numbers that go on from the highest of their group."""
    last = existing.groupBy(group).agg(F.max("sequence").alias("_last"))
    w = Window.partitionBy(group).orderBy(order)
    return events.join(last, group, "left").withColumn("sequence", F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).drop("_last")


def folded(events: DataFrame, group: str, status: str, sequence: str) -> DataFrame:
    """The state that a run's events end in, and how many there are."""
    return events.groupBy(group).agg(F.max_by(status, sequence).alias(status), F.count(F.lit(1)).alias("events"))


def retryable(runs: DataFrame, errors: DataFrame, most: int) -> DataFrame:
    """Failed or partial runs with a retryable error and attempts left."""
    e = errors.where("retryable").select(F.col("run_id").alias("_run"))
    return runs.where(F.col("status").isin("failed", "partial") & (F.col("attempt") < most)).join(e, F.col("id") == F.col("_run"), "left_semi")


def protected_plan(df: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """Every row with its sorted reasons to stay; a row without one is kept for want of a policy."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit("no_deletion_policy"), *(F.when(c, name) for name, c in reasons.items())))))
    return df.select(F.col(key), found.alias("reasons"))
