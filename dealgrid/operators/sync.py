"""Source refresh and drift: field-level merge, three-way compare, push diff, schema evolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.operators.sequences import NO_KEY
from dealgrid.session import cut_lineage


def line_up(key: Sequence[str], sides: Mapping[str, DataFrame], cols: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per key with one struct per side, null where the side lacks the key.

    The sides are stacked and grouped, so any number of sides costs one shuffle. A row without a key is
    a row of its own; of rows of a side that share a key the largest is taken, and `n_<side>` counts them.
    """
    stacked = None
    keyless = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    for name, df in sides.items():
        alone = F.when(keyless, F.concat(F.lit(f"{name}:"), F.monotonically_increasing_id().cast("string")))
        part = df.select(*key, alone.alias("_alone"), F.struct(F.lit(1).alias("_in"), *cols[name]).alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    counts = [F.count(name).alias(f"n_{name}") for name in sides]
    return stacked.groupBy(*key, "_alone").agg(*[F.max(name).alias(name) for name in sides], *counts).drop("_alone")


def refresh_merge(local: DataFrame, source: DataFrame, key: str, ownership: Mapping[str, str]) -> DataFrame:
    """Source-owned columns take the source value, all others survive; rows new in the source are added.

    Of source rows that share a key the largest counts, so no local row is doubled; source rows without a key are new rows.
    """
    cols = [c for c in source.columns if c != key]
    if cols:
        folded = source.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("_v")).select(key, "_v.*")
        source = folded.unionByName(source.filter(F.col(key).isNull()).select(key, *cols))
    else:
        source = source.filter(F.col(key).isNotNull()).distinct().unionByName(source.filter(F.col(key).isNull()))
    l, s = local.alias("l"), source.withColumn("_returned", F.lit(True)).alias("s")
    both = l.join(s, F.col(f"l.{key}") == F.col(f"s.{key}"), "full")
    out = [F.coalesce(F.col(f"l.{key}"), F.col(f"s.{key}")).alias(key)]
    for col in [c for c in local.columns if c != key]:
        mine = F.col(f"l.{col}")
        if ownership.get(col) == "crm" and col in source.columns:
            # A record the source no longer returns keeps what it had.
            mine = F.when(F.col("s._returned"), F.col(f"s.{col}")).otherwise(mine)
        out.append(mine.alias(col))
    return both.select(*out)


def numbered_from(df: DataFrame, order: Sequence[str], start: Column, name: str) -> DataFrame:
    """Dense numbers in `order` of any sortable columns, without one global sort.

    Rows are cut into ranges, landed so that the cut stays, and numbered inside a range from the range's offset; the only
    window over everything sees one row per range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "numbered")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    counts = counts.withColumn("_before", offset).drop("_n")
    ranked = ranges.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return (
        ranked.join(counts, "_range").withColumn(name, start + F.col("_before") + F.col("_at"))
        .drop("_range", "_at", "_before")
    )


def upsert_by_key(local: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """Update matches, give new rows the next local ids in key order, never change an id that exists.

    Keys may be of any type. Of incoming rows that share a key the largest counts; an incoming row without a key is new.
    """
    value_cols = [c for c in local.columns if c not in (key, id_col)]
    folded = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*value_cols)).alias("_v")).select(key, "_v.*")
    incoming = folded.unionByName(incoming.filter(F.col(key).isNull()).select(key, *value_cols))
    i = folded.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in value_cols])
    kept = local.join(i, F.col(key) == F.col("_key"), "left").select(
        id_col, key,
        *[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in value_cols],
    )
    fresh = incoming.join(local.select(key), key, "left_anti").select(key, *value_cols)
    top = local.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("top")).scalar()
    fresh = numbered_from(fresh, [key, *value_cols], top, id_col)
    return kept.unionByName(fresh.select(id_col, key, *value_cols))


def verify_sync(local: DataFrame, source: DataFrame, baseline: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Class of every field of every record against the source and the last synced copy.

    Null equals null. IN-SYNC: equal; DRIFT: only the source moved; AHEAD: only we moved;
    CONFLICT: both moved. A record missing on one side is compared as blank fields. Every row without
    a key is reported by itself, and a key that a side holds more than once as DUPLICATE, with the numbers of rows.
    """
    lined = line_up([key], {"l": local, "s": source, "b": baseline}, dict.fromkeys(("l", "s", "b"), cols))
    fields = []
    for col in cols:
        mine, theirs, base = F.col(f"l.{col}"), F.col(f"s.{col}"), F.col(f"b.{col}")
        kind = (
            F.when(mine.eqNullSafe(theirs), "IN-SYNC").when(mine.eqNullSafe(base), "DRIFT")
            .when(theirs.eqNullSafe(base), "AHEAD").otherwise("CONFLICT")
        )
        fields.append(F.struct(
            F.lit(col).alias("field"), kind.alias("sync_class"),
            mine.cast("string").alias("local_value"), theirs.cast("string").alias("source_value"),
        ))
    twice = (F.col("n_l") > 1) | (F.col("n_s") > 1) | (F.col("n_b") > 1)
    fields.append(F.when(twice, F.struct(
        F.lit("(record)").alias("field"), F.lit("DUPLICATE").alias("sync_class"),
        F.col("n_l").cast("string").alias("local_value"), F.col("n_s").cast("string").alias("source_value"),
    )))
    return lined.select(key, F.explode(F.array_compact(F.array(*fields))).alias("f")).select(key, "f.*")


def push_diff(
    local: DataFrame, source: DataFrame, key: str, classes: Mapping[str, str], reasons: Mapping[str, str] | None = None
) -> DataFrame:
    """Pending edits as rows: current value, proposed value, class and the recorded reason.

    A field that the profile does not list is never pushed.
    """
    reasons = reasons or {}
    cols = [c for c in local.columns if c != key and c in source.columns]
    l = local.select(key, *[F.col(c).alias(f"l_{c}") for c in cols])
    s = source.select(key, *[F.col(c).alias(f"s_{c}") for c in cols])
    fields = [
        F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"s_{c}")), F.struct(
            F.lit(c).alias("field"), F.col(f"s_{c}").cast("string").alias("current"),
            F.col(f"l_{c}").cast("string").alias("proposed"), F.lit(classes.get(c, "never")).alias("push_class"),
            F.lit(reasons.get(c)).cast("string").alias("reason"),
        ))
        for c in cols
    ]
    return (
        l.join(s, key).select(key, F.explode(F.array_compact(F.array(*fields))).alias("f")).select(key, "f.*")
    )


def approval_triggers(
    local: DataFrame, source: DataFrame, key: str, stage_order: Sequence[str], max_amount_drop: float = 0.1,
    max_discount: float = 0.08,
) -> DataFrame:
    """Pending changes that would start an approval: a discount over the limit, a large amount drop, a stage moved back."""
    ranks = F.create_map(*[F.lit(x) for i, st in enumerate(stage_order) for x in (st, i)])
    both = local.select(key, F.col("stage").alias("new_stage"), F.col("amount").alias("new_amount"), "discount").join(
        source.select(key, F.col("stage").alias("old_stage"), F.col("amount").alias("old_amount")), key
    )
    drop = F.try_divide((F.col("old_amount") - F.col("new_amount")).cast("double"), F.col("old_amount").cast("double"))
    hits = F.array_compact(F.array(
        F.when(F.col("discount") > max_discount, F.lit("discount over limit")),
        F.when(drop > max_amount_drop, F.lit("amount drop")),
        F.when(F.try_element_at(ranks, "new_stage") < F.try_element_at(ranks, "old_stage"), F.lit("stage moved back")),
    ))
    return both.select(key, F.explode(hits).alias("trigger"), "old_stage", "new_stage")


def reconcile_three_way(
    new: DataFrame, current: DataFrame, baseline: DataFrame, on_disk: DataFrame, key: str,
    mergeable: Column, metadata: Column | None = None,
) -> DataFrame:
    """Action for each object from its hashes; the order of the rules decides.

    `mergeable` and `metadata` are conditions over the columns of `new`.
    """
    extra = [c for c in new.columns if c not in (key, "hash")]
    lined = line_up(
        [key], {"n": new, "c": current, "b": baseline, "d": on_disk},
        {"n": ["hash", *extra], "c": ["hash"], "b": ["hash"], "d": ["hash"]},
    )
    flat = lined.select(
        key, F.col("n.hash").alias("_new"), F.col("c.hash").alias("_cur"), F.col("b.hash").alias("_base"),
        F.col("d.hash").alias("_disk"), *[F.col(f"n.{c}").alias(c) for c in extra],
    ).filter(F.col("_new").isNotNull() | F.col("_cur").isNotNull())
    n, c, b, d = (F.col(x) for x in ("_new", "_cur", "_base", "_disk"))
    meta = F.lit(False) if metadata is None else metadata
    edited = F.when(mergeable, "MERGE").otherwise("KEEP")
    action = (
        F.when(n.isNull(), "GONE").when(c.isNull(), "ADD").when(c == n, "SAME")
        .when((c == d) & (b == n), "SAME").when(meta, "UPDATE").when(c == b, "UPDATE").otherwise(edited)
    )
    why = (
        F.when(n.isNull(), "not in the new set").when(c.isNull(), "not present yet").when(c == n, "identical")
        .when((c == d) & (b == n), "settled earlier").when(meta, "metadata").when(c == b, "untouched here")
        .when(b.isNull(), "no baseline").otherwise("edited here")
    )
    return flat.select(key, action.alias("action"), why.alias("why"))


def write_guard(
    before: DataFrame, after: DataFrame, key: str, source_id: str, modified: str, max_lost_share: float = 0.1
) -> DataFrame:
    """Three checks on a write: rows lost, newer rows set back, ids renumbered.

    Rows are compared by their source id, and by their local id where that is blank.
    """
    sid = F.coalesce(F.col(source_id).cast("string"), F.concat(F.lit(NO_KEY), F.col(key).cast("string")))
    b = before.select(F.col(key).alias("b_id"), sid.alias("_sid"), F.col(modified).alias("b_mod"))
    a = after.select(F.col(key).alias("a_id"), sid.alias("_sid"), F.col(modified).alias("a_mod"))
    both = b.join(a, "_sid", "full")
    counts = both.agg(
        F.count("b_id").alias("rows"),
        F.count_if(F.col("a_id").isNull()).alias("lost"),
        F.count_if(F.col("a_mod") < F.col("b_mod")).alias("reverted"),
        F.count_if(F.col("a_id") != F.col("b_id")).alias("renumbered"),
    )
    checks = F.array(
        F.struct(F.lit("rows lost").alias("check"), F.col("lost").alias("n"), (F.col("lost") <= F.col("rows") * max_lost_share).alias("ok")),
        F.struct(F.lit("edits reverted").alias("check"), F.col("reverted").alias("n"), (F.col("reverted") == 0).alias("ok")),
        F.struct(F.lit("ids renumbered").alias("check"), F.col("renumbered").alias("n"), (F.col("renumbered") == 0).alias("ok")),
    )
    return counts.select(F.explode(checks).alias("c")).select("c.*")


def latest_record(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest version of each record; folds on the map side instead of sorting each key. Rows without a key all stay."""
    rest = [c for c in df.columns if c != key]
    newest = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(key, "_r.*").unionByName(df.filter(F.col(key).isNull()).select(key, *rest))


def schema_merge(local: DataFrame, new: DataFrame) -> DataFrame:
    """Merge column definitions, one row per registry and column, with a note of each decision.

    The new definition wins on type; extra enum values and the user's own columns stay, at the end;
    a user's owner or verify choice stays where the new definition has that key and does not
    correct it.
    """
    key = ["registry", "column_name"]
    l = local.select(*key, *[F.col(c).alias(f"l_{c}") for c in ("column_no", "column_type", "enum_values", "owner", "verify")])
    for fix in ("owner_corrected", "verify_corrected"):
        if fix not in new.columns:
            new = new.withColumn(fix, F.lit(False))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("column_no", "column_type", "enum_values", "owner", "verify", "owner_corrected", "verify_corrected")])
    both = l.join(n, key, "full")
    in_new, in_local = F.col("n_column_no").isNotNull(), F.col("l_column_no").isNotNull()
    both_enum = (F.col("n_column_type") == "enum") & (F.col("l_column_type") == "enum")
    mine = F.coalesce(F.split("l_enum_values", ";"), F.array().cast("array<string>"))
    theirs = F.coalesce(F.split("n_enum_values", ";"), F.array().cast("array<string>"))
    extra = F.when(both_enum, F.array_except(mine, theirs)).otherwise(F.array().cast("array<string>"))
    values = (
        F.when(~in_new, F.col("l_enum_values"))
        .when(F.size(extra) > 0, F.concat_ws(";", F.array_union(theirs, extra))).otherwise(F.col("n_enum_values"))
    )

    def chosen(name: str, corrected: Column) -> tuple[Column, Column, Column, Column]:
        ours, shipped = F.col(f"l_{name}"), F.col(f"n_{name}")
        differs = in_new & in_local & ours.isNotNull() & shipped.isNotNull() & (ours != shipped)
        keep, fix = differs & ~corrected, differs & corrected
        lost = in_new & in_local & ours.isNotNull() & shipped.isNull()
        return F.when(~in_new | keep, ours).otherwise(shipped), keep, fix, lost

    owner, owner_kept, owner_fixed, owner_lost = chosen("owner", F.coalesce("n_owner_corrected", F.lit(False)))
    verify, verify_kept, verify_fixed, verify_lost = chosen("verify", F.coalesce("n_verify_corrected", F.lit(False)))
    notes = F.array_compact(F.array(
        F.when(F.size(extra) > 0, F.lit("kept extra values")), F.when(owner_kept, F.lit("kept owner")),
        F.when(owner_fixed, F.lit("corrected owner")), F.when(owner_lost, F.lit("owner lost")),
        F.when(verify_kept, F.lit("kept verify")), F.when(verify_fixed, F.lit("corrected verify")), F.when(verify_lost, F.lit("verify lost")), F.when(~in_local, F.lit("new column")),
        F.when(~in_new, F.lit("kept user column")),
    ))
    return both.select(
        *key, F.coalesce("n_column_type", "l_column_type").alias("column_type"), values.alias("enum_values"),
        owner.alias("owner"), verify.alias("verify"), (~in_new).alias("at_end"),
        F.coalesce("n_column_no", "l_column_no").alias("column_no"), notes.alias("notes"),
    )


# Settings whose local value stays when the new definition has another.
OWN_SETTINGS = ("archive", "path", "id_prefix", "id_width")


def settings_merge(local: DataFrame, new: DataFrame) -> DataFrame:
    """Merge the settings of a registry that are not columns: registry, setting, value and a note where the user's choice stays.

    Both sides hold registry, setting and value. A setting the user added stays; of those in both the new value wins, but for OWN_SETTINGS.
    """
    key = ["registry", "setting"]
    l = local.select(*key, F.col("value").alias("l_value"), F.lit(True).alias("_l"))
    n = new.select(*key, F.col("value").alias("n_value"), F.lit(True).alias("_n"))
    added = F.col("_n").isNull()
    kept = F.col("_l") & F.col("_n") & ~F.col("l_value").eqNullSafe(F.col("n_value")) & F.col("setting").isin(*OWN_SETTINGS)
    note = F.when(added, "kept your setting").when(kept, "kept your value").when(F.col("_l").isNull(), "new setting")
    return l.join(n, key, "full").select(*key, F.when(added | kept, F.col("l_value")).otherwise(F.col("n_value")).alias("value"), note.alias("note"))


def migrate_registry(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Declared columns first, in order and typed, then the user's own; missing ones arrive empty."""
    declared = [
        (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()
    ]
    return df.select(*declared, *[c for c in df.columns if c not in schema])


def dropped_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti").distinct()


def changes_between(log: DataFrame, old: str, new: str) -> DataFrame:
    """Dated entries after `old` up to `new`; entries without a body are left out."""
    v = F.col("version")
    return log.filter((v > F.lit(old).cast("date")) & (v <= F.lit(new).cast("date")) & (F.trim("body") != ""))


def drift_trend(drift: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Drift as a pattern: rows by field, day, old and new value, and how many have been AHEAD too long."""
    old = F.col("day") <= F.date_sub(F.lit(as_of).cast("date"), days)
    return drift.groupBy("field", "day", "from_value", "to_value").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.col("drift_class") == "AHEAD") & old).alias("ahead_too_long")
    )


def unassigned_records(frames: Mapping[str, DataFrame], roster: DataFrame) -> DataFrame:
    """Records of any registry whose owner is blank or not on the roster."""
    reps = roster.select(F.col("rep").cast("long").alias("owner")).distinct()
    parts = []
    for kind, df in frames.items():
        ids = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("record_id"), F.col("owner").cast("long").alias("owner"))
        blank = ids.filter(F.col("owner").isNull())
        gone = ids.filter(F.col("owner").isNotNull()).join(reps, "owner", "left_anti").select("kind", "record_id", "owner")
        parts.append(blank.unionByName(gone))
    return reduce(DataFrame.unionByName, parts)


def drift_changes_actor(activity: DataFrame, opps: DataFrame, me: int, since: str) -> DataFrame:
    """What colleagues did on my open deals since the last brief."""
    mine = opps.filter(F.col("is_open") & (F.col("owner") == me)).select("opp_id")
    others = activity.filter((F.col("day") >= F.lit(since).cast("date")) & (F.col("actor") != me))
    return others.join(mine, "opp_id").select("activity_id", "opp_id", "actor", "kind", "day")
