"""People, accounts and groups: property folds, merges and the identity graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.props import and_filters
from clickloom.operators.trends import page
from clickloom.plans.graph import connected_components, resolve_chains
from clickloom.plans.small import broadcast_if_small, with_row

MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP)


def merge_traits(current: Column, set_once: Column, set_: Column, unset: Column) -> Column:
    """First-time values fill gaps, set values win, unset keys go."""
    merged = F.map_concat(*[F.coalesce(c, empty_map()) for c in (set_once, current, set_)])
    gone = F.coalesce(unset, F.array().cast("array<string>"))
    return F.map_filter(merged, lambda k, _: ~F.array_contains(gone, k))


def property_update(event_data: Column) -> dict[str, Column]:
    """``$set``, ``$set_once`` and textual ``$unset`` entries of an event."""
    def part(name: str, kind: str) -> Column:
        return F.from_json(F.get_json_object(event_data, f"$['{name}']"), kind)

    listed = part("$unset", "array<variant>")
    names = F.filter(
        F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))),
        lambda s: s.isNotNull(),
    )
    return {"set": part("$set", MAP), "set_once": part("$set_once", MAP), "unset": names}


def fold_properties(updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ("created_at", "event_id")) -> DataFrame:
    """Properties per key after all updates in order, without walking a key's rows.

    Per property the last set or unset decides; without a set after the last
    unset, the first ``set_once`` after it fills in. All of it is grouped by
    key and property with partial aggregation.
    """
    keys, at = list(keys), F.struct(*order)

    def listed(column: str, kind: int) -> Column:
        entries = F.map_entries(column) if kind != 2 else F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))
        return F.transform(
            F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")),
            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(kind).alias("kind")),
        )

    ops = updates.select(
        *keys, at.alias("at"), F.explode(F.concat(listed("set_once", 0), listed("set", 1), listed("unset", 2))).alias("op")
    ).select(*keys, "at", "op.*")
    kind, unset = F.col("kind"), F.col("kind") == 2
    state = ops.groupBy(*keys, "name").agg(
        F.max_by(F.struct("kind", "value"), F.when(kind > 0, F.struct("at", "kind"))).alias("last"),
        F.max(F.when(unset, F.col("at"))).alias("unset_at"),
        F.min_by(F.struct("value"), F.when(kind == 0, F.col("at"))).alias("first"),
    )
    # Only properties that end unset need their later set_once rows.
    undone = state.filter("last.kind = 2").select(*keys, "name", "unset_at")
    again = ops.filter(kind == 0).join(undone, [*keys, "name"]).filter(F.col("at") > F.col("unset_at")).groupBy(*keys, "name").agg(
        F.min_by(F.struct("value"), "at").alias("again")
    )
    full = state.join(again, [*keys, "name"], "left")
    final = (
        F.when(F.col("last.kind") == 1, F.struct(F.col("last.value").alias("value")))
        .when(F.col("last.kind") == 2, F.col("again"))
        .otherwise(F.col("first"))
    )
    kept = full.withColumn("final", final).filter(F.col("final").isNotNull())
    # One entry per property name.
    return kept.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "final.value"))).alias("traits"))


def fold_profiles(updates: DataFrame, key: str = "visitor_id") -> DataFrame:
    """Profiles from updates: traits, account id, first and last seen, identified time.

    ``updates`` holds set, set_once and unset columns, ``user_id`` and
    ``identified`` next to the key and the order columns.
    """
    at = F.struct("created_at", "event_id")
    seen = updates.groupBy(key).agg(
        F.max_by("user_id", F.when(F.col("user_id").isNotNull(), at)).alias("user_id"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
        F.min(F.when(F.col("identified"), F.col("created_at"))).alias("identified_at"),
    )
    return seen.join(fold_properties(updates, [key]), key, "left").withColumn("traits", F.coalesce("traits", empty_map()))


def fold_accounts(updates: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Accounts or groups: last given name, merged traits, first and last seen."""
    keys, at = list(keys), F.struct("created_at", "event_id")
    seen = updates.groupBy(*keys).agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), at)).alias("name"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"),
    )
    return seen.join(fold_properties(updates, keys), keys, "left").withColumn("traits", F.coalesce("traits", empty_map()))


def memberships(rows: DataFrame) -> DataFrame:
    """One row per account and visitor with the last role and account id."""
    at = F.struct("created_at", "event_id")
    return rows.groupBy("account_id", "visitor_id").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), at)).alias("role"),
        F.max_by("user_id", F.when(F.col("user_id").isNotNull(), at)).alias("user_id"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"),
    )


# Merging people.


def redirect_map(merges: DataFrame) -> DataFrame:
    """``from_id, to_id`` with chains followed to their end."""
    return resolve_chains(merges.select("from_id", "to_id").distinct())


def redirect(df: DataFrame, redirects: DataFrame, column: str = "visitor_id") -> DataFrame:
    """Replace merged ids; other ids stay."""
    side = broadcast_if_small(redirects.select(F.col("from_id").alias(column), "to_id"))
    return df.join(side, column, "left").withColumn(column, F.coalesce("to_id", column)).drop("to_id")


def merge_profiles(profiles: DataFrame, merges: DataFrame) -> DataFrame:
    """Profiles after merging: the target's traits win, then sources in list order.

    ``merges`` holds ``from_id, to_id, position``; targets may themselves be
    merged further.
    """
    final = resolve_chains(merges.select("from_id", "to_id")).join(merges.select("from_id", "position"), "from_id")
    ranked = profiles.join(broadcast_if_small(final), profiles["visitor_id"] == final["from_id"], "left").select(
        F.coalesce("to_id", "visitor_id").alias("person"), F.coalesce("position", F.lit(0)).alias("position"),
        F.col("visitor_id").alias("old_id"), "user_id", "traits", "first_seen_at",
    )
    rank = F.struct("position", "old_id")
    heads = ranked.groupBy("person").agg(
        F.min_by("user_id", F.when(F.col("user_id").isNotNull(), rank)).alias("user_id"), F.min("first_seen_at").alias("first_seen_at")
    )
    traits = ranked.select("person", rank.alias("rank"), F.explode("traits").alias("name", "value")).groupBy("person", "name").agg(
        F.min_by(F.struct("value"), "rank").alias("v")
    ).groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("traits"))
    return heads.join(traits, "person", "left").select(
        F.col("person").alias("visitor_id"), "user_id", "first_seen_at", F.coalesce("traits", empty_map()).alias("traits")
    )


def merge_keyed(rows: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Re-key rows that are unique per key and visitor: the target's row, else the first-listed."""
    final = resolve_chains(merges.select("from_id", "to_id")).join(merges.select("from_id", "position"), "from_id")
    joined = rows.join(broadcast_if_small(final), rows["visitor_id"] == final["from_id"], "left")
    rank = F.struct(F.coalesce("position", F.lit(0)).alias("p"), F.col("visitor_id").alias("v"))
    values = F.struct(*[F.col(c) for c in rows.columns if c not in (key, "visitor_id")])
    return joined.groupBy(key, F.coalesce("to_id", "visitor_id").alias("visitor_id_")).agg(F.min_by(values, rank).alias("kept")).select(
        key, F.col("visitor_id_").alias("visitor_id"), "kept.*"
    )


# Groups.


def assign_group_types(existing: DataFrame, seen: DataFrame, max_types: int | None = None) -> DataFrame:
    """``group_type, type_index``: kept mappings, then new types on free indexes.

    ``seen`` holds ``group_type, first_seen``. With ``max_types``, only indexes
    below it are given; ``refused_group_types`` has the types that get none.
    """
    new = seen.groupBy("group_type").agg(F.min("first_seen").alias("first_seen")).join(existing, "group_type", "left_anti")
    n = existing.count() + new.count() if max_types is None else max_types
    # Nothing beyond the n earliest new types can get an index.
    head = new.orderBy("first_seen", "group_type").limit(n)
    head = head.withColumn("_n", F.row_number().over(Window.orderBy("first_seen", "group_type")))
    all_indexes = existing.sparkSession.range(n).select(F.col("id").cast("int").alias("type_index"))
    free = all_indexes.join(existing, "type_index", "left_anti").withColumn("_n", F.row_number().over(Window.orderBy("type_index")))
    return existing.select("group_type", "type_index").unionByName(head.join(free, "_n").select("group_type", "type_index"))


def refused_group_types(mapping: DataFrame, seen: DataFrame) -> DataFrame:
    """``group_type, first_seen`` of the seen types without an index."""
    return seen.groupBy("group_type").agg(F.min("first_seen").alias("first_seen")).join(mapping, "group_type", "left_anti")


def _type_indexes(mapping: DataFrame, max_types: int | None) -> DataFrame:
    kept = mapping if max_types is None else mapping.orderBy("type_index", "group_type").limit(max_types)
    return kept.agg(F.map_from_entries(F.collect_list(F.struct("group_type", F.col("type_index").cast("string")))).alias("_types"))


def stamp_groups(
    df: DataFrame, mapping: DataFrame, groups: str = "groups", properties: str = "properties", max_types: int | None = None, max_key: int | None = None
) -> DataFrame:
    """Write ``{type: key}`` into ``$group_<i>``; ``refused_groups`` has the entries that the limits keep out."""
    fits = lambda k: F.lit(True) if max_key is None else F.length(k) <= max_key
    valid = F.map_filter(
        F.coalesce(groups, empty_map()), lambda t, k: k.isNotNull() & (k != "") & fits(k) & F.map_contains_key("_types", t)
    )
    stamped = F.transform_keys(valid, lambda t, _: F.concat(F.lit("$group_"), F.try_element_at("_types", t)))
    return with_row(df, _type_indexes(mapping, max_types)).withColumn(properties, F.map_concat(properties, stamped)).drop("_types")


def refused_groups(
    df: DataFrame, mapping: DataFrame, keys: Sequence[str], groups: str = "groups", max_types: int | None = None, max_key: int | None = None
) -> DataFrame:
    """``keys``, ``group_type, group_key, reason``: entries with a key that ``stamp_groups`` does not write."""
    entries = with_row(df.select(*keys, groups), _type_indexes(mapping, max_types)).select(*keys, "_types", F.explode(groups).alias("group_type", "group_key"))
    long = F.lit(False) if max_key is None else F.length("group_key") > max_key
    reason = F.when(~F.map_contains_key("_types", F.col("group_type")), "type").when(long, "key")
    return entries.filter("group_key != ''").withColumn("reason", reason).filter("reason is not null").drop("_types")


def merge_envelope_groups(envelope: Column, event: Column) -> Column:
    """Groups of the envelope and the event; the event's own key wins."""
    return F.map_concat(F.coalesce(envelope, empty_map()), F.coalesce(event, empty_map()))


def group_people(stamped: DataFrame, profiles: DataFrame, index: int, group_key: str) -> DataFrame:
    """People active in a group with their profile and event count."""
    rows = stamped.filter(F.col("properties")[f"$group_{index}"] == group_key)
    counts = rows.groupBy("visitor_id").agg(F.count("*").alias("events"), F.max("created_at").alias("last_at"))
    return counts.join(profiles.select("visitor_id", "user_id", "traits"), "visitor_id", "left")


def list_groups(groups: DataFrame, index: int, search: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """One page of groups with the number of all matches."""
    out = groups.filter(F.col("type_index") == index)
    if search:
        needle = search.lower()
        out = out.filter(F.lower("group_key").contains(needle) | F.lower(F.to_json("properties")).contains(needle))
    total = out.agg(F.count("*").alias("total"))
    return with_row(page(out, [F.col("group_key")], limit, offset), total)


# People lists.

PEOPLE_ORDERS = {
    "last_seen": [F.desc, "last_seen_at"], "first_seen": [F.desc, "first_seen_at"], "visitor": [F.asc, "visitor_id"],
}


def list_people(
    profiles: DataFrame, search: str | None = None, filters=(), members: DataFrame | None = None, order: str = "first_seen",
    limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """One page of people and the number of all matches."""
    out = profiles
    if search:
        needle = search.lower()
        texts = [F.col("visitor_id"), F.coalesce("user_id", F.lit("")), F.to_json("traits")]
        out = out.filter(reduce(lambda a, b: a | b, [F.lower(t).contains(needle) for t in texts]))
    if filters:
        out = out.filter(and_filters(filters))
    if members is not None:
        out = out.join(members.select("visitor_id").distinct(), "visitor_id", "left_semi")
    direction, column = PEOPLE_ORDERS[order]
    total = out.agg(F.count("*").alias("total"))
    return with_row(page(out, [direction(column), F.col("visitor_id")], limit, offset), total)


def person_details(
    profiles: DataFrame, aliases: DataFrame, redirects: DataFrame, events: DataFrame, sessions: DataFrame, members: DataFrame
) -> DataFrame:
    """Every person with alias, merge, activity and cohort counts."""
    def count(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("visitor_id")).agg(F.count("*").alias(name))

    out = profiles
    for side in (
        count(aliases, "visitor_id", "aliases"), count(redirects, "to_id", "merged_from"), count(events, "visitor_id", "events"),
        count(sessions, "visitor_id", "sessions"), count(members.select("cohort_id", "visitor_id").distinct(), "visitor_id", "cohorts"),
    ):
        out = out.join(side, "visitor_id", "left")
    return out.fillna(0, ["aliases", "merged_from", "events", "sessions", "cohorts"])


def person_sessions(sessions: DataFrame, recordings: DataFrame, visitor: str, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Sessions of a person with a flag for recorded ones."""
    recorded = recordings.select("session_id").distinct().withColumn("has_recording", F.lit(True))
    out = sessions.filter(F.col("visitor_id") == visitor).join(recorded, "session_id", "left")
    out = out.withColumn("has_recording", F.coalesce("has_recording", F.lit(False)))
    return page(out, [F.desc("first_at"), F.col("session_id")], limit, offset)


# Accounts.


def account_analytics(members: DataFrame, sessions: DataFrame, pageviews: DataFrame, events: DataFrame) -> DataFrame:
    """Members, identified users and activity of every account."""
    def per_visitor(df: DataFrame, name: str, *extra: Column) -> DataFrame:
        return df.groupBy("visitor_id").agg(F.count("*").alias(name), *extra)

    out = members.select("account_id", "visitor_id", "user_id").distinct()
    for side in (
        per_visitor(sessions, "sessions"), per_visitor(pageviews, "pageviews"),
        per_visitor(events, "events", F.sum("revenue_amount").cast("double").alias("revenue")),
    ):
        out = out.join(side, "visitor_id", "left")
    return out.groupBy("account_id").agg(
        F.count_distinct("visitor_id").alias("members"), F.count_distinct("user_id").alias("identified_users"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("sessions", "pageviews", "events")],
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
    )


def accounts_as_groups(accounts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Account profiles carried over as groups of the account type."""
    side = mapping.filter(F.col("group_type") == "account").select("type_index")
    named = F.when(F.col("name").isNotNull(), F.create_map(F.lit("name"), F.col("name")))
    return with_row(accounts, side.limit(1)).filter(F.col("type_index").isNotNull()).select(
        "type_index", F.col("account_id").alias("group_key"),
        F.map_concat(F.coalesce(named, empty_map()), F.coalesce("traits", empty_map())).alias("properties"),
    )


# Identity graph.


def _node(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c))


def identity_edges(profiles: DataFrame, aliases: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``source, target, kind`` edges between visitors, users and accounts."""
    def edges(df: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))

    known = members.filter(F.col("user_id").isNotNull())
    parts = [
        edges(profiles.filter(F.col("user_id").isNotNull()), _node("visitor", "visitor_id"), _node("user", "user_id"), "identified_as"),
        edges(aliases, _node("visitor", "visitor_id"), _node("user", "alias_id"), "alias"),
        edges(members, _node("visitor", "visitor_id"), _node("account", "account_id"), "member_of"),
        edges(known, _node("user", "user_id"), _node("account", "account_id"), "member_of"),
        edges(known, _node("visitor", "visitor_id"), _node("user", "user_id"), "identified_as"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def related_visitors(
    profiles: DataFrame, aliases: DataFrame, members: DataFrame, visitor: str | None = None, user: str | None = None, account: str | None = None
) -> DataFrame:
    """Visitors tied to the seed by a profile, an alias or a membership."""
    def hit(user_column: str) -> Column:
        v = F.col("visitor_id") == visitor if visitor is not None else F.lit(False)
        return v | (F.col(user_column) == user if user is not None else F.lit(False))

    in_account = F.col("account_id") == account if account is not None else F.lit(False)
    parts = [
        profiles.filter(hit("user_id")), aliases.filter(hit("alias_id")), members.filter(hit("user_id") | in_account),
    ]
    return reduce(DataFrame.union, [p.select("visitor_id") for p in parts]).distinct()


def identity_graph(edges: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the related visitors."""
    seeds = related.select(_node("visitor", "visitor_id").alias("seed"))
    mine = edges.join(broadcast_if_small(seeds), F.col("source") == F.col("seed"), "left_semi")
    nodes = mine.select(F.col("source").alias("node")).union(mine.select("target")).distinct()
    return nodes.withColumn("kind", F.substring_index("node", ":", 1)), mine


def people_components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)
