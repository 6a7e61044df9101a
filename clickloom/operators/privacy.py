"""Consent decisions, anonymisation, and export or deletion of people's data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.props import any_of

# Parts of user agents that mark bots.
BOT_NAMES = [
    "bot", "crawler", "spider", "slurp", "bingpreview", "headlesschrome", "phantomjs", "pingdom", "uptimerobot", "datadog",
    "newrelic", "statuscake", "monitoring", "facebookexternalhit", "discordbot", "slackbot", "linkedinbot", "twitterbot",
]


@dataclass(frozen=True)
class PrivacySettings:
    respect_dnt: bool = False
    bot_filtering: bool = True
    blocked_user_agents: tuple[str, ...] = ()
    consent_required: bool = False
    allowed_consent_modes: tuple[str, ...] = ()


def is_bot(user_agent: Column, custom: tuple[str, ...] = ()) -> Column:
    low = F.lower(F.coalesce(user_agent, F.lit("")))
    names = [*BOT_NAMES, *[c.strip().lower() for c in custom if c.strip()]]
    return (F.trim(low) != "") & any_of(low.contains(n) for n in names)


def skip_reason(s: PrivacySettings, user_agent: Column, dnt: Column, mode: Column, granted: Column) -> Column:
    """Why a request is not tracked, or NULL when it is."""
    def on(setting: bool) -> Column:
        return F.lit(setting)

    allowed = [m.lower() for m in s.allowed_consent_modes]
    wrong_mode = ~F.lower(mode).isin(allowed) if allowed else F.lit(False)
    return (
        F.when(on(s.respect_dnt) & dnt, "dnt")
        .when(on(s.bot_filtering) & is_bot(user_agent, s.blocked_user_agents), "bot")
        .when(granted == F.lit(False), "consent_denied")
        .when(on(s.consent_required) & ~F.coalesce(granted, F.lit(False)), "consent_required")
        .when(on(s.consent_required) & mode.isNull(), "consent_mode_required")
        .when(on(s.consent_required) & wrong_mode, "consent_mode_not_allowed")
    )


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf":{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def anonymize_ip(ip: Column) -> Column:
    """IPv4 without its last octet, the first three groups of IPv6, other texts unchanged."""
    v4 = F.regexp_replace(ip, r"\.\d+$", ".0")
    plain = F.lower(F.regexp_replace(ip, _V4_TAIL, ":0:0"))
    halves = F.split(plain, "::")
    empty = F.array().cast("array<string>")

    def groups(part: Column) -> Column:
        return F.when(F.coalesce(part, F.lit("")) == "", empty).otherwise(F.split(part, ":"))

    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = 8 - F.size(left) - F.size(right)
    short = F.size(halves) == 2
    full = F.when(short, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(left)
    valid = (
        (F.size(halves) <= 2) & F.when(short, missing >= 1).otherwise(F.size(left) == 8)
        & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    )
    head = F.transform(F.slice(full, 1, 3), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    # Trailing zero groups join the zeros behind them.
    text = F.regexp_replace(F.concat(F.array_join(head, ":"), F.lit("::")), "(^|:)0(:0)*::$", "::")
    text = F.regexp_replace(text, "^:::?$", "::")
    return F.when(ip.rlike(_V4), v4).when(ip.contains(":") & valid, text).otherwise(ip)


def strip_geo(df: DataFrame, anonymize: Column) -> DataFrame:
    """Drop region and city where the request is anonymised."""
    return df.withColumns({c: F.when(~anonymize, F.col(c)) for c in ("region", "city") if c in df.columns})


def export_people(tables: dict[str, DataFrame], visitors: DataFrame) -> DataFrame:
    """``visitor_id, table, record`` with every row of the wanted people as JSON.

    Rows stay rows, so one person's data never has to fit into one document.
    """
    wanted = visitors.select("visitor_id").distinct()
    parts = [
        df.join(wanted, "visitor_id", "left_semi").select("visitor_id", F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("record"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def delete_people(tables: dict[str, DataFrame], visitors: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the people, and the number of rows removed per table and person."""
    gone = visitors.select("visitor_id").distinct()
    kept = {name: df.join(gone, "visitor_id", "left_anti") for name, df in tables.items()}
    counts = [
        df.join(gone, "visitor_id", "left_semi").groupBy("visitor_id").agg(F.count("*").alias("deleted")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return kept, reduce(DataFrame.unionByName, counts)
