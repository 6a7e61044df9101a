"""Device, place and intent lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.props import any_of
from clickloom.plans.small import broadcast_if_small

# Tokens that name browsers, systems and device classes, in test order.
BROWSERS = [("Edge", "edg/"), ("Opera", "opr/"), ("Firefox", "firefox/"), ("Chrome", "chrome/"), ("Safari", "safari/")]
SYSTEMS = [("Android", "android"), ("iOS", "iphone|ipad|ipod"), ("Windows", "windows"), ("macOS", "mac os x|macintosh"), ("Linux", "linux")]
DEVICES = [("tablet", "ipad|tablet"), ("mobile", "mobile|iphone|android")]


def _named(low: Column, table: Sequence[tuple[str, str]], default: str | None) -> Column:
    out = F
    for name, pattern in table:
        out = out.when(low.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if default else out


def parse_user_agents(agents: DataFrame, column: str = "user_agent") -> DataFrame:
    """Browser, system and device class of every distinct user agent."""
    low = F.lower(column)
    return agents.select(column).distinct().select(
        column, _named(low, BROWSERS, None).alias("browser"), _named(low, SYSTEMS, None).alias("os"), _named(low, DEVICES, "desktop").alias("device")
    )


def with_device(df: DataFrame, column: str = "user_agent") -> DataFrame:
    """Add the parsed columns by joining the distinct agents."""
    return df.join(broadcast_if_small(parse_user_agents(df, column)), column, "left")


def address_key(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hexadecimal digits; NULL for anything else.

    IPv4 addresses, alone or at the end of an IPv6 one, are the last eight
    digits; alone they stand behind the prefix ``::ffff:``.
    """
    text = F.lower(F.trim(ip))
    octets = F.split(F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1), r"\.")
    numbers = F.transform(octets, lambda x: x.try_cast("int"))
    dotted = F.when(F.forall(numbers, lambda n: n.isNotNull() & (n <= 255)), F.array_join(F.transform(numbers, lambda n: F.lpad(F.lower(F.hex(n)), 2, "0")), ""))
    plain = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    tail = F.concat(F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))
    whole = F.when(plain, F.concat(F.lit("::ffff:"), tail)).when(text.contains("."), F.concat(F.regexp_replace(text, r"[\d.]+$", ""), tail)).otherwise(text)
    sides = F.split(whole, "::", -1)
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":", -1), lambda g: g != "")
    head, back = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = F.lit(8) - F.size(head) - F.size(back)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), back)
    colons = F.regexp_replace(whole, "::", ":")
    fits = whole.rlike(r"^[0-9a-f:]+$") & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (F.size(sides) <= 2)
    fits = fits & F.when(F.size(sides) == 2, missing >= 1).otherwise((missing == 0) & ~colons.rlike("^:|:$"))
    fits = fits & ~whole.rlike(":::|^:[^:]|[^:]:$")
    return F.when(fits, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def prefix_key(key: Column, length: Column) -> Column:
    """The first ``length`` bits of an address key, with the length, as text."""
    digits, bits = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    last = F.conv(F.substring(key, digits + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - bits).cast("int")
    cut = F.when(bits > 0, F.lower(F.hex(last - last % step))).otherwise("")
    return F.concat_ws("/", F.concat(F.substring(key, F.lit(1), digits), cut), length.cast("string"))


def locate(df: DataFrame, networks: DataFrame, column: str = "ip") -> DataFrame:
    """Country, region and city of addresses by the longest matching network.

    ``networks`` holds ``network``, an address and a prefix length such as
    ``10.0.0.0/8`` or ``2001:db8::/32``, and the place; IPv4 lengths count from
    the IPv4 part. Only the lengths that occur are tried: an address makes one
    key for each of them, at most 129, and all meet the networks in one join on
    equality. Addresses in no network, or that are none, have a NULL place; of a
    network listed twice the smallest place holds.
    """
    given = F.split("network", "/")
    bits = F.get(given, F.lit(1)).try_cast("int")
    side = networks.select(address_key(F.get(given, F.lit(0))).alias("_net"), F.when(F.get(given, F.lit(0)).contains(":"), bits).otherwise(bits + 96).alias("_bits"), F.struct("country", "region", "city").alias("_place"))
    side = side.filter("_net is not null and _bits between 0 and 128")
    side = side.groupBy(prefix_key(F.col("_net"), F.col("_bits")).alias("_key"), "_bits").agg(F.min("_place").alias("_place"))
    lengths = side.agg(F.array_sort(F.collect_set("_bits")).alias("n")).scalar()  # at most 129
    addresses = df.select(F.col(column).alias("_ip")).filter("_ip is not null").distinct().withColumn("_hex", address_key(F.col("_ip"))).filter("_hex is not null")
    keys = addresses.withColumn("_n", F.explode(lengths)).select("_ip", prefix_key(F.col("_hex"), F.col("_n")).alias("_key"))
    found = keys.join(side, "_key").groupBy("_ip").agg(F.max_by("_place", "_bits").alias("_place"))
    return df.join(found, df[column] == found["_ip"], "left").select(*[df[c] for c in df.columns], *[F.col("_place")[c].alias(c) for c in ("country", "region", "city")])


# Words that route a question to a report, in test order.
INTENTS = [
    ("errors", ["error", "bug", "exception", "crash"]),
    ("top_pages", ["page", "url", "landing"]),
    ("referrers", ["referrer", "source", "utm", "campaign", "channel"]),
    ("events", ["event", "conversion", "click", "signup", "purchase"]),
    ("devices", ["device", "browser", "os", "mobile", "desktop"]),
    ("geo", ["country", "geo", "region", "city", "location"]),
    ("traffic_trend", ["trend", "over time", "timeseries", "daily"]),
]


def intent(question: Column) -> Column:
    """The report a question asks for."""
    low, out = F.lower(question), F
    for name, words in INTENTS:
        out = out.when(any_of(low.contains(w) for w in words), F.lit(name))
    return out.otherwise("overview")
