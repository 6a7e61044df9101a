import ipaddress
import random

from pyspark.sql import functions as F

from clickloom.functions.enrich import address_key, locate

ODD = ["1.2.3", "1.2.3.4.5", "256.1.1.1", "", " 10.0.0.1 ", "::", "::1", "1::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1::2", "1:2:3:4:5:6:7:", "12345::", "g::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "::1.2.3.256", "FE80::A", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", None, "text", "1.2.3.4:5"]


def number(text):
    try:
        found = ipaddress.ip_address(text.strip())
    except (ValueError, AttributeError):
        return None
    return int(found) + (0xFFFF << 32 if found.version == 4 else 0)


def test_addresses_as_keys(spark):
    rng = random.Random(4)
    some = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & (-1 << rng.randrange(0, 100)))) for _ in range(200)]
    some += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in ODD + some], "ip string").select("ip", address_key(F.col("ip")).alias("key")).collect()
    for r in rows:
        want = number(r.ip)
        assert r.key == (None if want is None else f"{want:032x}"), r.ip


def test_longest_network_wins(spark):
    rng = random.Random(7)
    base = [ipaddress.ip_network((rng.getrandbits(32), rng.randrange(0, 33)), strict=False) for _ in range(60)]
    base += [ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(96), rng.randrange(30, 129)), strict=False) for _ in range(60)]
    base += [ipaddress.ip_network("2001:db8::/32"), ipaddress.ip_network("0.0.0.0/0"), ipaddress.ip_network("10.0.0.0/8")]
    networks = [(str(n), f"place{i}", None, "city") for i, n in enumerate(dict.fromkeys(base))] + [("nonsense", "x", "x", "x"), ("10.0.0.0/40", "x", "x", "x"), (None, "x", "x", "x")]
    addresses = [str(n[0]) for n in base] + [str(n[-1]) for n in base] + ["3fff::1", "no", None] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)]
    given = spark.createDataFrame([(i, a, "mine") for i, a in enumerate(addresses)], "n int, ip string, _bits string")
    got = {r.n: (r.country, r.region, r.city) for r in locate(given, spark.createDataFrame(networks, "network string, country string, region string, city string")).collect()}
    assert len(got) == len(addresses)
    for i, a in enumerate(addresses):
        try:
            own = ipaddress.ip_address(a)
        except ValueError:
            assert got[i] == (None, None, None)
            continue
        near = [(ipaddress.ip_network(n).prefixlen, c, r, t) for n, c, r, t in networks[:-3] if own in ipaddress.ip_network(n)]
        assert got[i] == (max(near)[1:] if near else (None, None, None))
    empty = locate(given, spark.createDataFrame([], "network string, country string, region string, city string"))
    assert empty.filter("country is null").count() == len(addresses)
