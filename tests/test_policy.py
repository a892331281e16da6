import gzip
import ipaddress
import json
import random
import zlib

from pyspark.sql import functions as F

from foliospark.operators import policy as P


def test_addresses_against_the_library(spark):
    r = random.Random(6)
    some = ["127.0.0.1", "169.254.169.254", "100.64.0.1", "8.8.8.8", "::1", "fc00::1", "::ffff:127.0.0.1", "64:ff9b::7f00:1", "2002:7f00:1::", "2001:db8::1", "2001:4860:4860::8888", "010.0.0.1", "300.1.1.1", "x", None]
    rows = some + [".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(300)] + [f"{b.split('/')[0]}" for b in P.PRIVATE]
    got = {x.a: x.v for x in spark.createDataFrame([(a,) for a in rows], "a string").select("a", P.address_verdict(F.col("a")).alias("v")).collect()}
    for a in rows:
        if a is None:
            assert got[a] is None
            continue
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            assert got[a] == "dns_invalid"
            continue
        ip = getattr(ip, "ipv4_mapped", None) or ip
        tunnel = ip.version == 6 and any(ip in ipaddress.ip_network(t) for t in P.TUNNELS)
        closed = not ip.is_global or ip.is_multicast or ip.is_reserved or tunnel
        assert got[a] == ("ssrf_blocked" if closed else "ok"), a
    hosts = spark.createDataFrame([("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "8.8.8.8"), ("c", None)], "h string, a string")
    assert {r.h: r.verdict for r in P.host_verdict(hosts, "h", "a").collect()} == {"a": "ssrf_blocked", "b": "ok", "c": "dns_empty"}


def test_packed_bytes(spark):
    text = b"abc" * 100
    bare = zlib.compressobj(wbits=-15)
    rows = [(gzip.compress(text),), (zlib.compress(text),), (bare.compress(text) + bare.flush(),), (b"junk",), (gzip.compress(b"x" * 10_000),), (gzip.compress(text)[:-9],), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(P.inflated(1000)("b").alias("t")).collect()]
    assert [None if x is None else bytes(x) for x in got] == [text, text, text, None, None, None, None]


def test_semantic_hash(spark):
    rows = [('{"a": 1, "b": {"c": [1, 2], "t": 5}}',), ('{"b":{"t":9,"c":[1,2]},"a":1}',), ('{"a": 1, "b": {"c": [2, 1]}}',), ("{",), (None,)]
    got = [r.h for r in spark.createDataFrame(rows, "j string").select(P.semantic_hash(F.col("j"), ("t",)).alias("h")).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None and got[4] is None
    text = spark.createDataFrame(rows[:1], "j string").select(P.canonical_json()("j").alias("c")).first().c
    assert text == json.dumps(json.loads(rows[0][0]), sort_keys=True, separators=(",", ":"))


def test_scope_and_time_to_live(spark):
    u = spark.createDataFrame([("https", "a.example.com", "/docs/a"), ("https", "badexample.com", "/docs/a"), ("https", "example.com", "/docs/private/a"), ("https", "example.com", "/elsewhere"), ("ftp", "example.com", "/docs/a")], "s string, h string, p string")
    rule = P.in_scope(F.col("p"), F.col("s"), F.col("h"), F.col("p"), F.lit(""), [], ["example.com"], ["/docs/"], ["*/private/*"], False, True)
    assert [r.e for r in u.select(rule.alias("e")).collect()] == [None, "host_not_allowed", "path_denied", "path_not_allowed", "unsupported_scheme"]
    q = spark.createDataFrame([("a", 10), ("a", 400), ("a", 311), ("b", 5)], "k string, at bigint")
    loads = spark.createDataFrame([("a", 10, "v1"), ("a", 100, "v2")], "k string, at bigint, v string")
    got = {(r.k, r.at): r.v for r in P.as_of(q, loads, "k", "at", 300, "v").collect()}
    assert got == {("a", 10): "v1", ("a", 400): "v2", ("a", 311): "v2", ("b", 5): None}
