"""What a crawler may fetch, and what it may keep: scope, addresses, robots, media types, and the canonical form of JSON."""

from __future__ import annotations

import ipaddress
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Blocks of IPv4 addresses that are not public, and blocks of IPv6 addresses that stand for others.
PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
TUNNELS = ("64:ff9b::/96", "64:ff9b:1::/48", "2001::/32", "2002::/16")
_V4 = "^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def in_scope(url: Column, scheme: Column, host: Column, path: Column, origin: Column, origins: list[str], domains: list[str], prefixes: list[str], denied: list[str], same_origin: bool, subdomains: bool) -> Column:
    """NULL for an address within the policy, else the first rule it breaks. Globs of denied paths know * and ?."""
    any_of = lambda cs: F.lit(False) if not cs else cs[0] if len(cs) == 1 else cs[0] | any_of(cs[1:])
    hosts = any_of([(host == x) | (F.endswith(host, F.lit("." + x)) if subdomains else F.lit(False)) for x in domains])
    glob = lambda g: "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in g) + "$"
    allowed = origin.isin(origins) if same_origin else (hosts if domains else F.lit(True))
    return (
        F.when(~scheme.isin("http", "https"), "unsupported_scheme").when(~allowed, "cross_origin" if same_origin else "host_not_allowed")
        .when(~any_of([F.startswith(path, F.lit(p)) for p in prefixes]) if prefixes else F.lit(False), "path_not_allowed").when(any_of([path.rlike(glob(g)) for g in denied]), "path_denied")
    )


def _number(a: Column) -> Column:
    parts = F.split(a, "\\.")
    return sum((F.get(parts, F.lit(i)).cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0))


@F.pandas_udf(StringType())
def _v6(addresses: pd.Series) -> pd.Series:
    tunnels = [ipaddress.ip_network(t) for t in TUNNELS]

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return "dns_invalid"
        a = getattr(a, "ipv4_mapped", None) or a
        closed = not a.is_global or a.is_multicast or a.is_reserved or (a.version == 6 and any(a in t for t in tunnels))
        return "ssrf_blocked" if closed else "ok"

    return addresses.map(one, na_action="ignore")


def address_verdict(address: Column) -> Column:
    """ok, ssrf_blocked or dns_invalid. IPv4 addresses are compared as numbers in the JVM, all others go to Python in batches."""
    plain = F.coalesce(address.rlike(_V4) & ~address.rlike("(^|\\.)0[0-9]"), F.lit(False))
    n = _number(F.when(plain, address))
    blocked = F.lit(False)
    for block in PRIVATE:
        net = ipaddress.ip_network(block)
        blocked = blocked | n.between(int(net.network_address), int(net.broadcast_address))
    return F.when(plain, F.when(blocked, "ssrf_blocked").otherwise("ok")).otherwise(_v6(F.when(~plain, address)))


def host_verdict(resolved: DataFrame, host: str, address: str) -> DataFrame:
    """One verdict per host: any closed address closes it, none at all is dns_empty."""
    worst = F.array_max(F.collect_set(F.when(F.col("_v") != "ok", F.col("_v"))))
    g = resolved.withColumn("_v", address_verdict(F.col(address))).groupBy(host).agg(F.count(address).alias("n"), worst.alias("w"))
    return g.select(host, F.when(F.col("n") == 0, "dns_empty").otherwise(F.coalesce("w", F.lit("ok"))).alias("verdict"))


def robots_access(status: Column, delay: Column) -> Column:
    """What a site's robots file allows as a whole by its status: all, nothing, or what its rules say."""
    return F.when(status.isin(404, 410), "all").when(status.isin(401, 403), "nothing").when(~status.between(200, 299) | status.isNull(), "unavailable").when(delay > 60, "nothing").otherwise("rules")


def robots_rules(requests: DataFrame, rules: DataFrame, site: str, path: str, request: str) -> DataFrame:
    """request, allowed: the longest rule of the site that begins the path decides; allow wins a tie, no rule allows.

    rules has site, prefix and allow. A path meets the rules by equality with
    its own beginnings of the lengths that rules of its site have.
    """
    lengths = rules.groupBy(site).agg(F.collect_set(F.length("prefix")).alias("_ls"))  # a site has a bounded number of rules
    r = requests.join(lengths, site, "left").withColumn("_l", F.explode_outer("_ls")).where("_l is null or _l <= length(" + path + ")")
    r = r.withColumn("prefix", F.left(F.col(path), F.col("_l")))
    hit = r.join(rules.select(site, "prefix", "allow"), [site, "prefix"], "left")
    best = F.max_by("allow", F.when(F.col("allow").isNotNull(), F.struct(F.length("prefix"), "allow")))
    decided = hit.groupBy(request).agg(best.alias("allow"))
    return requests.select(request).join(decided, request, "left").select(request, F.coalesce("allow", F.lit(True)).alias("allowed"))


def as_of(requests: DataFrame, loads: DataFrame, key: str, at: str, ttl: int, value: str) -> DataFrame:
    """Each request with the value of the last load of its key that is not older than a time to live, else NULL.

    Both sides are merged by time, so each row looks back once; at is in seconds.
    """
    both = requests.withColumn("_kind", F.lit(1)).withColumn(value, F.lit(None).cast(dict(loads.dtypes)[value])).unionByName(loads.select(key, at, value).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    last = F.last(F.when(F.col("_kind") == 0, F.struct(at, value)), True).over(Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    j = both.withColumn("_last", last).where("_kind = 1")
    return j.withColumn(value, F.when(F.col(at) - F.col(f"_last.{at}") <= ttl, F.col(f"_last.{value}"))).drop("_last", "_kind")


def inflated(most: int):
    """A column function that unpacks gzip or deflate bytes; NULL for what is broken or would be longer than a bound."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> bytes | None:
            if raw is None:
                return None
            for window in (47, -15):  # gzip or zlib by their heads, else a bare stream
                try:
                    unpack = zlib.decompressobj(window)
                    out = unpack.decompress(raw, most + 1)
                    return out if len(out) <= most and unpack.eof else None
                except zlib.error:
                    continue
            return None

        return data.map(one, na_action="ignore")

    return run


def canonical_json(drop: tuple[str, ...] = ()):
    """A column function: JSON with sorted keys, compact, without the named keys at any depth; NULL for what is no JSON."""

    def kept(value: object) -> object:
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if k not in drop}
        return [kept(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(kept(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return run


def semantic_hash(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """Equal for JSON that differs in the order of keys and in white space only."""
    return F.sha2(canonical_json(drop)(text), 256)


def links_of(html: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, tag, href, truncated, canonical of every link in HTML; rows go to Python in batches."""
    from foliospark.functions.url import links

    kind = dict(html.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[column]):
                found, more, canonical = links(text)
                out += [(k, i, tag, href, more, canonical) for i, (tag, href) in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "pos", "tag", "href", "truncated", "canonical"])

    return html.select(key, column).mapInPandas(run, f"`{key}` {kind}, pos int, tag string, href string, truncated boolean, canonical string")


def cells_of(html: DataFrame, key: str, column: str) -> DataFrame:
    """key, row, col, row_span, col_span, text, is_header of every cell of HTML tables."""
    from foliospark.functions.url import table_cells

    kind = dict(html.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, c["row"], c["col"], c["row_span"], c["col_span"], c["text"], c["is_header"]) for k, text in zip(pdf[key], pdf[column]) for c in table_cells(text)]
            yield pd.DataFrame(out, columns=[key, "row", "col", "row_span", "col_span", "text", "is_header"])

    return html.select(key, column).mapInPandas(run, f"`{key}` {kind}, row int, col int, row_span int, col_span int, text string, is_header boolean")
