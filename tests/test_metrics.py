import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import url as U
from foliospark.operators import metrics, quality, sampling, sequences
from foliospark.streaming import logs


def test_order_statistics_of_skewed_groups(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["hot"] * 3000 + ["one"] + [None] * 50, "v": np.concatenate([np.where(r.random(3000) < 0.4, 7.0, np.round(r.lognormal(0, 3, 3000), 2)), [5.0], np.arange(50.0)])})
    pdf.loc[3, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    rules = {"near": metrics.nearest_rank(0.95), "up": metrics.upper_median(), "cut": metrics.truncated(0.9), "low": metrics.floored(0.95)}
    got = {x.k: x for x in metrics.order_statistics(df, ["k"], "v", rules).collect()}
    med = {x.k: x.m for x in metrics.median(df, ["k"], "v", "m").collect()}
    for k in ("hot", "one", None):
        v = np.sort(pdf[pdf.k.isna() if k is None else pdf.k == k].v.dropna().to_numpy())
        n = len(v)
        assert (got[k].near, got[k].up) == (v[int(np.ceil(0.95 * n)) - 1], v[n // 2])
        assert (got[k].cut, got[k].low) == (v[min(n - 1, int(0.9 * n))], v[int(0.95 * (n - 1))])
        assert med[k] == np.median(v)
    assert metrics.order_statistics(df.limit(0), ["k"], "v", rules).count() == 0


def test_ranks_with_ties(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": "a", "v": np.where(r.random(500) < 0.5, 1.0, r.integers(0, 9, 500)), "id": r.permutation(500)})
    got = {x.id: x.r for x in metrics.ranks(spark.createDataFrame(pdf), ["g"], "v", "id", "r").collect()}
    want = {i: n for n, i in enumerate(pdf.sort_values(["v", "id"]).id, 1)}
    assert got == want


def test_stage_profile(spark):
    rows = [("a", 1, 9.0, False), ("a", 2, 1.0, True), ("a", 3, 3.0, False), ("b", 1, 2.0, False)]
    g = metrics.stage_profile(spark.createDataFrame(rows, "s string, t int, x double, f boolean"), ["s"], ["t"], "x", F.col("f"))
    got = {r.s: (r.n, r.failures, r.cold, r.warm_mean, r.warm_median, r.implied_load, round(r.share, 3)) for r in g.collect()}
    assert got == {"a": (3, 1, 9.0, 2.0, 2.0, 7.0, 0.867), "b": (1, 0, 2.0, None, None, None, 0.133)}


def test_several_micro_batches_keep_every_key(spark, tmp_path):
    for n, rows in enumerate([[("a", 1.0), ("b", 5.0)], [("a", 7.0)], [("c", 1.0)]]):
        spark.createDataFrame(rows, "k string, v double").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    s = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r.k: (r.used, r.n, r.exceeded) for r in logs.drain(logs.budget(s, "k", "v", 6.0), "update", ["k"]).collect()}
    assert got == {"a": (8.0, 2, True), "b": (5.0, 1, False), "c": (1.0, 1, False)}
    assert {r.k: r.n for r in logs.drain(s.groupBy("k").agg(F.count("*").alias("n")), "complete").collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        logs.drain(s, "update")


def test_row_bands_compare_with_the_top_of_the_band(spark):
    # boxes 1 high: the third is near the second but not near the band's top; NULL coordinates have no band
    rows = [(1, 0.0, 0.0, 9.0, 1.0), (2, 0.0, 3.0, 9.0, 4.0), (3, 0.0, 6.0, 9.0, 7.0), (4, 0.0, 30.0, 9.0, 50.0), (5, 0.0, 49.0, 9.0, 60.0), (6, None, None, None, None)]
    df = spark.createDataFrame([("d", 0, *r) for r in rows], "d string, p int, id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.band for r in sequences.row_bands(df, ["d", "p"], "id").collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}


def test_kinds_of_files(spark):
    def archive(*names):
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x" * 500)
        return out.getvalue()

    files = [("a.bin", archive("word/document.xml")), ("b.docx", archive("other.txt")), ("c.docx", b"PK\x03\x04broken"), ("d.txt", b"%PDF-1.7"), ("e.xls", bytes.fromhex("D0CF11E0A1B11AE1")), ("f.png", b"none"), ("g", b""), ("h.pdf", b"\xff\xd8\xff\xe0")]
    got = {r.path: tuple(r.s) for r in spark.createDataFrame(files, "path string, content binary").select("path", quality.sniff(F.col("content"), F.col("path")).alias("s")).collect()}
    assert got == {"a.bin": ("docx", 1.0), "b.docx": ("zip_unknown", 0.3), "c.docx": ("unknown", 0.0), "d.txt": ("pdf", 1.0), "e.xls": ("xls_legacy", 0.5), "f.png": ("image/png", 0.4), "g": ("unknown", 0.0), "h.pdf": ("image/jpeg", 1.0)}


def test_marginal_sample_against_the_plain_greedy(spark):
    import hashlib

    r = np.random.default_rng(1)
    rows = [(i, str(r.choice(["x", "y", "z"], p=[0.8, 0.15, 0.05])), str(r.choice(["en", "vi"], p=[0.7, 0.3]))) for i in range(300)]
    got = {x.id for x in sampling.marginal_sample(spark.createDataFrame(rows, "id bigint, a string, b string"), ["a", "b"], 12).collect()}
    want = {(c, v): max(1, round(12 * sum(x[c] == v for x in rows) / 300)) for c in (1, 2) for v in {x[c] for x in rows}}
    have, picked = dict.fromkeys(want, 0), set()
    for _ in range(12):
        left = [x for x in rows if x[0] not in picked]
        gain = lambda x: round(sum(max(0, want[c, x[c]] - have[c, x[c]]) / want[c, x[c]] for c in (1, 2)), 9)
        best = min(left, key=lambda x: (-gain(x), hashlib.sha256(f"42:{x[0]}".encode()).hexdigest()))
        picked.add(best[0])
        for c in (1, 2):
            have[c, best[c]] += 1
    assert got == picked


@pytest.mark.parametrize("raw,want", [("https://example.com:443", "https://example.com/"), ("https://example.com/%7eA/%2e%2e/B", "https://example.com/B"), ("https://example.com/café", "https://example.com/caf%C3%A9"), ("https://[2001:4860:4860::8888]:443/a", "https://[2001:4860:4860::8888]/a"), ("http://1.2.3.4", "http://1.2.3.4/")])
def test_canonical_addresses(raw, want):
    assert U.canonical_url(raw) == want
    assert U.canonical_url(want) == want


@pytest.mark.parametrize("url", ["http://example.com\\@127.0.0.1/", "http://2130706433/", "http://0177.0.0.1/", "http://127.1/", "http://%31%32%37.0.0.1/", "http://[fe80::1%eth0]/", "https://example.com/\r\nx", "http://e.org:99999/", "http://e.org:x/", "http:///x"])
def test_addresses_without_canonical_form(url):
    with pytest.raises(U.AddressError):
        U.canonical_url(url)


def test_plain_addresses_take_the_short_way(spark):
    urls = ["https://e.org/a/b.c?x=1", "https://e.org/a/../b", "https://E.org/a", None, "https://e.org/a..b", "https://e.org/%zz", "https://e.org", "https://1.2.3/", "https://e.org/a?", "https://e.org/a\n"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = {r.i: (r.n.url, r.n.error) for r in df.select("i", U.url_normalize("u").alias("n")).collect()}
    for i, u in enumerate(urls):
        try:
            want = (U.canonical_url(u), None) if u is not None else (None, "invalid_url")
        except U.AddressError as e:
            want = None, str(e)
        assert got[i] == want, u


def test_sorted_and_dropped_queries():
    assert U.canonical_url("https://e.org/a//b?b=2&a=1", query="sort", collapse=True) == "https://e.org/a/b?a=1&b=2"
    assert U.canonical_url("https://e.org/?k=v", query="drop") == "https://e.org/"
