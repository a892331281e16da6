from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import mixing as M


@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 100)), min_size=1, max_size=8), st.floats(0, 500))
@settings(max_examples=200, deadline=None)
def test_water_fill(sources, total):
    w = {str(i): s[0] for i, s in enumerate(sources)}
    caps = {str(i): s[1] for i, s in enumerate(sources)}
    a = M.water_fill(total, w, caps)
    assert all(0 <= a[s] <= caps[s] + 1e-6 for s in a)
    usable = sum(caps[s] for s in a if w[s] > 0)
    assert abs(sum(a.values()) - min(total, usable)) <= 1e-6 * max(1, total)
    free = [a[s] / w[s] for s in a if w[s] > 1e-9 and caps[s] > 0 and a[s] < caps[s] - 1e-6]
    assert not free or max(free) - min(free) <= 1e-6 * max(1, max(free))


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 9), "abc"[i % 3], 0) for i in range(600)] + [(1000, "x", None, 0), (1001, "x", "other", 0), (1002, None, "a", 0), (1003, "", "a", 0)]
    df = spark.createDataFrame(docs + docs[:50], "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, t)
    got = mix.documents().collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"a", "b", "c"}
    assert max(r.copies for r in got if r.source == "b") == 1 and max(r.copies for r in got) <= 2
    report = {r.source: r for r in mix.report().collect()}
    assert all(abs(report[s].actual_share - w) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and report["none"].used_tokens == 0
    again = M.Mix(df, t).documents().collect()
    assert sorted(again) == sorted(got)
    big = {r.source: r for r in M.Mix(df, t, total_tokens=1e9).report().collect()}
    assert big["a"].epochs == 2 and big["b"].epochs == 1 and big["c"].epochs == 3
    assert M.Mix(df.limit(0), t).documents().count() == 0
