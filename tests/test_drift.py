import itertools
import json
import random

import numpy as np

from foliospark.operators import drift as D
from foliospark.operators import tree_edit as T


def runs(spark, files):
    rows = [("f", seq, json.dumps({"document_id": f"r{i}", "metadata": m})) for seq, ms in files for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "feed string, file_seq int, payload string")


def changes(spark, files):
    return {tuple(r)[1:] for r in D.edit_scripts(runs(spark, files)).collect()}


def test_rename_move_retype_add_remove(spark):
    ids = range(12)
    one = [{"dpi": 100 + 7 * i, "ratio": i / 64, "langs": ["en", "vi"][: i % 2 + 1], "gone": f"g{i}", "level": f"l{i}"} for i in ids]
    two = [{"resolution": str(100 + 7 * i), "ratio": f"{100 * i / 64}%", "langs": ",".join(["en", "vi"][: i % 2 + 1]), "new": i % 3, "log": {"level": f"l{i}"}} for i in ids]
    assert changes(spark, [(1, one), (4, two)]) == {
        (4, "renamed", "metadata.dpi", "metadata.resolution"),
        (4, "renamed", "metadata.level", "metadata.log.level"),
        (4, "retyped", "metadata.ratio", ""),
        (4, "retyped", "metadata.langs", ""),
        (4, "removed", "metadata.gone", ""),
        (4, "added", "metadata.new", ""),
    }


def test_null_fields_are_not_there_and_edges(spark):
    assert changes(spark, [(1, [{"a": None, "b": 1}] * 2), (2, [{"a": 5, "b": None}, {"b": None}])]) == {(2, "added", "metadata.a", ""), (2, "removed", "metadata.b", "")}
    empty = runs(spark, [(1, [{"a": 1}])]).limit(0)
    assert D.edit_scripts(empty).count() == 0
    broken = spark.createDataFrame([("f", 1, None), ("f", 2, "{"), ("f", 3, "7")], "feed string, file_seq int, payload string")
    assert D.edit_scripts(broken).count() == 0


def test_assignment_is_minimal():
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        cost = np.array([[r.random() for _ in range(m)] for _ in range(n)])
        got = sum(cost[i, j] for i, j in T.assign(cost))
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert abs(got - best) < 1e-9


def test_one_table_of_all_runs(spark):
    one = [{"dpi": 100 + 7 * i, "fast": True} for i in range(12)]
    two = [{"resolution": str(100 + 7 * i), "fast": "off"} for i in range(12)]
    df = runs(spark, [(1, one), (2, two), (3, two)])
    paths, kinds = D.projections(D.edit_scripts(df), D.file_schemas(D.flatten(df)))
    assert paths["metadata.dpi"] == paths["metadata.resolution"]
    out = D.unified(df, paths, kinds).orderBy("file_seq", "document_id").collect()
    assert len(out) == 36 and [r["metadata__fast"] for r in out] == ["true"] * 12 + ["off"] * 24  # a string in two of three files


def test_values_survive_as_they_are(spark):
    rows = [{"document_id": "007", "schema_version": "1.10", "n": 1234567890123, "said": "yes", "share": 0.378, "langs": ["en", "vi"], "big": 1}, {"document_id": "008", "schema_version": "1.9", "n": 1234567890124, "said": "no", "share": 0.5, "langs": "en,vi", "big": 2**53 + 1}, {"document_id": "009", "n": "n/a", "share": "37.8%", "said": "x", "langs": [], "big": 3}]
    df = spark.createDataFrame([("f", 1, json.dumps(r)) for r in rows], "feed string, file_seq int, payload string")
    flat = D.flatten(df)
    out = D.unified(df, *D.projections(D.edit_scripts(df), D.file_schemas(flat))).orderBy("document_id").collect()
    assert [(r.document_id, r.schema_version, r.n, r.said, r.share, r.langs, r.big) for r in out] == [("007", "1.10", 1234567890123.0, "yes", 0.378, ["en", "vi"], 1.0), ("008", "1.9", 1234567890124.0, "no", 0.5, ["en", "vi"], None), ("009", None, None, "x", 0.378, [], 3.0)]
    assert [r.unconverted for r in out] == [{}, {"big": str(2**53 + 1)}, {"n": "n/a"}]


def test_predecessors_over_blocks(spark):
    seqs = [0, 3, 1023, 1024, 5000, 5001]
    got = {(r.file_seq, r.before) for r in D.predecessors(spark.createDataFrame([("f", s) for s in seqs] * 2 + [("g", 9)], "feed string, file_seq int")).collect()}
    assert got == set(zip(seqs[1:], seqs))


def nodes(n):
    return [n] + [x for k in n.kids for x in nodes(k)]


def brute(a, b, change, drop):
    """Least cost over all mappings that keep ancestry and map disjoint subtrees to disjoint subtrees."""
    A, B = nodes(a), nodes(b)
    up = {}

    def climb(n, above):
        up[id(n)] = [*above, n]
        for k in n.kids:
            climb(k, up[id(n)])

    climb(a, [])
    climb(b, [])
    lca = lambda x, y: [p for p, q in zip(up[id(x)], up[id(y)]) if p is q][-1]
    over = lambda x, y: x is not y and any(x is z for z in up[id(y)])
    best = sum(map(drop, A)) + sum(map(drop, B))
    for k in range(1, min(len(A), len(B)) + 1):
        for xs in itertools.combinations(A, k):
            for ys in itertools.permutations(B, k):
                m = list(zip(xs, ys))
                if any(over(p, q) != over(r, s) for p, r in m for q, s in m):
                    continue
                if any(over(lca(p, q), c) != over(lca(r, s), d) for (p, r), (q, s), (c, d) in itertools.product(m, repeat=3)):
                    continue
                best = min(best, sum(change(x, y) for x, y in m) + sum(drop(x) for x in A if x not in xs) + sum(drop(y) for y in B if y not in ys))
    return best


def test_tree_distance_against_brute_force():
    r = random.Random(5)
    drop = lambda n: 1.0 if n.leaf else 0.3
    for _ in range(120):
        pick = lambda: T.tree(r.sample(["a", "b", "o.a", "o.c", "o.p.d", "q.e"], r.randint(1, 3)))
        a, b = pick(), pick()
        cost = {}
        change = lambda x, y: 5.0 if x.leaf != y.leaf else cost.setdefault((x.path, y.path), r.choice([0.0, 0.2, 0.7, 1.5, 2.0]))
        got, pairs = T.Distance(change, drop).trees(a, b)
        if len(nodes(a)) <= 5 and len(nodes(b)) <= 5:
            assert abs(got - brute(a, b, change, drop)) < 1e-9
        # the mapping attains the distance
        xs, ys = {id(x) for x, _ in pairs}, {id(y) for _, y in pairs}
        paid = sum(change(x, y) for x, y in pairs) + sum(drop(n) for n in nodes(a) if id(n) not in xs) + sum(drop(n) for n in nodes(b) if id(n) not in ys)
        assert abs(got - paid) < 1e-9


def test_object_renamed_wrapped_and_moved():
    ev = {(o, n): (20, 0, 40.0) for o, n in (("c.log.level", "c.logging.depth"), ("c.log.file", "c.logging.path"), ("c.dpi", "c.render.dpi"), ("c.cap", "d.x.cap"), ("c.top", "d.x.top"))}
    got = D.script(["c.kept", "d.kept"], ["c.log.level", "c.log.file", "c.dpi", "c.cap", "c.top"], ["c.logging.depth", "c.logging.path", "c.render.dpi", "d.x.cap", "d.x.top"], [], ev)
    assert got == [("renamed", o, n) for o, n in sorted(ev)]


def test_canonical_values():
    c = D.canonical
    assert c("37.8%") == c(0.378) and c("on") == c(True) and c([65]) == c("65") == c(65) and c(["en", "vi"]) == c("en,vi") and c(20.290399999999998) == c(20.2904)
