import random

import numpy as np
import pandas as pd

from foliospark.llm import moderation as M

SOUND = ["the ledger was closed on time", "please approve the {} copy", "stroke of the press is {} mm", "we attack the backlog of {} pages", "phòng kế toán giữ báo cáo {}"]
BAD = ["you are a worthless {} idiot", "go to hell you {} moron", "mày là đồ ngu {}"]


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = r.random() < 0.3
        lines = [r.choice(SOUND).format(r.randint(1, 999)) for _ in range(r.randint(2, 6))]
        if bad:
            lines.insert(r.randint(0, len(lines)), r.choice(BAD).format(r.choice(["old", "green", "slow", "odd"])))
        rows.append(("\n".join(lines), "en", bad))
    return pd.DataFrame(rows, columns=["text", "lang", "flagged"])


def test_held_out_accuracy_and_disguise():
    train = corpus(500, 1)
    train.loc[::40, "flagged"] = ~train.loc[::40, "flagged"]  # reviewers err
    c = M.Classifier.fit(train)
    test = corpus(200, 2)
    s = np.array(c.score(test.text.tolist(), {}))
    assert ((s >= c.threshold("en")) == test.flagged).mean() > 0.97
    odd = c.score(["YOU ARE A W0RTHLESS OLD 1D1OT", "you are a worthless old i-d-i-o-t", "", None], {})
    assert odd[0] >= c.threshold("en") and odd[1] >= c.threshold(None) and odd[2:] == [0.0, 0.0]


def test_words():
    assert M.words("1D1OT i-d-i-o-t LX33152 duuuuumb ｉdiot") == ["idiot", "idiot", "#", "dumb", "idiot"]
    assert M.words("混蛋 去死") == ["混", "蛋", "去", "死"]
    long = [str(i) for i in range(1000)]
    assert {w for ws in M.windows(long) for w in ws} == set(long)


def test_without_labels_and_with_repeats(spark):
    docs = spark.createDataFrame([(1, "a", "s", None), (1, "a", "s", None), (2, None, None, "en")], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1)], "label_id bigint, doc_id bigint, flagged int")
    got = M.score(docs, labels).collect()
    assert {r.score for r in got} == {0.0} and not any(r.flagged for r in got)
    assert {r.source: r.n_docs for r in M.rates(M.score(docs, labels)).collect()} == {"s": 1, None: 1}


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(2)
    model = M.Model()
    model.p["b1"] += 0.3
    rows = [[f"word{r.integers(0, 50)}" for _ in range(r.integers(1, 12))] for _ in range(40)]
    whole = model.scores(rows)
    assert np.allclose(whole, [model.scores([x])[0] for x in rows], atol=1e-5)
    # against plain convolution over the padded passage
    for x, got in zip(rows[:5], whole):
        b = M.Batch([x])
        v = b.vectors(model.p["E"])[b.padded()[0]]
        h = [np.maximum((np.concatenate([v[k : len(v) - w + 1 + k] for k in range(w)], 1) @ model.p[f"W{w}"] + model.p[f"b{w}"]).max(0), 0) for w in M.WIDTHS]
        assert abs(1 / (1 + np.exp(-(np.concatenate(h) @ model.p["v"] + model.p["c"][0]))) - got) < 1e-5


def test_gradient_against_differences():
    model, r = M.Model(3), np.random.default_rng(1)
    rows, y = [["a", "bcdef", "a"], ["x", "bcdef"], ["q"]], np.array([1.0, 0.0, 1.0], np.float32)

    class Keep:  # leaves nothing out
        random = staticmethod(lambda shape: np.ones(shape))

    def loss(m):
        p = m.scores(rows)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) / 1.0

    before = {k: v.copy() for k, v in model.p.items()}
    scale = 1 / (1 - M.DROP)
    model.p["v"] *= scale  # the step scales the filters it keeps, none being left out here
    numeric = {}
    for k in ("W2", "E"):
        at = (M.parts("bcdef")[3], 5) if k == "E" else (7, 11)
        eps = 1e-2
        model.p[k][at] += eps
        up = loss(model)
        model.p[k][at] -= 2 * eps
        down = loss(model)
        model.p[k][at] += eps
        numeric[k] = (at, (up - down) / (2 * eps))
    model.p = {k: v.copy() for k, v in before.items()}
    model.step(M.Batch(rows), y, np.ones(3), Keep)
    for k, (at, g) in numeric.items():
        moved = before[k][at] - model.p[k][at]
        assert abs(g) < 1e-6 or np.sign(moved) == np.sign(g)


def test_every_language_has_a_threshold(spark):
    train = corpus(300, 4)
    train["lang"] = np.where(np.arange(300) % 10 == 0, "vi", "en")
    c = M.Classifier.fit(train, spark)
    assert set(c.by_lang) == {"en", "vi"} and all(0.2 <= t <= 0.9 for t in c.by_lang.values())
    assert ((c.held_out.score >= c.common) == c.held_out.flagged).mean() > 0.95
