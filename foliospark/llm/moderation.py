"""Abusive, hateful or sexual content: a convolutional text classifier.

A document is a bag of passages (sentences and lines); it counts as flagged
by its worst passage. A passage is a sequence of words (single characters for
Chinese); each word's vector is the mean of hashed embeddings of its folded
spelling, its skeleton without accents, and all its letter trigrams, so that
disguised spellings stay near their word. Filters of several widths slide
over the words, their maxima over the passage feed one logit. Training is in
numpy on labelled documents: every passage of a sound document is sound; of a
flagged one only the passage the model itself finds worst has to be bad.
Documents whose label the model firmly contradicts late in training are left
out, since reviewers err.

The trainings are tasks of one Spark job: one on all labelled documents, and
one for each of FOLDS parts of them that is left out and scored. All thresholds
come from these held-out scores: one of all languages, and one of each language,
drawn towards the common one the fewer flagged documents the language has.

The classifier is fitted on at most max_labels labelled documents, the ones
of the lowest hash among those of at most LABEL_CHARS characters (documented
parameters, 20,000 and 100,000), which bounds what the tasks and the driver
hold; every document is scored over its whole text.

Scoring a passage needs no product of matrices: what a word adds to every
filter at every offset is computed once per distinct word of a batch, and a
window is a sum of such rows.

Defined results: NULL and empty texts score 0 and are not flagged; documents
with a NULL language use the common threshold; repeated labels count once and
a document's label is the majority of its reviews, sound on a tie; without any
flagged label every document scores 0; repeated rows count once.
"""

from __future__ import annotations

import functools
import pickle
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELS = 20_000
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 32, 40, (1, 2, 3, 4)
LENGTH, OVERLAP = 40, 8
FOLDS = 3
LABEL_CHARS = 100_000
EPOCHS, BATCH, RATE = 12, 128, 0.05
SOUND_PER_EPOCH = 12_000  # sound passages drawn for each epoch, besides those the model finds hard
SLIPS = 0.1  # share of flagged documents that training may leave out as reviewers' slips
MIN_STEPS = 1200  # steps of gradient at least, however few documents there are
DROP = 0.3  # share of words and of filters left out of each training step
PRIOR = 20  # flagged documents that the common threshold weighs beside a language's own
CACHE = 200_000  # passages whose score a worker remembers

_SPLIT = re.compile(r"[\n\r  ]+|(?<=[.!?…])\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[㐀-鿿]|(?:[^\W_]|[@$*'’](?=\w)|(?<=\w)[-.*_·](?=\w))+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][-.*_· ]){2,}[^\W\d_](?!\w)")
_CODE = re.compile(r"[A-Z]{1,4}\d{2,}|[A-Z]{2}-\d{4}")
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def passages(text: str) -> list[str]:
    return [p for part in _SPLIT.split(text) if (p := part.strip())]


@functools.lru_cache(1 << 17)
def spelled(word: str) -> str:
    """One word without disguise: case, digits for letters, separators and stretched letters."""
    w = word.lower()
    if any(c.isalpha() for c in w):
        w = re.sub(r"[-.*_·'’]", "", w.translate(_DISGUISE)) if re.search(r"[\d@$*._·]|(?:\b|\W)\w-", w) else w
        if _CODE.match(word) or sum(c.isdigit() for c in word) > 3:
            return "#"
    elif any(c.isdigit() for c in w):
        return "#"
    return re.sub(r"(.)\1{2,}", r"\1", w)


def skeleton(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


@functools.cache
def _invisible() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]+")


def words(passage: str) -> list[str]:
    text = passage if passage.isascii() else _invisible().sub("", unicodedata.normalize("NFKC", passage))
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[-.*_· ]", "", m.group()), text)
    return [spelled(w) for w in _TOKEN.findall(text)]


def _bucket(key: str) -> int:
    return 1 + zlib.crc32(key.encode()) % (BUCKETS - 1)


@functools.lru_cache(1 << 17)
def parts(word: str) -> tuple[int, ...]:
    """Embedding rows of a word: its spelling, its skeleton and all letter trigrams of it."""
    s = skeleton(word)
    return (_bucket("w" + word), _bucket("s" + s), *(_bucket("t" + s[i : i + 3]) for i in range(len(s) - 2) if len(s) > 3))


def windows(ws: list[str]) -> list[list[str]]:
    """A passage in overlapping windows, so that long ones are read whole."""
    step = LENGTH - OVERLAP
    return [ws[i : i + LENGTH] for i in range(0, max(1, len(ws) - OVERLAP), step)] if ws else []


class Batch:
    """Windows of words as numbers of distinct words; number 0 is no word."""

    def __init__(self, rows: list[list[str]]):
        number: dict[str, int] = {}
        self.at = [[number.setdefault(w, len(number) + 1) for w in ws] for ws in rows]
        lists = [parts(w) for w in number]
        self.rows = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        self.count = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if lists else np.zeros(0, np.int64)

    def vectors(self, e: np.ndarray) -> np.ndarray:
        """One row per distinct word, the mean of its parts; row 0 is zero."""
        out = np.zeros((len(self.count) + 1, e.shape[1]), np.float32)
        if len(self.count):
            out[1:] = np.add.reduceat(e[self.rows], self.start) / self.count[:, None]
        return out

    def padded(self) -> np.ndarray:
        """All windows at one length, so long that every row ends in no words for every filter."""
        t = max(map(len, self.at), default=0) + max(WIDTHS)
        out = np.zeros((len(self.at), t), np.int64)
        for i, x in enumerate(self.at):
            out[i, : len(x)] = x
        return out


def _sums(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    uniq, first = np.unique(at[order], return_index=True)
    return uniq, np.add.reduceat(values[order], first)


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "v": r.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.array([-2.0], np.float32)}
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.g = {k: np.full(v.shape if k != "E" else (BUCKETS, 1), 1e-3, np.float32) for k, v in self.p.items()}

    def step(self, batch: Batch, y: np.ndarray, weight: np.ndarray, r: np.random.Generator) -> None:
        """One step of gradient, with words and filters left out at random."""
        ids = batch.padded()
        ids[r.random(ids.shape) < DROP / 2] = 0
        x = batch.vectors(self.p["E"])[ids]
        h, keep = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            u = np.concatenate([x[:, k : k + n] for k in range(w)], 2)
            z = u @ self.p[f"W{w}"] + self.p[f"b{w}"]
            top = z.argmax(1)
            best = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0)
            h.append(best)
            keep.append((u, top, best))
        mask = (r.random((len(y), FILTERS * len(WIDTHS))) >= DROP).astype(np.float32) / (1 - DROP)
        hidden = np.concatenate(h, 1) * mask
        logit = hidden @ self.p["v"] + self.p["c"][0]
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        grad = {"v": hidden.T @ d + 1e-5 * self.p["v"], "c": d.sum(keepdims=True)}
        dh, dx = d[:, None] * self.p["v"][None] * mask, np.zeros_like(x)
        for i, w in enumerate(WIDTHS):
            u, top, best = keep[i]
            g = dh[:, i * FILTERS : (i + 1) * FILTERS] * (best > 0)
            # a filter sends its gradient to the one window that is its maximum
            b, f = np.nonzero(g)
            t, value = top[b, f], g[b, f]
            full = np.zeros((len(y), u.shape[1], FILTERS), np.float32)
            full[b, t, f] = value
            hit = np.unique(b * u.shape[1] + t)
            flat_u, flat_g = u.reshape(-1, u.shape[2])[hit], full.reshape(-1, FILTERS)[hit]
            grad[f"W{w}"], grad[f"b{w}"] = flat_u.T @ flat_g, g.sum(0)
            du = flat_g @ self.p[f"W{w}"].T
            rows, cols = hit // u.shape[1], hit % u.shape[1]
            for k in range(w):
                dx[rows, cols + k] += du[:, k * DIM : (k + 1) * DIM]
        for k, gk in grad.items():
            self.g[k] += gk * gk
            self.p[k] -= RATE * gk / np.sqrt(self.g[k])
        word, dv = _sums(dx.reshape(-1, DIM), ids.reshape(-1))
        word, dv = (word[1:], dv[1:]) if len(word) and word[0] == 0 else (word, dv)
        if not len(word):
            return
        word = word - 1
        count = batch.count[word]
        spread = np.repeat(batch.start[word] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        row, sums = _sums(np.repeat(dv / count[:, None], count, 0), batch.rows[spread])
        self.g["E"][row] += (sums * sums).mean(1, keepdims=True)
        self.p["E"][row] -= RATE * sums / np.sqrt(self.g["E"][row])
        self.p["E"][0] = 0

    @functools.cached_property
    def table(self) -> np.ndarray:
        """The filters side by side: width by width, offset by offset."""
        return np.concatenate([self.p[f"W{w}"][k * DIM : (k + 1) * DIM] for w in WIDTHS for k in range(w)], 1)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Probability of each window.

        Each distinct word is multiplied with all filters once; windows lie one
        behind the other with no words between them, so that none depends on another.
        """
        self.__dict__.pop("table", None)  # the filters may have been trained since
        out, at = np.zeros(len(rows), np.float32), 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and size < 20_000:
                size += len(rows[end]) + max(WIDTHS)
                end += 1
            batch = Batch(rows[at:end])
            add = batch.vectors(self.p["E"]) @ self.table
            gap = [0] * max(WIDTHS)
            flat = np.array([i for x in batch.at for i in (*x, *gap)] + gap, np.int64)
            first = np.concatenate([[0], np.cumsum([len(x) + len(gap) for x in batch.at])[:-1]]).astype(np.int64)
            # windows begin at each word and once behind the last; those in the rest of the gap would reach the next row
            ends = np.stack([first, first + [len(x) + 1 for x in batch.at]], 1).reshape(-1)
            h, col = [], 0
            for w in WIDTHS:
                n = len(flat) - len(gap)
                z = add[flat[:n], col : col + FILTERS]
                for k in range(1, w):
                    z = z + add[flat[k : n + k], col + k * FILTERS : col + (k + 1) * FILTERS]
                col += w * FILTERS
                h.append(np.maximum(np.maximum.reduceat(z, ends, axis=0)[::2] + self.p[f"b{w}"], 0))
            logit = np.concatenate(h, 1) @ self.p["v"] + self.p["c"][0]
            out[at:end] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            at = end
        return out


def suspects(bags: list[list[int]], rows: list[list[str]], flagged: np.ndarray) -> list[int]:
    """For each flagged document the window whose words tell flagged from sound documents most: where training starts."""
    seen: dict[str, list[int]] = {}
    for bag, f in zip(bags, flagged):
        for w in {w for i in bag for w in rows[i]}:
            seen.setdefault(w, [0, 0])[int(f)] += 1
    rate = float(np.mean(flagged))
    base = np.log(rate / (1 - rate)) if rate < 1 else 0.0
    odds = {w: max(0.0, float(np.log((n[1] + 3 * rate) / (n[0] + 3 * (1 - rate) + 1e-9)) - base)) for w, n in seen.items()}
    return [max(bag, key=lambda i: sum(sorted((odds[w] for w in set(rows[i])), reverse=True)[:4])) for bag, f in zip(bags, flagged) if f and bag]


def train(docs: list[list[list[str]]], flagged: np.ndarray, seed: int = 7) -> Model:
    """Fit on documents as lists of windows of words."""
    model, r = Model(seed), np.random.default_rng(seed)
    number: dict[tuple, int] = {}
    bags = [[number.setdefault(tuple(w), len(number)) for w in d] for d in docs]
    rows = [list(k) for k in number]
    sound = np.array(sorted({i for b, f in zip(bags, flagged) if not f for i in b}), int)
    bad = [b for b, f in zip(bags, flagged) if f and b]
    n_sound, n_bad = np.zeros(len(rows)), np.zeros(len(rows))
    for b, f in zip(bags, flagged):
        (n_bad if f else n_sound)[list(set(b))] += 1
    trusted = n_sound > np.maximum(1, n_bad)  # passages that sound documents share cannot be what flagged a document
    bad = [[i for i in b if not trusted[i]] for b in bad]
    bad = [b for b in bad if b]
    worst = [i for i in suspects(bags, rows, flagged) if not trusted[i]]
    hard = np.zeros(0, int)
    boost = float(np.clip(0.15 * min(len(sound), SOUND_PER_EPOCH) / max(1, len(worst)), 1, 10))
    epochs = int(np.clip(MIN_STEPS * BATCH / max(1, min(len(sound), SOUND_PER_EPOCH)), EPOCHS, 4 * EPOCHS))
    for epoch in range(epochs):
        if epoch and epoch % max(3, epochs // 4) == 0:
            need = sorted({i for b in bad for i in b})
            s = dict(zip(need, model.scores([rows[i] for i in need])))
            worst = sorted((max(b, key=s.__getitem__) for b in bad), key=s.__getitem__)
            slips = int(SLIPS * len(worst))  # a flagged document without any bad passage is a reviewer's slip
            worst = [i for i in worst[:slips] if s[i] > 0.9] + worst[slips:]
            p = model.scores([rows[i] for i in sound])
            slip = (p >= 0.9) & ~trusted[sound]  # firmly contradicted: a bad passage in a document that passed as sound
            hard = sound[(p > 0.1) & ~slip]
            sound = sound[~slip]
        drawn = r.choice(sound, min(len(sound), SOUND_PER_EPOCH), replace=False) if len(sound) else sound
        good = np.union1d(drawn, hard)
        idx = np.concatenate([np.array(worst, int), good])
        y = np.concatenate([np.ones(len(worst), np.float32), np.zeros(len(good), np.float32)])
        lengths = np.array([len(rows[i]) for i in idx])
        order = np.lexsort((r.random(len(idx)), np.minimum(lengths // 8, 5)))
        for at in r.permutation(np.arange(0, len(order), BATCH)):
            part = order[at : at + BATCH]
            model.step(Batch([rows[i] for i in idx[part]]), y[part], np.where(y[part] > 0, boost, 1.0), r)
    return model


def best_threshold(score: np.ndarray, truth: np.ndarray, slack: float = 0.01) -> float:
    """The score that separates best by F1; of cuts about as good, the middle of the widest gap between scores."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], truth[order].astype(float)
    f1 = 2 * hit.cumsum() / (np.arange(1, len(s) + 1) + max(1.0, hit.sum()))
    below = np.append(s[1:], 0.0)
    good = np.flatnonzero(f1 >= f1.max() - slack)
    k = int(good[np.argmax((s - below)[good])])
    return float((s[k] + below[k]) / 2)


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


def _bag(text: str) -> list[list[str]]:
    return [w for p in passages(text) for w in windows(words(p))]


def _worst(model: Model, docs: list[list[list[str]]]) -> list[float]:
    flat = [w for d in docs for w in d]
    s = model.scores(flat) if flat else np.zeros(0)
    ends = np.cumsum([len(d) for d in docs])
    return [float(s[e - len(d) : e].max(initial=0.0)) for d, e in zip(docs, ends)]


def fit_part(labelled: pd.DataFrame, fold: int, seed: int = 7) -> tuple[Model | None, list[float]]:
    """Train without one fold and score it; fold FOLDS leaves nothing out. A part without flagged documents has no model and scores 0."""
    own = np.array([fold_of(t) == fold for t in labelled.text], bool)
    docs, y = [_bag(t) for t in labelled.text], labelled.flagged.to_numpy(bool)
    model = train([d for d, o in zip(docs, own) if not o], y[~own], seed) if y[~own].any() else None
    held = [d for d, o in zip(docs, own) if o]
    return model, _worst(model, held) if model else [0.0] * len(held)


class Classifier:
    """A model and its thresholds by language; small enough to ship to every worker (a few MB, fixed)."""

    def __init__(self, model: Model | None, common: float, by_lang: dict[str, float], held_out: pd.DataFrame | None = None):
        self.model, self.common, self.by_lang, self.held_out = model, common, by_lang, held_out

    @classmethod
    def fit(cls, labelled: pd.DataFrame, spark: SparkSession | None = None, seed: int = 7) -> Classifier:
        """labelled: text, lang, flagged of distinct documents; with a session the trainings run as its tasks."""
        if not labelled.flagged.any():
            return cls(None, 1.0, {})
        labelled = labelled.assign(text=labelled.text.fillna(""))
        labelled = labelled.iloc[np.argsort([zlib.crc32(f"order {t}".encode()) for t in labelled.text], kind="stable")].reset_index(drop=True)
        if spark is None:
            fitted = {k: fit_part(labelled, k, seed) for k in range(FOLDS + 1)}
        else:
            shared = spark.sparkContext.broadcast(labelled)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for k in pdf.fold:
                        model, held = fit_part(shared.value, int(k), seed)
                        yield pd.DataFrame({"fold": [k], "model": [pickle.dumps(model) if k == FOLDS else b""], "held": [held]})

            parts = spark.range(FOLDS + 1, numPartitions=FOLDS + 1).withColumnRenamed("id", "fold").mapInPandas(run, "fold long, model binary, held array<double>")
            fitted = {r.fold: (pickle.loads(r.model) if r.model else None, r.held) for r in parts.collect()}
        score = np.zeros(len(labelled))
        fold = np.array([fold_of(t) for t in labelled.text])
        for k in range(FOLDS):
            score[fold == k] = fitted[k][1]
        truth, lang = labelled.flagged.to_numpy(bool), labelled.lang.to_numpy()
        clip = lambda t: min(0.9, max(0.2, t))
        common = clip(best_threshold(score, truth))
        own = {}
        for name in {x for x in lang if isinstance(x, str)}:
            m = lang == name
            n = int(truth[m].sum())
            own[name] = (n * clip(best_threshold(score[m], truth[m])) + PRIOR * common) / (n + PRIOR) if n else common
        return cls(fitted[FOLDS][0], common, own, pd.DataFrame({"lang": lang, "flagged": truth, "score": score}))

    def threshold(self, lang: str | None) -> float:
        return self.by_lang.get(lang, self.common) if isinstance(lang, str) else self.common

    def score(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        """Each distinct passage is scored once."""
        if self.model is None:
            return [0.0] * len(texts)
        split = {t: passages(t) for t in dict.fromkeys(texts) if isinstance(t, str) and t}
        new = list(dict.fromkeys(p for ps in split.values() for p in ps if p not in cache))
        parts = [windows(words(p)) for p in new]
        flat = [w for ws in parts for w in ws]
        s = self.model.scores(flat) if flat else np.zeros(0)
        got: dict[str, float] = {}
        at = 0
        for p, ws in zip(new, parts):
            got[p] = float(s[at : at + len(ws)].max(initial=0.0))
            at += len(ws)
        of = {t: max((cache[p] if p in cache else got[p] for p in ps), default=0.0) for t, ps in split.items()}
        if len(cache) + len(got) <= CACHE:
            cache.update(got)
        return [of.get(t, 0.0) if isinstance(t, str) else 0.0 for t in texts]


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> pd.DataFrame:
    """At most max_labels reviewed documents with their majority label, distinct texts."""
    votes = labels.where("doc_id is not null and flagged is not null").select("label_id", "doc_id", "flagged").distinct()
    truth = votes.groupBy("doc_id").agg((F.avg("flagged") > 0.5).alias("flagged"))
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = documents.select("doc_id", "text", "lang").join(F.broadcast(truth), "doc_id")  # at most max_labels rows
    # copies of a text are one document, flagged if most of them are
    rows = rows.where(F.length(F.coalesce("text", F.lit(""))) <= LABEL_CHARS)
    return rows.groupBy("text").agg(F.min("lang").alias("lang"), (F.avg(F.col("flagged").cast("int")) > 0.5).alias("flagged")).orderBy(F.xxhash64("text")).toPandas()


def score(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, source, lang, score, flagged of every document."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(Classifier.fit(labelled_sample(documents, labels, max_labels), spark))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                s = np.array(model.value.score(part.text.tolist(), cache))
                limit = np.array([model.value.threshold(x) for x in part.lang])
                yield pd.DataFrame({"doc_id": part.doc_id, "source": part.source, "lang": part.lang, "score": s, "flagged": s >= limit})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "source", "lang", "text").mapInPandas(run, f"doc_id {kind}, source string, lang string, score double, flagged boolean")


def held_out(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """lang, n, flagged, threshold, precision, recall of the labelled documents, each scored by a model that did not see it."""
    spark = documents.sparkSession
    fitted = Classifier.fit(labelled_sample(documents, labels, max_labels), spark)
    rows = []
    held = fitted.held_out if fitted.held_out is not None else pd.DataFrame({"lang": [], "flagged": [], "score": []})
    for name in sorted({x for x in held.lang if isinstance(x, str)}):
        part = held[held.lang == name]
        got, true = part.score >= fitted.threshold(name), part.flagged.astype(bool)
        both = int((got & true).sum())
        rows.append((name, len(part), int(true.sum()), fitted.threshold(name), both / max(1, int(got.sum())), both / max(1, int(true.sum()))))
    return spark.createDataFrame(rows, "lang string, n int, flagged int, threshold double, precision double, recall double")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, flagged documents, rate and mean score per source."""
    return scored.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("flagged"), F.col("doc_id"))).alias("n_flagged"), F.avg("score").alias("mean_score")).withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
