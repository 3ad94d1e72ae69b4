"""Toxicity classifier regularised by counterfactuals.

A logistic model over the presence of words and character n-grams. For every
labelled text that names a group, copies with the group term swapped for another of
its kind are made, and the squared change of the logit between a text and its
copies is added to the loss: the weights of identity terms, and of features that
come and go with them, are pushed to where a swap changes nothing, so that neutral
mentions of a group do not raise the score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = re.compile(r"[^\W_]+")
GRAMS = (4, 5, 6)
CACHE = 200_000

#: Identity terms by kind; a term is swapped for the others of its list.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual"],
    ["transgender", "cisgender"], ["immigrants", "natives", "refugees"],
    ["disabled", "blind", "deaf"], ["old", "young"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]


@dataclass
class Model:
    """Weights by feature; ``bias`` alone scores a text without features."""

    weights: dict[str, float]
    bias: float


def word_features(word: str) -> list[str]:
    """The word itself in marks, and its character n-grams."""
    w = f"<{word}>"
    return [w] + [w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1) if n < len(w)]


def _words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def _swaps(terms: list[list[str]]) -> dict[str, list[str]]:
    return {t: [o for o in kind if o != t] for kind in terms for t in kind}


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``(text, toxic)`` of at most ``limit`` labelled rows, the first by a hash of
    the id. Labels other than 0 and 1 and rows without id or text teach nothing; an
    id labelled twice counts as toxic if either label says so."""
    known = (labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    known = known.join(docs.filter("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """``(feature, toxic, n)``: in how many toxic texts, and in how many in all."""
    def run(batches):
        toxic, every = Counter(), Counter()

        def flush():
            keys = list(every)
            out = pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()),
                                              "toxic": pa.array([toxic[x] for x in keys], pa.int64()),
                                              "n": pa.array([every[x] for x in keys], pa.int64())})
            toxic.clear()
            every.clear()
            return out

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {f for w in _words(text) for f in word_features(w)}
                every.update(found)
                if label:
                    toxic.update(found)
                if len(every) > 300_000:
                    yield flush()
        yield flush()

    part = rows.mapInArrow(run, "feature string, toxic long, n long")
    return part.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _select(rows: DataFrame, size: int, min_docs: int) -> list[str]:
    """The ``size`` features whose presence tells most (chi-square on presence)."""
    base = rows.agg(F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("tox")).first()
    n, t = base["all"], base["tox"] or 0
    if n == 0 or t == 0 or t == n:
        return []
    want = F.col("n") * F.lit(t / n)
    chi = (F.col("toxic") - want) * (F.col("toxic") - want) / (want * F.lit(1 - t / n))
    top = (_feature_counts(rows).filter(F.col("n") >= min_docs).select("feature", chi.alias("chi"))
           .orderBy(F.desc("chi"), "feature").limit(size))
    return [r["feature"] for r in top.collect()]


def _encode(rows: DataFrame, index: dict[str, int], terms: list[list[str]]):
    """The texts as feature numbers, and one row of numbers per swapped copy."""
    swaps = _swaps(terms)

    def run(batches):
        for b in batches:
            ids, copies = [], []
            for text in b.column(0).to_pylist():
                words = _words(text)
                enc = lambda ws: sorted({index[f] for w in ws for f in word_features(w) if f in index})
                ids.append(enc(words))
                copies.append([enc((words - {w}) | {o}) for w in sorted(words & swaps.keys()) for o in swaps[w]])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(copies, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "ids", "copies"])

    return rows.mapInArrow(run, "toxic int, ids array<int>, copies array<array<int>>").collect()


def _fit(y, ids, copies, size: int, penalty: float, l2: float, steps: int):
    """Minimise log loss + l2 |w|^2 + penalty * mean squared logit change by Adam."""
    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter(
            (i for x in lists for i in x), np.int64)

    r, c = sparse(ids)
    pairs = [(d, x) for d, cs in enumerate(copies) for x in cs]
    plus = sparse([ids[d] for d, _ in pairs])
    minus = sparse([x for _, x in pairs])
    n, m = len(y), max(1, len(pairs))
    w, bias = np.zeros(size), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m1, m2, b1, b2 = np.zeros(size + 1), np.zeros(size + 1), 0.9, 0.999
    for step in range(1, steps + 1):
        z = bias + np.bincount(r, w[c], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(c, gap[r], minlength=size) / n + 2 * l2 * w
        if pairs:
            delta = (np.bincount(plus[0], w[plus[1]], minlength=len(pairs))
                     - np.bincount(minus[0], w[minus[1]], minlength=len(pairs)))
            g += 2 * penalty / m * (np.bincount(plus[1], delta[plus[0]], minlength=size)
                                    - np.bincount(minus[1], delta[minus[0]], minlength=size))
        g = np.append(g, gap.mean())
        m1, m2 = b1 * m1 + (1 - b1) * g, b2 * m2 + (1 - b2) * g * g
        move = 0.1 * (m1 / (1 - b1 ** step)) / (np.sqrt(m2 / (1 - b2 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000, features: int = 4_000, min_docs: int = 5,
          penalty: float = 1.0, l2: float = 1e-4, steps: int = 400, terms: list[list[str]] | None = None) -> Model:
    """Fit on at most ``limit`` labelled rows (the documented bound of the sample);
    the model holds at most ``features`` weights. Without both labels the model is
    the share of toxic labels alone (0.5 without any)."""
    terms = IDENTITY_TERMS if terms is None else terms
    from ..session import materialize
    rows = materialize(training_rows(docs, labels, limit), "toxicity-training")
    names = _select(rows, features, min_docs)
    if not names:
        share = rows.agg(F.avg("toxic")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(share / (1 - share))))
    got = _encode(rows, {f: i for i, f in enumerate(names)}, terms)
    w, bias = _fit(np.array([x["toxic"] for x in got], float), [x["ids"] for x in got], [x["copies"] for x in got],
                   len(names), penalty, l2, steps)
    return Model({f: float(v) for f, v in zip(names, w)}, bias)


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``into`` (0 to 1) from the whole text; null, empty and
    wordless texts get the score of the bias alone. Rows and other columns stay as
    they are; a column of that name is replaced."""
    kept = [(name, c) for name, c in zip(docs.columns, quoted(docs)) if name != into]
    cols = [name for name, _ in kept]
    at = cols.index("text")
    index = {f: i for i, f in enumerate(model.weights)}
    weights, bias = np.array(list(model.weights.values())), model.bias

    def run(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                hits: set[int] = set()
                for w in _words(text):
                    f = known.get(w)
                    if f is None:
                        if len(known) >= CACHE:
                            known.clear()
                        f = known[w] = tuple(index[x] for x in word_features(w) if x in index)
                    if f:
                        hits.update(f)
                z = bias + (float(weights[list(hits)].sum()) if hits else 0.0)
                out.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, z))))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    # by place, as mapInArrow takes no names with dots
    source = docs.select([c.alias(f"c{i}") for i, (_, c) in enumerate(kept)])
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).toDF(*cols, into)
