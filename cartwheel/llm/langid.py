"""Language identification of mixed-language text.

A word's script narrows the candidate languages, character n-gram scores rate the
word for each candidate, and a Viterbi pass over the words with a penalty per
switch labels the text with language spans.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = re.compile(r"[^\W\d_]+")
CACHE = 200_000
#: Steps of the sampling share.
SHARES = 1 << 20
#: Texts cut into words at a time.
TEXTS = 256
#: Sampled ids (a long and a language code each) up to which the sample is broadcast.
BROADCAST_IDS = 200_000
UNDETERMINED = "und"
#: A language is a candidate for a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01

#: First and last code point of script ranges.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
_STARTS = [a for _, a, _ in SCRIPT_RANGES]


def script(char: str) -> str:
    """The script whose range holds the character, else ``other``."""
    at = int(np.searchsorted(_STARTS, ord(char), side="right")) - 1
    return SCRIPT_RANGES[at][0] if at >= 0 and ord(char) <= SCRIPT_RANGES[at][2] else "other"


def grams(word: str) -> list[str]:
    """The word in marks and its character n-grams of two and three characters."""
    w = f"<{word}>"
    n = len(w)
    return [w, *[w[i:i + 2] for i in range(n - 1)], *[w[i:i + 3] for i in range(n - 2)]]


@dataclass
class Model:
    """Languages in code-point order, log probability of each n-gram per language,
    that of an unseen one, candidate languages per script, and the most frequent
    language (for text no language can claim)."""

    langs: list[str]
    index: dict[str, int]
    logp: np.ndarray
    unseen: np.ndarray
    candidates: dict[str, np.ndarray]
    usual: str


def _counts(rows: DataFrame) -> DataFrame:
    """``(lang, kind, key, n)``: n-gram (g) and script (s) counts of the rows."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in keys], pa.string()), "kind": pa.array([k[1] for k in keys], pa.string()),
                "key": pa.array([k[2] for k in keys], pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(WORDS.findall(text.lower())).items():
                    held[(lang, "s", script(w[0]))] += n * len(w)
                    for g in grams(w):
                        held[(lang, "g", g)] += n
                if len(held) > 300_000:
                    yield flush()
        yield flush()

    part = rows.mapInArrow(run, "lang string, kind string, key string, n long")
    return part.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_lang: int = 1_500, features: int = 60_000) -> Model:
    """Learn from about ``per_lang`` rows of each language (the documented size of the
    sample: all rows of a language that has no more, else those whose id hashes
    below the share that gives ``per_lang`` on average) and keep the ``features`` most
    frequent n-grams. Rows with null text or lang teach nothing. Without rows the
    model knows no language."""
    known = docs.filter("lang is not null and text is not null")
    have = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    below = F.ceil(F.lit(float(per_lang * SHARES)) / F.col("_n"))
    some = materialize(known.select("doc_id", "lang").join(F.broadcast(have), "lang")    # a row per language, as in the model
                       .filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < below)
                       .select("doc_id", "lang").distinct(), "language-sample")
    if some.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    rows = known.select("doc_id", "lang", "text").join(some, ["doc_id", "lang"], "left_semi").select("text", "lang")
    counts = materialize(_counts(rows), "language-counts")
    totals = {r["lang"]: r["n"] for r in counts.filter("kind = 'g'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    at = {x: i for i, x in enumerate(langs)}
    top = (counts.filter("kind = 'g'").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
           .orderBy(F.desc("n"), "key").limit(features))
    got = counts.filter("kind = 'g'").join(F.broadcast(top.select("key")), "key").collect()
    index: dict[str, int] = {}
    for r in got:
        index.setdefault(r["key"], len(index))
    n = np.zeros((len(index), len(langs)))
    for r in got:
        n[index[r["key"]], at[r["lang"]]] = r["n"]
    size = np.array([totals[x] for x in langs], float) + 0.5 * (len(index) + 1)
    scripts = counts.filter("kind = 's'").collect()
    letters = Counter()
    for r in scripts:
        letters[r["lang"]] += r["n"]
    candidates: dict[str, np.ndarray] = {}
    for r in scripts:
        if r["n"] >= SCRIPT_SHARE * letters[r["lang"]]:
            candidates.setdefault(r["key"], np.zeros(len(langs), bool))[at[r["lang"]]] = True
    usual = max(langs, key=lambda x: (totals[x], x)) if langs else UNDETERMINED
    return Model(langs, index, np.log((n + 0.5) / size), np.log(0.5 / size), candidates, usual)


#: A word speaks for or against a language by at most this much.
CLIP = 6.0
EXCLUDED = -12.0


def word_scores(words: list[str], m: Model) -> np.ndarray:
    """Per word and language the mean-centred log likelihood, clipped; languages that
    do not use a word's script get ``EXCLUDED``; a script of no language, and a word
    of unknown n-grams alone, say nothing (0)."""
    n, langs = len(words), len(m.langs)
    found = [grams(w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, n)
    at = np.fromiter(map(m.index.get, chain.from_iterable(found), repeat(-1)), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(n), sizes)[at >= 0]
    logp = m.logp[at[at >= 0]]
    sums = np.stack([np.bincount(of, logp[:, k], minlength=n) for k in range(langs)], axis=1)
    known = np.bincount(of, minlength=n)
    may = np.stack([np.zeros(langs, bool), *m.candidates.values()])
    row = {name: i for i, name in enumerate(m.candidates, 1)}
    first = {c: row.get(script(c), 0) for c in {w[0] for w in words}}
    ok = may[np.fromiter((first[w[0]] for w in words), np.int64, n)]
    mean = np.where(ok, sums, 0).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
    s = np.clip(sums - mean[:, None], -CLIP, CLIP)
    s[known == 0] = 0.0
    return np.where(ok.any(axis=1)[:, None], np.where(ok, s, EXCLUDED), 0.0).astype(np.float32)


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word on the best path; ``s`` is words x languages.

    Where no run of words can gain ``penalty`` by leaving the language with the
    highest total, staying there throughout is the best path; else the recursion
    runs over all words. Ties go to the lower language number.
    """
    s = s.astype(np.float64)
    total = s.sum(axis=0)
    main = int(total.argmax())
    if s.shape[1] == 1:
        return np.zeros(len(s), np.int64)
    gain = np.delete(s, main, axis=1).max(axis=1) - s[:, main]
    walk = np.concatenate(([0.0], np.cumsum(gain)))
    if (walk - np.minimum.accumulate(walk)).max() < penalty:
        return np.full(len(s), main)
    best, back, langs = s[0].tolist(), [], range(s.shape[1])
    for row in s[1:].tolist():
        top = max(best)
        lead = best.index(top)
        back.append([k if best[k] >= top - penalty else lead for k in langs])
        best = [max(best[k], top - penalty) + row[k] for k in langs]
    path = np.empty(len(s), np.int64)
    path[-1] = at = best.index(max(best))
    for t in range(len(s) - 2, -1, -1):
        path[t] = at = back[t][at]
    return path


def identify(docs: DataFrame, m: Model, penalty: float = 10.0) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` for every row of ``docs``, whole texts.

    ``spans``: array of (first word, last word, lang), words counted from 0.
    lang_pred is the language of most words (ties: by code point), score its share
    of the words. Text that is null or has no letter gets ``und``, score 0 and no
    spans; letters of scripts no learned language uses get the most frequent learned
    language and score 0. lang, source and id are never looked at.
    """
    matrix = "array<struct<first:int,last:int,lang:string>>"

    def run(batches):
        rows: dict[str, int] = {}
        table = np.zeros((0, len(m.langs)), np.float32)
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts = [WORDS.findall(t.lower()) if t else [] for t in b.column(1).to_pylist()]
            if len(rows) > CACHE:
                rows, table = {}, table[:0]
            new = [w for w in {w for words in texts for w in words} if w not in rows]
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            table = np.concatenate([table, word_scores(new, m)]) if new and m.langs else table
            preds, scores, spans = [], [], []
            for words in texts:
                if not any(c.isalpha() for w in words for c in w):      # none, or only signs such as a raised 2
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    spans.append([])
                    continue
                s = (table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]
                     if m.langs else np.zeros((0, 0)))
                if not s.any():
                    preds.append(m.usual)
                    scores.append(0.0)
                    spans.append([])
                    continue
                path = viterbi(s, penalty)
                share = np.bincount(path, minlength=len(m.langs))
                preds.append(m.langs[int(share.argmax())])
                scores.append(float(share.max() / len(path)))
                cut = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)])).tolist()
                spans.append([{"first": a, "last": z - 1, "lang": m.langs[path[a]]} for a, z in zip(cut, cut[1:])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, lang_pred string, score double, spans {matrix}")
