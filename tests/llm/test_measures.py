"""Quality rules, periodic runs and whitening against brute force and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cartwheel.llm import queries, qualityrules, runs, whitening

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words long, kept string, runs int, `a.b` int"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
PLAIN = " ".join(f"word{i}" for i in range(80))


def odd_rows():
    return [(1, PLAIN, "en", "s", 1, "x", 0, 0), (1, PLAIN, "en", "s", 1, "x", 0, 0), (2, None, None, None, None, None, None, None),
            (3, "", "en", None, 0, "x", 0, 0), (4, " \t\n\v\f\r", None, "t", 3, "x", 0, 0), (5, LONG, "en", "s", 9, "x", 0, 0),
            (None, PLAIN, "en", "s", 1, "x", 0, 0), (None, PLAIN + " $$$$ " * 90, "en", "s", 1, "x", 0, 0),
            (6, "a b a b a b a b", None, None, 1, "x", 0, 0)]


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- quality rules

def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op11_quality_rules(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in qualityrules.COUNTS], ("base_failed", "boolean"), ("kept", "boolean")]
    for r in got.collect():
        n, chars, symbols, dups, repeats = tuple(r)[1:6]
        assert (n, chars, symbols, dups, repeats) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("text", ["a a a a a", "a b c a b c", "a b c x a b c y b c x", "a b c", "", "a b a b a", "ä ö ü ä ö ü ß"])
def test_repeated_words_of_small_texts(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(qualityrules.counts(qualityrules.F.col("text")).alias("c")).first()["c"]
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == plain_counts(text)


def test_sketches_merge_and_bound_the_error(spark):
    values = [random.Random(5).randrange(100_000) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", qualityrules.bucket(qualityrules.F.col("v")).alias("b"))
    for r in df.collect():
        assert r.b <= r.v < r.b + max(1, r.b / 2 ** (qualityrules.SKETCH_BITS - 1))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = qualityrules.measure(docs, ["doc_id", "lang", "source"])
    parts = [qualityrules.sketch(m.filter(f"doc_id % 3 = {i}")) for i in range(3)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    key = ["lang", "source"]
    assert sorted(qualityrules.merge(union, key).collect()) == sorted(qualityrules.merge(qualityrules.sketch(m), key).collect())


def test_fences_follow_the_group(spark):
    """The same text is usual in one source and odd in another."""
    quiet = [(i, PLAIN + f" end{i}", "en", "quiet") for i in range(300)]
    loud = [(1000 + i, (PLAIN + f" end{i}").replace("word1", "$$word1"), "en", "loud") for i in range(300)]
    odd = [(5000, " ".join(f"$$$$word{i}" for i in range(80)), "en", "quiet"), (5001, PLAIN, "xx", "rare"), (5002, PLAIN, None, None)]
    docs = spark.createDataFrame(quiet + loud + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in qualityrules.judge(docs).collect()}
    assert [i for i, kept in got.items() if not kept] == [5000]


def test_quality_of_odd_tables(spark, tmp_path):
    sf = save(spark, tmp_path, "documents", odd_rows(), DOCS)
    got = [tuple(r) for r in queries.op11_quality_rules(spark, sf).collect()]
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in odd_rows())
    assert {r[0] for r in got if r[7]} == {1, None}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    limits = qualityrules.thresholds(qualityrules.sketch(qualityrules.measure(docs, ["doc_id", "lang", "source"])))
    kept = qualityrules.keep(docs, limits)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}
    sf = save(spark, tmp_path / "none", "documents", [], DOCS)
    assert queries.op11_quality_rules(spark, sf).collect() == []


# ---- periodic runs

def plain_runs(w, min_length=6, min_periods=4):
    n, out = len(w), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_periods * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,periods", [(6, 4), (4, 2), (5, 3), (1, 2)])
def test_runs_equal_brute_force(least, periods):
    rnd, texts = random.Random(least), []
    for _ in range(400):
        n, kinds = rnd.randint(0, 60), rnd.randint(1, 3)
        w = [str(rnd.randint(0, kinds)) for _ in range(n)]
        if n and rnd.random() < 0.5:
            at, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
            w = w[:at] + [w[min(at + (i - at) % p, n - 1)] for i in range(at, n)]
        texts.append(w)
    got, left = runs._texts(texts, least, periods)
    assert got == [plain_runs(w, least, periods) for w in texts]
    for w, found, rest in zip(texts, got, left):
        gone = {k for i, length, q in found for k in range(i + q, i + length)}
        assert rest == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_classes_meet_alike_by_insertion_and_by_merge():
    rnd = random.Random(2)
    for _ in range(300):
        both = rnd.sample(range(200), 60)
        cut = rnd.randint(1, 59)
        one, other = sorted(both[:cut]), sorted(both[cut:])
        united, pairs = runs.meet(list(one), list(other))
        assert united == sorted(both)
        assert sorted(pairs) == [(i, j) for i, j in zip(united, united[1:]) if (i in one) != (j in one)]


def test_runs_of_long_periodic_texts():
    got, left = runs._texts([["a"] * 30_000, ["a", "b"] * 20_000 + ["c"]], 6, 4)
    assert got == [[(0, 30_000, 1)], [(0, 40_000, 2)]] and left == ["a", "a b c"]


def test_periodic_runs_query(spark):
    got = queries.op12_periodic_runs(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")],
                          ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = WORD.findall(r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 600:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {k for i, length, q in found for k in range(i + q, i + length)}
        i, length, q = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{i},{n},{q}\n" for i, n, q in found),
                                                                  " ".join(x for k, x in enumerate(w) if k not in gone))]
        assert got[r.doc_id] == (len(found), i, length, q, 1000 * length // q if found else None, *digest)
        seen += len(found)
    assert seen > 20


def test_runs_of_odd_tables(spark, tmp_path):
    sf = save(spark, tmp_path, "documents", odd_rows(), DOCS)
    empty = hashlib.sha256(b"").hexdigest()
    got = queries.op12_periodic_runs(spark, sf).collect()
    assert len(got) == len(odd_rows())
    assert {r.collapsed_sha256 for r in got if r.doc_id in (2, 3, 4)} == {empty}
    assert all(r.runs_sha256 == empty and r.start is None for r in got if not r.n_runs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = {r.doc_id: r for r in runs.find_runs(docs).filter("doc_id = 6").collect()}
    assert [tuple(x) for x in small[6].runs] == [(0, 8, 2)] and small[6].collapsed == "a b"
    sf = save(spark, tmp_path / "none", "documents", [], DOCS)
    assert queries.op12_periodic_runs(spark, sf).collect() == []


# ---- whitening

def plain_whitening(x, k):
    n = len(x)
    a = (n * x - x.sum(axis=0)) / n
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return a @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v), ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)


def test_whitening_query_equals_an_eigensolver(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 100_000
    white, share, deviation = plain_whitening(x, 8)
    got = queries.op13_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    by = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(by) == 8 * len(rows)
    for c in range(8):
        mine = np.array([by[r.vec_id, c + 1].whitened for r in rows])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-9
        assert abs(by[rows[0].vec_id, c + 1].explained / share[c] - 1) < 1e-9
    assert all(by[r.vec_id, 1].deviation == d for r, d in zip(rows, deviation.tolist()))
    assert max(r.identity_error for r in by.values()) < 1e-9


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-5])
def test_ill_conditioned_vectors(spark, spread):
    """Dimensions of very unequal variance: the shift lets the first factor exist, later passes repair it."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 6)) * (spread ** np.linspace(0, 1, 6)) @ np.linalg.qr(rnd.normal(size=(6, 6)))[0] + 50
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    model = whitening.fit(rows, "v")
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert np.allclose(model.eigenvalues, s, rtol=1e-6)
    assert whitening.identity_error(rows, "v", model, 6) < 1e-6
    out = whitening.whiten(rows, ["id"], "v", model, 3)
    assert out.columns == ["id", "whitened"] and {len(r.whitened) for r in out.collect()} == {3}


def test_whitening_of_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int, x int, whitened string, `a.b` int"
    good = [(i, [float(i % 5), float(i % 7), 2.0], 1, 0, "x", 0) for i in range(40)]
    odd = [(100, None, 1, 0, "x", 0), (101, [1.0, None, 2.0], 1, 0, "x", 0), (102, [1.0, float("nan"), 2.0], 1, 0, "x", 0),
           (103, [1.0, float("inf"), 2.0], 1, 0, "x", 0), (104, [], 1, 0, "x", 0), (105, [1.0], 1, 0, "x", 0),
           (106, [3e38, 1.0, 1.0], 1, 0, "x", 0), (None, [9.0, 1.0, 2.0], 1, 0, "x", 0), (3, [3.0, 3.0, 2.0], 1, 0, "x", 0)]
    sf = save(spark, tmp_path, "embeddings", good + odd, schema)
    got = queries.op13_whitening(spark, sf).collect()
    assert {r.n for r in got} == {42} and {r.component for r in got} == {1, 2}      # the third dimension has no variance
    assert collections.Counter(r.vec_id for r in got)[3] == 4 and sum(r.vec_id is None for r in got) == 2
    x = np.floor(1024 * np.array([v[1] for v in good] + [odd[-2][1], odd[-1][1]])).astype(np.int64) + 100_000
    white, share, deviation = plain_whitening(x, 2)
    mine = np.array([next(r.whitened for r in got if r.vec_id == i and r.component == 1) for i in range(40)])
    assert min(np.abs(mine - white[:40, 0]).max(), np.abs(mine + white[:40, 0]).max()) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9
    for name, rows in (("none", []), ("one", good[:1]), ("same", [good[0]] * 5)):
        sf = save(spark, tmp_path / name, "embeddings", rows, schema)
        assert queries.op13_whitening(spark, sf).collect() == []
