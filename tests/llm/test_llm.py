"""The training-data operators against brute force, held-out rows and edge cases."""

import collections
import datetime as dt
import math

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from cartwheel.llm import (covertree, decontamination, graph, langid, licenses, lmscore, mixing, sharding, simhash,
                           toxicity, urlfilter)
from cartwheel.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, shard int"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
ODD = [(1, "a b c d e f", "en", "s", 1, "x", 0, 0), (2, "A b C d e f", "en", "s", 1, "x", 0, 0),
       (3, None, None, None, None, None, None, None), (4, "", "en", None, 0, "x", 0, 0), (5, " \t\n", None, "t", 3, "x", 0, 0),
       (6, LONG, "en", "s", 9, "x", 0, 0), (6, LONG, "en", "s", 9, "x", 0, 0), (None, "a b c d e f", "en", "s", 1, "x", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


# ---- SimHash

def plain_simhash(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_equals_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.filter("doc_id < 300").collect()}
    got = simhash.near_duplicates(docs.filter("doc_id < 300")).collect()
    fp = {i: plain_simhash(t) for i, t in texts.items()}
    assert {r.doc_id: r.fp & (2 ** 64 - 1) for r in got} == fp
    root = brute_components(set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id: r.component_id for r in got} == {i: least[root[f]] for i, f in fp.items()}


def test_links_lose_none_in_dense_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2 ** 63, 60)]
    fps = set(base) | {base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    fps |= {b ^ 0b1111 for b in base[:20]} | {b ^ (0b11111 << 20) for b in base[20:40]}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    want = brute_components(fps)
    got_groups = collections.Counter(frozenset(g) for g in _groups({f: comp.get(f, f) for f in fps}))
    assert got_groups == collections.Counter(frozenset(g) for g in _groups(want))


def _groups(label):
    out = collections.defaultdict(set)
    for k, v in label.items():
        out[v].add(k)
    return out.values()


def test_simhash_odd_rows_and_keep_one(odd, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (6, 6)}
    kept = simhash.keep_one(odd, simhash.near_duplicates(odd))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, None] and kept.columns == odd.columns
    assert simhash.near_duplicates(empty).count() == 0


# ---- top-k

def test_topk_equals_brute_force_with_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "vec_id", covertree.quantized("embedding").alias("v"))
    got = collections.defaultdict(list)
    for r in sorted(covertree.top_k(df, df.filter("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if e and None not in e and not any(map(math.isnan, e))}
    want = {q: sorted(((i, sum(a * b for a, b in zip(v[q], w))) for i, w in v.items() if i != q),
                      key=lambda t: (-t[1], t[0]))[:5] for q in v if q % 50 == 0}
    assert got == want
    none = df.filter("vec_id < 0")
    assert covertree.top_k(none, none).count() == 0


def test_dual_search_prunes_clustered_data():
    """Right on clustered and on spread vectors with ties; few pairs are scored where the data allow it."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    near = np.floor(256 * (centres[rng.integers(0, 20, 4096)] + 0.05 * rng.normal(size=(4096, 64)))).astype(np.int64)
    spread = rng.integers(-2, 3, (1500, 6))
    share = {}
    for name, x, q in (("near", near, near[::100][:40]), ("spread", spread, spread[::20])):
        best = covertree.dual_search(q, x, np.arange(len(x)), 5)
        share[name] = best.scored / (len(q) * len(x))
        for row, v in enumerate(q):
            s = x @ v
            assert [(int(s[i]), int(i)) for i in np.lexsort((np.arange(len(x)), -s))[:5]] == [
                (int(a), int(i)) for a, i in zip(best.score[row], best.at[row])]
    assert share["near"] < 0.3 and share["spread"] <= 1


def test_query_equals_brute_force(spark):
    """op2's rows against all products of the whole table."""
    df = entry.queries()["op2_exact_topk"](spark, SF)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    ids = np.array([r.vec_id for r in good])
    x = np.floor(256 * np.array([r.embedding for r in good], float)).astype(np.int64)
    expected = []
    for at in np.nonzero(ids % 50 == 0)[0]:
        s = x @ x[at]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[at]][:5]
        expected += [(int(ids[at]), rank, int(ids[i]), int(s[i])) for rank, i in enumerate(order, 1)]
    assert sorted(map(tuple, df.collect())) == sorted(expected)


# ---- toxicity

def test_toxicity_held_out_and_counterfactual(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    r = (toxicity.score(docs, m).join(labels, "doc_id").filter(crc_mod("doc_id", 4) == 2)
         .select("toxicity", "toxic").collect())
    pos = [x.toxicity for x in r if x.toxic == 1]
    neg = [x.toxicity for x in r if x.toxic == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 50 and auc > 0.95
    rows = [(i, f"the {'women' if i % 2 else 'idiot women'} went home {i}", i) for i in range(40)]
    rows += [(40 + i, f"the {'weather' if i % 2 else 'idiot'} was here {i}", i) for i in range(40)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int("idiot" in t or ("women" in t and i % 3 == 0))) for i, t, _ in rows],
                                "doc_id long, toxic int")
    ask = spark.createDataFrame([(0, "the women went home"), (1, "the men went home")], "doc_id long, text string")

    def gap(penalty):
        a, b = [x.toxicity for x in toxicity.score(ask, toxicity.train(d, lab, min_docs=1, penalty=penalty)).orderBy("doc_id").collect()]
        return abs(a - b)

    assert gap(5.0) < 0.25 * gap(0.0)


def test_toxicity_odd_rows(spark, odd, empty):
    m = toxicity.Model({"<idiot>": 3.0}, -1.0)
    got = toxicity.score(odd, m)
    assert got.columns == odd.columns + ["toxicity"] and got.count() == len(ODD)
    assert all(abs(r.toxicity - 1 / (1 + math.e)) < 1e-9 for r in got.collect())
    assert toxicity.score(empty, m).count() == 0
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights == {} and none.bias == 0.0


# ---- mixing and sharding

def test_mix_targets_and_copies(spark, odd, empty):
    d = spark.createDataFrame([(i, "a b c " * (i % 7 + 1), f"s{i % 4}" if i % 9 else None) for i in range(400)],
                              "doc_id long, text string, source string")
    rows = mixing.decide(d).collect()
    total = sum(r["size"] for r in rows)
    target = {r.source: r.target for r in rows}
    assert abs(sum(target.values()) - total) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in rows)
    assert mixing.emit(d).count() == sum(r.copies for r in rows) and mixing.emit(d).columns == d.columns
    assert mixing.decide(odd).count() == len(ODD) and mixing.decide(empty).count() == 0
    assert mixing.emit(odd).columns == odd.columns and mixing.emit(empty).count() == 0


def test_shards_equal_the_plain_heap(docs):
    import heapq
    rows = docs.select("doc_id", "text").collect()
    total = collections.Counter()
    for r in rows:
        total[r.text] += len(r.text.encode()) + 16
    heap = [(0, s) for s in range(40)]
    for size in sorted(total.values(), reverse=True):
        x, s = heapq.heappop(heap)
        heapq.heappush(heap, (x + size, s))
    got = sharding.shard(docs).collect()
    loads = collections.Counter()
    place = collections.defaultdict(set)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        loads[r.shard] += r["size"]
        place[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in place.values()) and len(got) == len(rows)
    assert max(loads.values()) - min(loads.values()) <= max(h[0] for h in heap) * 0.01
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_deal_of_distinct_classes_is_the_heap_and_odd_rows(odd, empty):
    assert sharding.deal([(9, 1, 9.0), (5, 1, 5.0), (4, 1, 4.0), (3, 1, 3.0)], 2) == [
        (9, 0, 0, 0), (5, 1, 0, 0), (4, 1, 0, 0), (3, 0, 0, 0)]
    runs = sharding.deal([(9, 3, 9.0), (2, 1000, 2.0)], 4)
    load = collections.Counter()
    for key, s, a, z in runs:
        load[s] += key * (z - a + 1)
    assert sum(z - a + 1 for _, _, a, z in runs) == 1003 and max(load.values()) - min(load.values()) <= 2
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r.doc_id in (3, 4)} == {16}
    assert sharding.shard(empty).count() == 0


# ---- language

def test_language_held_out_and_spans(spark, docs):
    m = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    got = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").filter(crc_mod("doc_id", 3) == 1)
    rows = got.select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    part = {r.lang: r.text for r in docs.filter("lang in ('en', 'de') and length(text) between 300 and 900").collect()}
    mixed = spark.createDataFrame([(1, part["en"] + "\n" + part["de"])], "doc_id long, text string")
    spans = langid.identify(mixed, m).first().spans
    assert [s.lang for s in spans] == ["en", "de"]


def test_viterbi_equals_all_paths(spark, odd, empty):
    import itertools
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        for _ in range(30):
            s = rng.normal(0, 3, (n, 3)).astype(np.float32)

            def value(p):
                return sum(float(s[i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert abs(value(langid.viterbi(s, 2.0).tolist()) - best) < 1e-4
    m = langid.train(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, m).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[1] == "en"
    signs = spark.createDataFrame([(1, "\u00b2 \u00bd 12_3"), (2, "\u0431\u0443\u043a\u0432\u044b x\u00b2")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(signs, m).collect()}[1] == ("und", 0.0)
    assert {r.doc_id: r.lang_pred for r in langid.identify(signs, m).collect()}[2] == "en"
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


# ---- language model

def test_lm_equals_brute_force(spark, odd, empty, docs, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_TOKENS", 5000)
    for df in (docs.filter("doc_id < 200").select("doc_id", "text"), odd):
        rows = df.select("doc_id", "text").collect()
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            w = words(r.text)
            uni.update(w)
            ctx.update(w[:-1])
            bi.update(zip(w, w[1:]))
        n = sum(uni.values())
        want = []
        for r in rows:
            w, z = words(r.text), 0.0
            for k, x in enumerate(w):
                c = bi[(w[k - 1], x)] if k else 0
                z += math.log(c / ctx[w[k - 1]]) if c >= 2 else math.log(0.4 * uni[x] / n)
            want.append((str(r.doc_id), len(w), round(z, 3)))
        got = [(str(r.doc_id), r.n_words, round(r.logprob, 3)) for r in lmscore.score(df).collect()]
        assert sorted(got) == sorted(want)
    assert lmscore.score(empty).count() == 0


def test_lm_of_equal_chunks_in_two_partitions(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(lmscore, "PARTITION_NGRAMS", 20_000)
    once = docs.filter("doc_id < 200").select("doc_id", "text").coalesce(1)
    for _ in range(2):
        once.write.mode("append").parquet(str(tmp_path / "twice"))
    both = spark.read.parquet(str(tmp_path / "twice"))
    assert len({r.chunk for r in lmscore.chunks(both).select("chunk").collect()}) == 2
    want = sorted((r.doc_id, round(r.logprob, 6)) for r in lmscore.score(both.coalesce(1)).collect())
    assert sorted((r.doc_id, round(r.logprob, 6)) for r in lmscore.score(both).collect()) == want


# ---- decontamination

def test_decontamination_equals_brute_force(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    bench = {r.item_id: " ".join(norm(r.text)) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, b in bench.items() if b in " ".join(norm(r.text))}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert want and got == want
    assert decontamination.leaks(odd, items).count() == 0 and decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(docs, items.filter("item_id < 0")).count() == 0


def test_decontamination_slots(spark):
    item = spark.createDataFrame([(7, "Yesterday Alice had 30 apples and gave 8 apples to the girl while Alice kept 30 apples."),
                                  (8, None), (None, "x"), (9, "two words")], "item_id long, text string")
    d = spark.createDataFrame([
        (1, "So. Yesterday Bob had 12 apples and gave 5 apples to the girl while Bob kept 12 apples. End"),
        (2, "Yesterday Bob had 12 apples and gave 5 apples to the girl while Tom kept 9 apples."),
        (3, "two words of no matter and then some more that are not in any item at all")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.exact) for r in decontamination.leaks(d, item).collect()] == [(1, 7, False)]


def leaked(spark, item, texts):
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.exact) for r in decontamination.leaks(d, i).collect())


def test_decontamination_of_items_of_few_words(spark):
    item = "What is 12 + 30 + 45 - 7 + 9?"
    assert leaked(spark, item, ["so: " + item + " well", "What is 12 + 30 + 45 - 8 + 9?", "what is 12 and 30"]) == [(0, True)]


def test_decontamination_unites_nearby_shifts(spark):
    item = ("the old farmer told his friend Alice that ten of the wild geese saw Alice near "
            "a frozen lake and every one of them flew south before heavy snow came")
    texts = [item.replace("Alice", "Mary Ann"), item.replace("ten of", "ten big fat of").replace("frozen", "small and frozen")
             .replace("every", "so nearly every"), item.replace("Alice", "Bob", 1).replace("Alice", "Tom")]
    assert leaked(spark, item, texts) == [(0, False), (1, True)]
    cut = "one two three four five six seven eight nine ten eleven twelve of all these many small birds sang so very well on trees here today again"
    w = cut.split()
    assert leaked(spark, cut, [" ".join([*w[:9], "x", *w[9:18], "y", "z", *w[18:]]), " ".join(w[:9])]) == [(0, True)]


def test_decontamination_of_names_that_open_a_sentence(spark):
    item = "Alice had 30 apples. Alice gave 8 apples to Bob."
    assert leaked(spark, item, [item, "Tom had 12 apples. Tom gave 5 apples to Kim.", "Question Tom had 12 apples. Tom gave 5 apples to Kim.",
                                "Tom had a dog. Kim gave 5 apples to Tom."]) == [(0, True), (1, False), (2, False)]
    short = "Where did the grey horse sleep yesterday?"
    assert leaked(spark, short, ["Question " + short, "Where did the grey horse quietly sleep yesterday?",
                                 "Where did the black horse sleep yesterday?", "Where did the grey"]) == [(0, True), (1, True), (2, True)]


# ---- licenses and URLs

def test_license_families(spark, empty, odd):
    background = spark.read.parquet(f"{SF}/documents.parquet")
    m = licenses.train(spark, background, background=300)
    lines = ["noise\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "he lost his driving license there", "Licensed under the Foo Bar agreement of nobody"]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan(d, m).collect()}
    assert got == {0: "apache-2.0", 1: "mit", 2: "proprietary", 3: "gpl", 4: "cc-by-nc", 5: "unknown", 6: "unknown"}
    assert licenses.scan(odd, m).count() == 0 and licenses.scan(empty, m).count() == 0


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy",
       "of this software and associated documentation files (the \"Software\"), to deal",
       "in the Software without restriction, including without limitation the rights",
       "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
       "copies of the Software, and to permit persons to whom the Software is",
       "furnished to do so, subject to the following conditions:"]
BSD = ["Redistribution and use in source and binary forms, with or without",
       "modification, are permitted provided that the following conditions", "are met:"]
GPL = ["This program is free software: you can redistribute it and/or modify",
       "it under the terms of the GNU General Public License as published by",
       "the Free Software Foundation, either version 3 of the License, or",
       "(at your option) any later version."]
ISC = ["Permission to use, copy, modify, and/or distribute this software for any",
       "purpose with or without fee is hereby granted, provided that the above",
       "copyright notice and this permission notice appear in all copies."]


def test_license_of_wrapped_notices(spark):
    m = licenses.train(spark, spark.read.parquet(f"{SF}/documents.parquet"), background=300)
    noise = ["the code of this part was written by hand for the old machine and reads the file line by line"] * 6
    texts = ["/*\n * Copyright (c) 2019 A. Person\n *\n * " + "\n * ".join(MIT) + "\n */\nint main;", "# " + "\r\n# ".join(BSD),
             "dnl " + "\ndnl ".join(GPL) + "\ndnl\ndnl end", "\n".join(ISC), "\n".join(noise + BSD + noise),
             "// Copyright 2020 Foo. All rights\n// reserved.", "\n".join([*noise, "Released under the MIT License.", *noise]),
             "Released under the MIT License.\nAll rights reserved."]
    d = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (None, texts[3])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.family) for r in licenses.scan(d, m).collect())
    assert got == sorted([("0", "mit"), ("1", "bsd"), ("2", "gpl"), ("3", "isc"), ("4", "bsd"), ("5", "proprietary"), ("6", "mit"),
                          ("7", "mit"), ("7", "proprietary"), ("None", "isc"), ("None", "isc")])


def test_url_history(spark):
    day = lambda s: dt.date.fromisoformat(s)
    e = spark.createDataFrame([
        ("ads", "domain", "Bad.example.com", day("2020-01-10"), "add"), ("ads", "domain", "bad.example.com", day("2020-03-01"), "remove"),
        ("ads", "domain", "bad.example.com", day("2020-06-01"), "add"), ("allow", "url", "www.bad.example.com/a/b/c/d", day("2020-01-01"), "add"),
        ("ads", "domain", "x.y.z.w.deep.org", day("2020-01-01"), "add"), ("ads", "domain", None, day("2020-01-01"), "add")],
        "list string, kind string, value string, day date, action string")
    c = spark.createDataFrame([
        (1, "http://bad.example.com/", day("2020-01-09")), (2, "http://sub.bad.example.com:80/x?y", day("2020-01-10")),
        (3, "https://bad.example.com/q", day("2020-03-01")), (4, "https://www.BAD.example.com/a/b/c/d/e", day("2020-07-01")),
        (5, "https://notbad.example.com/", day("2020-07-01")), (6, None, day("2020-07-01")), (7, "http://bad.example.com", None),
        (8, "https://v.x.y.z.w.deep.org/", day("2020-02-01")), (9, "https://q.y.z.w.deep.org/", day("2020-02-01")),
        (2, "http://sub.bad.example.com:80/x?y", day("2020-01-10"))], "capture_id long, url string, fetched date")
    got = sorted((r.capture_id, r.n_active, r.blocked) for r in urlfilter.judge(c, e, ["ads"], ["allow"]).collect())
    assert got == [(1, 0, False), (2, 1, True), (2, 1, True), (3, 0, False), (4, 2, False), (5, 0, False), (6, 0, False),
                   (7, 0, False), (8, 1, True), (9, 0, False)]
    assert urlfilter.judge(c.limit(0), e, ["ads"], []).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    cols, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(
            stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == cols
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) > 400, name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count()
    assert {"pipeline", "op3_simhash", "op10_lm_score"} <= set(entry.queries())
