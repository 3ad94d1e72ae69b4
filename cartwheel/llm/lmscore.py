"""Stupid-backoff language-model scores.

    S(w | v) = c(v w) / c(v)          if c(v w) >= min_count
             = alpha * c(w) / N       otherwise

with counts over all documents. Relationally: the documents' n-grams are exploded
and pre-aggregated per chunk of documents, the count tables are partitioned by
hash, every partition sums its n-grams over all chunks, the counts are joined back
to the chunks' n-grams, and the logarithms are summed per document.

An n-gram travels as its 64-bit hash, and the n-grams that one chunk has in one
hash partition travel as one row of packed sorted arrays, each n-gram once per
chunk however often it occurs. A frequent n-gram is thus one entry per chunk, so no
partition is hot, and both shuffles are a few bytes per distinct n-gram. Chunks are
stored in the shared folder; each later step can be redone from there.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens after which a chunk of documents is closed.
CHUNK_TOKENS = 1_000_000
#: Distinct n-grams (summed over chunks) that one hash partition of the count tables holds.
PARTITION_NGRAMS = 2_000_000
START = b"\x00start"


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte by byte (high bytes are mostly 0)."""
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return pack(d.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(b: bytes) -> np.ndarray:
    d = unpack(b, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").ravel(), dtype=np.uint64)


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a bigram from its words' hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(docs: DataFrame) -> DataFrame:
    """``(chunk, n_tokens, doc_ids, sizes, words, tokens)``: one row per chunk of
    documents. ``words``: the chunk's distinct word hashes, ascending; ``tokens``:
    all tokens as numbers into ``words``, document after document.

    Words are runs of characters other than space and \\t-\\r, lower-cased (A-Z).
    A document is never cut; one longer than a chunk is a chunk of its own. Null
    text is a document of no words; a null id is kept. A chunk is told by its
    partition and its place there, so chunks of equal documents stay apart and a
    repeated task numbers alike.
    """
    def run(batches):
        key = TaskContext.get().partitionId() << 32
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        ids, sizes, tokens, held = [], [], [], 0

        def close():
            nonlocal key, number, ids, sizes, tokens, held
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            flat = place[np.concatenate(tokens)] if held else np.zeros(0, np.uint32)
            out = pa.RecordBatch.from_pydict({
                "chunk": pa.array([key], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "words": pa.array([pack_sorted(hashes[order])], pa.binary()),
                "tokens": pa.array([pack(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T)], pa.binary())})
            number = defaultdict()
            number.default_factory = number.__len__
            ids, sizes, tokens, held = [], [], [], 0
            key += 1
            return out

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, text in zip(doc_ids, b.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").lower().split()
                ids.append(i)
                sizes.append(len(words))
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= CHUNK_TOKENS or len(ids) >= 200_000:
                    yield close()
        if ids:
            yield close()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "chunk long, n_tokens long, doc_ids array<long>, sizes array<long>, words binary, tokens binary")
    return out


def _ngrams(sizes, words: np.ndarray, tokens: np.ndarray):
    """Of a chunk: distinct bigram hashes (ascending), their counts, the number of
    each token's bigram (-1 for the first word of a document), and per word its
    count and its count as a context."""
    first = np.zeros(len(tokens), bool)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    first[starts[np.asarray(sizes) > 0]] = True
    at = np.flatnonzero(~first)
    grams, number, count = np.unique(_mix(words[tokens[at - 1]], words[tokens[at]]), return_inverse=True,
                                     return_counts=True)
    bigram = np.full(len(tokens), -1, np.int64)
    bigram[at] = number
    unigram = np.bincount(tokens, minlength=len(words))
    context = np.bincount(tokens[at - 1], minlength=len(words))
    return grams, count, bigram, unigram, context


def _read(row: dict):
    words = unpack_sorted(row["words"])
    tokens = np.ascontiguousarray(unpack(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return row["sizes"], words, tokens


def _parts(keys: np.ndarray, n: int) -> list[int]:
    """Where each of n equal ranges of the hash space starts in ascending keys."""
    bounds = (np.arange(1, n, dtype=object) * (1 << 64) // n).tolist()
    return [0, *np.searchsorted(keys, np.array(bounds, np.uint64)).tolist(), len(keys)]


COUNTS = "part int, kind int, chunk long, keys binary, n binary, m binary"


def count_rows(stored: DataFrame, parts: int) -> DataFrame:
    """The chunks' n-grams by hash partition: kind 1 words with count and context
    count, kind 2 bigrams with count."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                sizes, words, tokens = _read(row)
                grams, count, _, unigram, context = _ngrams(sizes, words, tokens)
                out = []
                for kind, keys, n, m in ((1, words, unigram, context), (2, grams, count, None)):
                    cut = _parts(keys, parts)
                    for p, (a, z) in enumerate(zip(cut, cut[1:])):
                        if z > a:
                            out.append((p, kind, row["chunk"], pack_sorted(keys[a:z]), pack(n[a:z].astype("<u4")),
                                        pack(m[a:z].astype("<u4")) if m is not None else b""))
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(),
                                                           pa.binary()))],
                    names=["part", "kind", "chunk", "keys", "n", "m"])

    return stored.mapInArrow(run, COUNTS)


def _merge(t: pa.Table) -> pa.Table:
    """Count table of one hash partition and kind, joined back: every chunk's row
    gets the corpus counts of its n-grams."""
    keys = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    cut = np.cumsum([len(k) for k in keys])[:-1]
    back = {}
    for c in ("n", "m"):
        held = [unpack(x, "<u4") if x else None for x in t.column(c).to_pylist()]
        if held[0] is None:
            back[c] = [b""] * len(keys)
            continue
        total = np.bincount(place, np.concatenate(held).astype(np.float64), minlength=len(every)).astype("<u8")
        back[c] = [pack(x.astype("<u8").view(np.uint8).reshape(-1, 8).T) for x in np.split(total[place], cut)]
    return pa.table({"chunk": t.column("chunk"), "kind": t.column("kind"), "part": t.column("part"),
                     "n": pa.array(back["n"], pa.binary()), "m": pa.array(back["m"], pa.binary())})


def _counts_of(rows: list[dict], kind: int, column: str) -> np.ndarray:
    own = sorted((r["part"], r[column]) for r in rows if r["kind"] == kind)
    if not own:
        return np.zeros(0, "<u8")
    return np.concatenate([np.ascontiguousarray(unpack(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()
                           for _, x in own])


def score(docs: DataFrame, min_count: int = 2, alpha: float = 0.4) -> DataFrame:
    """``(doc_id, n_words, n_backoff, logprob)`` for every row of ``docs``: the sum of
    log S over the words of the whole text, natural logarithm.

    The first word of a document is scored by alpha * c(w) / N and counts as backed
    off; N is the number of words of all documents. Null, empty and blank texts
    have 0 words and logprob 0. Repeated rows each count and each get a score. An
    empty table gives no rows. Bigrams are told by 64-bit hashes.
    """
    stored = materialize(chunks(docs), "lm-chunks")
    total = stored.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-2 * total // PARTITION_NGRAMS))
    counted = count_rows(stored, parts).groupBy("part", "kind").applyInArrow(
        _merge, "chunk long, kind int, part int, n binary, m binary")
    body = stored.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("part"), "doc_ids", "sizes", "words", "tokens")
    none = F.array().cast("array<bigint>")
    empty = F.lit(None).cast("binary")
    rows = (body.withColumns({"n": empty, "m": empty})
            .unionByName(counted.withColumns({"doc_ids": none, "sizes": none, "words": empty, "tokens": empty})))

    def finish(t: pa.Table) -> pa.Table:
        every = t.to_pylist()
        counts = [r for r in every if r["kind"]]
        unigram, context, bigram = _counts_of(counts, 1, "n"), _counts_of(counts, 1, "m"), _counts_of(counts, 2, "n")
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_backoff": [], "logprob": []}
        for row in (r for r in every if r["kind"] == 0):
            sizes, words, tokens = _read(row)
            if len(tokens):
                number = _ngrams(sizes, words, tokens)[2]
                back = np.log(alpha) + np.log(unigram.astype(float) / total)[tokens]
                joint = np.where(number >= 0, bigram[number] if len(bigram) else 0, 0).astype(float)
                before = np.concatenate(([1.0], context.astype(float)[tokens[:-1]]))
                found = joint >= min_count
                logs = np.where(found, np.log(np.maximum(joint, 1) / np.maximum(before, 1)), back)
            else:
                logs, found = np.zeros(0), np.zeros(0, bool)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            out["doc_id"] += row["doc_ids"]
            out["n_words"] += list(sizes)
            out["n_backoff"] += [int((~found[a:z]).sum()) for a, z in zip(starts, ends)]
            out["logprob"] += [float(logs[a:z].sum()) for a, z in zip(starts, ends)]
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_backoff": pa.array(out["n_backoff"], pa.int64()),
                         "logprob": pa.array(out["logprob"], pa.float64())})

    return rows.groupBy("chunk").applyInArrow(
        finish, "doc_id long, n_words long, n_backoff long, logprob double")
