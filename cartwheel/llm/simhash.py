"""SimHash near-duplicate groups through pivot distance tables.

Method. Every text gets a 64-bit SimHash of its word shingles. For a fixed set of
reference fingerprints the Hamming distances of a fingerprint to all references
are its row of the pivot distance table. By the triangle inequality two
fingerprints within d bits differ by at most d in every coordinate, so a pair with
a larger maximum coordinate difference is discarded unseen; survivors are verified
on the fingerprints themselves.

Testing that bound on all pairs would be quadratic, so the references are chosen to
make a first discard an equality join: besides far references, there is an anchor
and, per bit, the anchor with that bit flipped. The flipped references fall into
``max_bits + 2`` groups of neighbouring bits, and a distance relative to the
anchor's depends on the bits of its own group alone. d differing bits touch at
most d groups, so a linked pair has equal relative distances in two groups at
least. Pairs that agree in no two groups are therefore discarded by the join (no
link is lost), and the rest go through the maximum coordinate difference over the
whole table and the final check.
"""

from __future__ import annotations

import sys
from itertools import combinations
from operator import getitem

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, parallelism, quoted
from .graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Shingles hashed at a time, so that a very long text needs bounded memory.
SHINGLE_BLOCK = 1 << 15
#: Members of one join cell compared in one task; larger cells are split in blocks.
CELL_BLOCK = 2048
ANCHOR = 0x9E3779B97F4A7C15
FAR_REFERENCES = 32


# ---- fingerprints -----------------------------------------------------------

def _splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_hashes(words: list[bytes], n: int):
    """XXH64 of all n-word shingles, block by block; fewer words: of the whole."""
    total = max(1, len(words) - n + 1)
    for at in range(0, total, SHINGLE_BLOCK):
        count = min(SHINGLE_BLOCK, total - at)
        part = words[at:at + count + n - 1]
        text = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:count].tolist()
        stops = (ends[-count:] - 1).tolist()
        yield np.fromiter(map(xxhash.xxh64_intdigest, [text[a:b] for a, b in zip(starts, stops)], [SEED] * count),
                          np.uint64, count)


def simhash(text: bytes | None, n: int) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    total, counts = 0, np.zeros(64, np.int64)
    for h in _shingle_hashes(words, n):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(h) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp long)`` for every row of ``docs``, whole texts.

    A-Z are lower-cased, words are runs of characters other than space and
    \\t-\\r, shingles count as often as they occur. Null, empty and blank texts
    get fingerprint 0. Other columns of ``docs`` are not looked at.
    """
    def run(batches):
        for b in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else None, shingle)
                   for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---- pivot distance table ---------------------------------------------------

def references() -> np.ndarray:
    """Anchor, the anchor with each single bit flipped, and far references."""
    near = np.uint64(ANCHOR) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    far = _splitmix(np.arange(1, FAR_REFERENCES + 1, dtype=np.uint64))
    return np.concatenate([far, [np.uint64(ANCHOR)], near]).astype(np.uint64)


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (row) to each reference (column)."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ references()[None, :]).astype(np.int8)


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(cell, fp)``: per pair of reference groups, a key of the fingerprint's
    relative distances in both groups."""
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
    groups = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [np.uint64(x | y) for x, y in combinations(groups, 2)]
    salt = _splitmix(np.arange(1000, 1000 + len(masks), dtype=np.uint64))

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                table = distance_table(part)
                relative = table[:, FAR_REFERENCES + 1:] - table[:, FAR_REFERENCES:FAR_REFERENCES + 1]
                signs = np.packbits(relative[:, ::-1] < 0, axis=1).view(">u8").ravel().astype(np.uint64)
                cells = np.concatenate([_splitmix((signs & m) ^ s) for m, s in zip(masks, salt)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.view(np.int64)), pa.array(np.tile(part, len(masks)))], names=["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def _linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int):
    """Of the pairs (i, j), those within ``max_bits``: each coordinate in turn
    discards pairs, the rest are verified."""
    for c in range(table.shape[1]):
        if len(i) == 0:
            break
        ok = np.abs(table[i, c] - table[j, c]) <= max_bits
        i, j = i[ok], j[ok]
    ok = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits
    return i[ok], j[ok]


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, parent: dict) -> list[tuple[int, int]]:
    """The pairs that join two trees of the union-find ``parent``."""
    out = []

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)``: links between different fingerprints of ``fps(fp)`` whose
    components are those of all pairs within ``max_bits`` bits. Links that only
    close a circle within one task's cells are left out, so a dense group does not
    emit its pairs.

    A cell with many members is split into blocks and each pair of blocks is
    compared on its own, so no task holds more than two blocks of a cell.
    """
    spark = fps.sparkSession
    cells = materialize(_cells(fps, max_bits), "pivot-cells")
    full = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select("cell", F.ceil(F.col("n") / CELL_BLOCK).cast("int").alias("g")))
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    members = (cells.join(full, "cell").withColumn("own", own)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
               .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    members = (members.repartition(parallelism(spark), "cell", "i", "j")
               .sortWithinPartitions("cell", "i", "j"))

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            keys = [t.column(k).to_numpy() for k in ("cell", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0      # the last cell may go on in the next batch
            yield compare([k[:cut] for k in keys], t.column("fp").to_numpy()[:cut])
            rest = t.slice(cut).combine_chunks().to_batches()
            held = rest[0] if rest else None
        if held is not None:
            yield compare([held.column(k).to_numpy() for k in range(3)], held.column(3).to_numpy())

    def compare(keys, fp):
        table, parent, out = distance_table(fp), {}, []
        i = np.arange(len(fp) - 1)
        step = 1
        while len(i):                                  # pairs (x, x + step) of the same cell
            i = i[i + step < len(fp)]
            i = i[np.all([k[i] == k[i + step] for k in keys], axis=0)]
            a, b = _linked(fp, table, i, i + step, max_bits)
            out += _forest(fp[a], fp[b], parent)
            step += 1
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Two rows are linked when their fingerprints differ in at most ``max_bits``
    bits (equal fingerprints included, so null, empty and blank texts form one
    group, with any text whose fingerprint is within ``max_bits`` bits of 0);
    component_id is the smallest doc_id that can be reached. Repeated rows stay
    and share a component; a null doc_id is kept but never becomes a
    component_id unless its group has no other. An empty table gives no rows.
    """
    fp = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = materialize(nodes, "fingerprint-nodes")
    comp = components(links(nodes, max_bits))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = rooted.join(first, "root").select("fp", "component_id")
    return fp.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id leads its component, one row each; where an
    id occurs on several rows the row with the least text hash stays. Rows without
    an id cannot lead a group and stay as they are."""
    rows, mark = fresh(docs, "_rows"), fresh(docs, "_h")
    lead = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows))
    once = docs.join(lead.filter(F.col(rows) == 1).select("doc_id"), "doc_id", "left_semi")
    again = (docs.join(lead.filter(F.col(rows) > 1).select("doc_id"), "doc_id", "left_semi")
             .withColumn(mark, F.xxhash64(*quoted(docs))))
    least = again.groupBy("doc_id").agg(F.min(mark).alias(mark))
    again = again.join(least, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id"])
    no_id = docs.filter("doc_id is null")
    cols = quoted(docs)
    return once.select(cols).unionByName(again.select(cols)).unionByName(no_id.select(cols))
