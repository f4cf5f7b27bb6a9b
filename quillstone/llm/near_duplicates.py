"""Near duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded, then verified.

Words are runs of letters and digits, lower-cased in ASCII; a shingle is five consecutive words (all of them in a text
of fewer). Its weight is its count in the text times idf = ln(1 + N / df), over N distinct texts. The document frequency
df of every shingle is counted exactly: blocks of texts send their shingles to ranges of hashes, a range adds up what it
gets and answers each block with those that are in more than one text.

Each text draws SAMPLES consistent samples (Ioffe's ICWS: two texts agree on a draw with the probability of their
weighted Jaccard similarity). Every band joins three draws; texts that share a band meet in its bucket. A bucket
proposes its members to two leaders each, never all pairs. A pair counts only if an exact check follows: its weighted
Jaccard similarity is LEAST or more. In that check alone the idf is ln(1 + N / max(df, N / 20)), so near copies don't
become less alike as their group grows, while wide-spread boilerplate counts less. Then buckets whose members ended up in several classes propose the classes' representatives to one
another, until no untested pair is proposed. Classes are the connected components.

Members of buckets that still hold several classes are unsettled. They are joined exactly: with the shingles of each
text in one order, those in few unsettled texts first, a pair of LEAST similarity has its first common shingle where
both texts have enough weight left for it, near the beginning. So only pairs of different classes whose beginnings
share such a shingle can be near; of those, all are tested that have enough weight in the same cells of hashes. Two texts that share a bucket are thus linked, tested or
provably less similar than LEAST.

Edge cases: texts without words (null, empty, signs only) are alone, each in a class of its own; equal texts are always
together and enter the search once; rows that repeat are equal texts; a null doc_id keeps its row, with its class, and
is last where the least id counts; ties of draws go to the least hash; very long texts are read whole; other columns are
ignored by the search and kept by keep_one(); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.components import components, extended
from quillstone.llm.shared import column, fresh, row_keys, scratch, settle, table, to_rows
from quillstone.llm.words import LETTERED, U, hash_words, mix, row_blocks, shingles, string_buffers

SHINGLE = 5
LEAST = 0.8
SAMPLES = 24
COMMON = 20  # in the check, idf is flat for shingles in up to one of so many texts
_RANGES, _RANGE, _WORD_BYTES = 128, 1 << 22, 6  # at least so many ranges; shingles of texts that one gets; about so many bytes of text make one
_BLOCKS = 8  # of the texts that one task has written
_HELD = 1 << 21
_TABLE = 1 << 16
_SLOTS = 1 << 20  # counters that rank shingles by how many unsettled texts hold them
_EARLIER = 16
_CELLS, _SHIFT = 128, 45  # cells of the shingles' hashes, by their highest bits, and
_WHOLE = 32_000  # the parts that a text's weight has in all cells
_WORDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # a byte that LETTERED keeps
_SLACK = 1 - 1e-6  # for rounding in sums of weights
_SPREAD = (0, 1, 5)  # draws of band i: i + each, modulo SAMPLES; their differences differ, so two bands share one draw at most


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) values at evenly spaced probabilities, and their logarithms: solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    lo, hi = np.zeros(_TABLE), np.full(_TABLE, 40.0)
    for _ in range(60):
        x = (lo + hi) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(under, x, lo), np.where(under, hi, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles()
_rng = np.random.Generator(np.random.PCG64(7))
_SEEDS = _rng.integers(1, 1 << 63, (SAMPLES, 2), dtype=np.uint64) | U(1)


def text_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: (first row, rows, row of each entry, shingle, count), sorted by row and shingle (52 bits)."""
    data, offsets = string_buffers(column)
    for lo, hi in row_blocks(offsets):
        h, row, _, _ = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], LETTERED)
        sh, at, _ = shingles(h, row, hi - lo, SHINGLE)
        for a in range(0, max(hi - lo, 1), 4096):  # row and shingle fit 64 bits
            here = (at >= a) & (at < a + 4096) if hi - lo > 4096 else slice(None)
            packed = np.sort(((at[here] - a).astype(np.uint64) << U(52)) | (sh[here] >> U(12)))
            first = np.ones(len(packed), bool)
            first[1:] = packed[1:] != packed[:-1]
            where = np.flatnonzero(first)
            count = np.diff(where, append=len(packed))
            packed = packed[where]
            yield lo + a, min(4096, hi - lo - a), (packed >> U(52)).astype(np.int64), packed & U((1 << 52) - 1), count


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers with their lowest bytes first, then the next ones: those that are mostly 0 take next to no room once compressed."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _gaps(sh: np.ndarray) -> bytes:
    return _packed(np.diff(sh, prepend=np.zeros(1, np.uint64)))


def _asker(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (block, text): for each block and range of hashes, its shingles and how many of the block's texts hold each. A block may ask in several rows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def asked() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                sh, texts = np.unique(np.concatenate(parts), return_counts=True)
                ends = np.searchsorted((sh >> U(20)) * U(ranges) >> U(32), np.arange(ranges + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(ends))
                cuts = [slice(ends[r], ends[r + 1]) for r in some]
                yield pa.RecordBatch.from_pydict({"range": pa.array(some), "block": pa.array(np.full(len(some), block, np.int64)), "shingles": pa.array([_gaps(sh[c]) for c in cuts], pa.binary()), "texts": pa.array([_packed(texts[c]) for c in cuts], pa.binary())})

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for first, _, row, sh, _ in text_sets(batch.column(1)):
                of = blocks[first + row]
                for block in np.unique(of).tolist():
                    held.setdefault(block, []).append(sh[of == block])
                n += len(sh)
                if n > _HELD:
                    yield from asked()
                    held, n = {}, 0
        yield from asked()

    return ask


def _adder(texts: int) -> Callable[[pa.Table], pa.Table]:
    """Of one range: for each row of a block, those of its shingles that several texts hold and how many do; as block -1, those in over a share of 1 / COMMON of all texts."""

    def add(asked: pa.Table) -> pa.Table:
        each = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in asked.column("shingles")]
        sh, n = np.concatenate(each), np.concatenate([_unpacked(x.as_py()) for x in asked.column("texts")])
        order = np.argsort(sh, kind="stable")
        starts = np.flatnonzero(np.diff(sh[order], prepend=~sh[order[:1]]))
        total = np.add.reduceat(n[order], starts)
        df = np.empty(len(sh), np.uint64)
        df[order] = np.repeat(total, np.diff(starts, append=len(sh)))
        ends = np.cumsum([len(x) for x in each])
        told = [(b, e - len(x) + np.flatnonzero(df[e - len(x) : e] > 1)) for b, e, x in zip(asked.column("block").to_pylist(), ends, each, strict=True)]
        told.append((-1, order[starts[total * U(COMMON) > texts]]))
        told = [(b, at) for b, at in told if len(at)]
        return pa.table({"block": pa.array([b for b, _ in told], pa.int64()), "shingles": pa.array([_gaps(sh[at]) for _, at in told], pa.binary()), "df": pa.array([_packed(df[at]) for _, at in told], pa.binary())})

    return add


def _listed(shingles: list[bytes], df: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in order, each once, and their document frequencies."""
    if not shingles:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sh, at = np.unique(np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint64) for x in shingles]), return_index=True)
    return sh, np.concatenate([_unpacked(x) for x in df])[at].astype(np.int64)


class Idf:
    """idf of shingles by their document frequencies; of those not in `common` it is ln(1 + rest)."""

    def __init__(self, texts: int, common: np.ndarray, frequency: np.ndarray, rest: float = COMMON):
        self.common = common
        self.flat = np.float32(np.log1p(rest))
        self.values = np.log1p(max(texts, 1) / np.maximum(frequency, 1)).astype(np.float32)

    def weights(self, sh: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.full(len(sh), self.flat, np.float32)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, sh), len(self.common) - 1)
            hit = self.common[at] == sh
            out[hit] = self.values[at[hit]]
        return out * count.astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[int, DataFrame, Idf]:
    """Of a table (block, text) of distinct texts: the number of those with words; (block, shingles, df) of the shingles of each block that are in several texts, packed; the idf of the check.

    The last lists at most COMMON times the mean number of shingles of a text.
    """
    known = texts.agg(F.sum(F.col("text").rlike(_WORDED).cast("long")).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, ranges = known["n"] or 0, max(_RANGES, (known["bytes"] or 0) // _WORD_BYTES // _RANGE)
    asked = texts.select("block", "text").mapInArrow(_asker(ranges), "range long, block long, shingles binary, texts binary")
    told = settle(asked.groupBy("range").applyInArrow(_adder(n), "block long, shingles binary, df binary"), "near-frequencies")
    common = told.where("block < 0").collect()
    return n, told.where("block >= 0"), Idf(n, *_listed([r["shingles"] for r in common], [r["df"] for r in common]))


def draws(row_starts: np.ndarray, sh: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of each set (sets are runs that begin at row_starts): 32 bits that name shingle and level."""
    log_w = np.log(weight)
    base = mix(sh)
    out = np.empty((len(row_starts), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        v = (base ^ _SEEDS[k, 0]) * _SEEDS[k, 1]
        v ^= v >> U(32)
        v *= U(0x9FB21C651E98DF25)
        v ^= v >> U(28)
        r = _GAMMA[v >> U(48)]
        beta = ((v >> U(16)) & U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536) + np.float32(1 / 131072)
        level = np.floor(log_w / r + beta)
        value = _LOG_GAMMA[(v >> U(32)) & U(0xFFFF)] - r * (level - beta + np.float32(1))
        bits = value.view(np.int32)
        bits = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32
        name = (v ^ (level.astype(np.int64).view(np.uint64) * U(0x9E3779B1))) & U(0xFFFFFFFF)
        out[:, k] = (np.minimum.reduceat(bits | name.view(np.int64), row_starts) & 0xFFFFFFFF).astype(np.uint32)
    return out


def bands(d: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    out = np.empty(d.shape, np.int64)
    wide = d.astype(np.uint64)
    for i in range(SAMPLES):
        key = np.full(len(d), i + 1, np.uint64)
        for j in _SPREAD:
            key = mix(key * U(0x9E3779B97F4A7C15) + wide[:, (i + j) % SAMPLES])
        out[:, i] = key.view(np.int64)
    return out


def _signer(texts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the texts of a block and the document frequencies of its shingles: (node, bands)."""

    def sign(block: pa.Table, told: pa.Table) -> pa.Table:
        idf = Idf(texts, *_listed(told.column("shingles").to_pylist(), told.column("df").to_pylist()), rest=texts)
        keys: list[np.ndarray | None] = [None] * block.num_rows
        for first, _, row, sh, count in text_sets(block.column("text")):
            if not len(row):
                continue
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            for r, k in zip((first + row[starts]).tolist(), bands(draws(starts, sh, idf.weights(sh, count))), strict=True):
                keys[r] = k
        return pa.table({"node": block.column("node"), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return sign


def _weighed(column: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, shs, ws = [], [], []
    for first, _, row, sh, count in text_sets(column):
        rows.append(row + first)
        shs.append(sh)
        ws.append(idf.weights(sh, count))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(shs), np.concatenate(ws)


def similarities(left: pa.Array, right: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row."""
    n = len(left)
    out = np.zeros(n)
    for lo in range(0, n, 256):
        part = min(256, n - lo)
        (ra, sa, wa), (rb, sb, wb) = (_weighed(c.slice(lo, part), idf) for c in (left, right))
        ka, kb = ((r.astype(np.uint64) << U(52)) | s for r, s in ((ra, sa), (rb, sb)))
        if not len(ka) or not len(kb):
            continue
        at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
        both = ka[at] == kb
        shared = np.bincount(rb[both], weights=np.minimum(wa[at[both]], wb[both]), minlength=part)
        whole = np.bincount(ra, weights=wa, minlength=part) + np.bincount(rb, weights=wb, minlength=part) - shared
        out[lo : lo + part] = np.where(whole > 0, shared / np.maximum(whole, 1e-30), 0)
    return out


def _verifier(idf: Idf, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = similarities(batch.column(2), batch.column(3), idf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s >= least)], names=["a", "b", "near"])

    return verify


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by slot of their shingles."""
    sums = np.zeros(_SLOTS, np.int64)
    for batch in batches:
        for _, _, _, sh, _ in text_sets(batch.column(0)):
            sums += np.bincount((sh & U(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "texts": pa.array(sums[some])})


def _prefixer(idf: Idf, least: float, crowd: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (node, label, text): the shingles from which on a text has weight enough left for a pair of `least`; any order common to all texts is right."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, row, sh, count in text_sets(batch.column(2)):
                if not len(row):
                    continue
                order = np.lexsort((sh, crowd[(sh & U(_SLOTS - 1)).astype(np.int64)], row))
                sh, w = sh[order], idf.weights(sh, count)[order].astype(np.float64)
                mass = np.bincount(row, weights=w)[row]
                before = np.cumsum(w) - w
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                rest = mass - (before - np.repeat(before[starts], np.diff(starts, append=len(row))))
                keep = rest >= least * _SLACK * mass
                at = pa.array(first + row[keep])
                cell = row * _CELLS + (sh >> U(_SHIFT)).astype(np.int64)
                spread = np.bincount(cell, weights=w, minlength=(int(row[-1]) + 1) * _CELLS).reshape(-1, _CELLS)
                parts = np.ceil(spread / np.maximum(spread.sum(axis=1, keepdims=True), 1e-30) * _WHOLE).astype(np.int16)[row[keep]]
                offsets = pa.array(np.arange(len(parts) + 1) * _CELLS, pa.int32())
                places = np.flatnonzero(keep)
                n = np.minimum(places - starts[np.searchsorted(starts, places, side="right") - 1], _EARLIER)
                ends = np.cumsum(n)
                earlier = np.repeat(places - ends, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sh[keep].astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(mass[keep]), pa.array(rest[keep]), pa.ListArray.from_arrays(offsets, pa.array(parts.reshape(-1))),
                     pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(sh[earlier].astype(np.int64)))],
                    names=["shingle", "node", "label", "mass", "rest", "cells", "earlier"],
                )

    return find


def _possible(unsettled: DataFrame, idf: Idf, least: float) -> DataFrame:
    """(a, b) of all pairs of unsettled (node, label, text) with different labels that may be `least` similar or more."""
    counted = unsettled.select("text").mapInArrow(_crowds, "slot long, texts long").groupBy("slot").agg(F.sum("texts").alias("texts")).toArrow()
    crowd = np.zeros(_SLOTS, np.int32)
    crowd[counted.column("slot").to_numpy()] = np.minimum(counted.column("texts").to_numpy(), (1 << 31) - 1)
    heavy = settle(unsettled.select("node", "label", "text").mapInArrow(_prefixer(idf, least, crowd), "shingle long, node binary, label binary, mass double, rest double, cells array<short>, earlier array<long>"), "near-prefixes")
    # Both texts of a pair hold least / (1 + least) of their joint weight in common; for the lighter one that is more of its own.
    part = least / (1 + least) * _SLACK
    light = heavy.where(F.col("rest") >= 2 * part * F.col("mass"))
    x, y = heavy.alias("x"), light.alias("y")
    heavier = F.expr("x.mass > y.mass OR (x.mass = y.mass AND x.node > y.node)")
    enough = F.least("x.rest", "y.rest") >= part * (F.col("x.mass") + F.col("y.mass"))
    # A pair meets at its first common shingle; at a later one only if none of the last few before it was common.
    # What two texts have in common is no more than what they have in each cell of their shingles' hashes.
    bound = F.aggregate(F.zip_with("x.cells", "y.cells", lambda p, q: F.least(p * F.col("x.mass"), q * F.col("y.mass"))), F.lit(0.0), lambda total, v: total + v)
    alike = bound >= part * _WHOLE * (F.col("x.mass") + F.col("y.mass"))
    met = x.join(y, F.expr("x.shingle = y.shingle AND x.label != y.label") & heavier & enough & ~F.arrays_overlap("x.earlier", "y.earlier") & alike)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def node_of(text: Column) -> Column:
    """What all rows of one text share."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def classes(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(signed: node, bands; labels: node, label). A node stands for all rows of one text; nodes without a label are alone, those without bands have no words."""
    with scratch(docs.sparkSession) as keep:
        distinct = settle(docs.select(node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text")).groupBy("node").agg(F.min("text").alias("text")).withColumn("block", F.spark_partition_id() * _BLOCKS + F.pmod(F.xxhash64("node"), F.lit(_BLOCKS))), "near-distinct")
        total, told, idf = document_frequencies(distinct)
        signed = keep(settle(distinct.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_signer(total), "node binary, bands array<long>"), "near-signed"))
        distinct = distinct.drop("block")
        entries = signed.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "key"))
        met = settle(entries.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high"), "near-buckets")
        inside = keep(settle(entries.join(met, ["band", "key"]), "near-entries"))
        proposed = inside.select(F.col("low").alias("a"), F.col("node").alias("b")).union(inside.select(F.col("node").alias("a"), F.col("high").alias("b"))).where("a != b").distinct()
        texts = keep(settle(distinct.join(inside.select("node").distinct(), "node", "left_semi"), "near-texts"))

    def tested(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return settle(full.mapInArrow(_verifier(idf, least), "a binary, b binary, near boolean"), "near-tested")

    done = tested(proposed)
    labels = components(done.where("near").select("a", "b"))
    while True:
        split = inside.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        heads = split.groupBy("band", "key", "label").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        across = heads.groupBy("band", "key").agg(F.min(F.struct("label", "first", "last")).alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "key", "head")
        other = heads.join(across, ["band", "key"]).where("label != head.label")
        pairs = other.select(F.col("head.first").alias("a"), F.col("first").alias("b")).union(other.select(F.col("head.last").alias("a"), F.col("last").alias("b")))
        fresh = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"), "near-fresh")
        if not fresh.limit(1).count():
            break
        found = tested(fresh)
        done = settle(done.unionByName(found), "near-tested")
        if not found.where("near").limit(1).count():
            break
        labels = extended(labels, found.where("near"))
    unsettled = settle(to_rows(split, across.select("band", "key"), ["band", "key"], F.xxhash64("node")).select("node", "label").distinct().join(texts, "node"), "near-unsettled")
    rest = settle(_possible(unsettled, idf, least).join(done.select("a", "b"), ["a", "b"], "left_anti"), "near-fresh")
    found = tested(rest)
    if not found.where("near").limit(1).count():
        return signed, labels
    return signed, extended(labels, found.where("near"))


def _labelled(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows: _file, _row, doc_id, node; nodes: node, label, wordless), from rows with text too."""
    signed, labels = classes(rows, least)
    nodes = signed.select("node", F.col("bands").isNull().alias("wordless")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return rows.select("_file", "_row", F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node")), nodes


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of each row of docs."""
    keyed = row_keys(docs.select("doc_id", "text"))
    with scratch(docs.sparkSession) as keep:
        rows, nodes = _labelled(keyed, least)
        known = settle(rows.groupBy("node").agg(F.min("doc_id").alias("id")).join(nodes, "node"), "near-nodes")
        named = to_rows(known.select("node", "label", "wordless"), known.groupBy("label").agg(F.min("id").alias("class_id")), "label", F.xxhash64("node"))
        named = keep(settle(named.select("node", "wordless", "class_id"), "near-named"))
    return to_rows(rows, named, "node").select("doc_id", F.when(F.col("wordless"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (of several, the least text, then the first in the table's files); rows that equal it go too. Rows without words stay."""
    file, row = fresh(docs.columns, "_file", "_row")
    keyed = row_keys(docs, file, row)
    with scratch(docs.sparkSession) as keep:
        rows, nodes = _labelled(keyed.select(column(file).alias("_file"), column(row).alias("_row"), "doc_id", "text"), least)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row"))
        heads = rows.groupBy("node").agg(first.alias("head")).join(nodes, "node").where("NOT wordless")
        chosen = heads.groupBy("label").agg(F.min(F.struct("head.none", "head.doc_id", "node", "head._file", "head._row")).alias("head")).select("head._file", "head._row")
        wordless = to_rows(rows, nodes.where("wordless").select("node"), "node", F.xxhash64("_file", "_row")).select("_file", "_row")
        kept = keep(settle(chosen.union(wordless), "near-kept")).select(F.col("_file").alias(file), F.col("_row").alias(row))
    return keyed.join(kept.hint("merge"), [file, row], "left_semi").select(*[column(c) for c in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
