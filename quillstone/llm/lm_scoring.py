"""Language-model scores by deleted interpolation of word trigrams.

P2(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1) and P(w | u v) = l3 c(u v w) / c(u v) + (1 - l3) P2(w | v). The
weights depend on the power-of-two bucket of the context's frequency, c(v) and c(u v). They come from
expectation-maximisation on held-out counts: those of the training documents of one remainder, each with its own counts
deleted from the totals.

Counts cover every training document. Equal texts are counted once, with their number of training rows. Long texts are
cut between words into pieces; a piece carries the two words before it. Pieces are dealt by hash into blocks of bounded
size, in a bucketed table, so that texts move once. A block sends each distinct n-gram it holds once, as sorted
delta-coded 64-bit hashes, to the range of hashes that the n-gram falls into; a range sums the counts of all blocks and
answers each block in the order of its message, so answers hold counts alone. A block asks for a trigram only if other
blocks hold both of its pairs; if not, its own count is the total. No task holds more than one block or one range.

Edge cases: null texts are empty and have one token, the end; a null doc_id counts as the empty text in the CRC; with
no training document every probability is the uniform share; repeated rows count each time; of very long texts the
held-out counts are deleted piece by piece; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import brief_shuffles, bucketed, row_keys, settle, table, to_rows
from quillstone.llm.words import SPACED, U, hash_words, mix, row_blocks, string_buffers

HELD_OUT, DELETED, FOLDS = 2, 3, 7
BLOCK_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
RANGE_KEYS = 1 << 19
TASK_BYTES = 32 << 20  # of text, for a task
EM_ROUNDS = 60
BUCKETS = 40
_STEPS = 4  # quantised probabilities a power of two, for the weights only
_END, _START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_ASKED = "block long, n int, part long, hashes binary, counts binary"
_ANSWERED = "block long, n int, part long, counts binary, found long, tokens long"
_PIECES = "node binary, piece int, skip int, last boolean, train long, deleted long, text string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def crc_remainder(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds)).cast("int")


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes: the high planes are zeros, which the shuffle's compression removes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _planes(np.diff(h, prepend=U(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def pieces_of(text: bytes, most: int) -> list[tuple[int, bytes]]:
    """(leading words that only give context, text) of each piece: whole words, about `most` bytes."""
    out: list[tuple[int, bytes]] = []
    at, before = 0, []
    raw = np.frombuffer(text, np.uint8)
    while at < len(text) or not out:
        end = at + most
        while end < len(text):
            gaps = np.flatnonzero(SPACED[raw[end : end + 4096]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        body = b" ".join([*before, text[at:end]])
        out.append((len(before), body))
        before, at = body.rsplit(None, 2)[-2:], end
    return out


def _splitter(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = string_buffers(batch.column(3))
            long = np.flatnonzero(np.diff(offsets) > most)
            kept = batch if not len(long) else batch.filter(pa.array(np.diff(offsets) <= most))
            n = kept.num_rows
            zeros = pa.array(np.zeros(n, np.int32))
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([kept.column(0), zeros, zeros, pa.array(np.ones(n, bool)), kept.column(1), kept.column(2), kept.column(3)], names=names)
            for r in long.tolist():
                node, train, deleted = (batch.column(c)[r].as_py() for c in range(3))
                parts = pieces_of(batch.column(3)[r].as_buffer().to_pybytes(), most)
                for i, (skip, body) in enumerate(parts):
                    yield _table([(node, i, skip, i == len(parts) - 1, train, deleted, body.decode())], _PIECES).to_batches()[0]

    return split


def tokens_of(column: pa.Array, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, row) of every token of every text; the end of rows that are `last` included."""
    data, offsets = string_buffers(column)
    hs, rows = [], []
    for lo, hi in row_blocks(offsets):
        h, row, _, _ = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACED)
        ends = last[lo:hi].astype(np.int64)
        count = np.bincount(row, minlength=hi - lo)
        out = np.full(len(h) + ends.sum(), _END, np.uint64)
        out[np.arange(len(h)) + (np.cumsum(ends) - ends)[row]] = h
        hs.append(out)
        rows.append(np.repeat(np.arange(lo, hi), count + ends))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(rows)


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + (h ^ (h >> U(29))))


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the place of each key among them; the sum of weights of each."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place.astype(np.int32), np.bincount(place, weights=weights, minlength=len(found)).astype(np.int64)


class _Block:
    """The tokens of a block, its words, pairs and triples with their counts in training rows: those of the block, then of all once answered."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        col = lambda name: t.column(name).chunk(0) if t.num_rows else t.column(name).combine_chunks()
        self.n = t.num_rows
        self.block = col("block")[0].as_py()
        self.nodes, self.deleted = col("node"), col("deleted").to_numpy()
        h, self.row = tokens_of(col("text"), col("last").to_numpy(zero_copy_only=False))
        count = np.bincount(self.row, minlength=self.n)
        start = np.cumsum(count) - count
        position = np.arange(len(h)) - start[self.row]
        self.live = position >= col("skip").to_numpy()[self.row]
        self.first = position == 0
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first] = _START
        weights = col("train").to_numpy()[self.row] * self.live
        # The end is always among the words: its count is that of the start.
        words, place, self.c1 = _distinct(np.append(h, _END), np.append(weights, 0))
        self.words, self.word, self.end = words, place[:-1], int(place[-1])
        self.pair_keys = pair_keys(before, h)
        self.pairs, self.pair, self.c2 = _distinct(self.pair_keys, weights)
        self.h, self.weights = h, weights
        self.keys = {1: self.words, 2: self.pairs}
        self.c3 = np.zeros(0, np.int64)

    def learn(self, answers: pa.Table) -> None:
        """Takes the totals of answers over; they come range by range, in the order of the keys asked for."""
        found = [(r[0], r[1], _unplanes(r[2], np.int64)) for r in zip(*(answers.column(c).to_pylist() for c in ("n", "part", "counts")), strict=True)]
        totals = {n: np.concatenate([x for _, x in sorted(((p, x) for m, p, x in found if m == n), key=lambda t: t[0])]) for n in {n for n, _, _ in found}}
        self.c1 = totals[1] >> 1
        if 2 in totals:
            self.elsewhere = (totals[2] & 1).astype(bool)
            self.c2 = totals[2] >> 1
        if 3 in totals:
            self.add_triples()
            self.c3[self.shared_triples()] = totals[3] >> 1

    def add_triples(self) -> None:
        if 3 in self.keys:
            return
        inside = np.flatnonzero(~self.first)
        keys = pair_keys(self.pair_keys[inside - 1], self.h[inside])
        triples, place, self.c3 = _distinct(keys, self.weights[inside])
        self.keys[3] = triples
        self.triple = np.full(len(self.h), -1, np.int32)
        self.triple[inside] = place

    def shared_triples(self) -> np.ndarray:
        """Places of the triples both of whose pairs other blocks hold too."""
        self.add_triples()
        elsewhere, inside = self.elsewhere, np.flatnonzero(~self.first)
        inside = inside[elsewhere[self.pair[inside]] & elsewhere[self.pair[inside - 1]]]
        return np.unique(self.triple[inside])

    def own(self, place: np.ndarray) -> np.ndarray:
        """Of each token: how often its row holds its n-gram."""
        _, inverse = np.unique(self.row.astype(np.int64) << 32 | place, return_inverse=True)
        return np.bincount(inverse, weights=self.live)[inverse].astype(np.int64)

    def shift(self, values: np.ndarray, at_start: int) -> np.ndarray:
        """Of each token the value of the token before it."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def estimates(self, total: int, delete: bool) -> tuple[np.ndarray, ...]:
        """c(u v), f3, c(v), f2, f1 of each token; with the row's own counts deleted if told so."""
        word, pair = self.c1[self.word], self.c2[self.pair]
        if delete:
            own_word, own_pair = self.own(self.word), self.own(self.pair)
            length = np.bincount(self.row, weights=self.live, minlength=self.n)[self.row]
        else:
            own_word = own_pair = np.zeros(len(word), np.int64)
            length = 0
        context = self.shift(word - own_word, self.c1[self.end] - int(delete))
        wide = self.shift(pair - own_pair, 0)
        share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        f2 = share(pair - own_pair, context)
        f1 = (word - own_word) / np.maximum(total - length, 1)
        if 3 in self.keys:
            triple = self.c3[np.maximum(self.triple, 0)] if len(self.c3) else np.zeros(len(word), np.int64)
            f3 = np.where(self.first, 0.0, share(triple - (self.own(self.triple) if delete else 0), wide))
        else:
            f3 = np.zeros(len(word))
        return wide, f3, context, f2, f1


def _messages(block: int, n: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> list[tuple]:
    part = (keys >> U(32)) * U(ranges) >> U(32)
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] + U(1))) if len(part) else []
    ends = [*starts[1:], len(keys)]
    return [(block, n, int(part[a]), _pack(keys[a:b]), _planes(counts[a:b])) for a, b in zip(starts, ends, strict=True)] if len(part) else []


def _asker(ranges: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block: its distinct words and pairs with their counts, a message for each range and order."""

    def ask(t: pa.Table) -> pa.Table:
        b = _Block(t)
        return _table([*_messages(b.block, 1, b.words, b.c1, ranges), *_messages(b.block, 2, b.pairs, b.c2, ranges)], _ASKED)

    return ask


def _triple_asker(ranges: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def ask(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs)
        b.learn(answers)
        some = b.shared_triples()
        return _table(_messages(b.block, 3, b.keys[3][some], b.c3[some], ranges), _ASKED)

    return ask


def _answer(t: pa.Table) -> pa.Table:
    """Of one range: for each message, in its order, twice the count in all of each n-gram and one more if another block holds it too; and the range's distinct and total counts (block -1)."""
    n, part, blocks = t.column("n")[0].as_py(), t.column("part")[0].as_py(), t.column("block").to_pylist()
    order = sorted(range(len(blocks)), key=blocks.__getitem__)
    keys = [_unpack(t.column("hashes")[i].as_py()) for i in order]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate([_unplanes(t.column("counts")[i].as_py(), np.int64) for i in order])).astype(np.int64)
    out: list[tuple] = [(-1, n, part, b"", int(np.count_nonzero(sums)), int(sums.sum()))]
    told = sums * 2 + (np.bincount(place) > 1)
    del found
    at = 0
    for i, k in zip(order, keys, strict=True):
        out.append((blocks[i], n, part, _planes(told[place[at : at + len(k)]]), 0, 0))
        at += len(k)
    return _table(out, _ANSWERED)


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(c, 0) + 1)).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """Quantised log2 of a probability, 0 for none."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.clip(np.round(-np.log2(p[some]) * _STEPS), 0, 60 * _STEPS)
    return out


def _share(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** (-(level - 1.0) / _STEPS), 0.0)


def _lower_model(context: np.ndarray, f2: np.ndarray, f1: np.ndarray, weights: np.ndarray, vocabulary: int) -> np.ndarray:
    """P2 of each token."""
    w = weights[bucket_of(context)]
    return w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (vocabulary + 1)


def _held_out_cells(total: int, vocabulary: int, weights: np.ndarray | None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of a block of deleted documents: how many tokens have each (bucket, level, level), with the document's own counts deleted.

    Without weights of the bigram model the levels are those of f2 and f1 and the bucket is that of c(v); with them, of f3, P2 and c(u v).
    """

    def cells(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs)
        b.learn(answers)
        if weights is not None:
            b.add_triples()
        wide, f3, context, f2, f1 = b.estimates(total, delete=True)
        if weights is None:
            code = (bucket_of(context) << 20) | (_level(f2) << 10) | _level(f1)
        else:
            code = (bucket_of(wide) << 20) | (_level(f3) << 10) | _level(_lower_model(context, f2, f1, weights, vocabulary))
        found, place = np.unique(code[b.live], return_inverse=True)
        counts = np.bincount(place, weights=b.deleted[b.row[b.live]]).astype(np.int64)
        return pa.table({"cell": pa.array(found, pa.int64()), "tokens": pa.array(counts, pa.int64())})

    return cells


def _em(p: np.ndarray, n: np.ndarray, bucket: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights of each bucket; a bucket without held-out tokens takes those of all."""

    def fit(at: np.ndarray) -> np.ndarray:
        w = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(rounds):
            e = p[at] * w
            w = (e / e.sum(axis=1, keepdims=True) * n[at, None]).sum(axis=0) / n[at].sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        return w

    everything = fit(np.arange(len(n))) if len(n) else np.eye(p.shape[1])[1] * 0.5 + np.eye(p.shape[1])[-1] * 0.5
    out = np.tile(everything, (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = fit(np.flatnonzero(bucket == b))
    return out


def learn_weights(cells: list[tuple[int, int]], vocabulary: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation."""
    code, n = np.array([c for c, _ in cells], np.int64), np.array([k for _, k in cells], np.float64)
    p = np.stack([_share((code >> 10) & 1023), _share(code & 1023), np.full(len(code), 1.0 / (vocabulary + 1))], axis=1)
    return _em(p, n, code >> 20, rounds)


def learn_top_weights(cells: list[tuple[int, int]], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (triple, lower model) of each bucket by expectation-maximisation."""
    code, n = np.array([c for c, _ in cells], np.int64), np.array([k for _, k in cells], np.float64)
    return _em(np.stack([_share((code >> 10) & 1023), _share(code & 1023)], axis=1), n, code >> 20, rounds)


_SCORED = "node binary, n_tokens long, n_known long, base double, score double"


def _scorer(total: int, vocabulary: int, weights: np.ndarray, top: np.ndarray) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs)
        b.learn(answers)
        b.add_triples()
        wide, f3, context, f2, f1 = b.estimates(total, delete=False)
        w = top[bucket_of(wide)]
        p = w[:, 0] * f3 + w[:, 1] * _lower_model(context, f2, f1, weights, vocabulary)
        word, row = b.c1[b.word][b.live], b.row[b.live]
        per = lambda x: np.bincount(row, weights=x, minlength=b.n)
        count = np.bincount(row, minlength=b.n)
        base = per(np.log10(word + 1.0)) - count * np.log10(float(total + vocabulary + 1))
        return pa.table([b.nodes, pa.array(count, pa.int64()), pa.array(per(word > 0).astype(np.int64)), pa.array(base), pa.array(per(np.log10(p[b.live])))], names=[c.split()[0] for c in _SCORED.split(", ")])

    return score


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    text = F.coalesce("text", F.lit(""))
    keyed = row_keys(docs.select("doc_id", "text"))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), crc_remainder(F.col("doc_id"), FOLDS).alias("fold"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("node"), text.alias("text"), "_file", "_row")
    size = int(docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0)
    blocks, tasks = 1 + size // block_bytes, 1 + size // TASK_BYTES
    ranges = 1 + size // (6 * range_keys)  # about six bytes a token; of one-letter words a range holds three times as many
    distinct = rows.groupBy("node").agg(F.count_if(F.col("fold") != HELD_OUT).alias("train"), F.count_if(F.col("fold") == DELETED).alias("deleted"), F.min("text").alias("text"))
    block = F.pmod(F.xxhash64("node", "piece"), F.lit(blocks)) * 2 + (F.col("deleted") > 0).cast("int")
    pieces = bucketed(distinct.mapInArrow(_splitter(piece_bytes), _PIECES).withColumn("block", block), "lm-pieces", "block", tasks)

    def answered(asked: DataFrame) -> DataFrame:
        return settle(asked.repartition(min(tasks, ranges), "n", "part").groupBy("n", "part").applyInArrow(_answer, _ANSWERED), "lm-counts")

    answers = answered(pieces.groupBy("block").applyInArrow(_asker(ranges), _ASKED))
    counts = answers.where("block >= 0").select("block", "n", "part", "counts")
    sums = answers.where("block < 0 AND n = 1").agg(F.sum("found"), F.sum("tokens")).first()
    vocabulary, total = sums[0] or 0, sums[1] or 0

    def met(function: Callable, schema: str, counts: DataFrame, only: str = "true") -> DataFrame:
        return pieces.where(only).groupBy("block").cogroup(counts.where(only).groupBy("block")).applyInArrow(function, schema)

    def cells(weights: np.ndarray | None, counts: DataFrame) -> list[tuple[int, int]]:
        found = met(_held_out_cells(total, vocabulary, weights), "cell long, tokens long", counts, "block % 2 = 1")
        # At most BUCKETS * 242 * 242 cells, whatever the input.
        with brief_shuffles(docs.sparkSession):
            return [(r[0], r[1]) for r in found.groupBy("cell").agg(F.sum("tokens")).collect()]

    weights = learn_weights(cells(None, counts), vocabulary)
    triples = answered(met(_triple_asker(ranges), _ASKED, counts)).where("block >= 0").select("block", "n", "part", "counts")
    everything = counts.unionByName(triples)
    top = learn_top_weights(cells(weights, everything))
    scored = met(_scorer(total, vocabulary, weights, top), _SCORED, everything)
    whole = scored.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    named = to_rows(rows.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "node", "_file", "_row"), whole, "node")
    return named.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
