"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton accepts every run of words of any item. A document's words are streamed through it while the longest
match that ends at each word is tracked: a match of `window` words or more is an occurrence of one of the items'
windows; an item of fewer words is one window, found through the suffix links. Only runs of words that all occur in
some item can match, so those are found first, vectorised, and the rest is skipped without loss.

Items are dealt into blocks of bounded size. With several, each block's automaton passes over all documents in a job of
its own and the hits of all blocks are merged before anything is decided, so neither the driver nor a task holds more
than one block however large the benchmark grows, and results don't depend on the blocks' size.

Edge cases: null or empty texts have no words and no hits; items without words are never found; words that only items
of null id hit are hit, though no item is named; repeated items and documents count as they stand; no items, or no documents, give no hits; input columns
named like an added one are replaced, others kept; a very long text is read whole, its words one block of rows; a null
text passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.shared import column, drop_clashing, fresh, mapped, row_keys, settle, shared_path, table
from quillstone.llm.words import LETTERED, hash_words, row_blocks, string_buffers

WINDOW = 10
BLOCK_BYTES = 1 << 20
COVERAGE = 0.8
_NO_ID = -(1 << 63)  # stands for a null item_id
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.LongType()))])


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.len)
        self.top = [0] * n  # the state of a state's suffix of `window` words
        for s in sorted(range(n), key=self.len.__getitem__):
            up = self.link[s]
            self.top[s] = s if up < 0 or self.len[up] < window else self.top[up]
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}  # by state: length and items of a whole item that ends there
        short_at: dict[tuple[int, int], set[int]] = {}
        for item, words in items:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.windows.setdefault(self.top[s], set()).add(item)
            if 0 < len(words) < window:
                short_at.setdefault((s, len(words)), set()).add(item)
        by_state: dict[int, list[tuple[int, set[int]]]] = {}
        for (s, m), found in short_at.items():
            by_state.setdefault(s, []).append((m, found))
        self.shorts: list[tuple[tuple[int, set[int]], ...]] = [()] * n  # of a state and all its suffixes
        for s in sorted(range(n), key=self.len.__getitem__):
            self.shorts[s] = (self.shorts[self.link[s]] if s else ()) + tuple(by_state.get(s, ()))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, -1, self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[int], at: int, spans: list[int], items: set[int]) -> None:
        """Adds the spans (pairs of first word and end, merged) and items of the windows in words, which start at word `at`."""
        moves, link, length, top, window, shorts = self.next, self.link, self.len, self.top, self.window, self.shorts
        s = n = 0
        for i, w in enumerate(words):
            while w not in moves[s] and s:
                s = link[s]
                n = length[s]
            s = moves[s].get(w, 0)
            n = n + 1 if s else 0
            reach = 0
            if n >= window:
                reach = window
                items |= self.windows[top[s]]
            for m, found in shorts[s]:
                if m <= n:
                    reach = max(reach, m)
                    items |= found
            if reach:
                lo, hi = at + i + 1 - reach, at + i + 1
                while spans and spans[-1] >= lo:
                    lo = min(lo, spans[-2])
                    del spans[-2:]
                spans += [lo, hi]


class Matcher:
    """The automaton of a block of items, over hashed words."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        h, row, _, _ = hash_words(data, offsets, LETTERED)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).tolist()
        words: list[list[int]] = [[] for _ in items]
        for r, w in zip(row.tolist(), ids, strict=True):
            words[r].append(w)
        kept = [(item, w) for (item, _), w in zip(items, words, strict=True) if w]
        self.least = min([window, *(len(w) for _, w in kept)])
        self.automaton = SuffixAutomaton(kept, window)

    def match(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> dict[int, tuple[list[int], set[int]]]:
        """By row with hits: word spans and items."""
        if not len(self.vocabulary) or not len(h):
            return {}
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
        ids = np.searchsorted(self.vocabulary, h)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == h
        starts = known.copy()
        starts[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (row[1:] != row[:-1])
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        long = e - s >= self.least
        found: dict[int, tuple[list[int], set[int]]] = {}
        for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True):
            r = int(row[a])
            spans, items = found.get(r) or ([], set())
            self.automaton.scan(ids[a:b].tolist(), a - int(first[r]), spans, items)
            if spans:
                found[r] = (spans, items)
        return found


def _merged(spans: list[int]) -> list[int]:
    pairs = sorted(zip(spans[::2], spans[1::2], strict=True))
    out: list[int] = []
    for lo, hi in pairs:
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _finder(items: list[tuple[int, str]] | None, window: int, leave_out: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_words, hit_spans and hit_items; without items it merges the hits that the batches bring."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None if items is None else Matcher(items, window)
        for batch in batches:
            names = batch.schema.names
            data, offsets = string_buffers(batch.column(names.index("text")))
            counts: list[np.ndarray] = [np.zeros(0, np.int64)]
            spans: list[list[int]] = [[]] * batch.num_rows
            hits: list[list[int]] = [[]] * batch.num_rows
            for lo, hi in row_blocks(offsets):
                h, row, _, _ = hash_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], LETTERED)
                counts.append(np.bincount(row, minlength=hi - lo))
                if matcher:
                    for r, (s, i) in matcher.match(h, row, hi - lo).items():
                        spans[lo + r], hits[lo + r] = s, sorted(i - {_NO_ID})
            if not matcher:
                spans = [_merged(x or []) for x in batch.column(names.index("hit_spans")).to_pylist()]
                hits = [sorted({*(x or [])}) for x in batch.column(names.index("hit_items")).to_pylist()]
            kept = [n for n in names if n not in _FOUND.names and n not in leave_out]
            found = [pa.array(np.concatenate(counts)), pa.array(spans, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), *found], names=[*kept, *_FOUND.names])

    return find


def _sized(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def block_count(items: DataFrame, block_bytes: int) -> int:
    return 1 + int((_sized(items).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)


def item_block(items: DataFrame, k: int, blocks: int) -> list[tuple[int, str]]:
    """(item_id, text) of the items of one of so many blocks."""
    part = _sized(items) if blocks == 1 else _sized(items).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    return [(_NO_ID if r[0] is None else r[0], r[1]) for r in part.collect()]


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (first word and end of each merged span, flat) and hit_items (sorted item ids).

    Each block of items passes over the documents in a job of its own, whose hits are written; then they are merged.
    """
    base, blocks = drop_clashing(docs, _FOUND.names), block_count(items, block_bytes)
    schema = T.StructType([*base.schema.fields, *_FOUND.fields])
    if blocks == 1:
        return mapped(base, _finder(item_block(items, 0, 1), window), schema)
    file, row = fresh([*base.columns, *_FOUND.names], "_file", "_row")
    keyed = row_keys(base, file, row)
    path = shared_path(docs.sparkSession, "decontamination-hits")
    narrow = T.StructType([T.StructField(file, T.StringType()), T.StructField(row, T.LongType()), *_FOUND.fields])
    for k in range(blocks):
        part = keyed.select(column(file), column(row), "text").mapInArrow(_finder(item_block(items, k, blocks), window, ("text",)), narrow)
        part.where("size(hit_spans) > 0").drop("n_words").write.mode("append").parquet(path)
    hits = docs.sparkSession.read.schema(part.drop("n_words").schema).parquet(path)
    merged = hits.groupBy(file, row).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "hit_items")])
    return mapped(keyed.join(merged, [file, row], "left").select(*[column(c) for c in base.columns], "hit_spans", "hit_items"), _finder(None, window), schema)


def cut_out(text: bytes, spans: list[int]) -> bytes:
    """text without the words of the spans and what stands between them."""
    raw = np.frombuffer(text, np.uint8)
    _, _, s, e = hash_words(raw, np.array([0, len(raw)]), LETTERED)
    pieces, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        pieces.append(text[done : int(s[a])])
        done = int(e[b - 1])
    return b"".join([*pieces, text[done:]])


def _covered(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2])


def _cutter(items: list[tuple[int, str]], window: int, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts and drops with one block of items, in one pass."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, window)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = string_buffers(batch.column(at))
            changed: dict[int, str | None] = {}
            for lo, hi in row_blocks(offsets):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                h, row, _, _ = hash_words(part, offs, LETTERED)
                count = np.bincount(row, minlength=hi - lo)
                for r, (spans, _) in matcher.match(h, row, hi - lo).items():
                    if _covered(spans) >= coverage * int(count[r]):
                        changed[lo + r] = None
                        continue
                    text = part[offs[r] : offs[r + 1]].tobytes()
                    while spans:  # what a cut joins can match again
                        text = cut_out(text, spans)
                        raw = np.frombuffer(text, np.uint8)
                        h2, row2, _, _ = hash_words(raw, np.array([0, len(raw)]), LETTERED)
                        spans = matcher.match(h2, row2, 1).get(0, ([], set()))[0]
                    changed[lo + r] = text.decode()
            if not changed:
                yield batch
                continue
            texts = batch.column(at).to_pylist()
            for r, text in changed.items():
                texts[r] = text
            kept = pa.array([r not in changed or changed[r] is not None for r in range(batch.num_rows)])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(kept)

    return cut


def _shorter(coverage: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (file, row, text, n_words, hit_spans): the text without its spans, null if they cover too much of it."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if coverage is not None and _covered(spans) >= coverage * n else cut_out(text.encode(), spans).decode()
                for text, n, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "hit_spans")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(texts, pa.string())], names=["file", "row", "text"])

    return shorten


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the passages of test items.

    A document of whose words the spans of all items cover `coverage` or more is dropped. Else all spans are cut out of
    its text, and again those that a cut has joined, until none is left. The result is the same for every block_bytes.
    """
    blocks = block_count(items, block_bytes)
    if blocks == 1:
        return mapped(docs, _cutter(item_block(items, 0, 1), window, coverage), docs.schema)
    file, row, new, cut_too = fresh(docs.columns, "_file", "_row", "_new", "_cut")
    keyed = row_keys(docs, file, row)
    todo = keyed.select(column(file).alias("file"), column(row).alias("row"), "text")
    changed, share = None, coverage
    while True:
        hits = find_hits(todo, items, window, block_bytes).where("size(hit_spans) > 0").select("file", "row", "text", "n_words", "hit_spans")
        cut = settle(hits.mapInArrow(_shorter(share), "file string, row long, text string"), "decontamination-cut")
        if changed is None:
            changed = cut
        elif cut.isEmpty():
            break
        else:
            changed = settle(changed.join(cut, ["file", "row"], "left_anti").unionByName(cut), "decontamination-cut")
        todo, share = cut.where("text IS NOT NULL"), None
    told = changed.select(F.col("file").alias(file), F.col("row").alias(row), F.col("text").alias(new), F.lit(True).alias(cut_too))
    met = keyed.join(told, [file, row], "left").where(F.col(cut_too).isNull() | F.col(new).isNotNull())
    return met.select(*[F.coalesce(new, column(c)).alias(c) if c == "text" else column(c) for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    pairs = F.expr("aggregate(sequence(1, size(hit_spans) div 2), 0L, (n, i) -> n + hit_spans[2 * i - 1] - hit_spans[2 * i - 2])")
    n_hit = F.when(F.size("hit_spans") > 0, pairs).otherwise(F.lit(0)).cast("long")
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hw AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hits)) GROUP BY rid
), hi AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
