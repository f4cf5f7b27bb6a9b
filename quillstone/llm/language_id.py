"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters'
vectors by multiplication, the first permuted twice and the second once; a text's vector bundles (adds) those of its
trigrams; a language's prototype bundles its training texts. A text gets the language whose prototype has the highest
cosine with its vector; the score is the softmax of the cosines at TEMPERATURE.

Letters are lower-cased; runs of other characters count as one boundary sign. Bundling adds whole numbers, so the
prototypes don't depend on how the rows are dealt.

Edge cases: null texts and texts without a letter get `und` and score 0; rows without lang teach nothing; without any
language every text gets `und`; repeated rows count each time; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.lm_scoring import crc_remainder
from quillstone.llm.shared import table

FOLDS, HELD_OUT = 3, 1
DIMENSIONS = 1024
TEMPERATURE = 0.05
SEED = 41
_GRAMS = 40_000  # vectors kept by a task
_PIECE = 1 << 20


def _letter_table() -> np.ndarray:
    """Of each code point up to U+FFFF: its lower-case letter's code point, 0 if it is no letter."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


class Vectors:
    """Trigram vectors of the letters met so far."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.table = _letter_table()
        self.index = np.zeros(0, np.int64)
        self.matrix = np.zeros((0, dimensions), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
        return self.letters[c]

    def trigrams(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a UTF-8 text and their counts; none if it has no letter."""
        keys, counts, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        at, letters = 0, False
        while at < len(raw):
            end = min(len(raw), at + _PIECE)
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            code = np.frombuffer(raw[at:end].decode().encode("utf-32-le"), np.uint32)
            at = end
            low = self.table[np.minimum(code, 0xFFFF)]
            for i in np.flatnonzero(code > 0xFFFF):
                s = chr(code[i])
                low[i] = ord(s.lower()[0]) if s.isalpha() else 0
            letters |= bool(low.any())
            run = np.concatenate([last, low] if at < len(raw) else [last, low, [0]])
            keep = np.ones(len(run), bool)
            keep[1:] = (run[1:] != 0) | (run[:-1] != 0)
            run = run[keep]
            last = run[-2:]
            if len(run) > 2:
                k, n = np.unique((run[:-2] << 42) | (run[1:-1] << 21) | run[2:], return_counts=True)
                keys, counts = np.concatenate([keys, k]), np.concatenate([counts, n])
        if not letters:
            return keys[:0], counts[:0]
        if len(raw) > _PIECE:
            keys, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse, weights=counts).astype(np.int64)
        return keys, counts

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted trigrams."""
        at = np.minimum(np.searchsorted(self.index, keys), max(len(self.index) - 1, 0))
        new = keys[self.index[at] != keys] if len(self.index) else keys
        if len(new):
            fresh = np.empty((len(new), self.dimensions), np.int8)
            for i, k in enumerate(new.tolist()):
                a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
                fresh[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            if len(self.index) + len(new) > _GRAMS:
                self.index, self.matrix = np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8)
                if len(new) < len(keys):
                    return self.rows(keys)
            both = np.concatenate([self.index, new])
            order = np.argsort(both, kind="stable")
            self.index, self.matrix = both[order], np.concatenate([self.matrix, fresh])[order]
            at = np.searchsorted(self.index, keys)
        return self.matrix[at]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float64)
        for a in range(0, len(keys), 8192):
            out += counts[a : a + 8192].astype(np.float32) @ self.rows(keys[a : a + 8192])
        return out


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, lang): each language's bundle, a row for each task, language and stretch of trigrams."""
    vectors = Vectors()
    counts: dict[str, dict[int, int]] = {}

    def bundles() -> Iterator[pa.RecordBatch]:
        for lang, grams in counts.items():
            total = np.zeros(vectors.dimensions, np.int64)
            keys = np.array(sorted(grams), np.int64)
            weights = np.array([grams[k] for k in keys.tolist()], np.int64)
            for a in range(0, len(keys), 8192):
                total += weights[a : a + 8192] @ vectors.rows(keys[a : a + 8192]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["lang", "at", "value"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for text, lang in zip(batch.column(0), langs, strict=True):
            if text.is_valid:
                parts.setdefault(lang, []).append(vectors.trigrams(text.as_buffer().to_pybytes()))
        for lang, found in parts.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)
            own = counts.setdefault(lang, {})
            for k, n in zip(keys.tolist(), sums.tolist(), strict=True):
                own[k] = own.get(k, 0) + n
        if sum(map(len, counts.values())) > 200_000:
            yield from bundles()
            counts = {}
    yield from bundles()


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from the rows of docs (doc_id, text, lang) outside the held-out fold; one vector a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)).select("text", "lang")
    sums = known.mapInArrow(_teach, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in sums})
    out = np.zeros((len(langs), DIMENSIONS))
    index = {lang: i for i, lang in enumerate(langs)}
    for r in sums:
        out[index[r["lang"]], r["at"]] = r["value"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    keep = norms[:, 0] > 0
    return [lang for lang, k in zip(langs, keep, strict=True) if k], out[keep] / norms[keep]


def _predictor(langs: list[str], prototypes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                keys, counts = vectors.trigrams(text.as_buffer().to_pybytes()) if text.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if not len(keys) or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                v = vectors.bundle(keys, counts)
                cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-30)
                e = np.exp((cosines - cosines.max()) / TEMPERATURE)
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(float(e[best] / e.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predictor(langs, prototypes), "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, *learn(docs)).select("doc_id", (crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
