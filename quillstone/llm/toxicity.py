"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: words that labelled toxic texts hold far more often than others, by a binomial test, counted
over distinct texts (near copies share a min-hash of their word pairs and count once). A text's words run through the
automaton of all terms at once; its states are sets of (trie node, edits), built as they are met, and most words leave
it after two or three letters. A word of clean training texts is no misspelling of a term; other words still are. Words
that clean texts quote are judged by their uses outside quotation.

Each distinct term adds its log-odds, less if misspelled, and less if all its uses stand in quotation: between quote
signs within the window, or near a word of saying. The score is the logistic of the sum and the prior.

Edge cases: null and empty texts score as the prior does; labels without a toxic value, or of unknown documents, teach
nothing; several labels of a document count as the highest; without toxic labels no text matches; equal texts have equal
scores, however often they repeat; of several terms that match a word the one with the fewest edits, then the one of
higher log-odds counts; very long texts are scored whole, one at a time; an empty table gives an empty table; other
columns are kept as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.lm_scoring import crc_remainder
from quillstone.llm.shared import drop_clashing, fresh, mapped, scratch, settle, table
from quillstone.llm.words import LETTERED

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
TRAIN_ROWS = 20_000  # labelled rows to learn from, those of least hash
LEAST_TEXTS = 3
MOST_CLEAN = 10  # toxic texts that a term needs for each clean one
MOST_ODDS = 6.0
UNSEEN = 4.0  # clean texts added to those that hold a term: it was picked for having few
EDIT_FACTOR = (1.0, 0.6, 0.5)  # by edits
QUOTED = 0.4
CONTEXT = 8  # words to either side
# Quote signs and words of saying.
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
SAYING = frozenset("said says called quoted wrote claimed quote dit disait écrit sagte schrieb dijo decía escribió".split())
_SPLIT = bytes(int(x) if x else 32 for x in LETTERED)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyTrie:
    """Finds the terms within their allowed edits of a word."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.most = [0]  # edits that some term below a node allows
        for t, term in enumerate(terms):
            node, limit = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], limit)
            for c in term:
                if c not in self.children[node]:
                    self.children.append({})
                    self.most.append(0)
                    self.children[node][c] = len(self.most) - 1
                node = self.children[node][c]
                self.most[node] = max(self.most[node], limit)
            self.ends[node] = t
        self.letters = set("".join(terms))
        self.reset()

    def reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[list[tuple[int, int]]] = []
        self.start = self._intern({0: 0} if self.terms else {})

    def _intern(self, state: dict[int, int]) -> int:
        """The number of a state, closed under letters of a term that the word lacks."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and state.get(child, 9) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(state.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            found = [(e, self.ends[n]) for n, e in state.items() if n in self.ends and e <= edits_allowed(self.terms[self.ends[n]])]
            self.accepts.append(sorted(found))
        return self.ids[key]

    def _move(self, s: int, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and out.get(node, 9) > e:
                out[node] = e

        for node, e in self.states[s].items():
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        return self._intern(out)

    def match(self, word: str) -> list[tuple[int, int]]:
        """(edits, term) of every term within its edits, the closest first."""
        if len(self.states) > 50_000:
            self.reset()
        s = self.start
        for c in word:
            if not self.states[s]:
                return []
            if c not in self.letters:
                c = ""
            moves = self.moves[s]
            if c not in moves:
                moves[c] = self._move(s, c)
            s = moves[c]
        return self.accepts[s]


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_SPLIT).split()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): text, toxic and the text's min-hash, which near copies share."""
    for batch in batches:
        keys = []
        for text in batch.column(0).to_pylist():
            words = _words((text or "").encode())
            keys.append(min((zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)), default=zlib.crc32(b" ".join(words))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64())], names=["text", "toxic", "key"])


def _counted(batches: Iterator[pa.RecordBatch], words_of: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic): each word's number of toxic texts and of clean ones."""
    sums: dict[str, list[int]] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], names=["word", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in words_of(text):
                sums.setdefault(w, [0, 0])[0 if toxic else 1] += 1
        if len(sums) > 200_000:
            yield rows()
            sums = {}
    if sums:
        yield rows()


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, lambda text: {w.decode().lower() for w in _words(text.encode())})


def _unquoted(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Like _teach, of the terms alone and of their uses outside quotation."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(terms, [0.0] * len(terms), frozenset(), 0.0), exact=True)
        yield from _counted(batches, lambda text: {terms[t] for t, factor in scorer.terms(text.encode()).items() if factor == 1.0})

    return find


def _close_words(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if any(e for e, _ in trie.match(w))], pa.string())], names=["word"])

    return find


class Lexicon:
    """terms with their log-odds; clean: words of clean texts, which match no other term; prior: log-odds of a text without terms."""

    def __init__(self, terms: list[str], odds: list[float], clean: frozenset[str], prior: float):
        self.terms, self.odds, self.clean, self.prior = terms, odds, clean, prior


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from at most `rows` labelled documents outside the held-out fold; its size is bounded by theirs."""
    with scratch(docs.sparkSession):
        return _learn(docs, labels, rows)


def _learn(docs: DataFrame, labels: DataFrame, rows: int) -> Lexicon:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(sample, "doc_id").select("text", "toxic")
    keyed = texts.mapInArrow(_keyed, "text string, toxic int, key long")
    once = settle(keyed.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-texts")
    counted = "word string, toxic long, clean long"
    added = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    stats = settle(once.mapInArrow(_teach, counted).groupBy("word").agg(*added), "toxic-words")
    sums = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    bad, good = sums.get(1, 0), sums.get(0, 0)
    prior = math.log((bad + 0.5) / (good + 0.5))
    tried = stats.where(F.col("toxic") >= LEAST_TEXTS).count()
    share = bad / max(bad + good, 1)

    def unlikely(a: int, c: int) -> bool:
        """Whether so many of a + c texts are toxic by chance in fewer than one of a hundred vocabularies."""
        chance = math.lgamma(a + c + 1) - math.lgamma(a + 1) - math.lgamma(c + 1) + a * math.log(max(share, 1e-9)) + math.log(max(tried, 1))
        return chance < math.log(0.01)

    # Words that quotations in clean texts hold as well are counted once more, by their other uses.
    enriched = stats.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") * good > F.col("clean") * bad)).collect()
    counts = {r["word"]: (r["toxic"], r["clean"]) for r in enriched if unlikely(r["toxic"], r["clean"])}
    doubtful = sorted(w for w, (a, c) in counts.items() if a < MOST_CLEAN * c)
    if doubtful:
        plain = {r["word"]: (r["toxic"], r["clean"]) for r in once.mapInArrow(_unquoted(doubtful), counted).groupBy("word").agg(*added).collect()}
        counts.update({w: plain.get(w, (0, 0)) for w in doubtful})
    found = []
    for word, (a, c) in counts.items():
        if a >= LEAST_TEXTS and a >= MOST_CLEAN * c and unlikely(a, c):
            odds = math.log((a + 0.5) / (bad + 1)) - math.log((c + UNSEEN) / (good + UNSEEN))
            found.append((-min(odds, MOST_ODDS), word))
    names = [w for _, w in sorted(found)]
    near = stats.where("clean > 0").select("word").mapInArrow(_close_words(names), "word string").distinct().collect()
    return Lexicon(names, [-o for o, _ in sorted(found)], frozenset(r[0] for r in near), prior)


class Scorer:
    def __init__(self, lexicon: Lexicon, exact: bool = False):
        self.lexicon, self.trie, self.exact = lexicon, FuzzyTrie(lexicon.terms), exact
        self.seen: set[bytes] = set()
        self.hits: dict[bytes, tuple[int, int]] = {}

    def find(self, word: bytes) -> tuple[int, int] | None:
        spelled = word.decode().lower()
        as_spelled = self.exact or spelled in self.lexicon.clean
        return next((m for m in self.trie.match(spelled) if not m[0] or not as_spelled), None)

    def terms(self, raw: bytes) -> dict[int, float]:
        """Terms in a text and the factor of each: its best use."""
        words = set(_words(raw))
        for w in words - self.seen:
            if m := self.find(w):
                self.hits[w] = m
        self.seen |= words
        found = words & self.hits.keys()
        out: dict[int, float] = {}
        if found:
            out = self._in_context(raw.decode(), found)
        if len(self.seen) > 300_000:
            self.seen, self.hits = set(), {}
        return out

    def _in_context(self, text: str, found: set[bytes]) -> dict[int, float]:
        spans = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        lowered = text.lower() if len(text.lower()) == len(text) else text
        out: dict[int, float] = {}
        for i, (a, b) in enumerate(spans):
            word = text[a:b].translate(_LOWER).encode()
            if word not in found:
                continue
            edits, term = self.hits[word]
            lo, hi = spans[max(0, i - CONTEXT)][0], spans[min(len(spans) - 1, i + CONTEXT)][1]
            before, after = text[lo:a], text[b:hi]
            quoted = any(before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c) for o, c in zip(OPENING, CLOSING, strict=True) if o in before and c in after)
            said = any(w in SAYING for w in _WORD.findall(lowered[lo:hi]))
            out[term] = max(out.get(term, 0.0), EDIT_FACTOR[edits] * (QUOTED if quoted or said else 1.0))
        return out

    def score(self, raw: bytes) -> tuple[float, int]:
        """(score, terms) of a text."""
        terms = self.terms(raw)
        total = self.lexicon.prior + sum(self.lexicon.odds[t] * f for t, f in sorted(terms.items()))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total)))), len(terms)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _scored(lexicon: Lexicon, names: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [scorer.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=[*batch.schema.names, *names])

    return score


def with_scores(docs: DataFrame, lexicon: Lexicon, score: str = "_score", terms: str = "_terms") -> DataFrame:
    """docs (with text) and its score and number of terms, in columns of the names given; columns of these names are replaced."""
    kept = drop_clashing(docs, [score, terms])
    return mapped(kept, _scored(lexicon, (score, terms)), T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(terms, T.LongType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    score, terms = fresh(docs.columns, "_score", "_terms")
    return with_scores(docs, learn(docs, labels), score, terms).where(F.col(score) < threshold).drop(score, terms)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_terms").alias("n_terms"))
