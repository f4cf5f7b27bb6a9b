import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import toxicity as t

TERMS = ["idiot", "moron", "worthless", "scum", "pathetically"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(term, edits):
    rng = random.Random(edits)
    for _ in range(edits):
        i = rng.randrange(len(term))
        term = rng.choice([term[:i] + term[i + 1 :], term[:i] + "z" + term[i:], term[:i] + "q" + term[i + 1 :]])
    return term


words = st.one_of(st.text(alphabet="idotmrnscuwhle", max_size=12), st.tuples(st.sampled_from(TERMS), st.integers(0, 3)).map(lambda x: mutated(*x)))


@settings(max_examples=300, deadline=None)
@given(words)
def test_automaton(word):
    wanted = sorted((distance(word, term), i) for i, term in enumerate(TERMS) if distance(word, term) <= t.edits_allowed(term))
    assert t.FuzzyTrie(TERMS).match(word) == wanted


def test_quotation_weighs_less():
    s = t.Scorer(t.Lexicon(TERMS, [4.0] * 5, frozenset(), -2.0))
    plain, quoted = s.score("you are an idiot my friend".encode())[0], s.score('he shouted "you idiot" at it'.encode())[0]
    assert plain >= 0.7 > quoted
    assert s.score(b"they said that moron was there")[0] < 0.7
    assert s.score(b"you idoit")[1] == 0 and s.score(b"you idiott")[1] == 1
    assert s.score(b"")[0] == s.score(b"nothing here")[0] < 0.2


def test_clean_words_are_no_misspellings():
    s = t.Scorer(t.Lexicon(TERMS, [4.0] * 5, frozenset(["mormon"]), -2.0))
    assert s.score(b"mormon")[1] == 0 and s.score(b"moron")[1] == 1 and s.score(b"mor0n")[1] == 1 and s.score(b"morron")[1] == 1


def planted(n=900):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "ri", "so", "mel") for b in ("nor", "vi", "du") for c in ("a", "en", "ist", "")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(TERMS))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learning(spark, make):
    rows, labels = planted()
    misspelled = [(1000 + i, "ta nora worthles xx " + mutated("pathetically", 2) + " sodu", "en", "s") for i in range(5)]
    docs, known = make(rows + misspelled), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon = t.learn(docs, known)
    assert set(lexicon.terms) == set(TERMS)
    got = {r["doc_id"]: r["_score"] >= t.THRESHOLD for r in t.with_scores(docs, lexicon).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i] == (i % 7 == 0) for i in held)
    assert all(got[1000 + i] for i in range(5))
    assert {r["doc_id"] for r in t.keep_clean(docs, known).collect()} == {i for i, bad in got.items() if not bad}


def test_accuracy_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = t.with_scores(docs.select("doc_id", "text"), t.learn(docs, labels)).join(labels.where("toxic IS NOT NULL"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    hit, missed = ([r for r in held if r["toxic"] == 1 and (r["_score"] >= t.THRESHOLD) == side] for side in (True, False))
    false = [r for r in held if r["toxic"] == 0 and r["_score"] >= t.THRESHOLD]
    assert len(hit) >= 0.75 * (len(hit) + len(missed)) and len(false) <= 0.01 * len(held)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_odd(spark, make, odd_rows, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert t.with_scores(make(odd_rows, clash=True), t.learn(make(odd_rows), known)).where("_score IS NOT NULL").count() == len(odd_rows)
    assert t.keep_clean(make([]), known).count() == 0


def by_hand(text, lexicon):
    """A text's score by the definition: distances to all terms of all words, uses judged one by one."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    best = {}
    for i, m in enumerate(words):
        word = m[0].lower()
        near = sorted((d, k) for k, term in enumerate(lexicon.terms) if abs(len(term) - len(word)) <= 2 and (d := distance(word, term)) <= t.edits_allowed(term))
        near = [x for x in near if not x[0] or word not in lexicon.clean]
        if not near:
            continue
        edits, term = near[0]
        window = words[max(0, i - t.CONTEXT) : i + t.CONTEXT + 1]
        before, after = text[window[0].start() : m.start()], text[m.end() : window[-1].end()]
        quoted = any(w[0].lower() in t.SAYING for w in window)
        for opening, closing in zip(t.OPENING, t.CLOSING, strict=True):
            opened = False
            for c in before:
                opened = not opened if c == opening == closing else c == opening or (opened and c != closing)
            quoted |= opened and closing in after
        factor = t.EDIT_FACTOR[edits] * (t.QUOTED if quoted else 1.0)
        best[term] = max(best.get(term, 0.0), factor)
    return 1 / (1 + math.exp(-(lexicon.prior + sum(lexicon.odds[k] * f for k, f in best.items()))))


def test_query_by_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = t.learn(docs.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = t.op6_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
        assert abs(r["score"] - by_hand(texts[r["doc_id"]], lexicon)) < 1e-9


pieces = st.sampled_from([*TERMS, "idiott", "mor0n", "morron", "mormon", "pathetcaly", "he", "said", "we", "tree", "“", "”", "'", '"', "«", "»", "!", "Scum", "WORTHLES"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=30))
def test_scores_by_brute_force(parts):
    lexicon = t.Lexicon(TERMS, [4.0, 3.0, 2.5, 5.0, 1.5], frozenset(["mormon"]), -2.0)
    text = " ".join(parts)
    assert abs(t.Scorer(lexicon).score(text.encode())[0] - by_hand(text, lexicon)) < 1e-9
