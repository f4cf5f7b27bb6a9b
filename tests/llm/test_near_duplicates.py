import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import near_duplicates as n
from quillstone.llm.components import components, extended

UPPER = {c: c + 32 for c in range(65, 91)}


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        out.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    return out


def brute(texts):
    """Least member of each text's component under exact weighted Jaccard similarity; pairs that share a shingle are compared."""
    s = sets(texts)
    once = [x for x in sets(sorted({t or "" for t in texts})) if x]
    total = len(once)
    df = Counter(g for x in once for g in x)
    w = {g: math.log(1 + total / max(c, total / n.COMMON)) for g, c in df.items()}
    mass = [sum(c * w[g] for g, c in x.items()) for x in s]
    by = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            by[g].append(i)
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in {(a, b) for m in by.values() for a in m for b in m if a < b}:
        shared = sum(min(c, s[b][g]) * w[g] for g, c in s[a].items() if g in s[b])
        if shared >= n.LEAST * (mass[a] + mass[b] - shared):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def corpus(seed=1, size=120):
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passage, texts = some(30), []
    for _ in range(size):
        base = some(rng.choice([3, 20, 80, 300]))
        texts.append(" ".join(base + (passage if rng.random() < 0.4 else [])))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    hot = some(100)
    for i in range(60):
        texts.append(" ".join(hot[: 100 - i % 4] + [f"tail{i % 9}"]))
    texts += [" ".join(some(50))] * 20
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(make, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: r["class_id"] for r in n.near_classes(make(texts, clash=True)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pairs_inside_a_family_of_one_template(make):
    rng = random.Random(11)
    some = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    template, texts = some(150), []
    for _ in range(200):
        both = some(2)
        texts += [" ".join(template + both + some(4)) for _ in range(2)]
    rng.shuffle(texts)
    wanted = brute(texts)
    assert len(set(wanted)) == 200
    got = {r["doc_id"]: r["class_id"] for r in n.near_classes(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == wanted


def test_keep_one(make):
    texts = [*corpus(3, 60), None, "", "!!!", None]
    docs = make([(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s"), (None, texts[6] + " and more words", "en", "s"), (None, texts[6] + " and more words", "en", "s")])
    kept = n.keep_one(docs).collect()
    label = brute([*texts, texts[6] + " and more words"])
    wanted = {i for i, x in enumerate(label[:-1]) if x == i}
    assert {r["doc_id"] for r in kept} - {None} == wanted
    assert len(kept) == len(wanted) + (label[-1] == len(texts))
    assert kept[0].__fields__ == docs.columns


def test_draws_agree_as_similarity_says():
    rng = np.random.default_rng(4)
    agree = total = 0.0
    for _ in range(150):
        both = rng.integers(0, 1 << 52, 60).astype(np.uint64)
        a, b = np.sort(np.concatenate([both, rng.integers(0, 1 << 52, 15).astype(np.uint64)])), np.sort(both)
        wa, wb = np.ones(len(a), np.float32), np.full(len(b), 0.9, np.float32)
        d = [n.draws(np.array([0]), x, w)[0] for x, w in ((a, wa), (b, wb))]
        agree, total = agree + (d[0] == d[1]).mean(), total + 54 / 75
    assert abs(agree - total) / 150 < 0.03


def test_texts_are_drawn_by_true_document_frequencies(make):
    texts = [*corpus(5, 60), None, "", "!!!"]
    held = {}
    for t in {t or "" for t in texts}:
        for _, _, _, sh, count in n.text_sets(pa.array([t])):
            held[t] = sh, count
    held = {t: x for t, x in held.items() if len(x[0])}
    df = Counter(g for sh, _ in held.values() for g in sh.tolist())
    assert len({c for c in df.values() if c * n.COMMON < len(held)}) > 2
    signed, _ = n.classes(make(texts))
    got = {bytes(r["node"]): r["bands"] for r in signed.collect()}
    assert len(got) == len({t or "" for t in texts})
    for t in {t or "" for t in texts}:
        wanted = None
        if t in held:
            sh, count = held[t]
            weight = np.log1p(len(held) / np.array([df[g] for g in sh.tolist()])).astype(np.float32) * count.astype(np.float32)
            wanted = n.bands(n.draws(np.array([0]), sh, weight))[0].tolist()
        assert got[hashlib.md5(t.encode()).digest()] == wanted


def test_similarities():
    left, right = ["a b c d e f g", "x", "", "a b c d e f"], ["a b c d e f g", "y", "x", "a b c d e g"]
    idf = n.Idf(10, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert n.similarities(pa.array(left), pa.array(right), idf).round(4).tolist() == [1.0, 0.0, 0.0, round(1 / 3, 4)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in label}
    some = components(spark.createDataFrame(edges[::2], "a long, b long"))
    assert {r["node"]: r["label"] for r in extended(some, spark.createDataFrame(edges[1::2], "a long, b long")).collect()} == got


def test_odd(make, odd_rows):
    got = n.near_classes(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert n.near_classes(make([])).count() == 0 and n.keep_one(make([])).count() == 0
    assert n.keep_one(make([None, None, ""])).count() == 3
