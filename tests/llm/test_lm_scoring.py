import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import lm_scoring as lm

UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


def remainder(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def brute_force(rows):
    """By row: held out, tokens, known tokens, N, base score, score; counted with dictionaries."""
    one, two, three, starts = Counter(), Counter(), Counter(), 0

    def grams(w):
        return zip(["START", *w], w, strict=False), zip(["START", *w], w, w[1:], strict=False)

    for i, t in rows:
        if remainder(i) != lm.HELD_OUT:
            w = tokens(t)
            pairs, triples = grams(w)
            one.update(w)
            two.update(pairs)
            three.update(triples)
            starts += 1
    total, distinct = sum(one.values()), len(one)
    at = lambda c: int(lm.bucket_of(np.array([c]))[0])
    level = lambda p: int(lm._level(np.array([p]))[0])

    def estimates(w, delete):
        own1, own2, own3 = Counter(), Counter(), Counter()
        if delete:
            own1.update(w)
            pairs, triples = grams(w)
            own2.update(pairs)
            own3.update(triples)
        n = total - (len(w) if delete else 0)
        for k, x in enumerate(w):
            v = w[k - 1] if k else "START"
            c = one[v] - own1[v] if k else starts - int(delete)
            u = (w[k - 2] if k > 1 else "START") if k else None
            wide = two[u, v] - own2[u, v] if k else 0
            f3 = (three[u, v, x] - own3[u, v, x]) / wide if wide > 0 else 0.0
            yield wide, f3, c, (two[v, x] - own2[v, x]) / c if c > 0 else 0.0, (one[x] - own1[x]) / max(n, 1)

    def lower(e, weights):
        w = weights[at(e[2])]
        return w[0] * e[3] + w[1] * e[4] + w[2] / (distinct + 1)

    deleted = [e for i, t in rows if remainder(i) == lm.DELETED for e in estimates(tokens(t), True)]
    weights = lm.learn_weights(sorted(Counter(at(c) << 20 | level(f2) << 10 | level(f1) for _, _, c, f2, f1 in deleted).items()), distinct)
    top = lm.learn_top_weights(sorted(Counter(at(e[0]) << 20 | level(e[1]) << 10 | level(lower(e, weights)) for e in deleted).items()))
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w)
        score = sum(math.log10(top[at(e[0])][0] * e[1] + top[at(e[0])][1] * lower(e, weights)) for e in estimates(w, False))
        out.append((i, remainder(i) == lm.HELD_OUT, len(w), sum(one[x] > 0 for x in w), total, base, score))
    return out


def alike(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-6)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, sf_dir, small):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10**9, None), (10**9 + 1, ""), (10**9, None), *rows[:3], (None, "a b a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alike(lm.score_documents(docs, *((5000, 500) if small else ())).collect(), brute_force(rows))


def test_the_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    alike(lm.op8_lm_scoring(spark, sf_dir).collect(), brute_force(rows))


def test_long_texts_are_counted_in_pieces(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 400)) + "  ") for i in range(40) if remainder(i) != lm.DELETED]
    rows += [(900, "x" * 5000 + " a  b\n"), (901, "  "), (902, "x" * 5000)]
    rows = [r for r in rows if remainder(r[0]) != lm.DELETED]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alike(lm.score_documents(docs, 3000, 500, 200).collect(), brute_force(rows))


def test_pieces():
    text = " one two  three\tfour five six  "
    parts = lm.pieces_of(text.encode(), 6)
    words = [w for skip, body in parts for w in body.split()[skip:]]
    assert words == text.encode().split() and len(parts) > 2
    assert all(body.split()[:skip] == text.encode().split()[:99][max(0, sum(len(b.split()) - s for s, b in parts[:i]) - 2) :][:skip] for i, (skip, body) in enumerate(parts))
    assert lm.pieces_of(b"", 6) == [(0, b"")]


def test_equal_rows_share_one_piece(spark):
    docs = spark.createDataFrame([(i, "again and again") for i in range(3000)] + [(None, "again and again")] * 50, "doc_id long, text string")
    got = lm.score_documents(docs, 500, 50).collect()
    alike(got, brute_force([tuple(r) for r in docs.collect()]))


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = [r for r in lm.score_documents(rows).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


def test_packing():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm._unpack(lm._pack(h)) == h).all() and lm._unpack(lm._pack(h[:0])).size == 0


def test_weights_sum_to_one():
    w = lm.learn_weights([(3 << 20 | 9 << 10 | 40, 5), (8 << 20 | 0 << 10 | 40, 7)], 100)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.9 and w[8, 0] < 1e-3
    assert np.allclose(lm.learn_weights([], 5).sum(axis=1), 1)


def test_odd(spark, make, odd_rows):
    assert lm.score_documents(make(odd_rows, clash=True)).count() == len(odd_rows)
    assert lm.score_documents(make([])).count() == 0
    held = next(i for i in range(100) if remainder(i) == lm.HELD_OUT)
    only = lm.score_documents(make([(held, "a b", "en", "s")])).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["base_score"] == 0.0 and only["score"] < 0.01
