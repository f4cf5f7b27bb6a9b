import zlib
from collections import Counter

import numpy as np

from quillstone.llm import language_id as g


def test_trigrams_and_binding():
    v = g.Vectors()
    keys, counts = v.trigrams("Ab, ab!".encode())
    assert sorted(counts.tolist()) == [1, 2, 2] and len(keys) == 3  # " ab" and "ab " twice, "b a" once
    for k, row in zip(keys.tolist(), v.rows(keys), strict=True):
        a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
        assert (row == np.roll(v.letter(a), 2) * np.roll(v.letter(b), 1) * v.letter(c)).all()
    assert len(v.trigrams("123 !?".encode())[0]) == 0 and len(v.trigrams(b"")[0]) == 0


def test_pieces_of_long_texts():
    v, text = g.Vectors(), ("été plus long, " * 90_000).encode()
    keys, counts = v.trigrams(text)
    small_k, small_n = v.trigrams(("été plus long, " * 2).encode())
    assert set(small_k) == set(keys) and counts.sum() > 1_000_000
    whole = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    a, b = (dict(zip(*(x.tolist() for x in v.trigrams(("été plus long, " * n).encode())), strict=True)) for n in (2, 3))
    assert all(whole[k] == a[k] + (90_000 - 2) * (b[k] - a[k]) for k in whole)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in g.identify(docs, *g.learn(docs)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]
    assert np.mean(right) > 0.98 and all(0 <= r["score"] <= 1 for r in got.values())


def test_prototypes_do_not_depend_on_dealing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    a, b = g.learn(docs), g.learn(docs.repartition(7))
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_odd(spark, make, odd_rows):
    docs = make(odd_rows, clash=True)
    got = g.identify(docs, *g.learn(docs)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert g.learn(make([])) [0] == [] and g.identify(make([]), ["en"], np.ones((1, g.DIMENSIONS))).count() == 0
    none = g.identify(docs, [], np.zeros((0, g.DIMENSIONS))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def grams(text):
    """Trigrams of lower-cased letters, by the definition: each run of other characters, and either end, is one boundary."""
    run = [0]
    for c in text:
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or run[-1]:
            run.append(code)
    if run[-1]:
        run.append(0)
    return Counter(zip(run, run[1:], run[2:], strict=False)) if any(c.isalpha() for c in text) else Counter()


def test_query_by_brute_force(spark):
    """Every row of the query against vectors bound and bundled one trigram at a time."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    letter, bound = g.Vectors().letter, {}

    def vector(text):
        out = np.zeros(g.DIMENSIONS)
        for abc, n in grams(text or "").items():
            if abc not in bound:
                a, b, c = map(letter, abc)
                bound[abc] = (np.roll(a, 2) * np.roll(b, 1) * c).astype(np.float64)
            out += n * bound[abc]
        return out

    vectors, sums = [vector(r["text"]) for r in rows], {}
    fold = [zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows]
    for r, v, f in zip(rows, vectors, fold, strict=True):
        if r["lang"] is not None and f != 1:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    langs = sorted(sums)
    got = {r["doc_id"]: r for r in g.op4_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r, v, f in zip(rows, vectors, fold, strict=True):
        x = got[r["doc_id"]]
        cosines = np.array([v @ sums[k] / np.linalg.norm(v) / np.linalg.norm(sums[k]) for k in langs]) if v.any() else None
        wanted, score = "und", 0.0
        if cosines is not None:
            e = np.exp((cosines - cosines.max()) / g.TEMPERATURE)
            wanted, score = langs[int(cosines.argmax())], float(e.max() / e.sum())
        assert (x["held_out"], x["lang_pred"]) == (f == 1, wanted) and abs(x["score"] - score) < 1e-4
