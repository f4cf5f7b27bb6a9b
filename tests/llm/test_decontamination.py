import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), window)
        for j in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


sentence = st.lists(st.sampled_from("a b c d".split()), max_size=40).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(sentence, min_size=1, max_size=4), st.lists(sentence, max_size=5), st.integers(2, 6))
def test_matcher(texts, items, window):
    import pyarrow as pa

    numbered = list(enumerate(items))
    data, offsets = d.string_buffers(pa.array(texts))
    h, row, _, _ = d.hash_words(data, offsets, d.LETTERED)
    found = d.Matcher(numbered, window).match(h, row, len(texts))
    for r, t in enumerate(texts):
        spans, got = found.get(r, ([], set()))
        n, hit, wanted = brute(t, numbered, window)
        assert sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)) == hit and sorted(got) == wanted


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(99, None), (98, "...")]
    texts = [some(200) for _ in range(20)] + [some(30) + ", " + t.upper() + "; " + some(30) for _, t in items[:12]]
    return texts, items


def test_find_hits(spark, make):
    texts, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (d.BLOCK_BYTES, 300):
        got = d.find_hits(make(texts, clash=True), table, block_bytes=block).collect()
        for r in got:
            n, hit, found = brute(r["text"], [(i, t) for i, t in items if t])
            assert r["n_words"] == n and r["hit_items"] == found
            assert sum(b - a for a, b in zip(r["hit_spans"][::2], r["hit_spans"][1::2], strict=True)) == hit


def test_decontaminate(spark, make):
    texts, items = corpus()
    long = [(i, t) for i, t in items if t and len(words(t)) >= 9]
    clean = "nothing here is in any item at all"
    filler = " ".join(f"f{i}" for i in range(30))
    split = f"before {filler} " + " ".join(long[0][1].split()[:5]) + " " + long[1][1] + " " + " ".join(long[0][1].split()[5:]) + f" {filler} after"
    table = spark.createDataFrame(long, "item_id long, text string")
    docs = make([*texts, clean, split, long[1][1], None, ""])
    for block in (d.BLOCK_BYTES, 300):
        got = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, table, block_bytes=block).collect()}
        n = len(texts)
        assert got[n] == clean and n + 2 not in got and got[n + 3] is None and got[n + 4] == ""
        assert all(brute(t, long)[1] == 0 for t in got.values())
        assert "before" in got[n + 1] and "after" in got[n + 1]


def plain(text, items, window, coverage=d.COVERAGE):
    """What decontaminate() states, word by word; None if the document goes."""
    first = True
    while text is not None:
        spans = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
        w, hit = words(text), set()
        for _, t in items:
            v = words(t)
            n = min(len(v), window)
            for j in range(len(v) - n + 1 if v else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
        if not hit:
            return text
        if first and len(hit) >= coverage * len(w):
            return None
        first, out, done, i = False, "", 0, 0
        while i < len(w):
            if i in hit:
                out += text[done : spans[i][0]]
                while i in hit:
                    done = spans[i][1]
                    i += 1
            i += 1
        text = out + text[done:]
    return None


def test_every_block_size_gives_the_same(spark, make):
    rng = random.Random(8)
    parts = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(4)]
    items = list(enumerate(parts)) + [(9, " ".join(f"p{k}x{i}" for k, i in [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (2, 7), (2, 8), (2, 9), (2, 10), (2, 11)]))]
    texts = ["t1 t2 t3 t4 t5 t6 t7 " + " ".join(parts[k][: parts[k].rindex(" ")] for k in range(4)), "t1 t2 " * 9 + parts[0] + " t9", "nothing at all", None]
    for _ in range(30):
        some = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(parts).split()
            some.append(rng.choice([" ".join(p), " ".join(p[:5]), " ".join(p[7:]), "u v w " * rng.randrange(9)]))
        texts.append(" ".join(some))
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = {i: t for i, t in enumerate(plain(t, items, 10) for t in texts) if t is not None or texts[i] is None}
    assert 0 not in wanted
    for size in (20, 90, 200, 1 << 20):
        docs = make(texts, clash=True)
        got = d.decontaminate(docs, table, block_bytes=size).collect()
        assert {r["doc_id"]: r["text"] for r in got} == wanted and all(r["_key"] == r["size"] == "x" for r in got)


def test_items_without_id(spark, make):
    text = " ".join(f"t{i}" for i in range(12))
    got = d.find_hits(make([f"x {text} y"]), spark.createDataFrame([(None, text)], "item_id long, text string")).first()
    assert got["hit_spans"] == [1, 13] and got["hit_items"] == []
    assert d.decontaminate(make([f"{'x ' * 9}{text} y"]), spark.createDataFrame([(None, text)], "item_id long, text string")).first()["text"] == "x " * 9 + " y"


def test_odd(spark, make, odd_rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.find_hits(make(odd_rows), empty).where("size(hit_items) > 0").count() == 0
    assert d.decontaminate(make(odd_rows), empty).count() == len(odd_rows)
    assert d.find_hits(make([]), empty).count() == 0
