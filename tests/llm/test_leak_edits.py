import random

from conftest import rows
from strataquery.llm import leaks
from test_texts import brute_leaks, docs


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        how = rng.randrange(3)
        words[at : at + 1] = [["new"], [], [words[at], "more"]][how]
    return words


def test_size_classes():
    assert [leaks.size_class(n) for n in (1, 2, 7, 8, 9, 10, 13, 20, 32, 46)] == [1, 2, 7, 8, 8, 10, 12, 18, 27, 41]
    assert all(leaks.size_class(n) <= n < 1.34 * leaks.size_class(n) + 1 for n in range(1, 400))


def test_item_sized_windows_find_edited_items(spark):
    """Items of 12 to 60 words planted with as many edits as are allowed: recall 0.9 of brute force, nothing else."""
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randrange(12, 61)) for _ in range(30)]
    texts = []
    for k in range(120):
        own = items[k % 30]
        texts.append(" ".join(text(10) + edited(rng, own, leaks.size_class(len(own)) // leaks.WORDS_AN_EDIT) + text(10)))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, ""), (91, None)], "item_id long, text string")
    got = set(rows(leaks.leaks(docs(spark, [*texts, None, "", "w1 w2"]), "doc_id", "text", it, "item_id", "text", size=None, reach=None, repeats=leaks.REPEATS)))
    want = set()
    for i, w in enumerate(items):
        size = leaks.size_class(len(w))
        want |= {(d, i) for d, _ in brute_leaks(texts, [" ".join(w)], size, size // leaks.WORDS_AN_EDIT)}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 60


def test_the_first_word_may_be_the_edited_one(spark):
    item = [f"k{i}" for i in range(20)]
    texts = [" ".join(["x", *item[1:]]), " ".join([*item[:-1], "x"]), " ".join(item[:10] + ["x"] + item[11:])]
    it = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert rows(leaks.leaks(docs(spark, texts), "doc_id", "text", it, "item_id", "text", size=None, reach=None, repeats=leaks.REPEATS)) == [(0, 7), (1, 7), (2, 7)]


def test_bitmaps_have_a_bound():
    for repeats in (1, 24, 200):
        block = leaks._block([0], ["a b c " * 5000], 13, repeats, 10, 1)
        assert sum(m.nbytes for t in block["tables"] for m in t.maps) <= leaks.BITMAP_BYTES


def test_shared_spans_with_hot_anchors(spark, scratch, monkeypatch):
    """One text in most documents, whole and at changing edges: the salted paths give what brute force gives."""
    from strataquery.llm import spans
    from strataquery.operators import skew
    from test_texts import brute_spans

    monkeypatch.setattr(skew, "LEAST_ROWS", 0)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(120)
    texts = [text(rng.randrange(30)) + (common[rng.randrange(3) :] if k % 3 else common) + text(rng.randrange(30)) for k in range(60)] + [text(80) for _ in range(5)] + [None, ""]
    for hot in (20_000, 3):
        assert rows(spans.shared_spans(docs(spark, texts), "doc_id", "text", scratch, 40, 8, hot)) == brute_spans(texts, 40)
