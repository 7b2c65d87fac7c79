import os
import random

import numpy as np
import pytest

from conftest import rows
from strataquery.llm import leaks, provenance, spans, tokenize
from strataquery.llm.textarrays import words

VOCAB = tokenize.VOCABULARY
DOCS = "doc_id long, text string, ids string, d string, t string, span_start int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "d", "t", 5) for i, t in enumerate(texts)], DOCS)


needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def lexicon():
    return tokenize.Lexicon(tokenize.pack(tokenize.read_ranks(VOCAB)))


@needs_vocabulary
def test_ids_equal_the_library(lexicon):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokenize.read_ranks(VOCAB), special_tokens={})
    rng = random.Random(5)
    signs = "ab 'sdmtlvreLL\n\t\r1é日. 　!́😀_\x00"
    texts = ["", "'", " 's", "don't'll", "<|endoftext|>", "a" * 3000, " " * 50, "x\n\n\ny  z ", "’s"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    flat, at = tokenize.encode(texts, lexicon)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(t), t


@needs_vocabulary
def test_merge_of_long_words_is_exact(lexicon):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenize.read_ranks(VOCAB)
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    for n in (1, 2, 5, 40, 400, 3000):
        word = "".join(rng.choice("abcth e") for _ in range(n))
        assert tokenize.merge(word.encode(), ranks) == enc.encode_ordinary(word)


def test_transducer_accepts_exactly_its_words():
    rng = random.Random(7)
    own = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    auto = tokenize.Transducer(own)
    lex = object.__new__(tokenize.Lexicon)
    lex.base, lex.final, lex.check, lex.target, lex.skip = auto.base, auto.final, auto.check, auto.target, auto.skip
    tries = own + [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    data = np.frombuffer(b"".join(tries), np.uint8)
    length = np.array([len(t) for t in tries])
    got = lex.numbers(data, np.r_[0, np.cumsum(length)[:-1]], length)
    place = {w: i for i, w in enumerate(own)}
    assert got.tolist() == [place.get(t, -1) for t in tries]
    assert len(auto.base) < sum(map(len, own)) / 2  # suffixes are shared


@needs_vocabulary
def test_ids_of_null_and_empty_texts(spark):
    got = {r.doc_id: r.ids for r in tokenize.token_ids(docs(spark, [None, "", "a b", "a b"]), "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and got[2] == got[3] and len(got[2]) == 2
    assert tokenize.token_ids(docs(spark, []), "doc_id", "text").count() == 0


def word_lists(texts):
    import regex

    return [[w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")] for t in texts]


def test_words_and_their_hashes():
    texts = ["", "Ab-ab AB", "İx ΟΔΟΣ οδος", "a_b", "１２ ²", "x"]
    h, doc, start, end = words(texts)
    own = [texts[d][s:e].lower() for d, s, e in zip(doc, start, end)]
    assert own == [w for ws in word_lists(texts) for w in ws]
    by = {}
    for w, x in zip(own, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def brute_leaks(texts, items, size, reach=0):
    out = set()
    docs_, items_ = word_lists(texts), word_lists(items)
    for i, d in enumerate(docs_):
        for j, e in enumerate(items_):
            if any(leaks.edit_distance(d[a : a + size], e[b : b + size], reach) <= reach for a in range(len(d) - size + 1) for b in range(len(e) - size + 1)):
                out.add((i, j))
    return sorted(out, key=repr)


def leak_case(seed, size):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "d1", "é", "Ω", "zeta", "eta"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [text(rng.randrange(size - 2, size + 8)) for _ in range(12)] + [""]
    texts = [text(rng.randrange(0, 40)) for _ in range(40)] + [None, "", " "] + [text(5) + " - " + items[k % 12].upper() + ", " + text(4) for k in range(20)]
    return texts, items + items[:1]


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_leaks_against_brute_force(spark, chars):
    texts, items = leak_case(1, 7)
    it = spark.createDataFrame([(i, t, "d") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = rows(leaks.leaks(docs(spark, texts), "doc_id", "text", it, "item_id", "text", size=7, block_chars=chars))
    assert got == brute_leaks(texts, items, 7)


def test_leaks_with_edits_reach_recall():
    texts, items = leak_case(2, 10)
    texts = [t or "" for t in texts]
    want = set(brute_leaks(texts, items, 10, 1))
    block = leaks._block(list(range(len(items))), items, 10, 24, 5, 1)
    got = leaks._match(texts, [block])
    assert got <= want and len(got) >= 0.9 * len(want)


def test_no_items_or_documents(spark):
    it = spark.createDataFrame([], "item_id long, text string")
    assert rows(leaks.leaks(docs(spark, ["a b"]), "doc_id", "text", it, "item_id", "text")) == []
    one = spark.createDataFrame([(1, "a " * 20), (2, None)], "item_id long, text string")
    assert rows(leaks.leaks(docs(spark, []), "doc_id", "text", one, "item_id", "text")) == []
    assert rows(leaks.leaks(docs(spark, ["A a " * 9]), "doc_id", "text", one, "item_id", "text")) == [(0, 1)]


def brute_spans(texts, least):
    where = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], set()).add(i)
    out = []
    for i, t in enumerate(texts):
        run = None
        for k in range(len(t or "") - least + 1):
            if len(where[t[k : k + least]]) > 1:
                if run and k <= run[1]:
                    run[1] = k + least
                else:
                    if run:
                        out.append((i, *run))
                    run = [k, k + least]
        if run:
            out.append((i, *run))
    return sorted(out, key=repr)


def span_case(seed):
    rng = random.Random(seed)
    text = lambda n, a="abcdé😀 ": "".join(rng.choice(a) for _ in range(n))
    pool = [text(rng.randrange(30, 90)) for _ in range(6)]
    head = text(70)
    out = [None, "", "short", "a" * 200, "a" * 120, pool[0], pool[0]]
    for _ in range(40):
        body = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            lo = rng.randrange(0, 15)
            body += p[lo : len(p) - rng.randrange(0, 15)] + text(rng.randrange(0, 30))
        out.append((head if rng.random() < 0.4 else "") + body)
    twice = text(45)
    return out + [twice + "|" + twice, text(20, "ab") * 6, text(20, "ab") * 6]


@pytest.mark.parametrize("seed,hot,gram", [(1, 20_000, 12), (2, 1, 12), (3, 2, 29), (4, 20_000, 1)])
def test_spans_against_brute_force(spark, scratch, seed, hot, gram):
    texts = span_case(seed)
    got = rows(spans.shared_spans(docs(spark, texts).repartition(3), "doc_id", "text", scratch, least=30, gram=gram, hot=hot))
    assert got == brute_spans(texts, 30)


def test_no_spans(spark, scratch):
    assert rows(spans.shared_spans(docs(spark, []), "doc_id", "text", scratch)) == []
    assert rows(spans.shared_spans(docs(spark, ["x" * 400, None]), "doc_id", "text", scratch)) == []


FILES = "file_id long, repository_id long, path string, content string, kind string, p string"


def kinds(spark, scratch, data):
    df = spark.createDataFrame([(*d, "clash", "p") for d in data], FILES)
    return {r.file_id: r.kind for r in provenance.classify(df, scratch).collect()}


def source(seed, n=60):
    rng = random.Random(seed)
    return "\n".join(f"def f{rng.randrange(10**6)}(a{rng.randrange(10**6)}):\n    return a{rng.randrange(10**6)} + {rng.randrange(10**6)}" for _ in range(n))


def test_origins(spark, scratch):
    squeezed = ";".join(f"var a{i}=function(b){{return b?b.c{i}:d}}" for i in range(60))
    rows_ = [[str(i * 7919 % 65536) for i in range(k, k + 10)] for k in range(0, 400, 10)]
    table_ = "x = [\n" + "\n".join("    " + ", ".join(r) + "," for r in rows_) + "\n]\n"
    data = [
        (1, 1, "a/x.py", source(1)), (2, 1, "a/package-lock.json", "{}"), (3, 1, "vendor/q/x.py", source(2)), (4, 1, "vendor_onboarding/x.py", source(3)), (5, 1, "a/y.go", "// Code generated by z 1.2. DO NOT EDIT.\npackage y\n"),
        (6, 1, "a/z.py", '"""Writes the "DO NOT EDIT" header."""\n# Skips files that start with Code generated by\n' + source(4)), (7, 1, "a/s.js", squeezed), (8, 1, "a/d.py", table_), (9, 1, "a/n.py", None), (10, 1, "third_party/n.py", None), (11, 1, "a/e.py", ""),
        (12, 1, "a/copy.py", source(5)), (13, 2, "b/c.py", source(5).replace("\n", "\r\n")), (14, 3, "own/c.py", source(5) + "\n# tail"), (15, 4, "a/t.py", source(6)), (16, 4, "a/u.py", source(6)), (12, 1, "a/copy.py", source(5)), (17, None, None, source(7)), (18, 1, "a/min.py", source(8)),
    ]
    got = kinds(spark, scratch, data)
    want = {2: "generated", 3: "vendored", 5: "generated", 7: "minified", 8: "data", 10: "vendored", 12: "vendored", 13: "vendored", 14: "vendored"}
    assert {k: v for k, v in got.items() if v != "handwritten"} == want and len(got) == 18
    assert kinds(spark, scratch, []) == {}


def test_idioms_of_many_files_make_no_copy(spark, scratch):
    # Every piece of file 1 stands in some other repository, but no other file has most of it.
    pieces = [source(100 + k, 12) for k in range(8)]
    data = [(1, 1, "a/x.py", "\n".join(pieces))] + [(10 + k, 10 + k, "b/y.py", source(200 + k, 30) + "\n" + p) for k, p in enumerate(pieces)]
    assert set(kinds(spark, scratch, data).values()) == {"handwritten"}


def test_copies_against_brute_force(spark, scratch):
    rng = random.Random(9)
    pieces = [source(300 + k, 8) for k in range(12)]
    data = [(i, rng.randrange(6), f"a/f{i}.py", "\n".join(rng.sample(pieces, rng.randrange(1, 6)) + [source(400 + i, rng.randrange(1, 6))])) for i in range(60)]
    data += [(60 + i, rng.randrange(6), f"b/f{i}.py", rng.choice(data)[3]) for i in range(20)]
    sets = [set(p.tolist()) for p in provenance.fingerprints([d[3] for d in data])]
    want = {d[0] for d, s in zip(data, sets) if any(e[1] != d[1] and len(s & t) >= 0.75 * len(s) for e, t in zip(data, sets))}
    got = {k for k, v in kinds(spark, scratch, data).items() if v == "vendored"}
    assert got == want and 0 < len(want) < len(data)


def test_notices_of_own_files_decide_nothing(spark, scratch):
    notices = ["# Copyright 2024 own contributors\n", "# own 1.2.0 - (c) 2024 The own Authors. MIT licensed.\n", "# Copyright 2016-2021 Own Software Foundation\n"]
    data = [(i, 1, f"a/n{i}.py", h + source(500 + i)) for i, h in enumerate(notices)] + [(9, 1, "a/c.py", notices[0] + source(510)), (10, 2, "b/c.py", source(510))]
    assert kinds(spark, scratch, data) == {0: "handwritten", 1: "handwritten", 2: "handwritten", 9: "vendored", 10: "vendored"}


def test_generated_header_after_a_long_licence():
    licence = "\n".join(f"Line {i} of a licence." for i in range(40))
    said = "// Code generated by z. DO NOT EDIT.\n\npackage a\n"
    assert provenance.by_content("a/x.go", licence.replace("Line", "// Line") + "\n\n" + said) == "generated"
    assert provenance.by_content("a/x.go", f"/*\n{licence}\n*/\r\n{said}") == "generated"
    assert provenance.by_content("a/x.js", '"use strict";\n' + licence.replace("Line", "// Line") + "\n// @generated\nf();\n") == "generated"
    assert provenance.by_content("a/x.go", "package a\n\nconst t = `\n" + said + "`\n") is None


def test_data_lines_of_any_length():
    for n in (15_000, 30_000, 3_000_000):
        assert provenance.by_content("a/x.js", "[\n" + ", ".join(["123"] * (n // 5)) + "\n]\n") == "data"
    # A line that fails at its end costs no more than one that fits.
    assert provenance.by_content("a/x.js", '"a" + 1 ' * 100_000 + "x") is None


def test_fingerprints_survive_layout():
    a, b = provenance.fingerprints(["foo ( bar ) ; " * 30, "foo(bar);\n" * 30])
    assert a.tolist() == b.tolist() and len(a)
    assert [len(x) for x in provenance.fingerprints(["", "a b", "日本 語" * 40])][:2] == [0, 0]
