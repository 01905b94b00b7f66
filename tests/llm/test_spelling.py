"""Spelling variants against plain edit distance over all pairs."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest

from tilth.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(spark, docs, **kw):
    return sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), **kw).collect())


def some_docs(seed, letters, base=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(base)]
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    weights = [rng.choice([1, 1, 3, 40, 600]) for _ in words]
    return [(d, " ".join(rng.choices(words, weights, k=400)) + rng.choice([".", " 1é2", "É"])) for d in range(20)]


@pytest.mark.parametrize("seed,letters", [(1, "abc"), (2, "abcdefgh"), (3, "aéÿ×bc"), (4, "ab")])
def test_against_all_pairs(spark, seed, letters):
    docs = some_docs(seed, letters)
    want = plain(docs)
    assert any(w[1] for w in want) and got(spark, docs) == want


def test_long_lists_are_dealt_again(spark):
    docs = some_docs(5, "abc", 100)
    assert got(spark, docs, long_list=4) == plain(docs)


def test_odd_input(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, ""), (None, "12 34")]) == []
    long = "ab" * 40_000
    docs = [(None, "Letters letters letterz letterz " * 20), (7, f"{long} {long} {long}c {long}c"), (7, f"{long} {long} {long}c {long}c"), (8, "étéétéé étéétéé ÉtéÉtéé")]
    assert got(spark, docs) == plain(docs)
    frame = spark.createDataFrame([(1, "seventy seventy", "w", 5)], "doc_id long, text string, word string, n int")
    assert [r["word"] for r in spelling.variants(frame).collect()] == ["seventy"]


def test_blocks_keep_runs_whole(monkeypatch):
    text = "".join(random.Random(1).choice("abc é1") for _ in range(5000))
    want = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert sum((Counter(r) for r in spelling.runs_of(text)), Counter()) == want


def test_words_of_seven_have_more_grams_than_an_edit_takes():
    """All patterns of frequent pairs: the bound is at most 3 and less than the number of grams."""
    for n in range(7, 14):
        for pattern in product((2, 3), repeat=n - 2):
            spans, last = [], 0
            for p, size in enumerate((*pattern, 2)):
                if p + size > last:
                    spans.append((p, p + size))
                    last = p + size
            assert spelling.most_lost(spans) <= min(3, len(spans) - 1)


def test_bound_covers_every_edit():
    rng = random.Random(2)
    frequent = frozenset(("ab", "ba", "bc", "cc"))
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 30)))
        grams = Counter(w[p:e] for p, e in spelling.decompose(w, frequent))
        most = spelling.most_lost(spelling.decompose(w, frequent))
        for i in range(len(w) + 1):
            for v in {w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]} - {w}:
                assert sum((grams - Counter(v[p:e] for p, e in spelling.decompose(v, frequent))).values()) <= most
