"""Texts of many megabytes: blocks give what whole texts give, in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from tilth.llm import language_id


@pytest.fixture(scope="module")
def models():
    rng = np.random.default_rng(1)
    tables = {}
    for lang, letters in (("xx", "abcde fgh"), ("yy", "aeiou rst"), ("zz", "äöü bcd")):
        codes = language_id.codes_of("".join(rng.choice(list(letters), 30_000)))
        keys, n = np.unique(language_id.grams(codes, language_id.ORDER), return_counts=True)
        tables[lang] = keys, n
    return language_id.KneserNey(tables)


def plain_codes(text):
    low = [c for c in text.lower()]
    out = [1, 1, 1]
    for i, c in enumerate(low):
        if c.isalpha():
            out.append(min(ord(c), 0xFFFF))
        elif i and low[i - 1].isalpha():
            out.append(32)
    return out if len(out) > 3 else None


@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_are_the_whole(monkeypatch, models, block):
    rng = np.random.default_rng(block)
    texts = ["".join(rng.choice(list("abc éÄ 12.,\n漢😀"), rng.integers(0, 300))) for _ in range(60)] + ["", None, "123", "a", " a ", "ab" * 400]
    whole = models.cross_entropies(texts)
    monkeypatch.setattr(language_id, "BLOCK", block)
    for t in texts:
        got = language_id.codes_of(t)
        assert (None if got is None else got.tolist()) == plain_codes(t or "")
    parts = models.cross_entropies(texts)
    assert (whole[1] == parts[1]).all() and np.allclose(whole[0], parts[0])


def test_memory_of_a_long_text_is_bounded(models):
    text = "abc de fgha eiou rst " * 1_000_000  # 21 million characters
    tracemalloc.start()
    found, sizes = models.cross_entropies([text, "abc"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[0] > 20_000_000 and np.isfinite(found).all() and most < 300_000_000
