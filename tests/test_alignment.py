"""Bit-parallel alignments against the plain table of distances."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from tilth.functions import alignment


def plain_table(hyp, ref, free_start):
    n = np.arange(len(ref) + 1)
    table = np.empty((len(hyp) + 1, len(ref) + 1), dtype=np.int64)
    table[0] = 0 if free_start else n
    codes = np.array([ord(c) for c in ref])
    for i, c in enumerate(hyp, 1):
        row = table[i]
        row[0] = i
        row[1:] = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (codes != ord(c)))
        row[:] = np.minimum.accumulate(row - n) + n
    return table


def plain_walk(table, hyp, ref, j, free_start):
    i, matched = len(hyp), {}
    while i or (j and not free_start):
        if i and j and table[i, j] == table[i - 1, j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            if hyp[i] == ref[j]:
                matched[j] = i
        elif j and table[i, j] == table[i, j - 1] + 1:
            j -= 1
        else:
            i -= 1
    return matched, j


def pairs():
    rng = random.Random(9)
    for _ in range(700):
        letters = rng.choice(["ab", "abc", "abcdefgh", "aéبت😀"])
        yield "".join(rng.choices(letters, k=rng.randint(0, 40))), "".join(rng.choices(letters, k=rng.randint(0, 90)))
    for _ in range(12):
        ref = "".join(rng.choices("abcdef", k=400))
        at = rng.randrange(200)
        yield "".join(c if rng.random() > 0.1 else rng.choice("abcdef") for c in ref[at : at + 150]), ref


@pytest.mark.parametrize("block", [None, 1, 7])
def test_equal_to_the_table(monkeypatch, block):
    if block:
        real = alignment.Rows.__init__

        def smaller(self, *args):
            real(self, *args)
            self.block = block

        monkeypatch.setattr(alignment.Rows, "__init__", smaller)
    for hyp, ref in pairs():
        table = plain_table(hyp, ref, False)
        found, _ = plain_walk(table, hyp, ref, len(ref), False)
        assert alignment.matched_positions(hyp, ref) == [found.get(j) for j in range(len(ref))]
        if hyp and ref:
            assert alignment.fit_distance(hyp, ref) == min(table[-1].min(), plain_table(hyp[::-1], ref[::-1], False)[-1].min()) / len(hyp)
            free = plain_table(hyp, ref, True)
            end = len(ref) - int(free[-1, ::-1].argmin())
            _, start = plain_walk(free, hyp, ref, end, True)
            assert alignment.reached_region(hyp, ref) == (start, max(start, end - 1))


def test_small_memory_and_five_times_faster():
    rng = random.Random(1)
    ref = "".join(rng.choices("abcdefghij", k=5000))
    hyp = "".join(c if rng.random() > 0.2 else rng.choice("abcdefghij") for c in ref)
    began = time.perf_counter()
    table = plain_table(hyp, ref, False)
    found, _ = plain_walk(table, hyp, ref, len(ref), False)
    plain = time.perf_counter() - began
    began = time.perf_counter()
    got = alignment.matched_positions(hyp, ref)
    fast = time.perf_counter() - began
    assert got == [found.get(j) for j in range(len(ref))] and fast * 5 < plain
    tracemalloc.start()
    alignment.matched_positions(hyp, ref)
    alignment.reached_region(hyp, ref)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10_000_000


def test_long_texts():
    rng = random.Random(2)
    ref = "".join(rng.choices("abcdefghij", k=60_000))
    assert alignment.reached_region(ref[20_000:40_000], ref) == (20_000, 39_999)
