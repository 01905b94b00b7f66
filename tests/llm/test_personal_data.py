"""Personal data: fixed patterns against plain regular expressions, the label model on votes of known reliability, called spans on planted ones."""

import random
import re

import numpy as np
import pytest

from tilth.llm import personal_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_fixed_patterns_against_plain_ones():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@x.y", ".", "..", "1", "23", "255", "256", "0001", " ", "-", "+", "+1", "(", ")", "é", "%", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "mail7.example.com", "@@", "\n", "٣", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert pd_.base_spans(text) == plain(text), text


def test_fixed_patterns_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 3_000_000, "1" * 3_000_000, "1." * 1_500_000, "a@" * 1_500_000, "+1 " * 1_000_000, "(" * 3_000_000, "1 -" * 1_000_000, "a.b@c" * 300_000, "1111-" * 600_000, "AB12" * 300_000 + "(at)"):
        pd_.base_spans(text)
        pd_.candidates(text[:200_000], pd_.base_spans(text[:200_000]))
    assert time.perf_counter() - began < 120


def test_label_model_finds_reliabilities():
    rng = np.random.default_rng(1)
    real = rng.random(20_000) < 0.3
    right, speaks = np.array([0.95, 0.9, 0.8, 0.85, 0.7, 0.75, 0.6, 0.9]), np.array([0.9, 0.8, 0.7, 0.5, 0.6, 0.8, 0.5, 0.4])
    votes = np.where(rng.random((20_000, 8)) < right, 1, -1) * np.where(real, 1, -1)[:, None] * (rng.random((20_000, 8)) < speaks)
    codes, counts = np.unique((votes + 1) @ 3 ** np.arange(8), return_counts=True)
    model = pd_.estimate(pd_.unpacked(codes), counts.astype(float))
    assert abs(model.prior - 0.3) < 0.02
    assert np.abs(model.chances[1, :, 2] - right).max() < 0.03 and np.abs(model.chances[0, :, 0] - right).max() < 0.03
    called = model.posterior(votes) > 0.5
    by_majority = votes.sum(axis=1) > 0
    assert (called == real).mean() > max(0.95, (by_majority == real).mean())


def planted(seed, n):
    """Documents with spans that the fixed patterns miss, and decoys."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        d += next(c for c in "0123456789" if pd_.luhn(d + c))
        return f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}"

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    word = lambda: "".join(rng.choice(["lo", "ra", "mi", "ten", "su"]) for _ in range(rng.randint(1, 4)))
    rows, spans, decoys = [], [], []
    for i in range(n):
        text, mine, bad = word(), [], []
        for _ in range(8):
            kind = rng.choice(["email", "phone beside ip", "iban", "card beside number", "decoy", "plain phone", "plain card", None])
            text += " " + word() + " "
            at = len(text)
            if kind == "email":
                s = f"{word()}.{word()} [at] {word()} [dot] com"
                mine.append(("email", at, at + len(s)))
            elif kind == "phone beside ip":
                p = f"+49 ({rng.randint(20, 99)}) {digits(3)}-{digits(4)}"
                s = p + f" {rng.randint(1, 200)}.{rng.randint(100, 250)}.{rng.randint(100, 250)}.{rng.randint(100, 250)}"
                mine.append(("phone", at, at + len(p)))
            elif kind == "iban":
                s = iban()
                mine.append(("iban", at, at + len(s)))
            elif kind == "card beside number":
                c = card()
                s = c + " " + digits(6)
                mine.append(("card", at, at + len(c)))
            elif kind == "decoy":
                s = rng.choice(["order 1234-5678-9012-3456", "version 1.2.3", f"DE00{digits(18)}", "no. 555-12-12", "0000 0000 0000 0001 22", f"id {digits(12)}"])
                bad.append((at, at + len(s)))
            elif kind == "plain phone":
                s = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
            elif kind == "plain card":
                s = card()
            else:
                s = word()
            text += s + rng.choice([".", ",", " and", ""])
        rows.append((i, text))
        spans.append(mine)
        decoys.append(bad)
    return rows, spans, decoys


def test_planted_spans_are_called(spark):
    rows, spans, decoys = planted(5, 400)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pd_.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    wanted = sum(len(s) for s in spans)
    assert sum(x in got[i] for i, s in enumerate(spans) for x in s) >= 0.95 * wanted
    assert all(set(pd_.base_spans(t)) <= set(got[i]) for i, t in rows)
    bad = sum(any(s < e2 and e > s2 for s2, e2 in decoys[i]) for i, t in rows for k, s, e in got[i] if (k, s, e) not in plain(t))
    assert bad <= 0.02 * wanted
    for i, t in rows:
        added = [x for x in got[i] if x not in plain(t)]
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in added for b in got[i] if a != b)


def test_odd_input(spark):
    schema = "doc_id long, text string, base string, candidates int"
    assert pd_.scan(spark.createDataFrame([], schema)).collect() == []
    long = "word " * 400_000 + "a@b.co " + "1 " * 100_000
    rows = [(None, "x@y.de", None, None), (3, None, "b", 1), (3, "", "b", 1), (4, "x@y.de +1 (017) 555-7713", None, 2), (4, "x@y.de +1 (017) 555-7713", None, 2), (5, long, None, 3)]
    got = pd_.scan(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in got) == sorted((str(r[0]), plain(r[1])) for r in rows)
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)


@pytest.mark.parametrize("kind,text,real", [("card", "4111 1111 1111 1111", 1), ("iban", "DE89370400440532013000", 1), ("iban", "DE88370400440532013000", -1), ("ssn", "666-12-1234", -1), ("ip", "300.1.1.1", -1)])
def test_checks(kind, text, real):
    assert pd_.check(kind, text, pd_.digits_of(text)) == real
