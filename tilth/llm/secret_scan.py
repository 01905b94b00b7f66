"""Secrets in text: three fixed patterns, and other strings that pass for random.

A long run of key characters, less what the fixed patterns take of it, is cut at equals signs that are
not padding, and each value of some length is a candidate, as are its parts between separators where
the whole doesn't pass. Its encoding (the smallest
alphabet that holds it) is inferred, and three tests ask whether it looks drawn uniformly from it:
chi-squared over groups of symbols, runs above and below the middle, and lag-one correlation. Against
"this is ordinary text" stands an e-value, the likelihood under the uniform alphabet over that under
a model of words and numbers that rarely switches between kinds of characters; its inverse is a
p-value. Candidates of a text are called by Benjamini and Hochberg's step-up rule within classes of
length, so that the many short strings don't spend what the few long ones need.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import bounded_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SPACE = re.compile(r"\S{20,}")
LEAST = 20
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")  # what stands between equals signs; those at the end are padding
SEPARATORS = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+"))

ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("upper hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64 url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
#: Relative frequencies of letters in running text of western European languages, per mille.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (80, 15, 32, 42, 140, 15, 18, 35, 75, 3, 6, 45, 28, 75, 65, 25, 5, 68, 72, 72, 35, 12, 14, 3, 12, 5), strict=True))
STAY, SWITCH = math.log(0.93), math.log(0.07 / 3)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def upper_tail(chi2: float, df: int) -> float:
    """P(chi-squared > chi2), by the cube-root normal approximation."""
    if df < 1:
        return 1.0
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def looks_uniform(symbols: np.ndarray, size: int) -> float:
    """Bonferroni-combined p-value of the three tests that ``symbols`` are uniform on 0..size-1."""
    n = len(symbols)
    groups = max(2, min(size, n // 5))
    at = symbols * groups // size
    expected = n * np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    chi2 = upper_tail(float(((np.bincount(at, minlength=groups) - expected) ** 2 / expected).sum()), groups - 1)
    high = symbols * 2 >= size
    ups = int(high.sum())
    downs = n - ups
    runs_p = 0.0
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        runs_p = math.erfc(abs(runs - mean) / math.sqrt(2 * max(var, 1e-9)))
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    serial_p = math.erfc(abs(float((centred[1:] * centred[:-1]).sum()) / power) * math.sqrt(n) / math.sqrt(2)) if power else 0.0
    return min(1.0, 3 * min(chi2, runs_p, serial_p))


def text_likelihood(token: str) -> float:
    """Log likelihood of a token as words, numbers and joiners."""
    total, before = 0.0, ""
    for c in token:
        kind = "d" if "0" <= c <= "9" else "l" if c.islower() else "u" if c.isupper() else "s"
        total += (STAY if kind == before else SWITCH) if before else math.log(0.25)
        total += math.log(0.1) if kind == "d" else math.log(0.25) if kind == "s" else math.log(LETTERS[c.lower()] / 997)
        before = kind
    return total


def judge(token: str) -> tuple[float, str]:
    """(p-value against ordinary text, encoding); 1.0 where the randomness tests already say no."""
    body = token.rstrip("=")
    chars = set(body)
    for name, alphabet in ALPHABETS:
        if chars <= set(alphabet):
            break
    else:
        return 1.0, "none"
    if name == "decimal" or len(body) < 20 or (body.isalpha() and (body.islower() or body.isupper() or body.istitle())):
        return 1.0, name
    index = {c: i for i, c in enumerate(alphabet)}
    if looks_uniform(np.array([index[c] for c in body]), len(alphabet)) < 0.01:
        return 1.0, name
    return min(1.0, math.exp(min(0.0, text_likelihood(body) + len(body) * math.log(len(alphabet))))), name


def left_over(start: int, end: int, taken: list[tuple[int, int]], i: int) -> list[tuple[int, int]]:
    """What ``taken``, by start, from its place ``i`` on leaves of a range."""
    found = []
    while i < len(taken) and taken[i][0] < end:
        s, e = taken[i]
        if e > start:
            found.append((start, s))
            start = e
        i += 1
    return [(s, e) for s, e in [*found, (start, end)] if e - s >= LEAST]


def judged_parts(token: str) -> list[tuple[float, int, int]]:
    """(p-value, start, end) of the parts of a token that are judged, apart from each other.

    The token as a whole if it passes; otherwise its parts between separators of either base-64
    alphabet or both, the least p-values first, times the number of parts tried.
    """
    p, _ = judge(token)
    if p < 1.0:
        return [(p, 0, len(token))]
    parts = {m.span() for x in SEPARATORS for m in x.finditer(token) if m.end() - m.start() >= LEAST} - {(0, len(token))}
    found: list[tuple[float, int, int]] = []
    for p, s, e in sorted((min(1.0, judge(token[s:e])[0] * (len(parts) + 1)), s, e) for s, e in parts):
        if all(e <= s2 or s >= e2 for _, s2, e2 in found):
            found.append((p, s, e))
    return found or [(1.0, 0, len(token))]


def random_spans(text: str, taken: list[tuple[int, int, str]], rate: float) -> list[tuple[int, int, str]]:
    """Parts of candidates outside ``taken`` that the step-up rule calls at false discovery rate ``rate``."""
    if not SPACE.search(text):
        return []
    starts = sorted((s, e) for s, e, _ in taken)
    judged: dict[int, list[tuple[float, int, int]]] = {}
    i = 0
    for m in CANDIDATE.finditer(text):
        while i < len(starts) and starts[i][1] <= m.start():
            i += 1
        for start, end in left_over(m.start(), m.end(), starts, i):
            for v in VALUE.finditer(text[start:end]):
                if v.end() - v.start() >= LEAST:
                    for p, s, e in judged_parts(v.group()):
                        judged.setdefault((e - s).bit_length(), []).append((p, start + v.start() + s, start + v.start() + e))
    found = []
    for tests in judged.values():
        tests.sort()
        last = max((k for k, (p, _, _) in enumerate(tests, 1) if p <= rate * k / len(tests) / len(judged)), default=0)
        found += [(s, e, "random") for _, s, e in tests[:last]]
    return found


def spans_of(text: str | None, rate: float = 1e-4) -> list[tuple[int, int, str]]:
    """All spans of a text (null: none) by start, then kind in the order of KINDS."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + random_spans(text, base, rate), key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame, rate: float = 1e-4) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, spans: kind, start, end in code points, end exclusive.

    A null or empty text has no spans. Every row gets a row, repeated and null doc_ids too; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t, rate)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 1e-4) -> DataFrame:
    """``docs`` with every span of its text (overlapping ones as one) replaced by ``mark``; n_chars, if there, follows."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = spans_of(text, rate)
        if not spans:
            return text
        out, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    cleaned = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned
