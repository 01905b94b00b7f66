"""Personal data in text: four fixed patterns, and other spans that weak labels and a classifier call.

Candidates are spans of wider patterns: telephone numbers with or without a country code, cards in groups,
dotted numbers, spelt-out mail addresses, account and social security numbers, and whatever the
fixed patterns find. Eight labelers vote on each (yes, no or nothing): the strict shape, a check sum or range, a gazetteer
(issuers, calling codes, top-level domains, account formats, reserved networks), words for and against in the text before, what
the span is glued to, digits that are too regular, and the fixed pattern. Nobody has labelled
anything, so expectation-maximisation estimates per kind how often it is real and how reliable each
labeler is, from the counts of vote patterns over all documents; those counts are bounded by the number of
patterns. The posteriors are soft labels for the final classifier, a logistic regression over votes, shape and
words around, fitted to a bounded sample of candidates. It calls candidates that overlap no fixed span.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import bounded_batches, materialize

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SUMS = ("card", "iban")  # kinds with a check sum
LABELERS = ("shape", "check", "gazetteer", "words for", "words against", "glued", "regular", "fixed pattern")

# The base patterns. Possessive, and begun where a run begins, so that no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", re.A)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++", re.A)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.A)
DIGIT = re.compile("[0-9]")
ISLAND = re.compile(r"[0-9](?:[ ().-]{0,3}[0-9])*+")

CANDIDATES = {
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}([ .-])[0-9]{2,4}(?:\1[0-9]{2,4}){0,2}(?![0-9])(?!\.[0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,4} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I | re.A),
}
#: What a text must hold to be searched for a kind.
GATES = {"iban": re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), "email": re.compile(r"[\[(]at[\])]", re.I)}

# Public numbering plans. Calling codes; first digits of card issuers; lengths of account numbers; domains.
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 852 853 855 886 961 962 963 964 965 966 968 971 972 973 974 977 992 993 994 995 996 998".split()
)
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "35", "6011", "64", "65", "62")
ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
DOMAINS = frozenset("com org net edu gov int info biz io dev app co uk de fr es it nl be at ch se no dk fi pl pt ie eu us ca au nz jp cn in br mx ru".split())
FOR = {
    "email": "mail email correo courriel contact write adresse",
    "ip": "ip host server address addr client from gateway login",
    "card": "card visa mastercard amex credit karte carte tarjeta debit pay",
    "phone": "phone tel call mobile telefon fax telephone cell llame rufen appelez whatsapp",
    "iban": "iban account konto compte cuenta bank",
    "ssn": "ssn social security",
}
FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
AGAINST = frozenset("version release isbn order invoice part serial build chapter section page table figure number no nr id ticket case doi model code".split())
WORD = re.compile(r"[^\W\d_]+")
BUCKETS, SHAPES = 24, 7
EXTRA = struct.Struct(f"<{SHAPES}f4B")
WIDTH = len(KINDS) + 2 * len(LABELERS) + SHAPES + BUCKETS


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Matches of the address pattern, found from their at signs."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    if not text:
        return []
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def check(kind: str, s: str, digits: str) -> int:
    """A check sum votes either way; a range that holds proves nothing, so it votes only no."""
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "ip":
        return 0 if all(len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in s.split(".")) else -1
    if kind == "phone":
        return 0 if 9 <= len(digits) <= 15 else -1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 0
    return 0 if 5 <= len(s) <= 254 and all(len(x) <= 63 for x in s.split(".")) else -1


def gazetteer(kind: str, s: str, digits: str) -> int:
    if kind == "card":
        return 1 if digits.startswith(ISSUERS) else -1
    if kind == "phone":
        return 0 if s[0] != "+" else 1 if any(digits[:k] in CALLING for k in (1, 2, 3)) else -1
    if kind == "email":
        return 1 if re.split(r"\W+", s.lower().rstrip("-"))[-1] in DOMAINS else 0
    if kind == "ip":
        return -1 if int(s.split(".")[0][-3:]) in (0, 127) or int(s.split(".")[0][-3:]) >= 224 else 0
    if kind == "iban":
        return 1 if ACCOUNTS.get(s[:2]) == len(s.replace(" ", "")) else -1
    return 0


def shape(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}( ?[\[(]at[\])] ?|@)[A-Za-z0-9].*[A-Za-z]", s, re.S | re.I) else -1
    m = CANDIDATES[kind].fullmatch(s)
    if kind == "phone":
        return 1 if m and (s[0] in "+(") else -1
    return 1 if m else -1


def regular(digits: str) -> int:
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:], strict=False)}
    return -1 if len(digits) > 5 and (len(steps) == 1 or len(set(digits)) <= 2) else 0


def votes_on(text: str, kind: str, start: int, end: int, fixed: bool) -> tuple[list[int], list[str]]:
    """(votes in the order of LABELERS, words before)."""
    s = text[start:end]
    digits = digits_of(s[:512])
    before = [w.lower() for w in WORD.findall(text[max(0, start - 60) : start])][-4:]
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_/=#$")) or (end < len(text) and (text[end].isalnum() or text[end] in "_@/"))
    if kind == "email" and len(s) > 512:
        s = s[-512:]
    votes = [
        shape(kind, s), check(kind, s, digits), gazetteer(kind, s, digits), int(any(w in FOR[kind] for w in before)), -int(any(w in AGAINST for w in before)),
        -int(glued), regular(digits) if kind != "email" else 0, int(fixed),
    ]
    return votes, before


def packed(votes: list[int]) -> int:
    """Votes as one number, three digits to a labeler."""
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def unpacked(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1


def extra_of(s: str, before: list[str]) -> bytes:
    """Shape of a span and buckets of the words before it, in a few bytes."""
    n = min(len(s), 512)
    s = s[:512]
    x = [len(digits_of(s)) / 20, n / 40, sum(c in " -" for c in s) / 5, sum(c == "." for c in s) / 4, float("(" in s), float("+" in s), sum(c.isalpha() for c in s) / max(1, n)]
    buckets = [zlib.crc32(w.encode()) % BUCKETS for w in before]
    return EXTRA.pack(*x, *buckets, *[255] * (4 - len(buckets)))


def features(kinds: np.ndarray, codes: np.ndarray, extras: list[bytes]) -> np.ndarray:
    """A row of numbers per candidate: kind, votes, shape, words before."""
    n = len(extras)
    raw = np.frombuffer(b"".join(extras), dtype=[("shape", "<f4", SHAPES), ("words", "u1", 4)])
    votes = unpacked(codes)
    words = np.zeros((n, 256))
    for k in range(4):
        words[np.arange(n), raw["words"][:, k]] = 1.0
    return np.hstack([np.arange(len(KINDS)) == kinds[:, None], votes > 0, votes < 0, raw["shape"], words[:, :BUCKETS]]).astype(float)


def candidates(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, bytes]]:
    """(kind, start, end, packed votes, shape and words) of the fixed spans and of all matches of the wider patterns."""
    if not text:
        return []
    known = set(base)
    spans = dict.fromkeys(base)
    if GATES["email"].search(text):
        spans |= dict.fromkeys(("email", *m.span()) for m in CANDIDATES["email"].finditer(text))
    if DIGIT.search(text):
        if GATES["iban"].search(text):
            spans |= dict.fromkeys(("iban", *m.span()) for m in CANDIDATES["iban"].finditer(text))
        for island in ISLAND.finditer(text):
            lo, hi = island.span()
            if hi - lo >= 7:  # the shortest dotted number
                for kind in ("phone", "card", "ip", "ssn"):
                    spans |= dict.fromkeys((kind, *m.span()) for m in CANDIDATES[kind].finditer(text, max(0, lo - 4), min(len(text), hi + 2)))
    out = []
    for kind, start, end in spans:
        votes, before = votes_on(text, kind, start, end, (kind, start, end) in known)
        out.append((kind, start, end, packed(votes), extra_of(text[start:end], before)))
    return out


FOUND = (
    "doc_id long, base array<struct<kind: string, start: int, end: int>>, "
    "candidates array<struct<kind: string, start: int, end: int, votes: int, extra: binary>>"
)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, base, candidates: one row per row, without texts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
        more = [*span, ("votes", pa.int32()), ("extra", pa.binary())]

        def lists(rows, fields):
            flat = [x for r in rows for x in r]
            columns = zip(*flat, strict=True) if flat else [()] * len(fields)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            alls = [candidates(t, b) for t, b in zip(texts, bases, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(bases, span), lists(alls, more)], ["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


@dataclass
class LabelModel:
    """How often a kind is real, and the chance of each vote (no, nothing, yes) of each labeler that votes, if it is and if it isn't.

    No vote says nothing: its chance counts as 1 both ways.
    """

    prior: float
    chances: np.ndarray  # real or not, labeler, vote + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.stack([np.log(self.chances[y, np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for y in (0, 1)])
        logs += np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def estimate(votes: np.ndarray, counts: np.ndarray, check_sum: bool = False, weight: float = 4.0, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts.

    Starts at the majority of votes. ``weight`` rows of belief say that a labeler that votes is rather right, which
    tells the two classes apart and holds where there are few candidates. A ``check_sum`` isn't estimated:
    what fails it isn't real.
    """
    n = votes.shape[1] if votes.size else len(LABELERS)
    belief = np.array([[0.7, 1.0, 0.3], [0.3, 1.0, 0.7]])[:, None, :].repeat(n, axis=1)
    known = np.array([[0.9, 1.0, 0.1], [0.0001, 1.0, 0.9999]])
    at = LABELERS.index("check")
    if check_sum:
        belief[:, at] = known
    if not len(counts):
        return LabelModel(0.5, belief)
    real = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    model = LabelModel(0.5, belief)
    for _ in range(rounds):
        chances = belief * weight
        for y, share in ((0, counts * (1 - real)), (1, counts * real)):
            for v in (-1, 1):
                chances[y, :, v + 1] += ((votes == v) * share[:, None]).sum(axis=0)
        chances[:, :, [0, 2]] /= chances[:, :, [0, 2]].sum(axis=2, keepdims=True)
        chances[:, :, 1] = 1.0
        if check_sum:
            chances[:, at] = known
        model = LabelModel(float((counts @ real + 1) / (counts.sum() + 2)), chances)
        after = model.posterior(votes)
        if np.abs(after - real).max() < 1e-9:
            break
        real = after
    return model


def label_models(found: DataFrame) -> dict[str, LabelModel]:
    """A model per kind from all candidates of ``found``: only counts of distinct vote patterns (at most 3 ** 8 a kind) reach the driver."""
    each = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    rows: dict[str, list] = {k: [] for k in KINDS}
    for r in each.collect():
        rows[r["kind"]].append((r["votes"], r["n"]))
    return {k: estimate(unpacked(np.array([v for v, _ in sorted(x)], dtype=np.int64)), np.array([n for _, n in sorted(x)], dtype=float), k in SUMS) for k, x in rows.items()}


@dataclass
class SpanClassifier:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> SpanClassifier:
    """Logistic regression to soft labels by Newton steps."""
    d = x.shape[1]
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(d + 1)
    penalty = np.diag([ridge] * d + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return SpanClassifier(w[:-1], float(w[-1]))


def train(found: DataFrame, sample: int = 4000) -> SpanClassifier:
    """Classifier fitted to the ``sample`` candidates of each kind with the smallest hashes of place and document, with the label models' posteriors."""
    models = label_models(found)
    flat = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    flat = flat.withColumn("_h", F.xxhash64("doc_id", "kind", "start", "end", F.lit(17)))
    xs, ys = [], []
    for i, kind in enumerate(KINDS):
        rows = flat.where(F.col("kind") == kind).orderBy("_h", "start", "end").limit(sample).select("votes", "extra").collect()
        if rows:
            codes = np.array([r["votes"] for r in rows], dtype=np.int64)
            xs.append(features(np.full(len(rows), i), codes, [bytes(r["extra"]) for r in rows]))
            ys.append(models[kind].posterior(unpacked(codes)))
    if not xs:
        return SpanClassifier(np.zeros(WIDTH), -10.0)
    return fit(np.vstack(xs), np.concatenate(ys))


def call(base: list[tuple[str, int, int]], cands: list[tuple[str, int, int, float]], least: float) -> list[tuple[str, int, int]]:
    """Fixed spans and the candidates that score ``least`` or more, best first, apart from each other and from fixed ones; by kind, then start."""
    starts, ends, added = [], [], []

    def free(s, e):  # taken spans may overlap only if they are fixed: those are merged first
        i = bisect.bisect_right(starts, s)
        return (i == 0 or ends[i - 1] <= s) and (i == len(starts) or starts[i] >= e)

    for _, s, e in sorted(base, key=lambda b: b[1:]):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, s, e, p in sorted(cands, key=lambda c: (-c[3], c[1], c[2], c[0])):
        if p >= least and free(s, e):
            i = bisect.bisect_right(starts, s)
            starts.insert(i, s)
            ends.insert(i, e)
            added.append((kind, s, e))
    return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


SCANNED = "doc_id long, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame, least: float = 0.9, sample: int = 4000) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, base, spans (base and called): kind, start, end in code points, end exclusive.

    Spans are by kind in the order of KINDS, then start. Every row gets a row, repeated and null doc_ids too; a null or empty
    text has no spans. Other columns are ignored. An empty table gives none.
    """
    found = materialize(find(docs), "candidates")
    model = train(found, sample)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            flat = batch.column(2).flatten()
            of = [flat.field(i).to_pylist() for i in range(5)]
            scores = model.score(features(np.array([KINDS.index(k) for k in of[0]]), np.array(of[3], dtype=np.int64), of[4])) if len(flat) else []
            spans, at = [], 0
            for base, n in zip(batch.column(1).to_pylist(), batch.column(2).value_lengths().to_pylist(), strict=True):
                fixed = [(b["kind"], b["start"], b["end"]) for b in base]
                known = set(fixed)
                others = [c for c in zip(of[0][at : at + n], of[1][at : at + n], of[2][at : at + n], scores[at : at + n], strict=True) if c[:3] not in known]
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in call(fixed, others, least)])
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return found.mapInArrow(run, SCANNED)
