"""Language identification by interpolated Kneser-Ney character models.

A text is its lower-cased letters with every run of other characters as one space, after three
boundary marks. Each language has a model of order four with absolute discounts per order; all
models live in shared sorted arrays of hashed n-grams, one row of log probabilities per n-gram, so a
position costs one binary search in most cases. The language with the lowest cross-entropy per
character wins. A text is rejected when that cross-entropy is too high for its length, by limits
calibrated on labelled texts that the counts didn't see.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import bounded_batches
from tilth.llm.word_tokens import text_blocks

ORDER = 4
MARK, SPACE, OTHER = 1, 32, 0xFFFF
UNKNOWN = "und"
#: Characters of a text that are looked up at a time.
BLOCK = 1 << 19

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def code_blocks(text: str | None):
    """16-bit symbols of a text, about ``BLOCK`` characters at a time, each block after the last symbols before it, at first the marks.

    Blocks end behind a character that isn't a letter, unless a word is as long as a block.
    """
    text, before, after_letter, at = text or "", np.full(ORDER - 1, MARK, np.uint16), False, 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and end < at + 2 * BLOCK and text[end - 1].isalpha():
            end += 1
        raw = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = letters()[raw]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= after_letter
        found = np.concatenate([before, np.where(is_letter, np.minimum(raw, OTHER), SPACE).astype(np.uint16)[keep]])
        yield found
        before, after_letter, at = found[len(found) - (ORDER - 1) :], bool(is_letter[-1]), end


def codes_of(text: str | None) -> np.ndarray | None:
    """16-bit symbols of a whole text with its marks; None if it has no letter."""
    blocks = list(code_blocks(text))
    codes = np.concatenate([*blocks[:1], *[b[ORDER - 1 :] for b in blocks[1:]]]) if blocks else np.zeros(0, np.uint16)
    return codes if len(codes) > ORDER - 1 else None


def scramble(keys: np.ndarray) -> np.ndarray:
    """One-to-one hash of packed n-grams."""
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """The n-gram of length k that ends at each position from the first after the marks, packed by 16 bits a symbol."""
    n = len(codes) - (ORDER - 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        at = ORDER - k + j
        out = (out << np.uint64(16)) | codes[at : at + n].astype(np.uint64)
    return out


class KneserNey:
    """Built from highest-order counts per language; lower orders are continuation counts of those."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        levels = []  # per language: {k: (grams sorted, counts)}
        for lang in self.languages:
            keys, n = counts[lang]
            by = {ORDER: (keys, n.astype(np.float64))}
            for k in range(ORDER - 1, 0, -1):
                shorter, times = np.unique(by[k + 1][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
                by[k] = (shorter, times.astype(np.float64))
            levels.append(by)
        width = len(self.languages)
        symbols = len(set().union(*[by[1][0].tolist() for by in levels])) + 1 if levels else 1
        self.keys: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.context_keys: dict[int, np.ndarray] = {}
        self.backoffs: dict[int, np.ndarray] = {}
        self.floor = np.full(width, -np.log(symbols))
        for k in range(1, ORDER + 1):
            every = np.unique(np.concatenate([by[k][0] for by in levels])) if levels else np.zeros(0, np.uint64)
            contexts = np.unique(every >> np.uint64(16))
            prob, back = np.zeros((len(every), width)), np.ones((len(contexts), width))
            for l, by in enumerate(levels):
                keys, n = by[k]
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                ctx, first = np.unique(keys >> np.uint64(16), return_index=True)
                total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
                place = np.searchsorted(contexts, ctx)
                back[place, l] = discount * kinds / total
                prob[np.searchsorted(every, keys), l] = np.maximum(n - discount, 0) / total[np.searchsorted(ctx, keys >> np.uint64(16))]
            lower = np.exp(self._lookup(every & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)) if k > 1 else np.exp(self.floor)
            prob += back[np.searchsorted(contexts, every >> np.uint64(16))] * lower
            for keys, values, at, store in ((every, np.log(np.maximum(prob, 1e-12)), self.keys, self.logs), (contexts, np.log(back), self.context_keys, self.backoffs)):
                hashed = scramble(keys)
                order = np.argsort(hashed)
                at[k], store[k] = hashed[order], values[order].astype(np.float32)

    def _lookup(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probability, per language, of the last symbol of each n-gram of length k given the others."""
        if k == 0:
            return np.tile(self.floor, (len(keys), 1))
        hashed = scramble(keys)
        at = np.minimum(np.searchsorted(self.keys[k], hashed), len(self.keys[k]) - 1)
        out = self.logs[k][at].astype(np.float64)
        miss = np.flatnonzero(self.keys[k][at] != hashed)
        if len(miss):
            rest = self._lookup(keys[miss] & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
            ctx = scramble(keys[miss] >> np.uint64(16))
            c = np.minimum(np.searchsorted(self.context_keys[k], ctx), len(self.context_keys[k]) - 1)
            out[miss] = rest + np.where((self.context_keys[k][c] == ctx)[:, None], self.backoffs[k][c], 0.0)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each text and language, and each text's number of characters (0: no letter)."""
        long = {i for i, t in enumerate(texts) if t and len(t) > BLOCK}
        coded = [None if i in long else codes_of(t) for i, t in enumerate(texts)]
        sizes = np.array([0 if c is None else len(c) - (ORDER - 1) for c in coded], dtype=np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full) and self.languages:
            logs = self._lookup(np.concatenate([grams(coded[i], ORDER) for i in full]), ORDER)
            sums = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
            out[full] = -sums / sizes[full, None]
        for i in sorted(long):
            total = np.zeros(len(self.languages))
            for block in code_blocks(texts[i]):
                sizes[i] += len(block) - (ORDER - 1)
                if len(block) >= ORDER and self.languages:
                    total -= self._lookup(grams(block, ORDER), ORDER).sum(axis=0)
            out[i] = total / max(1, sizes[i])
        return out, sizes


class LanguageModel:
    """Models plus, per language, the limits of what counts as that language."""

    def __init__(self, models: KneserNey, mean: np.ndarray, spread: np.ndarray, most: float, sharpness: float):
        self.models, self.mean, self.spread, self.most, self.sharpness = models, mean, spread, most, sharpness

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score 0..1, accepted) of each text."""
        found, sizes = self.models.cross_entropies(texts)
        langs = self.models.languages
        if not langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = found.argmin(axis=1)
        low = found[np.arange(len(texts)), best]
        weight = np.exp(-(found - low[:, None]) * self.sharpness)
        score = np.where(sizes > 0, 1 / weight.sum(axis=1), 0.0)
        excess = (low - self.mean[best]) / self.spread[best] * np.sqrt(np.minimum(sizes, 400) / 400)
        accepted = (sizes > 0) & (excess <= self.most)
        return [langs[i] if n else UNKNOWN for i, n in zip(best, sizes, strict=True)], score, accepted


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that models may learn from: a remainder of crc32(doc_id) that isn't held out."""
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 5) != 0)


def train(docs: DataFrame, docs_per_lang: int = 1200, margin: float = 2.0) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang, ...): rows with a text and a lang, not held out.

    A pseudo-random ``docs_per_lang`` texts of each language, or all it has, are read whole, a fifth
    of them for the limits. Rows with a null text or lang teach nothing; no rows, no languages.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = learning_rows(docs.select("doc_id", "text", "lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_lang / n))]) if sizes else None
    if share is None:
        return LanguageModel(KneserNey({}), np.zeros(0), np.ones(0), 0.0, 1.0)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(dice < share[F.col("lang")]).withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0)

    def count(frames):
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                found, held = [], 0
                for block in chain((b for t in texts for b in code_blocks(t)), [None]):
                    if block is not None and len(block) >= ORDER:
                        found.append(grams(block, ORDER))
                        held += len(block)
                    if found and (block is None or held > 4 * BLOCK):
                        keys, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})
                        found, held = [], 0

    counted = sample.where(~F.col("check")).select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    tables = {}
    for lang, part in counted.groupby("lang"):
        keys, n = part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy()
        order = np.argsort(keys)
        tables[lang] = keys[order], n[order]
    models = KneserNey(tables)
    if not tables:
        return LanguageModel(models, np.zeros(0), np.ones(0), 0.0, 1.0)
    shared = spark.sparkContext.broadcast(models)

    def measure(frames):
        for frame in frames:
            found, sizes = shared.value.cross_entropies(frame["text"].tolist())
            yield pd.DataFrame({"lang": frame["lang"], "size": sizes, "found": list(found)})

    seen = sample.where("check").select("lang", "text").mapInPandas(measure, "lang string, size long, found array<double>").toPandas()
    seen = seen[(seen["size"] > 0) & seen["lang"].isin(models.languages)]
    mean, spread = np.zeros(len(models.languages)), np.ones(len(models.languages))
    worst = [0.0]
    for i, lang in enumerate(models.languages):
        part = seen[seen["lang"] == lang]
        if len(part) >= 2:
            own, size = np.array([f[i] for f in part["found"]]), np.minimum(part["size"].to_numpy(), 400)
            mean[i], spread[i] = np.median(own), max(1e-3, np.median(np.abs(own - np.median(own))) * 1.4826)
            worst.append(float(np.quantile((own - mean[i]) / spread[i] * np.sqrt(size / 400), 0.999)))
        else:
            spread[i] = np.inf  # too few texts for a limit
    return LanguageModel(models, mean, spread, margin * max(4.0, *worst), 25.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, lang_pred, score, accepted, over whole texts.

    A null text and a text without a letter are 'und' with score 0 and not accepted. Every row gets a row, repeated and null doc_ids too.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_blocks(texts, 400_000):
                lang, score, accepted = shared.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs`` whose text the model accepts as one of its languages, all columns as they were."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [shared.value.predict(texts[a:b])[2] for a, b in text_blocks(texts, 400_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
