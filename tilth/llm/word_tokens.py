"""Ids of whole texts by the ``tokenizers`` library, fast on repetitive text.

The vocabulary splits a lower-cased text into pre-tokens, and a text's ids are the ids of its
pre-tokens, one after another. A block of texts is split, and its distinct pre-tokens found, by Arrow;
ids of new ones come from the library, each worker keeps a bounded number, and numpy puts the
texts together. Texts for which that argument needs care go through the library as they are.
"""

from __future__ import annotations

#: Most pre-tokens that a worker keeps (about 150 bytes each). New ones past it are encoded anew in each block.
KEEP_WORDS = 350_000
#: The vocabulary's own split, a fixed value of its file, is: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
#: What of it isn't a run of letters, with white space spelled out to the end of Latin-1.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \x{85}\x{A0}\p{L}\p{N}]+)"
#: White space to Arrow and Python but not to the vocabulary.
CONTROLS = "\x1c\x1d\x1e\x1f"

_encoders: dict[str, "WordEncoder"] = {}


def wide(text: str) -> bool:
    """Whether a text has characters beyond Latin-1, of which lower case and normal forms may need context."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def needs_care(text: str) -> bool:
    """The vocabulary's special tokens begin with "<|"."""
    return "<|" in text or wide(text) or any(c in text for c in CONTROLS)


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}

    def library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: many in one call, told apart by the ids that end a word."""
        import numpy as np

        found: dict[str, bytes] = {}
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and (not len(ids) or stops[-1] == len(ids)):
                raw, begin = ids.tobytes(), 0
                for word, stop in zip(some, (stops * 4).tolist(), strict=True):
                    found[word] = raw[begin:stop]
                    begin = stop
            else:
                found.update(zip(some, self.library(some), strict=True))
        return found

    def _ids_of(self, words: list[str], resolve) -> list[bytes]:
        """Ids of distinct words; new ones by ``resolve``, and kept while there is room."""
        known = self.words
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if new:
            extra = resolve([words[i] for i in new])
            for i in new:
                out[i] = extra[words[i]]
            if room := max(0, KEEP_WORDS - len(known)):
                known.update(list(extra.items())[:room])
        return out

    def _together(self, lists, resolve) -> list[bytes]:
        """Ids of each list of words."""
        import numpy as np

        coded = lists.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist(), resolve)
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        sizes = lengths[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[index] - ends[:-1], sizes)
        at += np.arange(ends[-1])
        out = flat[at]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = ends[offsets].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Lower-cased texts that need no care."""
        import pyarrow as pa
        import pyarrow.compute as pc

        return self._together(pc.utf8_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.string()), APART, r" \1 ")), self._new_words)

    def _careful(self, texts: list[str]) -> list[bytes]:
        """Texts without control characters by white-space chunks, which no pre-token crosses; chunks that need care by the library."""
        import pyarrow as pa

        def resolve(chunks: list[str]) -> dict[str, bytes]:
            odd = [c for c in chunks if needs_care(c)]
            even = [c for c in chunks if not needs_care(c)]
            found = dict(zip(odd, self.library(odd), strict=True))
            return found | dict(zip(even, self._plain([c.lower() for c in even]), strict=True))

        return self._together(pa.array([t.split() for t in texts], pa.list_(pa.string())), resolve)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, careful, whole = [], [], []
        for i, text in enumerate(texts):
            if text:
                (plain if not needs_care(text) else whole if any(c in text for c in CONTROLS) else careful).append(i)
        for some, by in ((plain, lambda t: self._plain([x.lower() for x in t])), (careful, self._careful), (whole, self.library)):
            if some:
                for i, ids in zip(some, by([texts[i] for i in some]), strict=True):
                    out[i] = ids
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_blocks(texts: list[str | None], most_chars: int = 2_000_000):
    """Cut a batch into runs of about ``most_chars`` characters, so that long texts don't pile up."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
