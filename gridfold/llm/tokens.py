"""Token ids of whole texts by a vocabulary file of the tokenizers library.

Words between white space are encoded once and looked up afterwards. That is exact for a tokenizer whose normalisation
and splitting never look across ASCII white space, which the word vocabulary's file declares. The file's declaration is read
when it is loaded: texts are encoded whole where it differs from the one known here (KNOWN).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridfold.llm._common import Words, slices

#: Words that a process keeps at most before it starts anew: about 150 MB.
KEPT = 700_000

#: The normaliser and splitter of a file whose words may be encoded alone.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

#: What the file's splitting rule makes of printable ASCII without apostrophes, once it is in lower case.
_ASCII_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII = re.compile(r"[!-&(-~]+")
#: Letters that are whole characters in either case (the dotted capital I is not).
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class TextEncoder:
    """Encodes texts; one per process and file (see encoder())."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        declared = json.loads(self.tokenizer.to_str())
        self.by_words = all(declared.get(k) == v for k, v in KNOWN.items())
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def word(self, word: str) -> list[int]:
        """Ids of a word without white space. Plain words skip the library's normaliser, which would leave them as they are."""
        tokenize = self.model.tokenize
        if word.isascii():
            if word.isalpha():
                return [t.id for t in tokenize(word.lower())]
            if _ASCII.fullmatch(word) and "<|" not in word:
                return [t.id for p in _ASCII_PIECES.findall(word.lower()) for t in tokenize(p)]
        else:
            end = word[-1] in ".,;:!?" and word[-2:-1].isalpha()
            core = word[:-1] if end else word
            if _LATIN.fullmatch(core):
                low = "".join(map(self.letters.__getitem__, core.lower().encode()))
                return [t.id for p in ((low, word[-1]) if end else (low,)) for t in tokenize(p)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> np.ndarray:
        """Each word's row in the table of ids."""
        if len(self.rows) > KEPT:
            self.forget()
        rows = self.rows
        out = [rows.get(w, -1) for w in words]
        new = [k for k, r in enumerate(out) if r < 0]
        if new:
            first, flat, lengths, word = len(rows), [], [], self.word
            for k in new:
                ids = word(words[k])
                flat += ids
                lengths.append(len(ids))
            own = range(first, first + len(new))
            rows.update(zip([words[k] for k in new], own, strict=True))
            for k, r in zip(new, own, strict=True):
                out[k] = r
            lengths = np.array(lengths, np.int32)
            self.starts = _put(self.starts, first, self.used + np.cumsum(lengths) - lengths)
            self.lengths = _put(self.lengths, first, lengths)
            self.ids = _put(self.ids, self.used, np.array(flat, np.uint32))
            self.used += len(flat)
        return np.array(out, np.int32)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends. end_id, if given, ends each text."""
        if not self.by_words:
            end = [] if end_id is None else [end_id]
            each = [[*e.ids, *end] for e in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each], dtype=np.int64)
        words = Words(plainer(texts))
        rows = self.learn(words.vocabulary.to_numpy(zero_copy_only=False).tolist())[words.codes]
        starts, lengths = self.starts[rows], self.lengths[rows]
        ends = np.cumsum(words.counts)
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.repeat((starts - before[:-1]).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.ids[at]
        ends = before[ends]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


def plainer(texts: pa.Array) -> pa.Array:
    """The same ids from fewer distinct words: lower case, and a full stop or comma that ends a word stands alone.

    The tokenizer lowers case itself and splits at these places. Left alone: texts with a special token's beginning (those
    are found before case is lowered) or with combining marks (a letter may compose with them in one case only).
    """
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{036F}]"))
    if not pc.all(plain).as_py():
        return pc.if_else(plain, _plainer(texts), texts)
    return _plainer(texts)


def _plainer(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])([\x20\x09-\x0D])", r"\1 \2\3")


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Values written at a place of an array that grows by doubling."""
    while at + len(values) > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    array[at : at + len(values)] = values
    return array


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For bounded ranges of texts: the first row, ids, and each text's end in them."""
    own = encoder(path)
    for lo, hi in slices(texts, 6 << 20):
        yield lo, *own.encode(texts.slice(lo, hi - lo), end_id)
