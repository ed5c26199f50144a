"""Fast whole-text tokenisation with the tokenizers library and a word vocabulary file.

The vocabulary drops white space, so a text's ids are the ids of its words in
turn. Each Arrow batch is split into words once, every distinct word is encoded
once, and the ids of the texts are gathered with numpy.
"""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of these letters and then these marks alone need no Unicode normalisation, and split after the letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
EACH_LETTER = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that one gather works on.
BATCH_BYTES = 8 << 20
#: Runs whose ids a task remembers between batches; later ones are encoded anew (results don't depend on it).
REMEMBERED = 500_000


def spans(sizes: np.ndarray) -> np.ndarray:
    ends = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    return ends


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces flat[first[i]:first[i]+sizes[i]] one after the other."""
    ends = spans(sizes)
    at = np.repeat((first - ends[:-1]).astype(np.int32), sizes)
    at += np.arange(ends[-1], dtype=np.int32)
    return flat[at]


class WordEncoder:
    """Encodes columns of texts. Marker strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # the same model for words that are already normalised and split
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.known_ids, self.known_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.plain.encode_batch_fast([" ".join(words[k : k + 512]) for k in range(0, len(words), 512)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, dtype=np.uint32) for e in got]) if got else np.zeros(0, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and first and size for each of the distinct unsplit runs (an empty run has none)."""
        place = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.and_(pc.is_null(place), pc.not_equal(words, "")))
        ids, sizes = self.encode_runs(fresh.to_pylist())
        flat, size = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes, [0]])
        first = spans(size)[:-1]
        at = np.asarray(pc.fill_null(place, -1), dtype=np.int64)
        new = np.flatnonzero((at < 0) & np.asarray(pc.not_equal(words, "")))
        at[new] = len(self.known) + np.arange(len(new))
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known, self.known_ids, self.known_sizes = pa.concat_arrays([self.known, fresh]), flat, size[:-1]
        return flat, first[at], size[at]  # at -1, the empty run

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and first and size for each of the words."""
        letters = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(letters, f"^[{LETTERS}]*$")
        odd = np.flatnonzero(~np.asarray(plain))
        if len(odd):
            letters = pc.if_else(plain, letters, "")
        marks = pc.utf8_ltrim(words, characters=EACH_LETTER)
        if len(odd):
            marks = pc.if_else(plain, marks, "")
        parts = []
        base = 0
        for column in (pc.utf8_lower(letters), marks):
            coded = column.dictionary_encode()
            ids, at, sizes = self.runs(coded.dictionary)
            codes = np.asarray(coded.indices)
            parts.append((ids, (at + base)[codes], sizes[codes]))
            base += len(ids)
        whole = [self.whole.encode(w, add_special_tokens=False).ids for w in words.take(pa.array(odd)).to_pylist()] if len(odd) else []
        n_odd = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        flat = np.concatenate([parts[0][0], parts[1][0], np.fromiter((i for w in whole for i in w), dtype=np.uint32, count=int(n_odd.sum()))])
        parts[0][1][odd], parts[0][2][odd] = spans(n_odd)[:-1] + base, n_odd
        first = np.column_stack([parts[0][1], parts[1][1]]).ravel()
        size = np.column_stack([parts[0][2], parts[1][2]]).ravel()
        sizes = parts[0][2] + parts[1][2]
        return gather(flat, first, size), spans(sizes)[:-1], sizes

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (uint32), and where each text's ids start, with the end (null: empty)."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(texts)
        starts = np.asarray(words.offsets, dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        flat, first, sizes = self.distinct(coded.dictionary)
        codes = np.asarray(coded.indices)
        n = sizes[codes]
        return gather(flat, first[codes], n), spans(n)[starts - starts[0]]


_CODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    if path not in _CODERS:
        _CODERS[path] = WordEncoder(path)
    return _CODERS[path]


def release() -> None:
    """Give memory that a finished task no longer uses back: a worker process stays for later tasks."""
    for coder in _CODERS.values():
        coder.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(table_batches, size: int = BATCH_BYTES, column: str = "text"):
    """The incoming rows in batches of about ``size`` bytes of a text column at most (one row at least): larger ones are cut, smaller ones joined."""
    held, total = [], 0

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in table_batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            more = int(lengths[a:b].sum())
            if held and total + more > size:
                yield whole()
                held, total = [], 0
            held.append(batch.slice(a, b - a))
            total += more
    if held:
        yield whole()
    held = None
    release()
