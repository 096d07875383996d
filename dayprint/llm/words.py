"""Texts as token ids, through a word cache in each Python worker.

For tokenizers that drop white space and lower-case words (BPE with word ends): no token spans white space and
Unicode normalisation never acts across it, so the ids of a text are those of its words in order. Each distinct word
goes through the tokenizers library about once per worker, cut where the tokenizer cuts; `probe` checks at loading that both ways agree.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of words that a worker remembers; when full, the older half is forgotten (about 0.2 KB each).
CACHE_PIECES = 700_000
#: Text bytes handled at once.
CHUNK_BYTES = 12 << 20

#: Marks that a plain word may end with.
MARKS = ",.;:!?"
PROBE = "It's  1st, they'RE Étude é ẖ H̱ x\u0085y a b <|endoftext|> café!! _a-b_ \x1c ΣΣ don'T''s"
#: How the vocabulary's pre-tokenizer cuts an ASCII word in lower case.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _pieces(word: bytes) -> tuple[bytes, ...] | list[bytes] | None:
    """The word's parts that the tokenizer codes apart, or None where only the library can tell."""
    if word.isalpha():
        return (word.lower(),)
    core = word.rstrip(b",.;:!?")
    if core.isalpha():
        return core.lower(), word[len(core) :]
    if word.isascii():
        # Special tokens are found in the raw text, so words that may hold one go to the library whole.
        return PIECES.findall(word.lower()) if b"<|" not in word else None
    # Letters of any script stay one piece when normalised.
    if core.decode().isalpha():
        return (core, word[len(core) :]) if len(core) < len(word) else (core,)
    return None


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # ASCII pieces in lower case are normal already, which spares their normalisation
        self.normal = Tokenizer.from_file(path)
        self.normal.normalizer = None
        size = self.library.get_vocab_size()
        self.ends_word = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: list[dict[bytes, bytes]] = [{}, {}]
        want = self.library.encode(PROBE, add_special_tokens=False).ids
        got, _ = self.encode(pa.array([PROBE]))
        if got.tolist() != want:
            raise ValueError("this vocabulary does not split at white space as expected")

    def _library_ids(self, words: list[bytes]) -> list[bytes]:
        coded = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in coded]

    def _piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Many pieces in one call; every piece ends with a token that carries the word end."""
        plain = list(map(bytes.isascii, pieces))
        if not all(plain):
            parts = [self._piece_ids([p for p, a in zip(pieces, plain) if a]) if any(plain) else [], None]
            other = [p for p, a in zip(pieces, plain) if not a]
            parts[1] = self._joined_ids(self.library, other)
            ascii_ids, other_ids = map(iter, parts)
            return [next(ascii_ids) if a else next(other_ids) for a in plain]
        return self._joined_ids(self.normal, pieces)

    def _joined_ids(self, coder, pieces: list[bytes]) -> list[bytes]:
        ids = np.array(coder.encode_batch_fast([b" ".join(pieces).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) << 2
        if len(ends) != len(pieces):
            return self._library_ids(pieces)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _remembered(self, keys: list[bytes], make) -> list[bytes]:
        young, old = self.known
        values = list(map(young.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = {}
            for i in missing:
                v = values[i] = old.get(keys[i])
                if v is not None:
                    new[keys[i]] = v
            missing = [i for i in missing if values[i] is None]
            for i, v in zip(missing, make([keys[i] for i in missing]) if missing else ()):
                values[i] = new[keys[i]] = v
            young.update(new)
            if len(young) > CACHE_PIECES // 2:
                self.known = [{}, young]
        return values

    def _words(self, words: list[bytes]) -> list[bytes]:
        cut = list(map(_pieces, words))
        pieces = list({p for x in cut if x for p in x})
        ids = dict(zip(pieces, self._remembered(pieces, self._piece_ids)))
        whole = iter(self._remembered([w for w, x in zip(words, cut) if x is None], self._library_ids))
        return [next(whole) if x is None else ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x)) for x in cut]

    def _pool(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has.

        ASCII letters with at most one mark behind them, most words by far, are cut and lower-cased as a column; each
        is two units, the letters and the mark (or nothing). Every other word is a unit that `_words` codes.
        """
        core = pc.ascii_rtrim(names, characters=MARKS)
        tail = pc.binary_length(names).to_numpy() - pc.binary_length(core).to_numpy()
        plain = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False) & (tail <= 1)
        coded = pc.ascii_lower(core.filter(pa.array(plain))).dictionary_encode()
        letters = coded.dictionary.cast(pa.binary()).to_pylist()
        marks = [m.encode() for m in MARKS]
        others = names.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
        units = [b"", *self._remembered(marks, self._piece_ids), *self._remembered(letters, self._piece_ids), *self._words(others)]
        first, second = np.empty(len(names), np.int64), np.zeros(len(names), np.int64)
        first[plain] = coded.indices.to_numpy() + 1 + len(marks)
        first[~plain] = np.arange(len(others)) + 1 + len(marks) + len(letters)
        marked = np.flatnonzero(plain & (tail == 1))
        if len(marked):
            number = np.zeros(256, np.int64)
            number[np.frombuffer(MARKS.encode(), np.uint8)] = np.arange(1, len(marks) + 1)
            last = pc.binary_slice(names.take(pa.array(marked)).cast(pa.binary()), -1)
            second[marked] = number[np.frombuffer(b"".join(last.to_pylist()), np.uint8)]
        n_unit = np.array([len(x) >> 2 for x in units], np.int64)
        start = np.cumsum(n_unit) - n_unit
        order = np.stack([first, second], 1).reshape(-1)
        take = n_unit[order]
        upto = np.cumsum(take)
        at = np.repeat(start[order] - (upto - take), take) + np.arange(int(upto[-1]) if len(upto) else 0)
        return np.frombuffer(b"".join(units), "<u4")[at], take.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        gc.disable()  # many small byte strings and no cycles: collections only cost time
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pool, n_ids = self._pool(coded.dictionary)
        starts = np.cumsum(n_ids) - n_ids
        index = coded.indices.to_numpy()
        n_words = pc.list_value_length(lists).to_numpy()
        take = n_ids[index]
        ends = np.cumsum(take)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[index] - (ends - take)).astype(np.int32), take)
        out = pool[np.add(at, np.arange(total, dtype=np.int32), out=at)]
        upto = np.concatenate([[0], ends])
        last = np.cumsum(n_words)
        return out, upto[last] - upto[last - n_words]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with `end` after each text."""
    out = np.full(len(ids) + len(n), end, "<u4")
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = ids
    return out, n + 1
