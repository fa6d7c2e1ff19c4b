"""Token ids of whole Arrow batches by a public word-level BPE file, with a bounded cache of words."""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_slices, hand_back, text_buffers

#: Bytes of text encoded at once, and words per generation of the cache (two are held), each of CACHE_BYTES a word on
#: average at most: about 200 MB for a worker. A larger cache learns fewer words twice.
SLICE_BYTES = 1_000_000
CACHE_WORDS = 100_000
CACHE_BYTES = 20
#: ASCII punctuation that the vocabulary's pre-tokens take as one run after a word (the apostrophe starts contractions).
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lower-case ASCII letters with such a run after them.
_PLAIN = re.compile("([a-z]+)([" + re.escape(_TAIL) + "]*)")
#: A word of its own between the words of one library call; it never comes from a text's words there.
_BREAK = "\x1c"

_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS, slice_bytes: int = SLICE_BYTES) -> "WordEncoder":
    """One encoder per worker and vocabulary file; a later call may change its bounds."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].cache_words, _encoders[path].slice_bytes = cache_words, slice_bytes
    return _encoders[path]


class WordEncoder:
    """Exact ids of the tokenizers library for a vocabulary whose pre-tokens never span white space.

    White space only separates words there, so a text's ids are its words' ids in order; each distinct word
    goes through the library once while it stays in the cache. Texts that hold the string of a special token go
    through the library whole, as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = self.library  # finds special tokens in a text, as the file says
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(t.normalized or t.lstrip or t.rstrip for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("special tokens must be found as they are written")
        if self.special:  # words come in lower case: what looks special there is not
            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True
        self.learned, self.cache_words, self.slice_bytes = 0, CACHE_WORDS, SLICE_BYTES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.model = self.library.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        # byte-level vocabularies write each byte as a printable character
        self.bytes_as_text = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}
        (self.mark,) = self.library.encode(_BREAK, add_special_tokens=False).ids

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _simple(self, word: str) -> bytes | None:
        """Ids of lower-case Latin letters and a run of punctuation after them, past the normaliser; else None."""
        if plain := _PLAIN.fullmatch(word):
            shown, tail = plain.groups()
        else:
            stem = word.rstrip(_TAIL)
            if not stem.isalpha() or stem != stem.lower() or not max(stem) < "\u0250" or not unicodedata.is_normalized("NFC", stem):
                return None
            shown, tail = stem.encode().decode("latin-1").translate(self.bytes_as_text), word[len(stem) :]
        if (end := self.tails.get(tail)) is None:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            end = self.tails[tail] = np.array(self._ids(tail), np.uint16).tobytes()
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes() + end

    def _learn(self, words: list[str]) -> None:
        self.learned += sum(map(len, words))
        plain = []
        for w in words:
            if (ids := self._simple(w)) is not None:
                self.young[w] = ids
            elif _BREAK in w:
                self.young[w] = np.array(self._ids(w), np.uint16).tobytes()
            else:
                plain.append(w)
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.array(self._ids(f"\n{_BREAK}\n".join(some)), np.uint16)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:  # the mark also came from a word
                self.young.update((w, np.array(self._ids(w), np.uint16).tobytes()) for w in some)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, [*cuts.tolist(), len(ids)]):
                self.young[w] = raw[2 * at : 2 * end]
                at = end + 1

    def _lookup(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        if len(young) > self.cache_words or self.learned > self.cache_words * CACHE_BYTES:
            self.old, self.young, self.learned = young, {}, 0
            young, old = self.young, self.old
        missing = []
        for w in words:
            if w not in young:
                if (x := old.get(w)) is not None:
                    young[w] = x
                else:
                    missing.append(w)
        if missing:
            self._learn(missing)
        return [young[w] for w in words]

    def slices(self, column: pa.Array):
        """Yield (first row, rows, word index, words per row, ids of each distinct word as bytes)."""
        _, offsets = text_buffers(column)
        column = column.fill_null("") if column.null_count else column
        for low, high in byte_slices(offsets, self.slice_bytes):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(low, high - low)))
            words = lists.flatten().dictionary_encode()
            # the first and last item of a list are empty where a text begins or ends with white space
            per_row = np.diff(lists.offsets.to_numpy())
            yield low, high - low, words.indices.to_numpy(), per_row, self._lookup(words.dictionary.to_pylist())

    def _special_rows(self, column: pa.Array) -> np.ndarray:
        hit = np.zeros(len(column), bool)
        for token in self.special:
            hit |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(hit)

    def encode(self, column: pa.Array, end: int):
        """Yield (first row, ids of consecutive rows, ids per row); each row's ids are followed by ``end``."""
        at = 0
        for row in [*self._special_rows(column).tolist(), len(column)]:
            for low, tokens, sizes in self._by_words(column.slice(at, row - at), end):
                yield at + low, tokens, sizes
            if row < len(column):
                ids = self.whole.encode(column[row].as_py(), add_special_tokens=False).ids
                yield row, np.array([*ids, end], np.uint16), np.array([len(ids) + 1])
            at = row + 1
        hand_back()

    def _by_words(self, column: pa.Array, end: int):
        for low, rows, index, per_row, ids in self.slices(column):
            flat = np.frombuffer(b"".join(ids) + np.uint16(end).tobytes(), np.uint16)
            size = np.array([len(x) // 2 for x in ids] + [1], np.int32)
            begin = np.cumsum(size) - size
            # the end id goes in as one more word after each row
            row_end = np.cumsum(per_row)
            words = np.insert(index, row_end, len(ids))
            width = size[words]
            place = np.cumsum(width, dtype=np.int64)
            shift = np.int64 if len(place) and place[-1] > 2**31 - 1 else np.int32
            tokens = flat[np.repeat((begin[words] - place + width).astype(shift), width) + np.arange(place[-1] if len(place) else 0, dtype=shift)]
            stop = place[row_end + np.arange(rows)] if rows else np.zeros(0, np.int64)
            yield low, tokens, np.diff(np.concatenate([[0], stop]))
