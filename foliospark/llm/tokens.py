"""Token ids of whole texts with a public word-level BPE vocabulary."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

# a task has one core; the library's own threads would only contend for it
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import CharDelimiterSplit  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


#: Distinct words, and parts of words, that a worker remembers; when full it starts anew. Longer ones are not remembered.
KNOWN_WORDS = 1 << 17
KNOWN_PARTS = 1 << 19
KNOWN_BYTES = 64
#: Pieces that an encoder of a byte-level vocabulary remembers, some 150 bytes each.
KNOWN_PIECES = 3 << 19

# The vocabulary's own contractions, and the letters for which its normaliser does no more than lower-case.
_PLAIN = "a-z\u00df-\u00f6\u00f8-\u017f"
_PLAIN_WORD = re.compile(rf"[\x21-\x7eA-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u012f\u0131-\u0148\u014a-\u017e{_PLAIN}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_PLAIN}]+|[0-9]|[^{_PLAIN}0-9]+")

# The byte-level alphabet: a printable byte stands for itself, the others get the code points after 255 in turn.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _SHOWN))}
_LETTER_OF = np.array([_BYTE_LETTERS.get(b, b) for b in range(256)], "<u2")

# Classes of bytes for the byte-level pre-tokenizer. All bytes of a Latin letter (U+00C0 to U+017F but for two signs) are letters.
_FOREIGN, _LETTER, _DIGIT, _SIGN, _BLANK, _SPACE = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x09, 0x0A, 0x0D]] = _BLANK
_CLASS[0x20] = _SPACE


def _foreign(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts between ``bounds`` hold a character that is neither ASCII (control characters aside) nor a Latin letter."""
    bad = _CLASS[data] == _FOREIGN
    sign = np.flatnonzero((data == 0x97) | (data == 0xB7))  # U+00D7 and U+00F7 are no letters
    bad[sign[(sign > 0) & (data[sign - 1] == 0xC3)]] = True
    return np.diff(np.append(0, np.cumsum(bad))[bounds]) > 0


def _piece_starts(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin in the texts that lie between ``bounds``; a foreign or ``whole`` text is one piece.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?signs|\\s+(?!\\S)|\\s+: of a run of white space before something else the last
    character is a piece of its own, or the beginning of the next one if it is a space.
    """
    first = bounds[:-1][np.diff(bounds) > 0]
    kind = _CLASS[data]
    white = kind >= _BLANK
    begins, same = np.zeros(len(data), bool), kind[1:] == kind[:-1]
    begins[1:] = np.where(white[1:], ~white[:-1], ~same & (kind[:-1] != _SPACE))
    last_white = white[:-1] & ~white[1:]
    last_white[first[1:] - 1] = False  # a text's last character has nothing after it
    begins[:-1] |= last_white
    begins[first] = True
    mark = np.flatnonzero((data == 0x27) & begins)
    if len(mark):
        ends = bounds[np.searchsorted(bounds, mark, side="right")]
        after = lambda k: np.where(mark + k < ends, data[np.minimum(mark + k, len(data) - 1)], 0)
        one, two = after(1), after(2)
        short = np.isin(one, [*b"stmd"])
        long = (np.isin(one, [*b"rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[mark[short | long] + 1] = False
        cut = np.concatenate([mark[short] + 2, mark[long] + 3])
        begins[cut[cut < len(data)]] = True
    alone = np.flatnonzero(_foreign(data, bounds) | whole)
    for k in alone.tolist():
        begins[bounds[k] + 1 : bounds[k + 1]] = False
    return begins


class _Known(dict):
    """Values made once by ``make`` for each key, at most ``most`` at a time."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: bytes | str) -> bytes:
        value = self.make(key)
        if len(key) <= KNOWN_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` as bytes of ``dtype``; null and empty texts have no ids.

    The vocabulary's pre-tokenizer drops white space and its normaliser joins nothing across ASCII
    white space, so the ids of a text are those of the words between it, one after another, and a word met
    before need not be encoded again; nor a part of a word that the pre-tokenizer cuts off, where the word has plain
    Latin letters only. With ``plain`` strings that look like special tokens are ordinary
    text; without it they get the special tokens' ids, as in the library's default.
    """

    def __init__(self, path: str = WORD_BPE, dtype: str = "<u4", plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.parts = _Known(self._part, KNOWN_PARTS)
        self.known = _Known(self._word, KNOWN_WORDS)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _part(self, part: str) -> bytes:
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_LETTERS))])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha() and len(word) <= KNOWN_BYTES:  # ASCII letters only: one part
            return self.parts[word.lower().decode()]
        text = word.decode()
        if "<|" in text or len(text) > KNOWN_BYTES or not _PLAIN_WORD.fullmatch(text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, text.encode().split())) if text else b""


class ByteEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` of a byte-level vocabulary of at most 65,536 ids, as little-endian 16-bit integers.

    The pre-tokenizer cuts a text into pieces, which are coded on their own: contractions, runs of letters, of digits and of signs, each with the
    space before it, and white space. For texts of ASCII and Latin letters numpy finds the cuts in all texts of a batch at once, and Arrow the distinct pieces.
    A piece met before need not be encoded again; the new ones go to the library's model in one text. Other texts, and texts with a special token's
    string, are one piece that the library gets whole. What is remembered outlives a task: most pieces come again in the next.
    """

    def __init__(self, path: str = BYTE_BPE):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the library's model by itself: its texts are pieces in the byte-level alphabet, which has no space, with spaces between them
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0  # by piece
        self.ids, self.n_ids = np.zeros(1 << 14, "<u2"), 0

    def _add(self, coded: np.ndarray, sizes: np.ndarray) -> None:
        """Further pieces with their ids, one piece's after the other's."""
        while self.n + len(sizes) > len(self.sizes):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.n_ids + len(coded) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.starts[self.n : self.n + len(sizes)] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.ids[self.n_ids : self.n_ids + len(coded)] = coded
        self.n, self.n_ids = self.n + len(sizes), self.n_ids + len(coded)

    def _learn(self, pieces: list[bytes]) -> None:
        """The tokens of a piece have its bytes, so the ids of all pieces in one text are told apart by their lengths."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.full(int(lengths.sum()) + len(pieces), 0x20, "<u2")
        text[np.arange(len(text) - len(pieces)) + np.repeat(np.arange(len(pieces)), lengths)] = _LETTER_OF[np.frombuffer(b"".join(pieces), np.uint8)]
        coded = np.array(self.pieces.encode_batch_fast([text.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u2")
        ends, after = np.cumsum(lengths), np.cumsum(self.token_bytes[coded])
        cuts = np.searchsorted(after, ends)
        if len(after) != cuts[-1] + 1 or (after[cuts] != ends).any():
            raise ValueError("the tokens of a piece do not have its bytes")
        self._add(coded, np.diff(cuts, prepend=-1))

    def _is_special(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for s in self.special:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if not pc.sum(pc.binary_length(texts)).as_py():
            return [b""] * len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
        bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        special = self._is_special(texts)
        strings = [s.encode() for s in self.special] if special.any() else []
        begins = _piece_starts(data, bounds, special)
        offsets = np.append(np.flatnonzero(begins), len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = list(map(self.known.get, distinct))
        kept = self.n, self.n_ids
        new = [k for k, place in enumerate(places) if place is None]
        if new:
            # a piece of a text that was not cut is the whole text
            whole = _foreign(np.frombuffer(b"".join(map(distinct.__getitem__, new)), np.uint8), np.cumsum([0, *(len(distinct[k]) for k in new)]))
            plain, longer = [], []
            for k, other in zip(new, whole.tolist(), strict=True):
                own = distinct[k]
                (longer if other or len(own) > KNOWN_BYTES or any(s in own for s in strings) else plain).append(k)
            if plain:
                self.known.update(zip(map(distinct.__getitem__, plain), range(self.n, self.n + len(plain)), strict=True))
                for place, k in enumerate(plain, self.n):
                    places[k] = place
                self._learn([distinct[k] for k in plain])
            kept = self.n, self.n_ids
            for k in longer:  # not remembered
                places[k] = self.n
                coded = np.array(self.tokenizer.encode(distinct[k].decode(), add_special_tokens=False).ids, "<u2")
                self._add(coded, np.array([len(coded)]))
        own = np.array(places, np.int64)[pieces.indices.to_numpy()]
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        coded = self.ids[np.repeat(self.starts[own] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        self.n, self.n_ids = kept
        cuts = (2 * np.append(0, ends)[np.searchsorted(offsets, bounds)]).tolist()
        return list(map(coded.__getitem__, map(slice, cuts, cuts[1:])))


_BYTE_ENCODERS: dict[str, ByteEncoder] = {}


def encode_bytes(texts: list[str | None] | pa.Array, path: str = BYTE_BPE) -> list[bytes]:
    """The ids of each text by a byte-level vocabulary; the worker process's encoder outlives a task."""
    if path not in _BYTE_ENCODERS:
        _BYTE_ENCODERS[path] = ByteEncoder(path)
    return _BYTE_ENCODERS[path].encode_batch(texts)


_ENCODERS: dict[tuple[str, str, bool], WordEncoder] = {}


def encode_all(texts: Iterable[str | None], path: str = WORD_BPE, dtype: str = "<u4", plain: bool = False) -> Iterator[bytes]:
    """The ids of each text; the worker process's encoder outlives a task."""
    key = (path, dtype, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return map(_ENCODERS[key].encode, texts)


def forget_words() -> None:
    """Frees what the worker's encoders remember, at the end of a task: the next one may be of another stage."""
    for own in _ENCODERS.values():
        own.known.clear()
        own.parts.clear()
