"""Texts to token ids with a public tokenizer: a bounded memo of pre-tokens in front of the tokenizers library.

The library encodes pre-token by pre-token, and white space always ends one. So numpy cuts a block of
texts at white space and, inside words of plain letters and ASCII punctuation, where the one kind
meets the other; each distinct piece is encoded once and its ids are gathered by its 64-bit hash. A hash only groups:
pieces of one hash are compared byte by byte, and the memo goes by bytes, so the ids are those of the bytes. Words with
anything else (digits, apostrophes, other scripts, a special token's opening) go to the library whole.
This holds for tokenizers that lower-case, drop white space and split off letters; for others each text
is encoded as it is.
"""

from __future__ import annotations

import itertools
import json
from array import array

import numpy as np

#: Pieces that a memo may hold before its younger half goes; bounds a worker's memory.
MEMO_PIECES = 500_000
#: Bytes of text that are cut at once.
BLOCK = 1 << 21

_SPACE, _LETTER, _MARK, _ODD = range(4)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def dtype_for(vocabulary: int) -> str:
    """Little-endian id type in which ids are kept between steps."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _pieces(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether to encode whole, and the bytes (lower-cased in plain words) of a block that ends in white space."""
    kind, low = _KIND[buf], _LOWER[buf]
    c3 = np.flatnonzero(buf[:-1] == 0xC3)  # Latin letters of two bytes
    c3 = c3[(buf[c3 + 1] >= 0x80) & (buf[c3 + 1] != 0x97) & (buf[c3 + 1] != 0xB7)]
    kind[c3] = kind[c3 + 1] = _LETTER
    low[c3 + 1] |= np.where((buf[c3 + 1] < 0x9F), 0x20, 0).astype(np.uint8)
    opening = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    kind[opening] = _ODD
    word = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    if kind[0] != _SPACE:
        word = np.concatenate([[0], word])
    odd = np.flatnonzero(kind == _ODD)
    whole_words = np.unique(np.searchsorted(word, odd, side="right") - 1)
    word_end = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) + 1
    for a, b in zip(word[whole_words].tolist(), word_end[whole_words].tolist(), strict=True):
        kind[a:b] = _ODD
        low[a:b] = buf[a:b]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edges = np.concatenate([[0], change, [len(buf)]])
    kinds = kind[edges[:-1]]
    keep = kinds != _SPACE
    return edges[:-1][keep], edges[1:][keep], kinds[keep] == _ODD, low


#: Bytes of a piece whose key is the piece itself.
SHORT = 7
_BYTE = np.uint64(1) << (np.arange(SHORT, dtype=np.uint64) * np.uint64(8))
_WHOLE, _LONG = np.uint64(1 << 56), np.uint64(1 << 63)


def _piece_keys(starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A key for each piece: the bytes themselves up to ``SHORT``, else a hash (with the highest bit), which other pieces may share."""
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.concatenate([_BYTE, np.cumprod(np.full(int(lens.max()), _BASE | np.uint64(1)), dtype=np.uint64)])
    long = lens > SHORT
    values = low[pos + np.repeat(starts, lens)].astype(np.uint64) * powers[pos + np.repeat(np.where(long, SHORT, 0), lens)]
    h = np.add.reduceat(values, first)
    mixed = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(long, (mixed ^ mixed >> np.uint64(27)) | _LONG, h) ^ np.where(whole, _WHOLE, np.uint64(0))


def _unlike(starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, low: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The long pieces that differ from their hash's first piece."""
    lens = ends - starts
    others = np.flatnonzero((lens > SHORT) & (first != np.arange(len(first))))
    head = first[others]
    differs = (lens[others] != lens[head]) | (whole[others] != whole[head])
    same = np.flatnonzero(~differs)
    if len(same):
        n = lens[others[same]]
        begin = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(begin, n)
        wrong = low[pos + np.repeat(starts[others[same]], n)] != low[pos + np.repeat(starts[head[same]], n)]
        if wrong.any():
            differs[same[np.logical_or.reduceat(wrong, begin)]] = True
    return others[differs]


class Encoder:
    """Encodes texts (as UTF-8 bytes) to ids of ``dtype``; one for each worker process."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        shape = json.loads(definition)
        self.dtype = dtype_for(self.tokenizer.get_vocab_size())
        self.by_piece = shape["model"].get("end_of_word_suffix") == "</w>" and "'Lowercase'" in str(shape.get("normalizer")) and "[^\\s\\p{L}\\p{N}]+" in json.dumps(shape.get("pre_tokenizer")).replace("\\\\", "\\")
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo: dict[int | bytes, bytes] = {}  # ids by the key of a short piece or the bytes of a long one (with a blank if it is taken whole)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype == "<u2" else "I", ids).tobytes()

    def _ids_of(self, pieces: list[tuple[bytes, bool]]) -> list[bytes]:
        """The packed ids of pieces (bytes, whether taken whole)."""
        model, out, odd = self.tokenizer.model, [b""] * len(pieces), []
        for n, (raw, as_is) in enumerate(pieces):
            if as_is or not (raw[0] >= 0x80 or 97 <= raw[0] <= 122):
                odd.append(n)
            else:  # a run of letters is one pre-token, so the model can take it as it is
                text = raw.decode()
                mapped = text if text.isascii() else self.byte_level.pre_tokenize_str(text)[0][0]
                out[n] = self._pack([token.id for token in model.tokenize(mapped)])
        for at in range(0, len(odd), 10_000):
            some = odd[at : at + 10_000]
            for n, e in zip(some, self.tokenizer.encode_batch_fast([pieces[n][0].decode("utf-8", "replace") for n in some], add_special_tokens=False), strict=True):
                out[n] = self._pack(e.ids)
        return out

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(texts) + b" "
        buf = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends, whole, low = _pieces(buf)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        found, at, inverse = np.unique(_piece_keys(starts, ends, whole, low), return_index=True, return_inverse=True)
        n_short = int(np.searchsorted(found, _LONG))
        source = low.tobytes()
        long = lambda i: source[starts[i] : ends[i]] + b" " * int(whole[i])
        keys = found[:n_short].tolist() + [source[a:b] for a, b in zip(starts[at[n_short:]].tolist(), ends[at[n_short:]].tolist(), strict=True)]
        for n in (n_short + np.flatnonzero(whole[at[n_short:]])).tolist():
            keys[n] = long(at[n])
        others: dict[bytes, int] = {}
        for i in _unlike(starts, ends, whole, low, at[inverse]).tolist():  # one hash, but other bytes
            if long(i) not in others:
                others[long(i)] = len(keys)
                keys.append(long(i))
            inverse[i] = others[long(i)]
        if len(self.memo) + len(keys) > MEMO_PIECES:  # what it met first stays: frequent pieces come early
            self.memo = dict(itertools.islice(self.memo.items(), MEMO_PIECES // 2))
        found = list(map(self.memo.get, keys))
        missing = [n for n, ids in enumerate(found) if ids is None]
        pieces = [(source[starts[at[n]] : ends[at[n]]], bool(whole[at[n]])) if n < n_short else (keys[n].rstrip(b" "), keys[n].endswith(b" ")) for n in missing]
        for n, ids in zip(missing, self._ids_of(pieces), strict=True):
            found[n] = self.memo[keys[n]] = ids
        width = np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // width
        offsets = np.cumsum(counts) - counts
        each = counts[inverse]
        ends_at = np.cumsum(each)
        ids = flat[np.arange(int(ends_at[-1])) + np.repeat(offsets[inverse] - (ends_at - each), each)]
        upto = np.concatenate([[0], ends_at])[np.searchsorted(starts, begins)]
        return ids, np.diff(upto)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        texts = [t or b"" for t in texts]
        if not self.by_piece:
            return [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        block, owners, size = [], [], 0

        def flush() -> None:
            ids, counts = self._block(block)
            for owner, part in zip(owners, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[owner].append(part)

        for n, text in enumerate(texts):
            for part in cut(text):
                if block and size + len(part) > BLOCK:
                    flush()
                    block, owners, size = [], [], 0
                block.append(part)
                owners.append(n)
                size += len(part)
        if block:
            flush()
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


def cut(text: bytes) -> list[bytes]:
    """A long text in parts that end at white space."""
    if len(text) <= BLOCK:
        return [text]
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(text[at:end])
        at = end
    return parts


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for this definition, kept between tasks."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition_of(path: str | None) -> str:
    """The tokenizer's JSON, read once on the driver; a file of fixed size."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
