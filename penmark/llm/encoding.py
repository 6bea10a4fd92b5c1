"""Token ids of many texts at once, for a byte-level BPE vocabulary of the
tokenizers library with its usual splitting (letters, numbers, other signs,
white space; one space goes with what follows it; English contractions).

The splitting is done for a whole batch with numpy on the UTF-8 bytes, equal
pieces become one entry of an Arrow dictionary, and each distinct piece goes
to the tokenizer's own model once; its ids are remembered in a cache of
bounded size. Splitting is local, so the pieces' ids joined are the text's
ids. Where the classes of characters can't be said from small fixed tables
(code points from U+0250 on, rare white space, controls), or where a special
token's name stands in the text, the whole text goes through ``encode``.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000
_SLICE = 8 << 20  # bytes of text at once
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_KNOWN = 0x250


def _byte_signs() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary:
    itself where printable, else the next character from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _class(point: int) -> int:
    kind = unicodedata.category(chr(point))[0]
    return _LETTER if kind == "L" else _NUMBER if kind == "N" else _SPACE if chr(point) in " \t\n\r" else _OTHER


_SIGNS = _byte_signs()
_CLASSES = np.array([_class(i) for i in range(_KNOWN)], np.uint8)
_ODD = np.zeros(256, bool)  # bytes that send a text through encode()
_ODD[[0x0B, 0x0C, *range(0x1C, 0x20)]] = True
_ODD[0xC0 | (_KNOWN >> 6) :] = True
_loaded: dict[str, object] = {}
_young: dict[bytes, bytes] = {}
_old: dict[bytes, bytes] = {}


def load(path: str):
    """The tokenizer of a file, one per process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        for kept in (_loaded, _young, _old):
            kept.clear()
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte; ``firsts`` are the texts' starts."""
    kind = _CLASSES[data.astype(np.int64) & 0x7F]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        point = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _CLASSES[point]
    white = kind == _SPACE
    opens = np.zeros(len(data) + 1, bool)
    opens[firsts] = True
    start = np.empty(len(data), bool)
    start[0] = True
    # a new kind begins a piece, but not behind a single space, which is the piece's own
    start[1:] = (kind[1:] != kind[:-1]) & ~((data[:-1] == 32) & ~white[1:])
    # the last white space before something else stands apart from those before it
    last = white[:-1] & ~white[1:] & ~opens[1:-1]
    start[:-1] |= last
    start |= opens[:-1]
    # behind a text's first space nothing changes: the space itself is the start
    mark = np.flatnonzero((data == 39) & start & (np.r_[kind[1:], _SPACE] == _LETTER) & ~opens[1:])
    if len(mark):
        wide = np.r_[data, np.zeros(3, np.uint8)]
        one, two = wide[mark + 1], wide[mark + 2]
        pair = (one.astype(np.int64) << 8) | two
        single = np.isin(one, list(b"stmd"))
        double = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~opens[np.minimum(mark + 2, len(data))]
        for some, n in ((single, 2), (double & ~single, 3)):
            at = mark[some]
            start[at + 1] = False
            end = at + n
            start[end[end < len(data)]] = True
    return start


def _lookup(names: list[bytes], tokenizer) -> list[bytes]:
    """Ids (two bytes each) of every piece."""
    global _young, _old
    if len(_young) + len(names) > CACHE:
        _young, _old = {}, _young
    found = list(map(_young.get, names))
    split = tokenizer.model.tokenize
    for i, ids in enumerate(found):
        if ids is None:
            name = names[i]
            ids = _old.get(name)
            if ids is None:
                ids = array("H", [t.id for t in split(name.decode("latin-1").translate(_SIGNS))]).tobytes()
            _young[name] = found[i] = ids
    return found


def _encode_slice(tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.zeros(len(texts), np.int64)
    if not len(data):
        return np.zeros(0, np.uint16), n
    odd = _ODD[data]
    odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    upto = np.r_[0, np.cumsum(odd)]
    whole = upto[offsets[1:]] > upto[offsets[:-1]]
    for name in tokenizer.get_added_tokens_decoder().values():
        whole |= pc.match_substring(texts, name.content).to_numpy(zero_copy_only=False)
    if whole.any():  # their bytes are read as spaces, their pieces replaced below
        data = np.where(np.repeat(whole, np.diff(offsets)), np.uint8(32), data)
    firsts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    cut = np.flatnonzero(_starts(data, firsts))
    pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.r_[cut, len(data)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    table = _lookup(coded.dictionary.to_pylist(), tokenizer)
    index = coded.indices.to_numpy()
    if whole.any():
        index = index.copy()
        text_of = np.searchsorted(offsets, cut, "right") - 1  # empty texts own no piece
        at = np.flatnonzero(whole[text_of])
        heads = at[np.r_[True, np.diff(text_of[at]) > 0]]
        index[at] = len(table)
        index[heads] = len(table) + 1 + np.arange(len(heads))
        said = [texts[int(i)].as_py() for i in text_of[heads]]
        table = [*table, b"", *(array("H", tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in said)]
    size = np.fromiter(map(len, table), np.int32, len(table)) // 2
    begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int32)
    each = size[index]
    ends = np.cumsum(each, dtype=np.int32)
    flat = np.frombuffer(b"".join(table), np.uint16)
    total = int(ends[-1])
    out = flat[np.repeat(begin[index] - ends + each, each) + np.arange(total, dtype=np.int32)]
    # ids before each text's end
    before = np.r_[0, ends][np.searchsorted(cut, offsets)]
    return out, np.diff(before).astype(np.int64)


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint16) of all texts in one array, each text's as ``encode(text,
    add_special_tokens=False)``, and the number of ids of each text. A null
    text has none."""
    tokenizer = load(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // _SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    parts = [_encode_slice(tokenizer, texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
