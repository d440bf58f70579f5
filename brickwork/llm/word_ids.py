"""Token ids of whole texts by a tokenizer file, a piece of text at a time where that is exact.

The patterns of these vocabularies begin a new word at every space between two
characters that are no white space, at a single line feed between such, and at
a sign after a letter; what lies between two such places has the same ids alone
as in its text. So a batch is cut on its bytes, equal pieces become one by
Arrow's dictionary encoding, and only pieces not seen before go through the
tokenizer. Files of another kind encode each text as a whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa

#: Pieces that are one word of the patterns, whatever the normalisation.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Small letters for the capitals of such pieces; a byte from 0x80 on follows 0xC3 there.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))

BLANK, LETTER, SIGN = 1, 2, 4
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = BLANK
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SIGN


def _wide_blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the bytes a, b, c (or the two first) are white space beyond ASCII, in UTF-8."""
    line = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    rest = (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return line | rest | (a == 0xC2) & ((b == 0x85) | (b == 0xA0))


def _blank_beside(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character beside these places (at least four bytes from both ends) is white space."""
    found = ((CLASS[data[at - 1]] | CLASS[data[at + 1]]) & BLANK) > 0
    left, right = np.flatnonzero(data[at - 1] >= 0x80), np.flatnonzero(data[at + 1] >= 0x80)
    p, q = at[left], at[right]
    two = (data[p - 2] == 0xC2) & ((data[p - 1] == 0x85) | (data[p - 1] == 0xA0))
    found[left] |= two | _wide_blank(data[p - 3], data[p - 2], data[p - 1])
    found[right] |= _wide_blank(data[q + 1], data[q + 2], data[q + 3])
    return found


def _mode(spec: dict) -> str:
    """bytes: pieces keep the space before them; words: white space only separates; whole: no cut is known to be exact."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if any(set(s) & set(" \n") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for s, t in zip(special, spec.get("added_tokens", []))):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "bytes"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [{}])
    if kinds == ["NFC", "Replace", "Lowercase"] and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
        return "words"
    return "whole"


@lru_cache(maxsize=2)
def _loaded(path: str, changed: int):
    """A file's tokenizer, mode and special tokens, its merges for single words and their real ids; kept in the process, as tasks follow each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return tokenizer, _mode(spec), [t["content"].encode() for t in spec.get("added_tokens", [])], *_merges(tokenizer, spec)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def _merges(tokenizer, spec: dict):
    """The same merges for the quicker coder of single words, and the ids behind its ranks; none where it would not be sure to agree.

    A word's end is written as a space, which no word holds. A rank is a
    merge's place in the file; the coder takes a word that is a token as that
    token, so each token must be what the file's merges make of it.
    """
    model, mode = spec["model"], _mode(spec)
    tokens, suffix = model.get("vocab", {}), model.get("end_of_word_suffix") or ""
    if mode == "whole" or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or bool(suffix) != (mode == "words"):
        return None, None
    alphabet = _byte_alphabet()
    ends = [("", b"")] + ([(suffix, b" ")] if suffix else [])
    known = {c + s: bytes([b]) + e for s, e in ends for c, b in alphabet.items()}
    order = list(known)
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if left not in known or right not in known or left + right in known:
            return None, None
        known[left + right] = known[left] + known[right]
        order.append(left + right)
    whole = [t for t in order if t.endswith(suffix)]
    if set(order) - set(tokens) or any([x.id for x in tokenizer.model.tokenize(t.removesuffix(suffix))] != [tokens[t]] for t in whole):
        return None, None
    import tiktoken

    ranks = {known[t]: k for k, t in enumerate(order)}
    return tiktoken.Encoding("words", pat_str=r"\S+\s?", mergeable_ranks=ranks, special_tokens={}), np.array([tokens[t] for t in order], np.uint32)


class WordIds:
    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer, self.mode, self.special, self.merges, self.real = _loaded(path, os.stat(path).st_mtime_ns)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Known pieces: their numbers, and by number the ids' place in ``flat`` and how many they are."""
        self.number: dict[bytes, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _cuts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces begin and end: ``rows``, the edges of the texts, and the places between that are exact."""
        kind = CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] == SIGN) & (kind[:-1] == LETTER)
        wide = np.flatnonzero((kind[2:] == SIGN) & (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)) if len(data) > 2 else np.empty(0, int)
        cut[wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)] + 2] = True  # letters of Latin-1
        if self.mode == "words":
            cut[:-1] |= (data == 32) | (data == 10)
        else:
            edge = np.zeros(len(data) + 2, bool)  # a place by a text's first or last byte has no known neighbour
            edge[rows[rows < len(data)]] = True
            at = np.flatnonzero((data == 32) | (data == 10))
            at = at[(at >= 4) & (at < len(data) - 4)]
            at = at[~(edge[at] | edge[at + 1])]
            at = at[~_blank_beside(data, at)]
            cut[at] = True
            cut[at[data[at] == 10] + 1] = True
        if self.special:
            raw = data.tobytes()
            for token in self.special:
                place = raw.find(token)
                while place >= 0:
                    cut[place + 1 : place + len(token)] = False
                    place = raw.find(token, place + 1)
        cut[rows] = True
        return np.flatnonzero(cut)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column's texts (null: empty), one after another, and where each text's ids end."""
        if self.mode == "whole":
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum(np.array([len(i) for i in found], np.int64))
        texts = texts.fill_null("")
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        buffer = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        rows = offsets - offsets[0]
        edges = self._cuts(np.frombuffer(buffer, np.uint8), rows)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), buffer]).dictionary_encode()
        index = self._numbers(pieces.dictionary)[np.asarray(pieces.indices)]
        count = self.count[index]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[index] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(edges, rows[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        data, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of these pieces; new ones are learned."""
        if len(self.number) + len(distinct) > self.most or len(self.flat) > 20 * self.most:
            self._forget()
        stops = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
        raw = distinct.buffers()[2].to_pybytes()
        keys = [raw[a:b] for a, b in zip(stops, stops[1:])]
        get = self.number.get
        found = [get(k, -1) for k in keys]
        out = np.array(found, np.int64)
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = [keys[i] for i in fresh.tolist()]
            ids, count = self._learn(new)
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new))))
            out[fresh] = np.arange(first, first + len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, ids])
        return out

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and their counts."""
        plain = np.array([m is not None for m in map(PLAIN.fullmatch, new)] if self.merges else [False] * len(new), bool)
        words = list(compress(new, plain))
        if self.mode == "words":
            words = [k.lstrip().translate(LOWER) + b" " for k in words]
        alike = list(map(self.merges._core_bpe.encode_single_piece, words)) if words else []
        others = [e.ids for e in self.tokenizer.encode_batch_fast([k.decode() for k in compress(new, ~plain)], add_special_tokens=False)]
        count = np.empty(len(new), np.int64)
        count[plain], count[~plain] = list(map(len, alike)), list(map(len, others))
        ids, of_plain = np.empty(int(count.sum()), np.uint32), np.repeat(plain, count)
        ids[of_plain] = self.real[np.fromiter(chain.from_iterable(alike), np.int64)] if alike else []
        ids[~of_plain] = np.fromiter(chain.from_iterable(others), np.uint32)
        return ids, count
