"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text (a word mark before it and for each space) is cut into words: runs of
marks with what follows, which no piece spans. The symbols of all words not
seen before lie in one flat array. Each round looks up the rank of every
adjacent pair, takes the least rank of each word by a segmented minimum, merges
its leftmost places in all words at once, and closes the gaps; words without a
pair that merges leave the array. Symbols that are no piece become bytes.

Merging all places of a word's least pair in one round equals merging one at a
time as long as no new pair ranks lower than the merged one. Each round checks
that; a word where it happens is done again, one place a round.

Defined results. Null: like the empty text, no ids, decoded to the empty text.
Repeated rows give repeated results, an empty table an empty table. Texts and
words of any length are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long, string, with_text_columns

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NONE = np.int64(1) << 40


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


class PieceBPE:
    """Encoder and decoder of a SentencePiece BPE model file."""

    def __init__(self, path: str, most: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix or not t.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        kinds = [p.type for p in model.pieces]
        if 4 in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 5)}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("models with pieces across words are not supported")
        self.size = len(model.pieces)
        symbols = dict(normal)  # characters of pieces that are no piece themselves get numbers behind the pieces
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(symbols) + self.size)
        self.count = self.size + len(symbols) + 1
        self.of_char = np.full(0x110000, self.count - 1, np.int64)  # the last number: never merges
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = sorted(normal, key=lambda p: (-model.pieces[normal[p]].score, normal[p]))
        rank = {p: r for r, p in enumerate(order)}
        pairs = {}
        for p in normal:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.count + b] = (rank[p], normal[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.zeros(len(rank), np.int64)
        for p, r in rank.items():
            self.merged[r] = normal[p]
        self.of_byte = np.zeros(256, np.int64)
        self.bytes_of = [b""] * self.size  # what decoding puts for each id
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.of_byte[int(p.piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type == 2:
                self.bytes_of[i] = t.unk_surface.encode()
            elif p.type in (1, 5):
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
        self.marked = np.array([p.type in (1, 5) and p.piece.startswith(MARK) for p in model.pieces])
        self.most = most
        self.known: dict[str, tuple[bytes, str]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, symbols: np.ndarray, starts: np.ndarray, one_place: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all words; returns symbols, code points in each, word of each, in order."""
        lengths = np.diff(np.r_[starts, len(symbols)])
        word = np.repeat(np.arange(len(starts)), lengths)
        width = np.ones(len(symbols), np.int64)
        original, done, redo = symbols, [], []
        rank = np.full(len(symbols), NONE)  # of the pair that begins here
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(word)])
            least = np.minimum.reduceat(rank, heads)
            active = least < NONE
            if not active.all():  # words without a pair leave
                out = np.repeat(~active, sizes)
                done.append((symbols[out], width[out], word[out]))
                symbols, width, word, rank = (x[~out] for x in (symbols, width, word, rank))
                sizes, least = sizes[active], least[active]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            if one_place:
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            elif (at[1:] - at[:-1] == 1).any():  # overlapping places: of each chain every other one, from the left
                chain = np.flatnonzero(np.r_[True, at[1:] - at[:-1] != 1])
                nth = np.arange(len(at)) - np.repeat(chain, np.diff(np.r_[chain, len(at)]))
                at = at[nth % 2 == 0]
            old = rank[at]
            symbols[at] = self.merged[old]
            width[at] += width[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))  # of each merged symbol after the gaps are closed
            symbols, width, word = symbols[keep], width[keep], word[keep]
            rank = rank[keep]
            changed = np.unique(np.r_[place, np.maximum(place - 1, 0)])
            inner = changed[changed < len(symbols) - 1]
            rank[changed] = NONE
            same = word[inner] == word[inner + 1]
            rank[inner[same]] = self.pair_ranks(symbols[inner[same]], symbols[inner[same] + 1])
            if not one_place:
                floor = np.zeros(len(starts), np.int64)
                floor[word[place]] = old
                early = rank[changed] < floor[word[changed]]
                if early.any():
                    again = np.unique(word[changed[early]])
                    redo.append(again)
                    stay = ~np.isin(word, again)
                    symbols, width, word, rank = (x[stay] for x in (symbols, width, word, rank))
        if redo:
            for w in np.concatenate(redo).tolist():
                s, n, _ = self.merge(self._fresh[starts[w] : starts[w] + lengths[w]].copy(), np.zeros(1, np.int64), True)
                done.append((s, n, np.full(len(s), w)))
        symbols, width, word = (np.concatenate(x) for x in zip(*done)) if done else (original[:0], width[:0], word[:0])
        order = np.argsort(word, kind="stable")
        return symbols[order], width[order], word[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        self._fresh = self.of_char[points]
        symbols, width, word = self.merge(self._fresh.copy(), np.cumsum(lengths) - lengths)
        first = np.cumsum(width) - width
        known = symbols < self.size
        count = np.ones(len(symbols), np.int64)
        raw = [chr(c).encode() for c in points[first[~known]].tolist()]  # unknown symbols are single characters
        count[~known] = [len(b) for b in raw]
        ids = np.zeros(count.sum(), np.int64)
        at = np.cumsum(count) - count
        ids[at[known]] = symbols[known]
        if raw:
            places = np.repeat(at[~known], count[~known]) + np.concatenate([np.arange(len(b)) for b in raw])
            ids[places] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        per_word = np.bincount(word, count, len(words)).astype(np.int64)
        return np.split(ids, np.cumsum(per_word)[:-1]) if words else []

    def words(self, text: str) -> list[str]:
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit numbers and as decimals joined by commas."""
        rows = [self.words(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        new = {w for r in rows for w in r if w not in self.known}
        if new:
            fresh = list(new)
            for w, ids in zip(fresh, self.encode_words(fresh)):
                self.known[w] = ids.astype("<i4").tobytes(), ",".join(map(str, ids.tolist()))
        get = self.known.__getitem__
        out = []
        for r in rows:
            found = list(map(get, r))
            out.append((b"".join([x[0] for x in found]), ",".join([x[1] for x in found])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; each byte that is not UTF-8 becomes U+FFFD, the first mark goes."""
        ids = ids.tolist()
        parts = [self.bytes_of[i] for i in ids]
        first = next((k for k, p in enumerate(parts) if p), None)
        if first is not None and self.marked[ids[first]]:
            parts[first] = parts[first][1:]
        if first is None or b"" not in parts[first + 1 :]:
            return b"".join(parts).decode("utf-8", "each-byte")
        out, run = [], []  # control pieces, which put nothing, end a run of bytes
        for p in [*parts, b""]:
            if p:
                run.append(p)
            elif run:
                out.append(b"".join(run).decode("utf-8", "each-byte"))
                run = []
        return "".join(out)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", group: int = 400, with_ids: bool = False) -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256 (and ids as an array, decoded as text)."""
    from pyspark.sql import types as T

    def make():
        model = PieceBPE(model_path)

        def work(texts):
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for at in range(0, len(texts), group):
                for ids, decimals in model.encode([t or "" for t in texts[at : at + group]]):
                    row = np.frombuffer(ids, "<i4")
                    text = model.decode(row)
                    n.append(len(row))
                    ids_sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(row)
                        decoded.append(text)
            return [n, ids_sha, text_sha] + ([all_ids, decoded] if with_ids else [])

        return work

    fields = [long("n_tokens"), string("ids_sha256"), string("decoded_sha256")]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), string("decoded")]
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_text_columns(slim, "__text", fields, make).withColumnRenamed("__id", id_col).drop("__text")
