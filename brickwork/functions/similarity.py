"""Text similarity in Arrow batches, for names that share a block."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the likeness from which on a search hit is a company.
LEAST_SEQUENCE = 0.92


def sorted_tokens(name: str | None) -> str:
    """Lower-case, other than letters and digits to spaces, words sorted."""
    return " ".join(sorted(re.sub(r"[\W_]+", " ", (name or "").lower()).split()))


def indel_ratio(a: str, b: str) -> int:
    """100 * 2 * longest common subsequence / both lengths, rounded."""
    if not a and not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full  # zeros are the places where the longest common subsequence grows
    for y in b:
        met = rest & places.get(y, 0)
        rest = (rest + met | rest - met) & full
    return round(200 * (len(a) - rest.bit_count()) / (len(a) + len(b)))


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """``indel_ratio`` of many pairs at once: a letter of all right texts at a time against the bits of the left ones.

    Left texts of over 62 letters are compared one by one.
    """
    out = np.zeros(len(left), np.int32)
    long = np.array([len(a) > 62 for a in left], bool)
    for i in np.flatnonzero(long).tolist():
        out[i] = indel_ratio(left[i], right[i])
    at = np.flatnonzero(~long)
    if not len(at):
        return out
    a, a_of = np.unique(np.array([left[i] for i in at.tolist()], object), return_inverse=True)
    b, b_of = np.unique(np.array([right[i] for i in at.tolist()], object), return_inverse=True)
    letters = {c: k for k, c in enumerate(sorted(set("".join(a)) | set("".join(b))), 1)}
    masks = np.zeros((len(a), len(letters) + 1), np.uint64)  # the places of each letter; letter 0 is past the end
    for k, text in enumerate(a):
        for i, c in enumerate(text):
            masks[k, letters[c]] |= np.uint64(1 << i)
    m, n = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    codes = np.zeros((len(b), int(n.max(initial=0))), np.int32)
    for k, text in enumerate(b):
        codes[k, : len(text)] = [letters[c] for c in text]
    full = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    rest, whole = full[a_of], full[a_of]
    for j in range(codes.shape[1]):
        met = rest & masks[a_of, codes[b_of, j]]
        rest = ((rest + met) | (rest - met)) & whole
    total = m[a_of] + n[b_of]
    common = m[a_of] - np.bitwise_count(rest).astype(np.int64)
    out[at] = np.rint(200 * common / np.maximum(total, 1)).astype(np.int32)
    return out


def _trie(texts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of different texts of one length: for each depth the letter of every node, and where the children of each node above begin and end.

    The nodes of the last depth are the texts, in order; they have to be sorted.
    """
    codes = texts.view(np.uint32).reshape(len(texts), -1)
    apart, above, out = np.arange(len(texts)) == 0, np.zeros(1, np.int64), []
    for depth in range(codes.shape[1]):
        apart[1:] |= codes[1:, depth] != codes[:-1, depth]
        first = np.flatnonzero(apart)
        begin = np.searchsorted(first, above)
        out.append((codes[first, depth], begin, np.append(begin[1:], len(first))))
        above = first
    return out


def tries(right: list[str]) -> list[tuple[bool, int, np.ndarray, list]]:
    """For each length: whether texts are read from their end, the length, each text's place in ``right``, and the trie, of the direction with fewer nodes."""
    out, by_length = [], {}
    for at, text in enumerate(right):
        by_length.setdefault(len(text), []).append(at)
    for n, places in by_length.items():
        both = []
        for back in (False, True):
            texts = np.array([right[i][::-1] if back else right[i] for i in places], f"<U{n}")
            order = np.argsort(texts)
            both.append((back, n, np.array(places)[order], _trie(texts[order])))
        out.append(min(both, key=lambda x: sum(len(letters) for letters, _, _ in x[3])))
    return out


#: Nodes that are held at a time; letters times texts whose places are.
MOST_NODES, MOST_PLACES = 1_000_000, 2_000_000


def _walk(masks: np.ndarray, m: np.ndarray, need: np.ndarray, n: int, trie: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left text, leaf, letters in common: all pairs with ``need`` letters in common or more. A branch ends where it lacks more letters than a text may."""
    whole = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    of = np.flatnonzero(need <= np.minimum(m, n))
    node, rest = np.zeros(len(of), np.int64), whole[of]
    common = np.zeros(len(of), np.int64)
    for depth, (letters, begin, end) in enumerate(trie, 1):
        many = end[node] - begin[node]
        if many.sum() > MOST_NODES and len(m) > 1:
            half = len(m) // 2
            a, b = (_walk(masks[x], m[x], need[x], n, trie) for x in (slice(half), slice(half, None)))
            return np.append(a[0], b[0] + half), np.append(a[1], b[1]), np.append(a[2], b[2])
        up = np.repeat(np.arange(len(of)), many)
        node = begin[node][up] + np.arange(len(up)) - (np.cumsum(many) - many)[up]
        of, rest = of[up], rest[up]
        met = rest & masks[of, letters[node]]
        rest = ((rest + met) | (rest - met)) & whole[of]
        common = m[of] - np.bitwise_count(rest).astype(np.int64)
        on = common + (n - depth) >= need[of]
        of, node, rest, common = of[on], node[on], rest[on], common[on]
    return of, node, common


def best_ratios(left: list[str], right: list[str], least: int, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each left text, of 1 to 62 letters, the place of the first of the right ones with the highest ``indel_ratio`` of ``least`` or more, and that score; -1 and 0 without one.

    The right texts are different ones, not empty. They are read as tries, a letter of many branches at a
    time; scores are looked for from the top down, ``step`` points at a time.
    """
    place, score = np.full(len(left), -1, np.int64), np.zeros(len(left), np.int32)
    if not left or not right:
        return place, score
    letters, m = np.array(sorted(set("".join(left)))), np.array([len(t) for t in left])
    codes = letters.view(np.uint32)
    known = []
    for back, n, places, trie in tries(right):
        at = [np.minimum(np.searchsorted(codes, x), len(codes) - 1) for x, _, _ in trie]
        known.append((back, n, places, [(np.where(codes[k] == x, k, len(codes)), begin, end) for k, (x, begin, end) in zip(at, trie)]))
    batch = max(1, min(2048, MOST_PLACES // (len(codes) + 1)))
    for first in range(0, len(left), batch):
        rows = np.arange(first, min(first + batch, len(left)))
        masks = {}
        for back in {x[0] for x in known}:
            masks[back] = np.zeros((len(rows), len(codes) + 1), np.uint64)
            texts = np.array([left[i][::-1] if back else left[i] for i in rows], f"<U{m[rows].max()}").view(np.uint32).reshape(len(rows), -1)
            for i in range(texts.shape[1]):
                has = np.flatnonzero(m[rows] > i)
                masks[back][has, np.searchsorted(codes, texts[has, i])] |= np.uint64(1 << i)
        for floor in [*range(100, least, -step), least]:
            still = np.flatnonzero(place[rows] < 0)
            if not len(still):
                break
            for back, n, places, trie in known:
                enough = np.array([next((k for k in range(1, min(x, n) + 1) if round(200 * k / (x + n)) >= floor), n + 1) for x in range(m.max() + 1)])
                of, leaf, common = _walk(masks[back][still], m[rows[still]], enough[m[rows[still]]], n, trie)
                of, found = rows[still[of]], places[leaf]
                got = np.rint(200 * common / (m[of] + n)).astype(np.int32)
                order = np.lexsort((found, -got, of))
                of, found, got = of[order], found[order], got[order]
                top = np.append(True, of[1:] != of[:-1])[: len(of)]
                of, found, got = of[top], found[top], got[top]
                better = (got > score[of]) | (got == score[of]) & (found < place[of])
                place[of[better]], score[of[better]] = found[better], got[better]
    return place, score


def text_ratio(a: str | Column, b: str | Column) -> Column:
    """``indel_ratio`` of two columns of texts, in batches; null counts as empty."""

    @F.pandas_udf("int")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(indel_ratios(left.fillna("").tolist(), right.fillna("").tolist()))

    return score(a, b)


def _paired(ratio):
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = ratio(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return run


def token_sort_ratio(a: str | Column, b: str | Column) -> Column:
    """Likeness of two names from 0 to 100, whatever the order of their words; null counts as empty."""
    run = _paired(lambda x, y: indel_ratio(sorted_tokens(x), sorted_tokens(y)))

    @F.pandas_udf("int")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return run(left, right)

    return score(a, b)


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """Likeness of two texts from 0 to 1 by matching blocks."""
    run = _paired(lambda x, y: difflib.SequenceMatcher(None, x or "", y or "").ratio())

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return run(left, right)

    return score(a, b)
