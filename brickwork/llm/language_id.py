"""Language ID: a byte convolutional network trained in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of a fixed length
that cover the whole text. Each window goes through byte embeddings, filters of
several widths, a rectifier, max pooling and a softmax layer. A document's
prediction is the class with the largest mean log-probability over its windows,
weighted by their bytes; its score is the softmax of those means.

Training takes a sample of labelled rows, bounded by ``rows_per_language``, and
a few windows of each.

Defined results. Text that is null or without a letter (category L, so neither
``²`` nor ``①``): ``und``, score 0.
Training rows with null text, null language or no letters are left out; with no
training row at all every text is ``und``. Ties go to the language first in
alphabetical order. Repeated rows count as often as they occur. An empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import double, string, with_text_columns

#: A character of Unicode's category L, as in Spark's regular expressions.
LETTER = regex.compile(r"\p{L}")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Shape:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 6


class ByteCNN:
    """Parameters and passes of the network; all float32."""

    def __init__(self, classes: list[str], shape: Shape = Shape(), seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.shape = classes, shape
        d, wide, n = shape.embedding, max(shape.widths), shape.filters * len(shape.widths)
        self.mask = np.zeros((wide * d, n), np.float32)  # a filter of width w sees the first w bytes
        for k, w in enumerate(shape.widths):
            self.mask[: w * d, k * shape.filters : (k + 1) * shape.filters] = 1
        norm = lambda *size: rng.normal(size=size).astype(np.float32)
        self.params = {
            "embed": norm(256, d) * np.float32(0.5),
            "filter": norm(wide * d, n) * self.mask / np.sqrt(self.mask.sum(0, keepdims=True)),
            "shift": np.zeros(n, np.float32),
            "out": norm(n, len(classes)) * np.float32(0.1),
            "bias": np.zeros(len(classes), np.float32),
        }
        self.params["embed"][0] = 0  # padding

    def patches(self, codes: np.ndarray) -> np.ndarray:
        """(windows, positions, wide * d): the bytes that each filter position sees."""
        n, length = codes.shape
        wide, d = max(self.shape.widths), self.shape.embedding
        padded = np.zeros((n, length + wide - 1, d), np.float32)
        padded[:, :length] = self.params["embed"][codes]
        s = padded.strides
        return np.lib.stride_tricks.as_strided(padded, (n, length, wide * d), (s[0], s[1], s[2]))

    def hidden(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.patches(codes)
        n, length, size = x.shape
        act = (x.reshape(n * length, size) @ self.params["filter"]).reshape(n, length, -1)
        return x, act, act.max(axis=1) + self.params["shift"]

    def log_probabilities(self, codes: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(codes), len(self.classes)), np.float32)
        for at in range(0, len(codes), batch):
            top = np.maximum(self.hidden(codes[at : at + batch])[2], 0)
            z = top @ self.params["out"] + self.params["bias"]
            z -= z.max(axis=1, keepdims=True)
            out[at : at + batch] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, act, pooled = self.hidden(codes)
        n, _, size = x.shape
        d, p = self.shape.embedding, self.params
        top = np.maximum(pooled, 0)
        z = top @ p["out"] + p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), labels] -= 1
        z /= n
        back = (z @ p["out"].T) * (pooled > 0)
        where = act.argmax(axis=1)
        seen = x[np.arange(n)[:, None], where]  # (n, filters, size)
        g_filter = np.einsum("nfs,nf->sf", seen, back) * self.mask
        g_seen = back[:, :, None] * p["filter"].T[None]
        padded = np.concatenate([codes, np.zeros((n, size // d - 1), codes.dtype)], axis=1)
        g_embed = np.zeros_like(p["embed"])
        for k in range(size // d):
            np.add.at(g_embed, padded[np.arange(n)[:, None], where + k], g_seen[:, :, k * d : (k + 1) * d])
        g_embed[0] = 0
        return {"embed": g_embed, "filter": g_filter, "shift": back.sum(0), "out": top.T @ z, "bias": z.sum(0)}

    def train(self, codes: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 0) -> "ByteCNN":
        """Adam on windows; each batch takes the classes alike and cuts windows to random lengths, as texts may be short."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(w) for k, w in self.params.items()}
        for step in range(1, steps + 1):
            of = rng.integers(0, len(by_class), batch)
            rows = np.array([rng.choice(by_class[c]) for c in of])
            x = codes[rows].copy()
            keep = np.where(rng.random(batch) < 0.5, rng.integers(8, x.shape[1] + 1, batch), x.shape[1])
            x[np.arange(x.shape[1])[None] >= keep[:, None]] = 0
            lr = rate * (1 - step / (steps + 1))
            for k, g in self.gradients(x, of).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.params[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all windows of all texts, the number of windows of each text, the bytes in each window."""
        size = self.shape.window
        raw = [(t or "").encode().translate(LOWER) for t in texts]
        count = np.array([-(-len(b) // size) for b in raw], np.int64)
        codes = np.frombuffer(b"".join(b.ljust(c * size, b"\0") for b, c in zip(raw, count.tolist())), np.uint8).reshape(-1, size)
        used = np.full(len(codes), size, np.int64)
        last = np.cumsum(count)[count > 0] - 1
        lengths = np.array([len(b) for b in raw], np.int64)[count > 0]
        used[last] = lengths - (count[count > 0] - 1) * size
        return codes, count, used

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.classes else []
        if at:
            codes, count, used = self.windows([texts[i] for i in at])
            each = self.log_probabilities(codes).astype(np.float64) * used[:, None]
            mean = np.add.reduceat(each, np.cumsum(count) - count, axis=0) / np.add.reduceat(used, np.cumsum(count) - count)[:, None]
            best = mean.argmax(axis=1)
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p = p.max(axis=1) / p.sum(axis=1)
            for i, b, q in zip(at, best.tolist(), p.tolist()):
                lang[i], score[i] = self.classes[b], min(1.0, q)
        return lang, score


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 600, windows_per_row: int = 4, max_languages: int = 10_000, shape: Shape = Shape(), steps: int = 500) -> ByteCNN:
    """Train on a bounded sample of the labelled rows of ``df``.

    Rows are taken by a hash of ``id_col`` at a rate per language that gives
    about ``rows_per_language`` each; only ``windows_per_row`` windows of a row,
    spread over its whole text, reach the driver. Every language is learned;
    more than ``max_languages`` distinct values are an error, as such a column
    hardly holds languages.
    """
    slim = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND t RLIKE '\\\\p{L}'")
    counts = {r.l: r.n for r in slim.groupBy("l").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"{lang_col} has more than {max_languages} values")
    classes = sorted(counts)
    if not classes:
        return ByteCNN([], shape)
    rate = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, rows_per_language / counts[c]))])
    drawn = F.pmod(F.xxhash64("i", F.lit(17), F.when(F.col("i").isNull(), F.col("t"))), F.lit(1_000_000))  # rows without an id by their texts
    drawn = drawn < rate[F.col("l")] * 1_000_000
    index, size = {c: k for k, c in enumerate(classes)}, shape.window

    def cut(batches):
        for pdf in batches:
            out = []
            for text, lang in zip(pdf.t, pdf.l):
                raw = text.encode().translate(LOWER)
                for k in range(min(windows_per_row, -(-len(raw) // size))):
                    at = (len(raw) - size) * k // max(1, windows_per_row - 1) if len(raw) > size else 0
                    out.append((raw[at : at + size].ljust(size, b"\0"), index[lang]))
            yield type(pdf)(out, columns=["w", "c"])

    rows = slim.where(F.col("l").isin(classes)).where(drawn).mapInPandas(cut, "w binary, c int").limit(4 * rows_per_language * windows_per_row * len(classes)).collect()
    rows = sorted((r.c, bytes(r.w)) for r in rows)  # the same order however Spark deals the rows
    if not rows:
        return ByteCNN([], shape)
    labels = np.array([c for c, _ in rows])
    codes = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, size)
    present = np.unique(labels)
    net = ByteCNN([classes[c] for c in present], shape)
    return net.train(codes, np.searchsorted(present, labels), steps)


def with_language(df: DataFrame, net: ByteCNN, text_col: str = "text", lang_field: str = "lang_pred", score_field: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score."""
    return with_text_columns(df, text_col, [string(lang_field), double(score_field)], lambda: lambda texts: list(net.predict(texts)))


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """One row per row: id, held_out, lang_pred, score. Learns only from rows outside the held-out fold (by crc32 of the id)."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    held = F.coalesce(fold == held_fold, F.lit(False))
    net = learn(df.where(~held), text_col, lang_col, id_col)
    slim = df.select(F.col(id_col).alias("__id"), held.alias("held_out"), F.col(text_col).alias("__text"))
    out = with_language(slim, net, "__text")
    return out.withColumnRenamed("__id", id_col).drop("__text")
