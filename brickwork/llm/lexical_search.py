"""Ranked lexical search by windowed bucket scoring.

The items of the query set go in blocks of bounded size against all documents.
One pass over the texts writes, for each document, how often it holds each term
of the block, its postings; grouped sums over them give the counts of the
corpus. A second pass takes each task's postings in windows of documents in
doc_id order: within a window they are turned by term, each item scatter-adds
its terms' parts of the score into an array that fits the cache, the bitsets of
its terms give the places in use, and those are harvested into the item's heap.
Heaps of all tasks meet in two grouped rankings, the first one salted.

Defined results. Terms are the maximal runs of digits, letters and non-ASCII
characters, with only A-Z lower-cased; a null or empty text has none. Every row
of items is a query of its own, also if its id is null or repeated; one without
terms has no result. Every row of documents counts as a document of its own;
rows without an id count in the corpus but are not returned. Only scores above
0 are returned, ties go to the smaller id. Empty tables give an empty table.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, release_memory, small_batches, text_slices, written

#: A-Z to a-z, what separates terms to a space; bytes of non-ASCII characters stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A longer text is split in pieces of about so many bytes.
PIECE = 1 << 20


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    plain, at = (text or b"").translate(TERMS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _postings(vocabulary: dict[bytes, int]) -> Callable:
    """doc_id, number of terms, and the block's terms with their numbers of occurrences, of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = vocabulary.get, max(1, len(vocabulary))
        for batch in batches:
            for part in text_slices(batch, 1):
                n, keys = np.zeros(part.num_rows, np.int64), [np.zeros(0, np.int64)]
                for row, text in enumerate(part.column(1).to_pylist()):
                    for words in term_lists(text):
                        n[row] += len(words)
                        found = np.fromiter(map(known, words, repeat(-1)), np.int64, len(words))
                        keys.append(found[found >= 0] + row * width)
                keys, tf = np.unique(np.concatenate(keys), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * width).astype(np.int32))
                columns = [part.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array((keys % width).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))
        release_memory()

    return run


class _Window:
    """Postings of a window of documents in doc_id order, by term."""

    def __init__(self, ids, m, slots, terms, tf, weights):
        self.ids, self.size = ids, len(ids)
        order = np.argsort(terms, kind="stable")
        self.slots, terms, tf = slots[order], terms[order], tf[order]
        self.impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.slots]))
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.bits: dict[int, np.ndarray] = {}

    def used(self, term: int) -> np.ndarray:
        """The bitset of the window's documents that hold a term."""
        if term not in self.bits:
            flags = np.zeros(self.size, bool)
            flags[self.slots[self.starts[term] : self.starts[term + 1]]] = True
            self.bits[term] = np.packbits(flags)
        return self.bits[term]


def _scored(items: list[np.ndarray], queries: list[tuple[int, int | None]], weights: np.ndarray, documents: int, length: int, k: int, window: int, most: int) -> Callable:
    """Per task: the k best documents of each item."""

    def taken(held: list[pa.RecordBatch]) -> Iterator[_Window]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, n = np.asarray(table["doc_id"]), np.asarray(table["n"])
        lists, tf = table["terms"].combine_chunks(), np.asarray(table["tf"].combine_chunks().flatten()).astype(np.int64)
        sizes, terms = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
        m = 10 + (90 * n * documents) // length if 90 * int(n.max()) * documents < 2**63 else np.array([10 + 90 * x * documents // length for x in n.tolist()])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        of_posting = np.repeat(place, sizes)
        for at in range(0, len(ids), window):
            inside = (of_posting >= at) & (of_posting < at + window)
            own = order[at : at + window]
            yield _Window(ids[own], m[own], of_posting[inside] - at, terms[inside], tf[inside], weights)

    def harvest(w: _Window, sums: np.ndarray, wanted: np.ndarray, heap: list[tuple[int, int]]) -> None:
        wanted = wanted[w.starts[wanted + 1] > w.starts[wanted]]
        if not len(wanted):
            return
        used = np.zeros(-(-w.size // 8), np.uint8)
        for term in wanted.tolist():
            at = slice(w.starts[term], w.starts[term + 1])
            sums[w.slots[at]] += w.impact[at]  # a document has one posting a term
            used |= w.used(term)
        places = np.flatnonzero(np.unpackbits(used, count=w.size))
        scores = sums[places]
        sums[places] = 0
        least = max(1, heap[0][0]) if len(heap) == k else 1
        good = np.flatnonzero(scores >= least)
        if len(good) > k:
            cut = np.partition(scores[good], len(good) - k)[len(good) - k]
            good = good[scores[good] >= cut]
        for score, doc in zip(scores[good].tolist(), w.ids[places[good]].tolist()):  # by ascending id: of equal scores the first ones stay
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        sums, held, rows, postings = np.zeros(window, np.int64), [], 0, 0

        def score() -> None:
            for w in taken(held):
                for wanted, heap in zip(items, heaps):
                    harvest(w, sums, wanted, heap)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part.column(2).flatten())
                if rows >= window or postings >= most:
                    score()
                    rows, postings = 0, 0
        if held:
            score()
        found = [(*queries[n], -doc, s) for n, heap in enumerate(heaps) for s, doc in sorted(heap, reverse=True)]
        for at in range(0, len(found), 1 << 14):
            columns = list(zip(*found[at : at + (1 << 14)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "item_id", "doc_id", "score"])
        release_memory()

    return run


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, window: int = 16384, block_bytes: int = 16 << 20, most: int = 1 << 22) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    ``block_bytes`` bounds the item texts that a pass serves, ``window`` the
    documents and ``most`` the postings that a task scores at once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    asked = written(asked, "items")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = "item_id long, rank int, doc_id long, score long"
    out, parts = new_path(spark, "ranked"), 0
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).orderBy("q").collect()
        wanted = [sorted({w for words in term_lists(r.text) for w in words}) for r in rows]
        vocabulary = {w: n for n, w in enumerate(sorted({w for words in wanted for w in words}))}
        if not vocabulary:
            continue
        with small_batches(spark):
            postings = written(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "postings")
        documents, length = postings.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pandas().itertuples(index=False):  # one row a term of the block
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        terms = [np.array([vocabulary[w] for w in words], np.int64) for words in wanted]
        score = _scored(terms, [(r.q, r.item_id) for r in rows], weights, documents, length, k, window, most)
        best = postings.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(score, "q long, item_id long, doc_id long, score long")
        best = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        for key in (["q", "salt"], ["q"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        best.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
        parts += 1
    return spark.read.schema(schema).parquet(out) if parts else spark.createDataFrame([], schema)


ORACLE_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS MATERIALIZED (
  SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs), asked AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), terms AS MATERIALIZED (
  SELECT q, item_id, unnest(w) AS t FROM asked
), postings AS MATERIALIZED (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM terms) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, corpus GROUP BY t
), impacts AS MATERIALIZED (
  SELECT r, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS part FROM postings JOIN weights USING (t), corpus
), scored AS (
  SELECT q, item_id, r, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score FROM terms JOIN impacts USING (t) GROUP BY q, item_id, r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
