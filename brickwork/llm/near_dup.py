"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard check.

Words are runs without white space, A-Z lower-cased; a document's set holds its
distinct shingles of ``width`` consecutive words (64-bit hashes). Two
permutations make all signature coordinates: the first scatters shingles over a
circle of 2^20 places, the second gives each place a rank, and coordinate k is
the least rank over the document's places after a shift by k. So a shingle's
contribution to all coordinates is one contiguous slice of the second
permutation.

1. Documents with equal sets become one representative, the least id.
2. Signatures are cut into bands; representatives that share a band are
   candidates. In every band bucket each member is compared with two hubs, the
   least id and the least salted hash, on full sets. Confirmed links give
   components. That is linear in the bucket's size.
3. Where a bucket still holds several components, its members are compared by
   a bitmap bound: the parities of a set's hashes in 4096 bits; the bits in
   which two sets differ are a lower bound of their symmetric difference, so no
   true link is lost. Members of buckets above ``block`` are compared only
   where they share one of their rarest shingles, of which linked documents
   share one for certain. Pairs that pass are confirmed on full sets. Pairs
   within a component are never listed.

Only the choice of candidates is probabilistic: with 42 bands of 6 coordinates
a pair at a similarity of 0.8 shares none with probability 3e-6.

Defined results. Null or empty text, or text without words: set size 0, own
component. Fewer words than ``width``: the whole sequence is one shingle. A
null id is in no group: component null, kept. Rows with one id count as one
document. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import long, with_text_columns, written, written_texts
from .components import components, hot_above, join_grouped

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PLACES = 1 << 20
BANDS, ROWS = 42, 6
BITMAP = 4096
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX_B
    x = (x ^ (x >> np.uint64(29))) * MIX_A
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * MIX_A + h[k : len(h) - size + 1 + k])
    return np.unique(out)


class Circulant:
    """The two permutations and the bands of a signature."""

    def __init__(self, seed: int = 1):
        ranks = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        coordinates = BANDS * ROWS
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray, chunk: int = 2048) -> np.ndarray:
        places = (_mix(shingles + MIX_B) >> np.uint64(44)).astype(np.int64)
        out = self.shifted[places[:chunk]].min(axis=0)
        for at in range(chunk, len(places), chunk):
            np.minimum(out, self.shifted[places[at : at + chunk]].min(axis=0), out=out)
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; keys of different bands differ."""
        s = self.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = _mix(key * MIX_A + s[:, k])
        return key.view(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of BITMAP places."""
    places = (_mix(shingles ^ MIX_A) % np.uint64(BITMAP)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def linked(n_both, n_a, n_b, percent: int):
    """100 * intersection >= percent * union; for numbers and for columns."""
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, text -> id, n, digest of the set (null where empty), bands."""

    def make():
        hashes, circulant = _WordHashes(), Circulant()

        def work(texts):
            n, digest, bands = [], [], []
            for text in texts:
                s = shingle_set(text, width, hashes)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(circulant.bands(s) if len(s) else None)
            return [n, digest, bands]

        return work

    fields = [long("n"), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return with_text_columns(docs, "text", fields, make).drop("text")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, text -> id, n, shingles, bitmap."""

    def make():
        hashes = _WordHashes()

        def work(texts):
            sets = [shingle_set(t, width, hashes) for t in texts]
            return [[len(s) for s in sets], [s.view(np.int64) for s in sets], [bitmap(s) for s in sets]]

        return work

    fields = [long("n"), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]
    return with_text_columns(docs, "text", fields, make).drop("text")


def _of_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows of ``docs`` with these ids: by broadcast up to a checked number of ids, else by a shuffled join."""
    small = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def _with_set(pairs: DataFrame, sets: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """Pairs joined with the sets of the ids in ``key``; the pairs of hot ids are spread over copies of their set."""
    copies = F.coalesce("copies", F.lit(1))
    side = sets.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.col("shingles").alias(f"s_{key}")).join(F.broadcast(hot), key, "left")
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    dealt = pairs.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(other, F.lit(5)), copies).cast("int")).drop("copies")
    return dealt.join(side, [key, "salt"]).drop("salt")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table that are linked by their full sets."""
    above = hot_above(pairs, pairs.count())
    hot = lambda key: pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > above).select(key, F.ceil(F.col("n") / above).cast("int").alias("copies"))
    both = _with_set(_with_set(pairs, sets, "a", "b", hot("a")), sets, "b", "a", hot("b"))
    both = both.withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(linked(F.col("both"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, component): the rarest shingles of documents (id, component), so many that linked documents share one.

    Two sets of a similarity of p % share at least p % of either, so not all of
    what they share can lie outside the rarest 100 - p % and one more of both.
    Rarity is counted over these documents, ties go by the hash.
    """
    texts = sets.join(members, "id").withColumn("text", F.xxhash64("shingles")).dropDuplicates(["id", "text"])  # an id may come with several
    tokens = written(texts.select("id", "text", "component", "n", F.explode("shingles").alias("key")), "shingles")
    found = tokens.groupBy("key").agg(F.count("*").alias("df"), F.count("*").alias("docs"))
    ranked = join_grouped(tokens, found, "key", "docs", tokens.count())
    place = F.row_number().over(Window.partitionBy("id", "text").orderBy("df", "key"))  # one document's shingles
    first = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1
    return ranked.withColumn("place", place).where((F.col("place") <= first) & (F.col("df") > 1)).select("key", "id", "component")


def _close_pairs(percent: int):
    """Blocks of a bucket, sorted by key -> pairs of different components that the bitmap bound allows."""
    popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def of_run(run: pd.DataFrame):
        x = run.sort_values("id")
        side, comp, n, ids = (x[c].to_numpy() for c in ("block", "component", "n", "id"))
        i, j = int(x["i"].iloc[0]), int(x["j"].iloc[0])
        bits = np.frombuffer(b"".join(x["bits"]), np.uint8).reshape(len(x), -1)
        right = np.flatnonzero(side == j)
        for p in np.flatnonzero(side == i):
            q = right[right > p] if i == j else right
            q = q[(comp[q] != comp[p]) & (ids[q] != ids[p])]
            q = q[100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p])]
            if len(q):
                differ = popcount[bits[q] ^ bits[p]].sum(axis=1, dtype=np.int64)
                q = q[linked((n[q] + n[p] - differ) // 2, n[q], n[p], percent)]  # the most that they can share
                for r in ids[q]:
                    yield (min(ids[p], r), max(ids[p], r))

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            found = [p for s, e in zip(edges, edges[1:]) for p in of_run(pdf.iloc[s:e])]
            rest = pdf.iloc[edges[-1] :]
            if found:
                yield pd.DataFrame(sorted(set(found)), columns=["a", "b"])
        if rest is not None and len(rest):
            found = list(of_run(rest))
            if found:
                yield pd.DataFrame(sorted(set(found)), columns=["a", "b"])

    return run


def _mixed(placed: DataFrame, rows: int, block: int) -> DataFrame:
    """Of ``rows`` rows (key, id, component), those of keys with several components, and in how many blocks a key's are compared."""
    groups = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return join_grouped(placed, groups.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"), "size"), "key", "size", rows)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = 1024, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written_texts(_sketches(docs, width), "sketches")
    reps = written(sketches.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rid"), F.min_by("bands", "id").alias("bands"), F.count("*").alias("copies")), "representatives")

    members = reps.select(F.col("rid").alias("id"), F.explode("bands").alias("key"))
    salted = F.xxhash64("id", F.lit(7))
    buckets = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.min(F.struct(salted.alias("h"), "id")).alias("second"), F.count("*").alias("size")).where("hub < last").select("key", "hub", F.col("second.id").alias("hub2"), "size")
    shared = written(join_grouped(members, buckets, "key", "size", BANDS * reps.count()), "buckets")

    stars = shared.select("id", F.explode(F.array("hub", "hub2")).alias("h")).where("id <> h")
    stars = written(stars.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct(), "stars")
    ids = written(shared.select("id").distinct(), "candidates")
    sets = written_texts(_sets(_of_ids(docs, ids, broadcast_rows), width), "sets")
    links = written(_confirm(stars, sets, percent), "confirmed")
    first = components(links, "a", "b")

    placed = shared.select("key", "id").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "placed")
    rest = _mixed(placed, placed.count(), block)
    large = written(rest.where("blocks > 1").select("id", "component").distinct(), "look-alikes")
    rest = rest.where("blocks = 1")
    if not large.isEmpty():  # buckets too large for a comparison of their members: only those that share a rare shingle
        rare = written(_rare_shingles(large, sets, percent), "rare")
        rest = rest.unionByName(_mixed(rare, rare.count(), block))
    rest = rest.join(sets.select("id", "n", "bits"), "id")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n", "bits")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    close = rest.mapInPandas(_close_pairs(percent), "a long, b long").distinct()
    more = written(_confirm(written(close, "close"), sets, percent), "confirmed-late")
    label = first
    if not more.isEmpty():
        label = components(links.unionByName(more), "a", "b")

    rid = reps.select("digest", "rid", "copies").join(label.withColumnRenamed("node", "rid"), "rid", "left")
    rid = written(rid.select("digest", "copies", F.coalesce("component", "rid").alias("group")), "labels")  # read twice
    slim, grouped = sketches.select("id", "n", "digest"), F.col("digest").isNotNull() & F.col("id").isNotNull()
    out = join_grouped(slim.where(grouped), rid, "digest", "copies", rid.agg(F.sum("copies")).first()[0] or 0)
    out = out.unionByName(slim.where(~grouped).withColumn("group", F.lit(None).cast("long")))  # without words or an id: in no group
    component = F.when(F.col("id").isNotNull(), F.coalesce("group", "id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
