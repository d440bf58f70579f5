"""Best-fit packing: hierarchical residual packing of documents into sequences.

Documents are tokenized and cut; pieces of the full length are sequences of
their own. Each partition packs its other pieces best-fit, largest first.
Nearly full bins are done. The underfull ones of all partitions become items of
their fill: groups of partitions pack them best-fit again, and groups of groups
again, until one group is left or a round no longer saves bins. A group never
holds more than ``group_bins`` bins; beyond that there are more groups.

Defined results. Null text: like the empty text, the end id alone. A document
longer than a sequence is cut into full pieces, the first may be shorter.
Repeated rows are packed as often as they occur; a null id is carried. An empty
table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release_memory, text_slices, written, written_texts
from .word_ids import WordIds


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin.

    Open bins stand by their free room; the smallest room that fits is the
    lowest set bit of a mask.
    """
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            of = by_room[free].pop()
            if not by_room[free]:
                mask ^= 1 << free
        else:
            of, free = len(fill), room
            fill.append(0)
        where[item], offset[item] = of, fill[of]
        fill[of] += size
        free -= size
        if free:
            by_room[free].append(of)
            mask |= 1 << free
    return where, offset, fill


PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
PLACE = [T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())]


def _pack_local(tokenizer: str, room: int, end_id: int, schema: T.StructType, pack_rows: int):
    """Tokenize, cut and pack one partition; bins of a partition are numbered from its own range."""
    end, types, with_ids = np.array([end_id], "<u4").tobytes(), list(to_arrow_schema(schema).types), "ids" in schema.names

    def run(batches):
        from pyspark import TaskContext

        words = WordIds(tokenizer)
        next_bin = TaskContext.get().partitionId() << 36
        rows = []

        def packed():
            nonlocal next_bin, rows
            *columns, length, crc, ids = map(list, zip(*rows))
            rows = []
            sizes = np.array(length, np.int64)
            full = sizes == room
            where, offset, fill = best_fit(sizes[~full], room)
            bins, offsets, fills = (np.zeros(len(sizes), np.int64) for _ in range(3))
            bins[~full], offsets[~full], fills[~full] = where, offset, np.array(fill, np.int64)[where] if len(fill) else 0
            bins[full], fills[full] = len(fill) + np.arange(full.sum()), room
            columns += [length, crc, *([ids] if with_ids else []), bins + next_bin, offsets, fills]
            next_bin += len(fill) + int(full.sum())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            for part in text_slices(batch, 1):
                flat, ends = words.encode_column(part.column(1))
                stops = ends.tolist()
                for key, start, stop in zip(part.column(0).to_pylist(), [0, *stops], stops):
                    ids = flat[start:stop].astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % room or room, n + 1, room)] if n > room else [0, n]
                    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                        data = ids[4 * low : 4 * high]
                        rows.append((key, k, low, high - low, zlib.crc32(data), data if with_ids else None))
            if len(rows) >= pack_rows:
                yield packed()
        if rows:
            yield packed()
        words = None
        release_memory()

    return run


def _merge_groups(room: int):
    """Best-fit of the bins of one group as items of their fill: bin -> parent, shift, fill of the parent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ignore_index=True)
        where, offset, fill = best_fit(pdf["fill"].to_numpy(np.int64), room)
        names = np.zeros(len(fill), np.int64)
        names[where[::-1]] = pdf["bin"].to_numpy()[::-1]  # a parent is named after one of its bins
        return pd.DataFrame({"bin": pdf["bin"], "parent": names[where], "shift": offset, "filled": np.array(fill, np.int64)[where]})

    return run


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 1024, end_id: int = 2, slack: int = 0, fan_in: int = 8, group_bins: int = 100_000, with_ids: bool = False, pack_rows: int = 400_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids as bytes)."""
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([T.StructField("id", id_type), *PIECE, *ids, *PLACE])
    pieces = written_texts(docs.mapInArrow(_pack_local(tokenizer, room, end_id, schema, pack_rows), schema), "pieces")

    # bins that still have room, with the group that they come from
    bins = pieces.where(F.col("fill") < room - slack).groupBy("bin").agg(F.first("fill").alias("fill"))
    bins = written(bins.withColumn("group", F.shiftright("bin", 36)), "bins")
    final = None
    groups, n = bins.agg(F.count_distinct("group"), F.count("*")).first()
    while n:
        groups = max(math.ceil(groups / fan_in), math.ceil(n / group_bins))
        dealt = bins.select("bin", "fill", F.pmod(F.col("group") if n <= groups * group_bins / 2 else F.xxhash64("bin"), F.lit(groups)).alias("group"))
        step = written(dealt.groupBy("group").applyInPandas(_merge_groups(room), "bin long, parent long, shift long, filled long"), "merge")
        final = step if final is None else written(
            final.withColumnRenamed("parent", "via").withColumnRenamed("shift", "before").join(step.select(F.col("bin").alias("via"), "parent", "shift", F.col("filled").alias("now")), "via", "left")
            .select("bin", F.coalesce("parent", "via").alias("parent"), (F.col("before") + F.coalesce("shift", F.lit(0))).alias("shift"), F.coalesce("now", "filled").alias("filled")),
            "places",
        )
        bins = written(step.where(F.col("filled") < room - slack).groupBy(F.col("parent").alias("bin")).agg(F.first("filled").alias("fill")).withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(max(1, groups)))), "bins")
        before, n = n, bins.count()
        if groups == 1 or n > 0.99 * before and groups <= math.ceil(n / group_bins):
            break
    out = pieces
    if final is not None:
        out = pieces.join(final.select("bin", "parent", "shift"), "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("parent", "bin"))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """From ``pack_documents(..., with_ids=True)``: one row per sequence with its ids as bytes and its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's tokens
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.aggregate(F.transform("parts", lambda p: p.ids), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
