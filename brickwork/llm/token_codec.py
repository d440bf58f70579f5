"""An adaptive context-mixing range coder for token ids, and its files.

Ids are coded in blocks, each with a model of its own that starts anew, and a
checksum. A block is cut into lanes of consecutive ids that are coded in
lockstep, one numpy lane each; all of them use and teach the block's one model.

An id's probability mixes three predictions: order 0 gives every id seen in the
block its share so far; order 1 and order 2 give theirs to the id that they
expect after the last one and the last two. The three are added with weights
that follow how often each was right at this confidence of both, and the sum
drives one step of the range coder. Ids not seen before share a fourth weight
evenly. Expectations change with every id, shares and weights every few steps.

Only whole numbers and correctly rounded divisions whose result is cut to a
whole number are used, so that any machine decodes alike.

File: ``BWT2``, then pieces, each a 4-byte length and as many bytes: the header
as JSON with the sizes and checksums of the blocks, the document table (ids and
numbers of tokens, compressed, with checksum), the blocks. A block: the number
of 16-bit words of each lane, then the lanes' words.

Defined results of ``write_and_read``. Null or empty text: only the end id. A
null id comes first and stays null; rows with one id follow each other in the
order of their texts' first 64 characters, repeated rows too, over as many files
as they need. Very long texts may reach over several
blocks and make a file larger, never cut. An empty table gives an empty table.
Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, text_slices, written, written_texts
from .word_ids import WordIds

MAGIC = b"BWT2"
#: Coders keep 48 bits and move 16 at a time.
TOP, MASK = 1 << 32, (1 << 48) - 1
LANES, LANE_TOKENS = 4096, 256
WEIGHTS = 256  # parts that the four weights share
SLOTS_2 = 1 << 18  # places of the order-2 table
TEACH_STEPS = 32  # steps at most between changes of shares and weights
MOST_IDS = 1 << 20
#: What a trust of 0 (nothing expected) to 7 loses by a wrong expectation; from 1 down the expected id changes.
LOSS = np.array([0, 0, 1, 2, 2, 3, 3, 4], np.int32)


class Model:
    """One block's predictions for ids below ``alphabet``, used by so many lanes."""

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet = alphabet
        self.slots = 1 << max(17, (4 * alphabet - 1).bit_length())
        self.bits = self.slots.bit_length() - 1 + WEIGHTS.bit_length() - 1
        self.seen = np.zeros(alphabet, np.int64)
        self.edges = np.zeros(alphabet + 1, np.int32)  # order 0: id i has the slots from edges[i] to edges[i + 1]
        self.of_slot = np.zeros(self.slots, np.int32)
        self.expect_1, self.expect_2 = np.zeros(alphabet, np.int32), np.zeros(SLOTS_2, np.int32)  # 8 * id + trust
        self.right = np.zeros(128 * 4, np.int64) + np.tile(np.array([4, 2, 4, 1]), 128)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.cases: list[np.ndarray] = []
        self.weigh()
        self.new[:], self.weight_0[:] = WEIGHTS - 1, 1  # nothing is seen yet

    def weigh(self) -> None:
        """Weights by both trusts and whether both expect the same, from how often each order was right."""
        which = np.arange(128)
        n = self.right.reshape(128, 4).copy()
        n[(which & 56) == 0, 0] = 0  # order 2 expects nothing
        n[((which & 7) == 0) | (which >= 64), 1] = 0  # nor does order 1, or the same
        parts = 1 + n * (WEIGHTS - 4) // n.sum(axis=1, keepdims=True)
        parts[n == 0] = 0
        parts[:, 3] = np.maximum(parts[:, 3], 1)
        parts[:, 2] = WEIGHTS - parts[:, 0] - parts[:, 1] - parts[:, 3]
        self.weight_2, self.weight_1 = ((parts[:, k] * self.slots).astype(np.int32) for k in (0, 1))
        self.weight_0 = parts[:, 2].astype(np.int32)
        self.new = parts[:, 3].astype(np.int32)

    def predict(self, n: int) -> None:
        """Expected ids and weights of the first n lanes."""
        last, before = self.last[:n], self.before[:n]
        self.slot_2 = ((before * np.int32(-1640531535) + last) * np.int32(-2048144777) >> np.int32(9)) & np.int32(SLOTS_2 - 1)
        self.packed_2, self.packed_1 = self.expect_2.take(self.slot_2), self.expect_1.take(last)
        self.id_2, self.id_1 = self.packed_2 >> 3, self.packed_1 >> 3
        self.trust_2, self.trust_1 = self.packed_2 & 7, self.packed_1 & 7
        self.case = (self.trust_2 << 3) + self.trust_1 + ((self.id_2 == self.id_1) << 6)
        self.w2, self.w1, self.w0 = self.weight_2.take(self.case), self.weight_1.take(self.case), self.weight_0.take(self.case)
        new = self.new.take(self.case)
        self.main = new * np.int32(self.slots)  # unseen ids lie before all others
        self.each_new = self.main // np.int32(self.alphabet)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of these ids, one a lane; also notes what was right."""
        low = self.edges.take(ids)
        share = self.edges.take(ids + 1) - low
        is_2, is_1 = self.id_2 == ids, self.id_1 == ids
        width = share * self.w0 + self.w2 * is_2 + self.w1 * is_1
        start = self.main + low * self.w0 + self.w2 * (self.id_2 < ids) + self.w1 * (self.id_1 < ids)
        fresh = np.flatnonzero(width == 0)
        if len(fresh):
            width[fresh] = self.each_new[fresh]
            start[fresh] = ids[fresh] * self.each_new[fresh]
        kind = np.where(is_2 & (self.w2 > 0), 0, np.where(is_1 & (self.w1 > 0), 1, 2 + (share == 0)))
        self.cases.append((self.case << 2) + kind)
        self.is_2, self.is_1 = is_2, is_1
        return start, width

    def find(self, target: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these places, one a lane."""
        at = target - self.main
        lower = self.id_1 < self.id_2
        from_2 = at - (self.edges.take(self.id_2 + 1) * self.w0 + self.w1 * lower)
        from_1 = at - (self.edges.take(self.id_1 + 1) * self.w0 + self.w2 * ~lower)
        beyond_2, beyond_1 = from_2 >= self.w2, from_1 >= self.w1
        slot = (at - self.w2 * beyond_2 - self.w1 * beyond_1) / self.w0
        ids = self.of_slot.take(slot.astype(np.int64), mode="clip")
        ids = np.where((from_1 >= 0) & ~beyond_1, self.id_1, ids)
        ids = np.where((from_2 >= 0) & ~beyond_2, self.id_2, ids)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            ids[fresh] = np.minimum(target[fresh] // self.each_new[fresh], self.alphabet - 1)
        return ids

    def learn(self, ids: np.ndarray) -> None:
        """What follows the last ids is known; of lanes that meet in one place the last one counts."""
        n, anew = len(ids), (ids << 3) + 1
        for table, slot, packed, trust, right in ((self.expect_2, self.slot_2, self.packed_2, self.trust_2, self.is_2), (self.expect_1, self.last[:n], self.packed_1, self.trust_1, self.is_1)):
            wrong = np.where(trust > 1, packed - LOSS.take(trust), anew)
            table[slot] = np.where(right & (trust > 0), np.minimum(packed + 1, packed | 7), wrong)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def teach(self, ids: np.ndarray) -> None:
        """New shares and weights after these ids."""
        self.seen += np.bincount(ids, minlength=self.alphabet)
        self.right += np.bincount(np.concatenate(self.cases), minlength=512)
        self.cases = []
        share = (self.seen * (self.slots - np.count_nonzero(self.seen)) // self.seen.sum() + (self.seen > 0)).astype(np.int32)
        share[self.seen.argmax()] += self.slots - share.sum()
        np.cumsum(share, out=self.edges[1:])
        self.of_slot = np.repeat(np.arange(self.alphabet, dtype=np.int32), share)
        self.weigh()


class Coder:
    """Range coders of the lanes; they move 16-bit words out of ``low`` or into ``value``."""

    def __init__(self, lanes: int):
        self.low, self.range, self.at = np.zeros(lanes, np.int64), np.full(lanes, MASK, np.int64), np.zeros(lanes, np.int64)

    def code(self, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        n = len(start)
        low, rng = self.low[:n], self.range[:n]
        step = rng >> bits
        low += step * start
        np.multiply(step, width, out=rng)
        settled = (low ^ (low + rng)) < TOP
        go = np.flatnonzero(settled | (rng < TOP))
        settled = settled[go]
        while len(go):
            a, r = low[go], rng[go]
            r = np.where(settled, r, -a & (TOP - 1))  # a range that is too short is cut
            self.move(go, a)
            self.at[go] += 1
            a, r = (a << 16) & MASK, (r << 16) & MASK
            low[go], rng[go] = a, r
            settled = (a ^ (a + r)) < TOP
            more = settled | (r < TOP)
            go, settled = go[more], settled[more]


class Encoder(Coder):
    def __init__(self, lanes: int, tokens: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, tokens + tokens // 2 + 32), np.uint16)

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        if at.max() + 8 >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, at] = low >> 32

    def finish(self) -> bytes:
        """One more word a lane lies within its range, as zeros follow it."""
        self.out[np.arange(len(self.at)), self.at] = -(-self.low >> 32)
        self.at += 1
        words = self.out[np.arange(self.out.shape[1]) < self.at[:, None]]
        return self.at.astype("<u2").tobytes() + words.astype("<u2").tobytes()


class Decoder(Coder):
    def __init__(self, data: bytes, lanes: int):
        super().__init__(lanes)
        size = np.frombuffer(data, "<u2", lanes).astype(np.int64)
        self.words = np.frombuffer(data, "<u2", offset=2 * lanes).astype(np.int64)
        self.end = np.cumsum(size)
        if self.end[-1] != len(self.words):
            raise ValueError("a block's lanes are not as long as its bytes")
        self.at = self.end - size
        every = np.arange(lanes)
        self.value = np.zeros(lanes, np.int64)
        for _ in range(3):
            self.value = self.value << 16 | self.word(every)
            self.at += 1

    def word(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        return np.where(at < self.end[lanes], self.words.take(at, mode="clip"), 0)

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.value[lanes] = ((self.value[lanes] << 16) & MASK) | self.word(lanes)

    def target(self, n: int, bits: int) -> np.ndarray:
        """The places that the next ids cover; the quotient of two numbers of at most 48 and 31 bits is cut exactly."""
        return np.minimum((((self.value[:n] - self.low[:n]) & MASK) / (self.range[:n] >> bits)).astype(np.int64), (1 << bits) - 1).astype(np.int32)


def _lanes(n: int) -> tuple[int, int]:
    """How many lanes so many ids make, and of how many ids each but the last."""
    length = -(-n // min(LANES, max(1, n // LANE_TOKENS)))
    return -(-n // length), length


def _steps(n: int) -> Iterator[tuple[int, int, int]]:
    """Step, active lanes, and the first step not yet taught where that is due after this one (else -1)."""
    lanes, length = _lanes(n)
    taught, due = 0, 1
    for t in range(length):
        teach = t + 1 == due
        yield t, lanes - (n - (lanes - 1) * length <= t), taught if teach else -1
        if teach:
            taught, due = due, min(2 * due, due + TEACH_STEPS)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """A block's bytes; ids below ``alphabet``."""
    n = len(ids)
    if not n:
        return b""
    lanes, length = _lanes(n)
    table = np.zeros(lanes * length, np.int32)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, length).T)  # a row is a step
    model, coder = Model(lanes, alphabet), Encoder(lanes, length)
    for t, active, since in _steps(n):
        now = table[t, :active]
        model.predict(active)
        coder.code(*model.interval(now), model.bits)
        model.learn(now)
        if since >= 0:
            model.teach(_between(table, since, t, n))
    return coder.finish()


def decode_block(data: bytes, n: int, alphabet: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.empty(0, np.int32)
    lanes, length = _lanes(n)
    table = np.zeros((length, lanes), np.int32)
    model, coder = Model(lanes, alphabet), Decoder(data, lanes)
    for t, active, since in _steps(n):
        model.predict(active)
        now = model.find(coder.target(active, model.bits))
        coder.code(*model.interval(now), model.bits)
        model.learn(now)
        table[t, :active] = now
        if since >= 0:
            model.teach(_between(table, since, t, n))
    return np.ascontiguousarray(table.T).ravel()[:n]


def _between(table: np.ndarray, since: int, last: int, n: int) -> np.ndarray:
    """The ids of these steps; the last lane may end before."""
    length, lanes = table.shape
    used = n - (lanes - 1) * length
    return table[since : last + 1].ravel() if last < used else np.concatenate([table[since : last + 1, :-1].ravel(), table[since : min(used, last + 1), -1]])


def _piece(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block_tokens: int) -> bytes:
    """A file's bytes: documents in the given order, their ids one after another."""
    if not 0 < block_tokens <= 1 << 26:
        raise ValueError("a block has 1 to 2 ** 26 ids")
    alphabet = int(ids.max()) + 1 if len(ids) else 1
    if alphabet > MOST_IDS:
        raise ValueError(f"ids must be below {MOST_IDS}")
    blocks = [ids[at : at + block_tokens] for at in range(0, len(ids), block_tokens)]
    coded = [encode_block(b, alphabet) for b in blocks]
    table = zlib.compress(json.dumps([doc_ids, counts.tolist()]).encode(), 6)
    header = {"alphabet": alphabet, "blocks": [[len(b), len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4").tobytes())] for b, c in zip(blocks, coded)], "table_crc32": zlib.crc32(table)}
    return MAGIC + _piece(json.dumps(header).encode()) + _piece(table) + b"".join(coded)


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids and token counts, and all token ids; every checksum is held against its block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")

    def piece(at):
        n = int.from_bytes(data[at : at + 4], "little")
        return data[at + 4 : at + 4 + n], at + 4 + n

    head, at = piece(4)
    table, at = piece(at)
    header = json.loads(head)
    if zlib.crc32(table) != header["table_crc32"]:
        raise ValueError("the document table does not match its checksum")
    doc_ids, counts = json.loads(zlib.decompress(table))
    ids = []
    for k, (n, size, of_bytes, of_ids) in enumerate(header["blocks"]):
        coded = data[at : at + size]
        if len(coded) != size or zlib.crc32(coded) != of_bytes:
            raise ValueError(f"block {k} does not match its checksum")
        block = decode_block(coded, n, header["alphabet"])
        if zlib.crc32(block.astype("<u4").tobytes()) != of_ids:
            raise ValueError(f"the ids of block {k} do not match their checksum")
        ids.append(block)
        at += size
    return doc_ids, np.array(counts, np.int64), np.concatenate(ids) if ids else np.empty(0, np.int32)


def write_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_tokens: int = 1 << 21, file_tokens: int = 1 << 23, files: int | None = None) -> tuple[DataFrame, str]:
    """Encode all texts and write files in ascending id order (null first); one row per file: range part, number, path, tokens, documents."""
    spark = df.sparkSession
    folder = new_path(spark, "tokens")

    def write(batches):
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        words, part, number = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        keys, counts, ids, size = [], [], [], 0

        def flush():
            nonlocal keys, counts, ids, size, number
            path = f"{base}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(path, compression=None) as f:
                f.write(pack_file(keys, np.concatenate(counts), np.concatenate(ids), block_tokens))
            row = (part, number, path, size, len(keys))
            keys, counts, ids, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([dict(zip(("part", "number", "path", "tokens", "documents"), row))])

        for batch in batches:
            for piece in text_slices(batch, 1):
                found, ends = words.encode_column(piece.column(1))
                keys += piece.column(0).to_pylist()
                counts.append(np.diff(ends, prepend=0) + 1)
                ids.append(np.insert(found.astype(np.int32), ends, end_id))
                size += len(ids[-1])
                if size >= file_tokens:
                    yield flush()
        if keys:
            yield flush()

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = ["id", "head", "row"]  # rows of one id, or none, go to many tasks, equal ones too
    dealt = docs.withColumns({"head": F.left("text", F.lit(64)), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *place).sortWithinPartitions(*place)
    return written_texts(dealt.select("id", "text").mapInArrow(write, "part long, number long, path string, tokens long, documents long"), "token-files"), folder


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: its id, place among all ids, number of ids, their crc32 (and the ids)."""
    before = F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    placed = written(files.select("path", "part", "number", F.coalesce(before, F.lit(0)).alias("first")), "token-places")
    names = ["id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])

    def read(batches) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with system.open_input_stream(row.path, compression=None) as f:
                    keys, counts, ids = unpack_file(f.read())
                ends = np.cumsum(counts)
                data = ids.astype("<u4").tobytes()
                parts = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                out = [pd.array(keys, "Int64"), row.first + ends - counts, counts, [zlib.crc32(p) for p in parts]] + ([parts] if with_ids else [])
                yield pd.DataFrame(dict(zip(names, out)))

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartitionByRange(n, "part", "number")
    return dealt.mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def write_and_read(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, **options) -> DataFrame:
    """Write all documents' ids and read them back: id, start, n_tokens, ids_crc32. For odd rows see the module's text."""
    files, folder = write_tokens(df, tokenizer, id_col, text_col, end_id, **options)
    return read_tokens(files, folder).withColumnRenamed("id", id_col)
