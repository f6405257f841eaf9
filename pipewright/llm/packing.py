"""Packing token sequences into bins by minimum bin slack over the histogram of lengths.

Documents are tokenized whole; those longer than a bin are cut. What bins hold is decided on the
histogram of piece lengths alone, which has at most ``capacity`` entries however large the corpus is.
For a bin, the longest piece left is set in; a subset-sum dynamic program on a bitset (bit t: total t
can be reached), over the lengths left with their multiplicities, finds the fullest combination for
the rest; and the combination is taken out as many times as the histogram has it. Each such pattern
uses up a length, or leaves fewer of it than the pattern needs, so there are few patterns.

Then pieces of one length are numbered without gaps (counts per length and bucket, running sums over
those, row numbers within a bucket), and the number says which bin and place a piece has. Rows are
shuffled once, without their tokens, and no task sees all pieces of a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pipewright.llm._arrow import slices
from pipewright.llm._tables import cut, table

CAPACITY = 2048
MAX_REMEMBERED = 250_000


class _Odd(Exception):
    """A text with white space that can't be cut at single spaces and line feeds."""


def _byte_signs() -> dict[str, int]:
    """The printable signs that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Ids of whole texts under a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The vocabulary's parts begin at a space that follows other text, and a lone line feed is a part of
    its own. So texts are cut there, and what lies between is encoded once and remembered up to a
    bound. Texts with other runs of white space, or with strings of special tokens, go to the
    library whole."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        signs = _byte_signs()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.parts = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.starts = _Remembered(self, " "), _Remembered(self, "")
        self.line_feed = self.packed("\n")

    def packed(self, text: str) -> bytes:
        return np.array(self.parts.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        try:
            if any(s in text for s in self.special):
                raise _Odd
            out: list[bytes] = []
            word, start, feed = self.words.__getitem__, self.starts, self.line_feed
            lines = text.split("\n")
            for i, line in enumerate(lines):
                if i:
                    out.append(feed)
                parts = line.split(" ")
                if parts[0] or i == 0 or len(parts) == 1 and i < len(lines) - 1:
                    out.append(start[parts[0]])
                if len(parts) > 1:
                    out.extend(map(word, parts[1:]))
            return b"".join(out)
        except _Odd:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class _Remembered(dict):
    def __init__(self, owner: ByteBpe, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        ids = self.owner.packed(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_tokenizers: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole if they fit, else pieces of full capacity after a shorter first one."""
    if n <= capacity:
        return [n]
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs without the text, one row per piece: piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    keep = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode, end = tokenizer(tokenizer_path).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, text):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                data = encode(value or "") + end
                at = 0
                for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + n)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(crc32(part))
                    if with_ids:
                        ids.append(part)
                    at += n
            rows = pa.array(row, pa.int64())
            arrays = [*(batch.column(c).take(rows) for c in keep), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if with_ids else []), names=[*keep, "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else []))

    fields = [T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    out = docs.select(*keep, text)
    return out.mapInArrow(run, T.StructType([*out.select(*keep).schema.fields, *fields]))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiplicities of lengths with the largest total up to room; longer ones are tried first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            after = (reach | reach << (take * length)) & mask
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: multiplicity}) of each pattern, until the histogram is used up."""
    counts = {n: c for n, c in histogram.items() if c}
    plan = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        used = fullest({n: c for n, c in rest.items() if c}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        plan.append((times, used))
        for n, k in used.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
    return plan


def place_table(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, first bin, multiplicity, offset in the bin), sorted by length and number."""
    rows, used, first_bin = [], {}, 0
    for times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.append((length, used.get(length, 0), first_bin, k, offset))
            used[length] = used.get(length, 0) + times * k
            offset += k * length
        first_bin += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, order_by: list[str], capacity: int = CAPACITY, length: str = "length", buckets: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset; pieces must give the same rows when it is read again (a checkpoint or table).

    Every piece has its place, none overlap, and a sequence has no gaps. Lengths must be 1 to
    capacity. order_by, which should identify a row, orders pieces of one length; rows that are equal
    in it take their places in any order. An empty table gives an empty result. Columns named
    sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    buckets = buckets or max(8, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(length, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    if histogram and not (1 <= min(histogram) and max(histogram) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = place_table(plan_bins(histogram, capacity))
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(length, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = (
        dealt.withColumn("_place", F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order_by)))
        .join(starts, [length, "_bucket"])
        .withColumn("_number", F.col("_before") + F.col("_place") - 1)
        .select(*pieces.columns, "_number")
    )
    keep = pieces.columns
    keys = (places[:, 0] << 48) | places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch.column(length).to_numpy(), batch.column("_number").to_numpy()
            row = places[np.searchsorted(keys, (size << 48) | number, side="right") - 1]
            within = number - row[:, 1]
            arrays = [*(batch.column(c) for c in keep), pa.array(row[:, 2] + within // row[:, 3]), pa.array(row[:, 4] + within % row[:, 3] * size)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """id_column, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document.

    A null text is empty and gives the end id alone. Rows may repeat, and ids may be null or clash;
    each row's pieces get places of their own.
    """
    pieces = cut(token_pieces(docs.select(id_column, text), tokenizer_path, end_id, capacity, text))
    return pack(pieces, [id_column, "piece", "start", "ids_crc32"], capacity)


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens. A null text is empty: its token is the 0 at the end. Ids come from a cache of
    words and merges that gives what the tokenizers library gives; rows that repeat an id or a text are packed each, in any order among
    equals; an empty table gives an empty result."""
    packed = pack_documents(table(spark, sf_dir, "documents"), _tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; null texts, repeated rows and empty tables as in op5_packing."""
    return pack_documents(docs, _tokenizer_path())
