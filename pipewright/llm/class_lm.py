"""Language-model scores by Brown's class-based bigrams, with exchange clustering.

Every word belongs to one class, and a token costs the probability of its class after the class before
it, times that of the word in its class: P(w | v) = P(c(w) | c(v)) P(w | c(w)). Classes come from
exchange: a word moves to the class where the likelihood of the corpus rises most. Against contexts of
fixed classes that gain depends only on the word's profile (how often each class stands before and
after it) and on a matrix of classes and contexts. So a pass over the corpus gathers the profile of
every word; some rounds of exchange over profiles follow, in each of which words move at once, judged
by the matrix of the round before; and with the new classes as contexts the next pass begins. A round
that doesn't raise the likelihood is taken back. The first pass has the most frequent words as
contexts, each a class of its own.

Words seen less than ``LEAST`` times have a class of their own, which an unknown word shares: it counts
there like one more word, seen as often as there are words seen once. Transitions are smoothed by
``SMOOTHING`` tokens dealt by the classes' frequencies. Probabilities add up to one after any word, over
the known words, the end and one unknown word.

Scale: everything is counted over all training texts, and grows with them. Texts are read and cut
into words once, and become blocks of about ``BLOCK`` tokens: numbers into the block's own sorted list
of word hashes. What a block asks for and what it tells about its words goes to shards of the
vocabulary, ranges of the hash, as one packed row a block and shard; a shard's rows stream through its
task in order, so no task holds them all, and no word is hot, since a block names a word once. The
driver only sees the matrix of classes, whose size is fixed. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm._arrow import arrow_schema, slices
from pipewright.llm._tables import cut, table
from pipewright.llm._words import word_hashes

CLASSES, LEAST, SMOOTHING = 64, 3, 5.0
PASSES, ROUNDS = 2, 3
BLOCK = 2_000_000
MAX_SHARDS = 1 << 14
END = np.uint64(0)  # hash of the end of a text
SMALL = 8  # gains of counts up to this are tabled


class Shape:
    """Numbers of classes: those of exchange, then rare and unknown words, the end, and words without a class as yet."""

    def __init__(self, classes: int):
        self.classes, self.rare, self.end, self.open, self.contexts = classes, classes, classes + 1, classes + 2, classes + 3


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, ids, held, sizes (tokens), codes, words, counts (in training texts) of docs(id, held, text), several texts to a row."""
    schema = f"block long, ids array<{docs.schema['id'].dataType.simpleString()}>, held array<boolean>, sizes array<int>, codes binary, words binary, counts binary"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            nonlocal number
            words, codes = np.unique(np.concatenate(tokens), return_inverse=True)
            size = np.concatenate(sizes)
            flags = pa.chunked_array(held).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(codes[~np.repeat(flags, size)], minlength=len(words)).astype(np.uint32)
            out = _row(shape, number, pa.chunked_array(ids).to_pylist(), flags.tolist(), size.tolist(), _pack(codes.astype(np.uint32)), words.tobytes(), counts.tobytes())
            number += 1
            for x in (ids, held, tokens, sizes):
                x.clear()
            return out

        for batch in slices(batches, "text"):
            hashes, at = word_hashes(batch.column("text").cast(pa.binary()).to_pylist())
            tokens.append(np.insert(hashes, at[1:], END))
            sizes.append(np.diff(at) + 1)
            ids.append(batch.column("id"))
            held.append(batch.column("held"))
            if sum(map(len, tokens)) >= block:
                yield done()
        if ids:
            yield done()

    return cut(docs.select("id", "held", "text").mapInArrow(run, schema))


def _cuts(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits ranges of the hash begins in sorted words, and the end."""
    if not bits:
        return np.array([0, len(words)])
    first = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(words, first), len(words))


ASK = "shard int, kind byte, block long, words binary, counts binary"


def _asks(blocks: DataFrame, bits: int) -> DataFrame:
    shape = arrow_schema(ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = np.frombuffer(row["words"], dtype=np.uint64), np.frombuffer(row["counts"], dtype=np.uint32)
            at = _cuts(words, bits)
            some = np.flatnonzero(np.diff(at))
            n = len(some)
            parts = [(words[at[s] : at[s + 1]].tobytes(), counts[at[s] : at[s + 1]].tobytes()) for s in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.ones(n, dtype=np.int8)), pa.array([row["block"]] * n, pa.int64()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))], schema=shape
            )

    return blocks.select("block", "words", "counts").mapInArrow(run, ASK)


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "kind")


def _added(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, own = np.unique(np.concatenate(words), return_inverse=True)
    return every, np.bincount(own, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def vocabulary(asks: DataFrame, classes: int) -> DataFrame:
    """shard, words (sorted), counts of the training texts, and its totals: known, once, total; tops: its most frequent words."""
    schema = "shard int, words binary, counts binary, known long, once long, total long, tops array<struct<n: bigint, word: bigint>>"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in itertools.groupby(_rows(batches), key=lambda r: r["shard"]):
            words: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for row in rows:
                n = np.frombuffer(row["counts"], dtype=np.uint32)
                words.append(np.frombuffer(row["words"], dtype=np.uint64)[n > 0])
                counts.append(n[n > 0].astype(np.int64))
                if len(words) > 64 and sum(map(len, words[1:])) > len(words[0]):
                    words, counts = ([x] for x in _added(words, counts))
            every, n = _added(words, counts)
            best = [i for i in np.lexsort((every, -n))[: classes + 1].tolist() if every[i] != END][:classes]
            tops = [{"n": int(n[i]), "word": int(every[i : i + 1].view(np.int64)[0])} for i in best]
            yield _row(shape, shard, every.tobytes(), n.tobytes(), len(every), int((n == 1).sum()), int(n.sum()), tops)

    return cut(_by_shard(asks).mapInArrow(run, schema))


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the sorted table, and whether it's there."""
    if not len(table):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return at, table[at] == words


def _replies(asks: DataFrame, shards: DataFrame, kinds: Shape, counted: bool = False) -> DataFrame:
    """block, shard, classes, counts (if counted): what shards(shard, words, counts, moved, classes) know of the words of each ask."""
    schema = "block long, shard int, classes binary, counts binary"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counts = moved = classes = np.empty(0, dtype=np.uint64)
        shard = None
        for row in _rows(batches):
            if row["kind"] == 0 or row["shard"] != shard:
                shard = row["shard"]
                words, counts, moved, classes = (np.frombuffer(row[c] or b"" if row["kind"] == 0 else b"", dtype=t) for c, t in (("words", np.uint64), ("counts", np.int64), ("moved", np.uint64), ("classes", np.uint8)))
            if row["kind"]:
                asked = np.frombuffer(row["words"], dtype=np.uint64)
                packed = None
                if counted:
                    at, there = _found(words, asked)
                    packed = _pack(np.where(there, counts[at] if len(counts) else 0, 0).astype(np.int64))
                at, there = _found(moved, asked)
                own = np.where(there, classes[at] if len(classes) else 0, kinds.rare).astype(np.uint8)
                own[asked == END] = kinds.end
                yield _row(shape, row["block"], shard, own.tobytes(), packed)

    none = F.lit(None).cast("binary")
    known = shards.select("shard", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("block"), "words", "counts", "moved", "classes")
    return _by_shard(known.unionByName(asks.withColumns({"counts": none, "moved": none, "classes": none}))).mapInArrow(run, schema)


def _told(blocks: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """work(block's row, classes, counts of its words, if told) on each block, whose replies meet it by its number."""
    shape = arrow_schema(schema)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        classes = np.frombuffer(b"".join(right.column("classes").to_pylist()), dtype=np.uint8)
        counts = [_unpack(x, np.int64) for x in right.column("counts").to_pylist() if x is not None]
        row = {name: left.column(name)[0].as_py() for name in left.schema.names}
        return pa.Table.from_batches(list(work(row, classes, np.concatenate(counts) if counts else None)), schema=shape)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def _before(codes: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token: the end at the begin of a text."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def profiles(blocks: DataFrame, asks: DataFrame, shards: DataFrame, kinds: Shape, bits: int) -> DataFrame:
    """shard, words, counts, moved, classes, sizes, features, tallies: of each word with ``LEAST`` tokens (moved) its class
    and how often each class stands before it (feature: the class) and after it (contexts + class)."""
    sent = "shard int, kind byte, words binary, sizes binary, features binary, tallies binary"
    sent_shape = arrow_schema(sent)
    width = 2 * kinds.contexts

    def work(row: dict, classes: np.ndarray, counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        words, codes = np.frombuffer(row["words"], dtype=np.uint64), _unpack(row["codes"], np.uint32)
        sizes, held = np.array(row["sizes"], dtype=np.int64), np.array(row["held"], dtype=bool)
        codes, sizes = codes[~np.repeat(held, sizes)].astype(np.int64), sizes[~held]
        own = classes[codes].astype(np.int64)
        moves = (own != kinds.rare) & (own != kinds.end)
        after = np.append(own[1:], kinds.end)
        flat = np.concatenate(((codes * width + _before(own, sizes, kinds.end))[moves], (codes * width + kinds.contexts + after)[moves]))
        cells, tallies = np.unique(flat, return_counts=True)
        word, feature = cells // width, (cells % width).astype(np.uint8)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])
        ends = np.append(first, len(word))
        told = words[word[first]]
        at = _cuts(told, bits)
        for shard in np.flatnonzero(np.diff(at)).tolist():
            a, b = at[shard], at[shard + 1]
            part = slice(ends[a], ends[b])
            yield _row(sent_shape, shard, 1, told[a:b].tobytes(), np.diff(ends[a : b + 1]).astype(np.uint16).tobytes(), _pack(feature[part]), _pack(tallies[part].astype(np.uint32)))

    schema = "shard int, words binary, counts binary, moved binary, classes binary, sizes binary, features binary, tallies binary"
    shape = arrow_schema(schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in itertools.groupby(_rows(batches), key=lambda r: r["shard"]):
            known = next(rows)
            moved = np.frombuffer(known["moved"], dtype=np.uint64)
            dense = np.zeros(len(moved) * width, dtype=np.int64)
            for row in rows:
                at, _ = _found(moved, np.frombuffer(row["words"], dtype=np.uint64))
                cells = np.repeat(at * width, np.frombuffer(row["sizes"], dtype=np.uint16)) + _unpack(row["features"], np.uint8)
                dense[cells] += _unpack(row["tallies"], np.uint32)  # a block names a cell once
            cells = np.flatnonzero(dense)
            sizes = np.bincount(cells // width, minlength=len(moved)).astype(np.uint16)
            yield _row(shape, shard, known["words"], known["counts"], known["moved"], known["classes"], sizes.tobytes(), _pack((cells % width).astype(np.uint8)), _pack(dense[cells]))

    told = _told(blocks.select("block", "held", "sizes", "codes", "words"), _replies(asks, shards, kinds), work, sent)
    none = F.lit(None).cast("binary")
    known = shards.select("shard", F.lit(0).cast("byte").alias("kind"), "words", "counts", "moved", "classes", *(none.alias(c) for c in ("sizes", "features", "tallies")))
    told = told.withColumns({"counts": none, "moved": none, "classes": none})
    return cut(_by_shard(known.unionByName(told)).mapInArrow(gather, schema))


def _summed(df: DataFrame, cells_of, width: int) -> np.ndarray:
    """Sums of the int64 vectors (of ``width``, a fixed number) that cells_of gives for each row of df."""
    schema = "cell int, n long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for row in _rows(batches):
            cells, n = cells_of(row)
            total += np.bincount(cells, weights=n, minlength=width).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], schema=shape)

    out = np.zeros(width, dtype=np.int64)
    for cell, n in df.mapInArrow(run, schema).groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def class_matrix(found: DataFrame, kinds: Shape) -> np.ndarray:
    """How often each class has each feature."""
    width = 2 * kinds.contexts

    def cells_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.frombuffer(row["classes"], dtype=np.uint8), np.frombuffer(row["sizes"], dtype=np.uint16)).astype(np.int64)
        some = own < kinds.classes
        return own[some] * width + _unpack(row["features"], np.uint8)[some], _unpack(row["tallies"], np.int64)[some]

    return _summed(found.select("classes", "sizes", "features", "tallies"), cells_of, kinds.classes * width).reshape(kinds.classes, width)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What of the corpus's log-likelihood depends on the classes, contexts being fixed."""
    half = matrix.shape[1] // 2
    return float(_xlogx(matrix).sum() - _xlogx(matrix[:, :half].sum(axis=1)).sum() - _xlogx(matrix[:, half:].sum(axis=1)).sum())


def best_classes(classes: np.ndarray, sizes: np.ndarray, features: np.ndarray, tallies: np.ndarray, matrix: np.ndarray, portion: int = 1 << 15) -> np.ndarray:
    """The class of each word to which moving it alone, taken out of its own one, raises the likelihood most (ties: the least)."""
    n, width = matrix.shape
    half = width // 2
    known = _xlogx(matrix)
    tabled = np.stack([(_xlogx(matrix + x) - known).T for x in range(1, SMALL + 1)])  # (count, feature, class)
    sides = np.stack([matrix[:, :half].sum(axis=1), matrix[:, half:].sum(axis=1)])
    out = classes.copy()
    ends = np.append(0, np.cumsum(sizes.astype(np.int64)))
    some = np.flatnonzero(sizes)  # words without a profile stay
    for at in np.split(some, np.flatnonzero(np.diff(ends[some] // portion)) + 1) if len(some) else []:
        part = slice(ends[at[0]], ends[at[-1] + 1])
        f, x, first = features[part].astype(np.int64), tallies[part], ends[at] - ends[at[0]]
        word = np.repeat(np.arange(len(at)), sizes[at])
        gain = np.empty((len(f), n))
        small = x <= SMALL
        gain[small] = tabled[x[small] - 1, f[small]]
        large = matrix.T[f[~small]]
        gain[~small] = _xlogx(large + x[~small, None]) - _xlogx(large)
        own = classes[at][word].astype(np.int64)
        inside = np.flatnonzero(own < n)
        held = matrix[own[inside], f[inside]]
        gain[inside, own[inside]] = _xlogx(held) - _xlogx(np.maximum(held - x[inside], 0))
        total = np.add.reduceat(gain, first, axis=0)
        left = f < half
        for side, mask in zip(sides, (left, ~left), strict=True):
            m = np.bincount(word, weights=x * mask, minlength=len(at))[:, None]
            lost = _xlogx(side[None, :] + m) - _xlogx(side[None, :])
            here = np.flatnonzero(classes[at] < n)
            k = classes[at][here].astype(np.int64)
            lost[here, k] = _xlogx(side[k]) - _xlogx(np.maximum(side[k] - m[here, 0], 0))
            total -= lost
        out[at] = np.argmax(total, axis=1)
    return out


def exchanged(found: DataFrame, matrix: np.ndarray, turn: int, kinds: Shape) -> DataFrame:
    """The same profiles with words moved: words without a class, and in turns after the first every other one (by its hash)."""
    shape = arrow_schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            classes, sizes = np.frombuffer(row["classes"], dtype=np.uint8), np.frombuffer(row["sizes"], dtype=np.uint16)
            hashes = np.frombuffer(row["moved"], dtype=np.uint64)
            moves = (classes == kinds.open) | ((hashes & np.uint64(1)) == turn % 2) if turn else np.ones(len(classes), dtype=bool)
            entries = np.repeat(moves, sizes)
            new = classes.copy()
            new[moves] = best_classes(classes[moves], sizes[moves], _unpack(row["features"], np.uint8)[entries], _unpack(row["tallies"], np.int64)[entries], matrix)
            yield _row(shape, *({**row, "classes": new.tobytes()}[f.name] for f in shape))

    return cut(found.mapInArrow(run, found.schema))


def _seeded(shards: DataFrame, kinds: Shape, least: int) -> DataFrame:
    """shards(shard, words, counts, ...) with the words that take part (moved) and the classes of the most frequent ones."""
    best = shards.select(F.explode("tops").alias("t")).orderBy(F.col("t.n").desc(), "t.word").limit(kinds.classes).collect()
    seeds = {np.int64(r["t"]["word"]).view(np.uint64): k for k, r in enumerate(best) if r["t"]["n"] >= least}
    schema = "shard int, words binary, counts binary, moved binary, classes binary"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, counts = np.frombuffer(row["words"], dtype=np.uint64), np.frombuffer(row["counts"], dtype=np.int64)
            moved = words[(counts >= least) & (words != END)]
            classes = np.array([seeds.get(w, kinds.open) for w in moved], dtype=np.uint8)
            yield _row(shape, row["shard"], row["words"], row["counts"], moved.tobytes(), classes.tobytes())

    return cut(shards.select("shard", "words", "counts").mapInArrow(run, schema))


def clustered(blocks: DataFrame, asks: DataFrame, shards: DataFrame, kinds: Shape, bits: int, least: int, passes: int, rounds: int) -> DataFrame:
    """shard, words, counts, moved, classes after exchange."""
    state = _seeded(shards, kinds, least)
    for _ in range(passes):
        found = profiles(blocks, asks, state, kinds, bits)
        matrix = class_matrix(found, kinds)
        for turn in range(rounds):
            tried = exchanged(found, matrix, turn, kinds)
            after = class_matrix(tried, kinds)
            if after.sum() == matrix.sum() and likelihood(after) <= likelihood(matrix):
                break
            found, matrix = tried, after
        state = found.select("shard", "words", "counts", "moved", "classes")
    return state


class Model:
    """Transitions and emissions from counts of pairs of classes; ``once``: the number of words seen once."""

    def __init__(self, pairs: np.ndarray, kinds: Shape, once: int, smoothing: float = SMOOTHING):
        pairs = pairs.astype(float)
        n, rare = pairs.sum(axis=0), kinds.rare
        used = np.append(np.arange(kinds.classes)[n[: kinds.classes] > 0], [rare, kinds.end])
        prior = np.zeros(len(n))
        prior[used] = (n[used] + 1) / (n.sum() + len(used))
        transition = (pairs + smoothing * prior) / (pairs.sum(axis=1)[:, None] + smoothing)
        with np.errstate(divide="ignore"):
            self.transition = np.log10(transition)
            self.unknown = np.log10(max(once, 1))
            n[rare] += max(once, 1)
            self.sizes = np.log10(np.maximum(n, 1))
        self.cells = (self.transition - self.sizes[None, :]).ravel()  # what a pair of classes adds to a text's score


def class_scores(docs: DataFrame, id_column: str, text: str, held_out: str, classes: int = CLASSES, least: int = LEAST, passes: int = PASSES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """id_column, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs.

    Tokens are runs of characters other than space and 0x09-0x0D, A-Z lower-cased, and one end. The model
    learns from the rows whose ``held_out`` is false (null: false) and scores all. score: log10 of the
    text's probability by classes; base_score: by frequencies, sum of log10((c + 1) / (N + V + 1));
    perplexity: 10 ** (-score / n_tokens). A null or blank text is its end alone. Repeated rows and ids
    count as often as they occur; an empty table gives an empty result. If no row is left to learn
    from, N is 0, all words are unknown, and both models give what they give without any count.
    """
    if not 1 <= classes <= 120 or least < 2:
        raise ValueError("from 1 to 120 classes, and words seen once are rare")
    kinds = Shape(classes)
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = blocks_of(source, block)
    bits = min(MAX_SHARDS, max(1, blocks.count()) * 2 - 1).bit_length() - 1
    asks = _asks(blocks, bits)
    shards = vocabulary(asks, classes)
    total = shards.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "once", "total"))).first()
    known, once, tokens = (int(x) for x in total)
    state = clustered(blocks, asks, shards, kinds, bits, least, passes, rounds)
    counted = _counted(blocks, _replies(asks, state, kinds, counted=True), kinds)
    cells = kinds.contexts**2

    def cells_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["cells"], dtype=np.uint16), np.frombuffer(row["tallies"], dtype=np.uint32)

    pairs = _summed(counted.where("NOT held").select("cells", "tallies"), cells_of, cells).reshape(kinds.contexts, -1)
    return _scored(counted, Model(pairs, kinds, once), tokens, known).withColumnsRenamed({"id": id_column, "held": held_out})


COUNTED = "held boolean, n_tokens long, n_known long, logs double, plain double"


def _counted(blocks: DataFrame, replies: DataFrame, kinds: Shape) -> DataFrame:
    """id, held, n_tokens, n_known, logs (of counts), plain (logs of counts + 1), cells and tallies (pairs of classes) of each text."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, {COUNTED}, cells binary, tallies binary"
    shape = arrow_schema(schema)
    width = kinds.contexts

    def work(row: dict, classes: np.ndarray, counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        codes, sizes = _unpack(row["codes"], np.uint32), np.array(row["sizes"], dtype=np.int64)
        own, n = classes[codes].astype(np.int64), counts[codes]
        first = np.cumsum(sizes) - sizes
        known = np.add.reduceat((n > 0).astype(np.int64), first)
        logs = np.add.reduceat(np.log10(np.maximum(n, 1)), first)
        plain = np.add.reduceat(np.log10(n + 1), first)
        text = np.repeat(np.arange(len(sizes)), sizes)
        cells, tallies = np.unique((text * width + _before(own, sizes, kinds.end)) * width + own, return_counts=True)
        at = np.searchsorted(cells, np.arange(len(sizes) + 1) * width * width)
        cells, tallies = (cells % (width * width)).astype(np.uint16), tallies.astype(np.uint32)
        parts = [(cells[a:b].tobytes(), tallies[a:b].tobytes()) for a, b in itertools.pairwise(at.tolist())]
        columns = [row["ids"], row["held"], sizes, known, logs, plain, [p[0] for p in parts], [p[1] for p in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return cut(_told(blocks.select("block", "ids", "held", "sizes", "codes"), replies, work, schema))


def _scored(counted: DataFrame, model: Model, tokens: int, known: int) -> DataFrame:
    kind = counted.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    shape = arrow_schema(schema)
    per_token = float(np.log10(tokens + known + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n_known, logs, plain = (batch.column(c).to_numpy() for c in ("n_tokens", "n_known", "logs", "plain"))
            pairs = [
                float((np.frombuffer(t, dtype=np.uint32) * model.cells[np.frombuffer(c, dtype=np.uint16)]).sum()) for c, t in zip(batch.column("cells").to_pylist(), batch.column("tallies").to_pylist(), strict=True)
            ]
            score = np.array(pairs, dtype=float) + logs + (size - n_known) * model.unknown
            arrays = [pa.array(np.full(len(size), tokens)), pa.array(plain - size * per_token), pa.array(score), pa.array(10 ** np.minimum(-score / np.maximum(size, 1), 300))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "held", "n_tokens", "n_known")), *arrays], schema=shape)

    return counted.mapInArrow(run, schema)


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id as text) mod 7 is 2 are held out. A null doc_id counts as the empty
    text, a null text as empty; an empty table gives an empty result; repeated rows are scored each."""
    docs = table(spark, sf_dir, "documents")
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return class_scores(docs.select("doc_id", "text", (key % 7 == 2).alias("held_out")), "doc_id", "text", "held_out")
