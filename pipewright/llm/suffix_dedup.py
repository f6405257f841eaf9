"""Repeated passages by column-wise construction of a multi-document BWT with common prefixes.

The construction aligns the documents of a collection, inserts one symbol per document each round,
from the right to the left, and keeps the suffixes sorted: a round is a stable sort by the new symbol
(the column of the Burrows-Wheeler transform), and the common prefix of neighbours is one more than
the minimum over the range of the round before. Columns are read and written strictly in sequence.

Inserting 100,000-byte documents whole would take 100,000 rounds over everything, so the corpus is
first cut into short strings that keep every match. In each window of ``length`` bytes the ``k``-gram
with the least hash is its anchor. Equal windows have equal anchors at equal places, so only suffixes
that stand at the same distance from equal anchors can share ``length`` bytes, and strings aligned at
their anchors need only be compared column by column. A string is the stretch of all windows with one
anchor (up to 2 * length - k bytes). Anchors that occur once are dropped: a gram whose hash is unique
has no partner. Every other string goes through the rounds, which decide by the bytes themselves;
hashes only say who meets. (Equal strings that follow on each other, in a text with a short period,
are compared byte by byte where they stand, and one of them goes through the rounds.)

Scale: equal texts are one text with a count from the start: what they repeat of each other needs no
rounds, and one of them meets the others' strings. Anchors are counted with partial aggregation, the join back to the occurrences is an equi-join
that AQE splits when an anchor is hot, and texts are shuffled twice, compressed. An anchor with more
than ``group`` strings is dealt over sub-collections. What each of them finds repeated is repeated; one
of each of its different strings goes on to the next level, where an anchor is parted further: a
window has half of its other bytes or more on the left of the anchor, or over half on the right, so
its strings are cut into those two kinds, keyed by the hash of these bytes as well, and keys that
occur once are dropped. After eight levels a key stands for whole windows, so a hot anchor ends in
small groups or in equal strings, of which one a sub-collection goes on. No level drops a match.
A task works off portions of whole groups, in memory: executors must not use local folders, so the
sequential files of the construction are the columns of a portion of ``MAX_COLLECTION`` strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm._arrow import arrow_schema, record_batch, slices
from pipewright.llm._tables import cut, table

LENGTH, GRAM = 200, 40
MAX_COLLECTION = 8192
GROUP = 1024
PORTION = 1 << 18  # bytes of a text hashed at once; 24 bits hold a place in it
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)
_NONE = 255  # no byte of UTF-8


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes (k a multiple of 8) at each place."""
    n = len(data) - k + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k // 8):
        h += words[8 * i : 8 * i + n] * _ODD[i % len(_ODD)]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchored(data: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of documents [bounds[i], bounds[i + 1]) in data: first and last window start, anchor place and anchor hash of each string."""
    if len(data) < length:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    hashes = gram_hashes(data, k)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    places = sliding_min(ranked, length - k + 1) & _PLACE
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    begin, end = bounds[:-1], bounds[1:] - length + 1
    long = end > begin
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, end[long], -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(places)]))
    if not len(starts):
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    at = places[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | np.isin(starts[1:], begin))))
    first, last = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
    return first, last, at[new], hashes[at[new]]


def portions(values: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Concatenated texts with (row, offset in the text, offset in the bytes); longer texts come in overlapping parts."""
    parts: list[bytes] = []
    where: list[tuple[int, int, int]] = []
    total = 0
    for row, value in enumerate(values):
        if len(value) < length:
            continue
        for at in range(0, max(1, len(value) - length + 1), PORTION):
            part = value[at : at + PORTION + length - 1]
            if total + len(part) > 2 * PORTION:
                yield b"".join(parts), where
                parts, where, total = [], [], 0
            where.append((row, at, total))
            parts.append(part)
            total += len(part)
    if parts:
        yield b"".join(parts), where


def _strings(docs: DataFrame, length: int, k: int) -> DataFrame:
    """k1, k2 (of a text), first and last window start, anchor place, anchor hash: one row for each string.

    Where a text repeats itself with a short period, equal strings follow on each other; such a run
    is one row: ``times`` strings, of which the first is given, with window starts up to ``until``."""
    schema = "k1 long, k2 long, first int, last int, place int, anchor long, until int, times long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            values = batch.column("text").cast(pa.binary()).to_pylist()
            for data, where in portions(values, length):
                rows, offsets, begins = (np.array(x, dtype=np.int64) for x in zip(*where, strict=True))
                first, last, place, anchor = anchored(np.frombuffer(data, dtype=np.uint8), np.append(begins, len(data)), length, k)
                alike = (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1) & (last[1:] - first[1:] == last[:-1] - first[:-1]) & (place[1:] - first[1:] == place[:-1] - first[:-1])
                for i in np.flatnonzero(alike).tolist():
                    alike[i] = data[first[i] : last[i] + length] == data[first[i + 1] : last[i + 1] + length]
                begin = np.flatnonzero(np.concatenate(([True], ~alike))) if len(first) else np.empty(0, dtype=np.int64)
                end = np.append(begin[1:], len(first))[: len(begin)]
                first, last, place, anchor, until = first[begin], last[begin], place[begin], anchor[begin], last[end - 1]
                doc = np.searchsorted(begins, first, side="right") - 1
                shift, row = offsets[doc] - begins[doc], rows[doc]
                places = [pa.array((x + shift).astype(np.int32)) for x in (first, last, place)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), *places, pa.array(anchor.view(np.int64)), pa.array((until + shift).astype(np.int32)), pa.array(end - begin)], schema=shape
                )

    return docs.select("k1", "k2", "text").where(F.octet_length("text") >= length).mapInArrow(run, schema)


class Collection:
    """Strings aligned at their anchors; rounds() inserts a symbol of each per round."""

    def __init__(self, strings: list[bytes], before: list[int], length: int, k: int):
        self.length, self.left = length, length - k
        self.width = self.left + length
        n = len(strings)
        self.begin = self.left - np.array(before, dtype=np.int64)
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.columns = np.full((self.width, n), _NONE, dtype=np.uint8)
        for at in range(0, n, 2048):  # the arrays of places are wide: some strings at a time
            own, begin = sizes[at : at + 2048], self.begin[at : at + 2048]
            flat = np.frombuffer(b"".join(strings[at : at + 2048]), dtype=np.uint8)
            row = np.repeat(np.arange(at, at + len(own)), own)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(own) - own - begin, own)
            self.columns[column, row] = flat
        self.last_start = self.begin + sizes - length

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, order of the suffixes that begin there, common prefix of each with the one before)."""
        n = self.columns.shape[1]
        order = np.arange(n)
        common = np.zeros(n + 1, dtype=np.int16)
        for column in range(self.width - 1, -1, -1):
            symbols = self.columns[column][order]
            by = np.argsort(symbols, kind="stable")
            ranked = symbols[by]
            low = np.minimum.reduceat(common, by + 1)
            same = (ranked[1:] == ranked[:-1]) & (ranked[1:] != _NONE)
            common = np.zeros(n + 1, dtype=np.int16)
            common[1:n] = np.where(same, low[:-1] + 1, 0)
            order = order[by]
            yield column, order, common

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (string, first, last) of window starts, counted from the string's begin, whose window another string has too."""
        n = self.columns.shape[1]
        marks = np.zeros((self.left + 2, n), dtype=np.int8)
        for column, order, common in self.rounds():
            if column <= self.left:
                hit = order[np.maximum(common[:n], common[1:]) >= self.length]
                marks[column + 1, hit[(self.begin[hit] <= column) & (column <= self.last_start[hit])]] = 1
        edges = np.diff(np.vstack([np.zeros((1, n), dtype=np.int8), marks[1:], np.zeros((1, n), dtype=np.int8)]), axis=0).T
        string, up = np.nonzero(edges == 1)
        _, down = np.nonzero(edges == -1)
        return string, up - self.begin[string], down - 1 - self.begin[string]


def _text_keys(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)})


def _compressed(df: DataFrame, text: str) -> DataFrame:
    """df with the text as Zstandard bytes in column ``_z``, for a smaller shuffle."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, text):
            packed = [None if v is None else pack(v) for v in batch.column(text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(packed, pa.binary())], names=[*keep, "_z"])

    out = df.select(*keep, text)
    return out.mapInArrow(run, out.select(*keep).withColumn("_z", F.lit(b"")).schema)


STRING = "key long, left int, right int, k1 long, k2 long, first int, before int, string binary"


def _dealt(strings: DataFrame, group: int) -> DataFrame:
    """Strings whose key occurs more than once, each with the number of salts of its key and one of them."""
    counts = cut(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / group).cast("int").alias("salts")))
    return strings.join(counts, "key").withColumn("salt", _salt())


def _salt() -> Column:
    return F.pmod(F.xxhash64("k1", "k2", "first"), F.col("salts")).cast("int")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = GRAM, group: int = GROUP) -> DataFrame:
    """k1, k2 (hashes of a text), spans array<struct<from, to>>: byte ranges, possibly overlapping, whose every window of
    ``length`` bytes also starts elsewhere in docs. Texts without such are absent. Rows with equal texts are one text
    with a count: all of it occurs again, and to other texts it is a single partner."""
    keyed = _text_keys(docs.select(F.col(text).alias("text")), "text").where(F.octet_length("text") >= length)
    copies = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("to")).where("n > 1")
    strings = _strings(keyed, length, k)
    again = cut(  # joined from a table, not below its aggregation: only so can AQE split hot anchors
        strings.withColumn("own", F.xxhash64("k1", "k2", "first")).groupBy("anchor")
        .agg(F.max("times").alias("times"), F.count(F.lit(1)).alias("rows"), (F.min("own") != F.max("own")).alias("meets")).where("meets OR times > 1")
        .select("anchor", F.ceil(F.col("rows") / group).cast("int").alias("salts"), "meets")
    )
    hits = cut(strings.join(again, "anchor").withColumn("salt", _salt()))
    spans = hits.where("times > 1").select("k1", "k2", F.col("first").alias("from"), (F.col("until") + length).alias("to"))
    spans = spans.unionByName(copies.select("k1", "k2", F.lit(0).alias("from"), "to"))
    wanted = hits.where("meets").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "salt", "salts", "first", "last", "place")).alias("wanted"))
    level = _cutouts(_compressed(keyed, "text").dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]), length)
    while True:
        found = cut(_rounds(level, length, k))
        spans = spans.unionByName(found.where("string IS NULL").select("k1", "k2", F.col("first").alias("from"), F.col("to")))
        left = found.where("string IS NOT NULL").drop("to")
        if left.isEmpty():
            return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
        level = _dealt(_parted(left, length, k), group)


def _cutouts(joined: DataFrame, length: int) -> DataFrame:
    schema = f"{STRING}, salt int, salts int"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        total = 0
        for batch in slices(batches, "_z", max_bytes=1 << 20, max_rows=256):
            for z, wanted, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("_z", "wanted", "k1", "k2")), strict=True):
                data = unpack(z)
                for w in wanted:
                    string = data[w["first"] : w["last"] + length]
                    out.append((w["anchor"], 0, 0, k1, k2, w["first"], w["place"] - w["first"], string, w["salt"], w["salts"]))
                    total += len(string)
                    if total > 1 << 20:
                        yield record_batch(zip(*out, strict=True), shape)
                        out, total = [], 0
        if out:
            yield record_batch(zip(*out, strict=True), shape)

    return joined.select("_z", "wanted", "k1", "k2").mapInArrow(run, schema)


def _rounds(strings: DataFrame, length: int, k: int) -> DataFrame:
    """Spans (k1, k2, first, to; string null) of repeated windows, and the different strings of each sub-collection of a key with several."""
    schema = f"{STRING}, to int"
    shape = arrow_schema(schema)
    columns = [*(f.split()[0] for f in STRING.split(", ")), "salt", "salts"]

    def work(rows: list[tuple]) -> Iterator[tuple]:
        string, low, high = Collection([r[7] for r in rows], [r[6] for r in rows], length, k).repeated()
        for i, a, b in zip(string.tolist(), low.tolist(), high.tolist(), strict=True):
            _, _, _, k1, k2, first, *_ = rows[i]
            yield None, None, None, k1, k2, first + a, None, None, first + b + length
        seen = set()
        for r in rows:
            if r[9] > 1 and (own := (r[0], r[8], r[6], r[7])) not in seen:
                seen.add(own)
                yield *r[:8], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in collections_of((r for batch in slices(batches, "string", max_bytes=1 << 20) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))):
            for found in work(rows):
                out.append(found)
                if len(out) >= 8192:
                    yield record_batch(zip(*out, strict=True), shape)
                    out = []
        if out:
            yield record_batch(zip(*out, strict=True), shape)

    dealt = strings.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.select(*columns).mapInArrow(run, schema)


def collections_of(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in portions of about MAX_COLLECTION that end between two groups (key in front, salt last but one)."""
    portion: list[tuple] = []
    for row in rows:
        if len(portion) >= MAX_COLLECTION and (portion[-1][0], portion[-1][-2]) != (row[0], row[-2]):
            yield portion
            portion = []
        portion.append(row)
    if portion:
        yield portion


def parted(row: tuple, length: int, k: int) -> Iterator[tuple]:
    """A string's windows that have at least half of what isn't known to be equal on the left of it, and the others.

    All windows of a key's strings cover the anchor with ``left`` and ``right`` more bytes, which are equal."""
    from xxhash import xxh3_64_intdigest

    key, left, right, k1, k2, first, before, string = row
    rest = length - k - left - right
    if not rest:  # whole windows have one key
        yield row
        return
    half = (rest + 1) // 2
    parting = before - left - half  # the last window with so much on the left
    last = len(string) - length
    for side, low, high, more in (("l", 0, min(last, parting), half), ("r", max(0, parting + 1), last, rest - half + 1)):
        if low <= high:
            begin, end = (before - left - more, before - left) if side == "l" else (before + k + right, before + k + right + more)
            own = xxh3_64_intdigest(b"%d %d %d %s " % (key, left, right, side.encode()) + string[begin:end])
            grown = (left + more, right) if side == "l" else (left, right + more)
            yield own - (1 << 64) if own >> 63 else own, *grown, k1, k2, first + low, before - low, string[low : high + length]


def _parted(strings: DataFrame, length: int, k: int) -> DataFrame:
    shape = arrow_schema(STRING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "string", max_bytes=1 << 20):
            out = [x for row in zip(*(batch.column(f.name).to_pylist() for f in shape), strict=True) for x in parted(row, length, k)]
            if out:
                yield record_batch(zip(*out, strict=True), shape)

    return cut(strings.select(*shape.names).mapInArrow(run, STRING))


def merged_spans(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Sorted, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans cut down to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = GRAM, characters: bool = False, group: int = GROUP) -> DataFrame:
    """docs without the text column, with ``kept`` (binary), ``n_bytes``, ``removed_spans`` (byte ranges of the input).

    Every byte goes that is covered by a ``length``-byte string which also starts anywhere else, in
    another row or the same one; copies count as rows of their own. A null text is treated as empty;
    texts shorter than ``length`` stay whole; an empty table gives an empty result. Rows with equal
    texts, with or without ids, cost no more than one. characters: keep the bytes of characters that are only
    partly covered, so that ``kept`` is valid UTF-8. Columns of docs with the new names are replaced.
    """
    if k % 8 or not 8 <= k <= length:
        raise ValueError("k must be a multiple of 8 up to length")
    if group < 2:
        raise ValueError("a group needs two strings to compare")
    spans = repeated_spans(docs, text, length, k, group)
    keep = [c for c in docs.columns if c not in (text, "kept", "n_bytes", "removed_spans", "k1", "k2", "_z", "spans")]
    keyed = _text_keys(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t")
    joined = _compressed(keyed, "_t").join(spans, ["k1", "k2"], "left").drop("k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        span_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in slices(batches, "_z", max_bytes=1 << 20, max_rows=512):
            kept, sizes, removed = [], [], []
            for z, spans in zip(batch.column("_z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = unpack(z)
                own = merged_spans([(s["from"], s["to"]) for s in spans] if spans else None)
                own = whole_characters(data, own) if characters else own
                edges = [0, *(x for s in own for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
                removed.append([{"from": a, "to": b} for a, b in own])
            arrays = [*(batch.column(c) for c in keep), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, span_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "kept", "n_bytes", "removed_spans"])

    added = {"kept": F.lit(b""), "n_bytes": F.lit(0).cast("long"), "removed_spans": F.lit(None).cast("array<struct<from:int,to:int>>")}
    return joined.select(*keep, "_z", "spans").mapInArrow(run, docs.select(*keep).withColumns(added).schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages. A null text counts as empty; texts under 200 bytes stay whole; copies repeat
    each other, with one id or several; a null doc_id is a row like any other; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without repeated passages; whole characters go, n_chars follows, no row is dropped."""
    out = remove_repeats(docs, characters=True).withColumn("text", F.col("kept").cast("string"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _doubled(length: int) -> str:
    """Hashes of each length-byte string, put together from those of 1, 2, 4 ... bytes."""
    steps, k = ["h1 AS (SELECT r, i, x, hash(x) AS h1 FROM bytes)"], 1
    while 2 * k <= length:
        steps.append(f"h{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) OVER (PARTITION BY r ORDER BY i)) AS h{2 * k} FROM h{k})")
        k *= 2
    parts, at, last = [], 0, k
    while at < length:
        if k <= length - at:
            parts.append(f"lead(h{k}, {at}) OVER (PARTITION BY r ORDER BY i)")
            at += k
        k //= 2
    return ",\n".join([*steps, f"strings AS (SELECT r, i, x, CASE WHEN i <= max(i) OVER (PARTITION BY r) - {length - 1} THEN hash({', '.join(parts)}) END AS w FROM h{last})"])


OP3_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, regexp_extract_all(hex(encode(text)), '..') AS b FROM docs),
bytes AS (SELECT r, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS x FROM split),
{_doubled(LENGTH)},
again AS (SELECT w FROM strings WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
flagged AS (SELECT r, i, x, w IN (SELECT w FROM again) AS hit FROM strings),
covered AS (SELECT r, i, x, coalesce(bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM flagged),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS first FROM covered),
found AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM runs GROUP BY r)
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM docs LEFT JOIN found USING (r)
"""
