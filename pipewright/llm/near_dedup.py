"""Near-duplicates of texts by SuperMinHash signatures, banding, exact verification and union-find.

A document is its set of word shingles. SuperMinHash walks, for every element, a random permutation of
the signature's slots: step q offers the value q + (a uniform fraction) to the q-th slot. A slot keeps
its least value, so a slot filled in step q can only be changed in steps up to q, and a set is done at
the first step after which all its slots are filled: one step for long texts. Equal sets are one node;
from there on, copies cost nothing.

Nodes that agree in all slots of a band meet in a bucket, and every two of a bucket whose similarity
can reach the threshold are either found to be in one component or verified:

* A set's bitmap holds, for each of its bits, whether an odd number of elements hash to it. Two sets
  differ in at least as many elements as their bitmaps do in bits, so bitmaps and sizes bound the
  similarity from above. That bound never rules out a link; only such pairs are passed over.
* A bucket first offers a few links to each node: a maximum spanning tree of the bounds, each node's
  best partners, and those of the bucket's hub. They are verified on the full sets, and union-find
  within partitions plus star contraction between them give components.
* Then buckets that still hold several components name their nodes with a partner in another component
  that the bound allows (nodes, not pairs). The texts of those meet by bucket, and a task goes through
  its pairs row by row, verifying what its own union-find has not joined yet.

So beyond what the bands miss (``bands_for``), no link between different components is lost.

Scale: rows are shuffled as 64-bit band hashes. A bucket with more than ``block`` nodes, or more than
``BLOCK_SHINGLES`` shingles, is dealt over blocks that all hold its hub for the first offers, and for
the rest over a grid of cells, in which each block meets each other; blocks of the bucket's largest
component don't meet among themselves. Only texts of nodes in shared buckets are read again,
compressed; the joins that carry texts are equi-joins that AQE splits. Components are named by the
least id from the start, so no join has a component as its key, and the joins on a node or a hub
spread their rows over salts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm._arrow import arrow_schema, record_batch, slices
from pipewright.llm._tables import cut, table
from pipewright.llm._words import mixed, shingle_sets

SLOTS = 100
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21  # 16 MB of hashes in a block
BEST = 3
LEAST_BITS, MOST_BITS = 256, 1 << 14  # of a bitmap
SALTS = 8  # of joins on a node or a hub
SLICE = 64  # pairs of a row that are verified at once
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures, one row for each non-empty set: (step << 32) + fraction in each slot."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    signature = np.full((len(sets), slots), _UNSET, dtype=np.uint64)
    elements = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(slots):
        draw = mixed(elements ^ np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = step + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(slots - step)).astype(np.int64)
        value = (draw >> np.uint64(32)) | np.uint64(step << 32)
        rows = np.arange(len(elements))
        slot = place if order is None else order[rows, place].astype(np.int64)
        np.minimum.at(signature.reshape(-1), owner * slots + slot, value)
        open_ = (signature == _UNSET).any(axis=1)
        keep = open_[owner]
        if not keep.any():
            break
        if order is None:
            elements, owner, place = elements[keep], owner[keep], place[keep]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
        else:
            order[rows, place] = order[:, step]
            elements, owner, order = elements[keep], owner[keep], order[keep]
            continue
        order[np.arange(len(elements)), place] = 0
        # slot 0 now stands where the drawn one stood; entries up to the step aren't used again
    return signature


def bands_for(threshold: float, slots: int = SLOTS, miss: float = 2e-5) -> int:
    """Slots in a band: as many as leave a link at the threshold unseen with probability ``miss`` at most."""
    best = 1
    for rows in range(1, 9):
        if slots % rows == 0 and (1 - threshold**rows) ** (slots // rows) <= miss:
            best = rows
    return best


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    n, slots = signature.shape
    parts = mixed(signature).reshape(n, slots // rows, rows)
    out = np.zeros((n, slots // rows), dtype=np.uint64)
    for i in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return mixed(out + np.arange(slots // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _signed(docs: DataFrame, words: int, slots: int, rows: int) -> DataFrame:
    """id, t1, t2 (hashes of the text), n_shingles, node (digest of the set; null if empty), bands."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, t1 long, t2 long, n_shingles long, node binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, "text", max_bytes=1 << 19):
            sets = shingle_sets([v or b"" for v in batch.column("text").cast(pa.binary()).to_pylist()], words)
            full = [i for i, s in enumerate(sets) if len(s)]
            node: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                hashes = band_hashes(superminhash([sets[i] for i in full], slots), rows)
                for j, i in enumerate(full):
                    node[i], bands[i] = xxh3_128_digest(sets[i].tobytes()), hashes[j]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "t1", "t2")), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "t1", "t2", "n_shingles", "node", "bands"],
            )

    return docs.mapInArrow(run, schema)


def bitmap(elements: np.ndarray) -> bytes:
    """Parity of the number of elements at each bit; two to four bits for an element, within LEAST_BITS and MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(elements) - 1).bit_length()))
    count = np.bincount((mixed(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of half, a quarter ... of the bits: places are taken modulo the number of bits."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def bounds(bitmaps: list[bytes], sizes: np.ndarray, percent: int, split: int = 0) -> np.ndarray:
    """Upper bounds of the similarity of each with each, or of the first ``split`` with each of the rest.

    -1 where the bound rules a link at ``percent`` out: sets of p and q elements whose bitmaps differ in
    h bits have at most (p + q - h) / 2 elements in common."""
    n, start = split or len(sizes), split
    out = np.full((n, len(sizes) - start), -1, dtype=np.float32)
    widths = np.array([len(b) // 8 for b in bitmaps])
    tables = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        tables[w] = (at, np.frombuffer(b"".join(bitmaps[i] for i in at.tolist()), dtype="<u8").reshape(len(at), w))
    for wl, (rows, left) in tables.items():
        left, rows = left[rows < n], rows[rows < n]
        for wr, (columns, right) in tables.items():
            right, columns = right[columns >= start], columns[columns >= start]
            width = min(wl, wr)
            if not len(rows) or not len(columns):
                continue
            if 100 * min(sizes[rows].max(), sizes[columns].max()) < percent * max(sizes[rows].min(), sizes[columns].min()):
                continue  # all too different in size
            right = _folded(right, width)
            step = max(1, (1 << 20) // (len(columns) * width))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                apart = np.bitwise_count(_folded(left[i : i + step], width)[:, None, :] ^ right[None]).sum(axis=2, dtype=np.int64)
                p, q = sizes[own][:, None], sizes[columns][None]
                fits = (100 * (p + q - apart) >= percent * (p + q + apart)) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q))
                out[np.ix_(own, columns - start)] = np.where(fits, (p + q - apart) / (p + q + apart), -1)
    if not split:
        np.fill_diagonal(out, -1)
    return out


def offered(near: np.ndarray, best: int = BEST) -> set[tuple[int, int]]:
    """Links that ``near`` allows (at least 0) between the members of a block: at most 2 + best for each, a spanning forest among them."""
    n = len(near)
    links: set[tuple[int, int]] = set()
    add = lambda i, others: links.update((min(i, j), max(i, j)) for j in others if near[i, j] >= 0)
    hub = int((near >= 0).sum(axis=1).argmax())
    add(hub, range(n))
    inside = np.zeros(n, dtype=bool)
    inside[hub] = True
    value, parent = near[hub].copy(), np.full(n, hub)
    for _ in range(n - 1):
        value[inside] = -2
        i = int(value.argmax())
        add(i, (int(parent[i]),))
        inside[i] = True
        better = near[i] > value
        value[better], parent[better] = near[i][better], i
    k = min(best, n - 1)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    for i in range(n):
        add(i, top[i].tolist())
    return links


def partners(near: np.ndarray, labels: np.ndarray, whole: np.ndarray, bucket: int, split: int = 0) -> np.ndarray:
    """Members with a partner of another label that ``near`` allows and that they don't meet in an earlier bucket."""
    start, hit = split, np.zeros(len(labels), dtype=bool)
    for i in range(len(near)):
        at = np.flatnonzero((near[i] >= 0) & (labels[start:] != labels[i])) + start
        if len(at):
            common = (whole[at] == whole[i]) & (whole[i] != 0)
            at = at[~common.any(axis=1) | (whole[i][common.argmax(axis=1)] == bucket)]
            hit[at] = True
            hit[i] |= len(at) > 0
    return hit


def linked(sets: list[np.ndarray], near: np.ndarray, labels: np.ndarray, percent: int, split: int = 0) -> Iterator[tuple[int, int]]:
    """Verified links that join what has different labels: a spanning forest of the labels' links, best bounds first in each row."""
    labels, sizes = labels.copy(), np.array([len(s) for s in sets], dtype=np.int64)
    for i in range(len(near)):
        row = near[i].copy()
        if not split:
            row[: i + 1] = -1
        while True:
            at = np.flatnonzero((row >= 0) & (labels[split:] != labels[i]))
            if not len(at):
                break
            at = at[np.argsort(-row[at], kind="stable")[:SLICE]]
            row[at] = -1
            at += split
            elements = np.concatenate([sets[j] for j in at.tolist()])
            place = np.minimum(np.searchsorted(sets[i], elements), sizes[i] - 1)
            common = np.add.reduceat((sets[i][place] == elements).astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
            for j in at[100 * common >= percent * (sizes[i] + sizes[at] - common)].tolist():
                if labels[i] != labels[j]:
                    labels[labels == labels[j]] = labels[i]
                    yield i, j


def _by_cell(members: DataFrame, columns: list[str], work: Callable[[list[tuple], int], Iterator[tuple]], schema: str, heavy: str) -> DataFrame:
    """What ``work`` makes of the rows of each (bucket, low, high), ordered by block, and of how many of them are of block low (0 if it is alone)."""
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = (r for batch in slices(batches, heavy) for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for (_, low, high), group in groupby(rows, itemgetter(0, 1, 2)):
            own = sorted({r[4]: r for r in group}.values(), key=itemgetter(3))
            split = sum(r[3] == low for r in own) if low < high else 0
            if len(own) < 2 or low < high and split in (0, len(own)):
                continue
            for found in work(own, split):
                out.append(found)
                if len(out) >= 20_000:
                    yield record_batch(zip(*out, strict=True), shape)
                    out = []
        if out:
            yield record_batch(zip(*out, strict=True), shape)

    spread = members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return spread.select(*columns).mapInArrow(run, schema)


MEMBER = ["bucket", "low", "high", "block", "node"]


def _offers(members: DataFrame, percent: int) -> DataFrame:
    """members(bucket, low, high, block, node, n, bitmap) -> a, b (nodes): first links to verify."""
    def work(rows: list[tuple], split: int) -> Iterator[tuple]:
        for i, j in offered(bounds([r[6] for r in rows], np.array([r[5] for r in rows]), percent, split)):
            a, b = rows[i][4], rows[j][4]
            yield (a, b) if a < b else (b, a)

    return _by_cell(members, [*MEMBER, "n", "bitmap"], work, "a binary, b binary", "bitmap").distinct()


def _codes(labels: list) -> np.ndarray:
    found: dict = {}
    return np.array([found.setdefault(x, len(found)) for x in labels])


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """members(bucket, low, high, block, node, n, bitmap, whole, label) -> the same places of nodes that may have a link to another label."""
    kind = members.schema["label"].dataType.simpleString()

    def work(rows: list[tuple], split: int) -> Iterator[tuple]:
        near = bounds([r[6] for r in rows], np.array([r[5] for r in rows]), percent, split)
        hit = partners(near, _codes([r[8] for r in rows]), np.array([r[7] for r in rows]), rows[0][0], split)
        for i in np.flatnonzero(hit).tolist():
            yield (*rows[i][:5], rows[i][8])

    schema = f"bucket long, low int, high int, block int, node binary, label {kind}"
    return _by_cell(members, [*MEMBER, "n", "bitmap", "whole", "label"], work, schema, "bitmap")


def _joined(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members(bucket, low, high, block, node, label, z) -> a, b (labels): verified links between labels."""
    kind = members.schema["label"].dataType.simpleString()

    def work(rows: list[tuple], split: int) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sets: list[np.ndarray] = []
        for at in range(0, len(rows), 256):
            sets += shingle_sets([unpack(r[6]) for r in rows[at : at + 256]], words)
        near = bounds([bitmap(s) for s in sets], np.array([len(s) for s in sets]), percent, split)
        for i, j in linked(sets, near, _codes([r[5] for r in rows]), percent, split):
            yield rows[i][5], rows[j][5]

    return _by_cell(members, [*MEMBER, "label", "z"], work, f"a {kind}, b {kind}", "z")


def _grid(members: DataFrame) -> DataFrame:
    """Rows of divided buckets(.., parts) that hold several components, once for each cell (low, high) of blocks that they meet in.

    The largest component of a bucket has blocks of its own, which meet those of the rest alone."""
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"))
    share = F.col("parts") * F.col("top.c") / F.col("all")
    placed = members.drop("block").join(sizes.where("all > top.c"), "bucket").withColumns({
        "inside": F.col("label") == F.col("top.label"), "g": F.ceil(share).cast("int"), "r": F.greatest(F.lit(1), F.ceil(F.col("parts") - share)).cast("int"),
    })
    dealt = F.xxhash64("node", "bucket")
    placed = placed.withColumn("block", F.when(F.col("inside"), F.pmod(dealt, "g")).otherwise(F.col("g") + F.pmod(dealt, "r")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("inside"), F.col("g")).otherwise(0), F.expr("g + r - 1"))))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select(*MEMBER, "n", "bitmap", "whole", "label")


def _verified(offers: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b (ids) of offers(a, b) whose sets have 100 * intersection >= percent * union; texts(node, id, z) are compressed."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "zb", max_bytes=1 << 19, max_rows=256):
            a, b, za, zb = (batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))
            place = {}
            for key, z in zip([*a, *b], [*za, *zb], strict=True):
                place.setdefault(key, z)
            sets = dict(zip(place, shingle_sets([unpack(z) for z in place.values()], words), strict=True))
            hit = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                p, q = sets[x], sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit, pa.int64())) for c in ("ia", "ib")], names=["a", "b"])

    named = lambda c: texts.select(F.col("node").alias(c), F.col("id").alias(f"i{c}"), F.col("z").alias(f"z{c}"))
    both = offers.join(named("b"), "b").join(named("a"), "a")
    return both.select("a", "b", "ia", "ib", "za", "zb").mapInArrow(run, f"a {kind}, b {kind}")


def union_find(links: Iterator[tuple]) -> dict:
    """Of each node that isn't its own root: the root, the least node it is linked with."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for x, y in links:
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def _salted(df: DataFrame) -> DataFrame:
    """df once for each salt, to be joined with rows that are spread over salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the least node of its component, for nodes that are not that themselves.

    Union-find within each partition, then rounds of star contraction until nothing changes; every
    round is aggregations and joins, cut from its lineage. Links of a hub are spread over salts."""
    kind = links.schema["a"].dataType.simpleString()
    shape = arrow_schema(f"a {kind}, b {kind}")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = union_find((x, y) for batch in batches for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        if found:
            yield record_batch(zip(*found.items(), strict=True), shape)

    edges = cut(links.select("a", "b").mapInArrow(local, f"a {kind}, b {kind}"))  # a > b
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a")
        # large star: every larger neighbour goes to the least one
        spread = both.where("a < b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        large = spread.join(_salted(least), ["a", "salt"], "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the smaller neighbours and the node itself go to the least one
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a > b").distinct())
        # a star forest: no node has two parents, and no parent has one
        loose = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = after.select("b").distinct().join(after.select(F.col("a").alias("b")), "b", "left_semi")
        edges = after
        if loose.select("a").unionByName(deep.select(F.col("b").alias("a"))).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 85, words: int = 5, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """id_column, n_shingles (size of the set), component_id (least id that links lead to), kept (id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word
    shingles; with fewer words the whole sequence is one shingle. A null or blank text has an empty
    set and no links. Rows with one id are one document as far as links go, each with its own
    n_shingles; rows without an id link with nothing, have a null component and are kept. Ties and
    repeated rows are told apart by nothing but the id; an empty table gives an empty result.

    Two texts are compared if they meet in a band, which a pair at the threshold misses with a
    probability of ``bands_for``'s miss at most; among those that meet, no link between components is
    lost, whatever the size of a bucket. Shingles and sets are told apart by 64- and 128-bit hashes.
    """
    rows = bands_for(percent / 100, slots)
    source = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), F.col(text).alias("text"))
    signed = cut(_signed(source, words, slots, rows))
    usable = signed.where("node IS NOT NULL AND id IS NOT NULL")
    row = F.min(F.struct("id", "t1", "t2")).alias("row")  # whose text stands for the node
    nodes = cut(usable.groupBy("node").agg(F.min("id").alias("id"), row, F.first("bands").alias("bands"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    exploded = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    parts = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    shared = cut(  # a table, so that AQE can split hot buckets in the join
        exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1").select("bucket", parts)
    )
    met = cut(exploded.join(shared, "bucket").groupBy("bucket", "node").agg(F.max("parts").alias("parts"), F.max("band").alias("band")))
    hub = met.where("parts > 1").groupBy("bucket").agg(F.min("node").alias("node"), F.max("parts").alias("parts"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int").alias("block")
    dealt = met.select("bucket", own, "node", "parts", F.lit(False).alias("lent")).unionByName(
        hub.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "node", "parts", F.lit(True).alias("lent"))
    )
    texts = cut(_texts(source, nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "id", "row.t1", "row.t2"), words))
    # of each node the buckets that it shares, in the order of bands; 0 for others (at most one entry a band)
    listed = met.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(slots // rows - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    known = texts.select("node", "id", "n", "bitmap").join(listed.select("node", places.alias("whole")), "node")
    members = cut(dealt.join(known, "node").select("bucket", "block", "node", "id", "n", "bitmap", "whole", "parts", "lent"))
    alone = {"low": F.col("block"), "high": F.col("block")}

    # an id that stands in several nodes links them
    ids = signed.where("id IS NOT NULL").select("id", "node").distinct()
    several = ids.where("node IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    twice = ids.join(several, "id", "left_semi").join(nodes.select("node", F.col("id").alias("first")), "node")
    links = twice.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = cut(links.unionByName(_verified(cut(_offers(members.withColumns(alone), percent)), texts, words, percent)))
    roots = components(links)

    # pairs of a bucket that are still in several components
    labels = members.where("NOT lent").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root", "id")
    entire = labels.where("parts = 1").withColumns(alone)
    mixed_buckets = entire.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("bucket")
    cells = entire.join(mixed_buckets, "bucket", "left_semi").select(*MEMBER, "n", "bitmap", "whole", "label").unionByName(_grid(labels.where("parts > 1")))
    apart = cut(_apart(cells, percent))
    joined = cut(_joined(apart.join(texts.select("node", "z"), "node"), words, percent))
    if not joined.isEmpty():
        roots = components(links.unionByName(joined))

    named = nodes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("component", F.coalesce("root", "id"))
    named = _salted(named.where("copies > 1 OR component <> id").select("node", "component"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    found = ids.withColumn("salt", salt).join(named, ["node", "salt"], "left").groupBy("id").agg(F.min(F.coalesce("component", "id")).alias("component"))
    out = signed.select("id", "n_shingles").join(found, "id", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _texts(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, id, n (size of its set), bitmap, z (compressed text of a row) of each wanted node(node, id, t1, t2)."""
    keys = ["id", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            packed = [pack(v) for v in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(packed, pa.binary())], names=[*keys, "z"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", max_bytes=1 << 18):
            sets = shingle_sets([unpack(z) for z in batch.column("z").to_pylist()], words)
            sizes, bitmaps = pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), sizes, bitmaps, batch.column("z")], names=["node", "id", "n", "bitmap", "z"])

    kind = source.schema["id"].dataType.simpleString()
    packed = source.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"id {kind}, t1 long, t2 long, z binary")
    # a row's id and text lead to its node alone, however many texts an id has; equal rows become one before they are measured
    joined = packed.join(wanted, keys).select("node", "id", "z").dropDuplicates(["node"])
    return joined.mapInArrow(measured, f"node binary, id {kind}, n long, bitmap binary, z binary")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85. Null and blank texts link with nothing; texts of one doc_id are one document
    as far as links go; a row without a doc_id has no component and is kept; an empty table gives an empty result."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at similarity 0.8 stays: the one with the least doc_id. All rows of a doc_id that stays are kept, and
    those without one; an empty table gives an empty result."""
    found = near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    numbered = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    return numbered.select(*docs.columns)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN ties l ON l.a = r.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM sizes s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
