"""Spelling variants of words: deletion keys by rolling hashes, grouping by sorted keys, checked on strings.

Two words are near if one inserted, deleted or replaced code point makes one of the other. If a place
is left out of a word, what remains is the concatenation of a prefix and a suffix, so its polynomial
hash is put together from two running sums: the keys of all places of all words of a batch are a few
NumPy operations on 64-bit integers. Near words meet at keys of three kinds:

* ``replaced``: remainder and place. Two words of one length that differ in one place, and only such,
  have the same remainder at the same place, and at no other: each pair meets once.
* ``short``: the word itself, and ``long``: the remainders of a word, each once (of a run of equal code
  points, leaving out the first one). A word meets those with one more code point, each once.

Keys are dealt over partitions by their hash and sorted there; whatever shares a key is compared as
strings, so a collision of hashes costs a comparison and nothing else. A replaced place can hold as
many letters as there are in the alphabet, and a word has at most (length + 1) x letters longer
neighbours, so no key is hot, however often its words occur. Members of a key don't form pairs: each
gets their number and the best of the others, and both are added up by word.

Rows of keys carry the word. For words of over ``LONG`` code points, whose rows would grow with the
square of their length, keys are first counted alone; only those that occur twice bring the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm._arrow import arrow_schema, slices
from pipewright.llm._tables import cut, table
from pipewright.llm._words import mixed

LONG = 64
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPOS = 7, 2, 10, 31
MAX_KEYS = 1 << 18  # keys made or compared at once
_LETTER = rb"(?:[a-z]|\xC3[\x80-\xBF])"  # a-z and U+00C0 to U+00FF in UTF-8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KINDS = np.array([0x632BE59BD9B4E019, 0xD1B54A32D192ED03], dtype=np.uint64)


def without(word: bytes, at: int) -> bytes:
    """The word (UTF-8) without the code point at this place."""
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def _counts(docs: DataFrame, id_column: str, text: str, least: int, typos: int) -> DataFrame:
    """word, n: what the texts hold, with one code point deleted where the CRC of id and word is divisible by ``typos``."""
    run_of = re.compile(_LETTER + b"{%d,}" % least)
    shape = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total: Counter[bytes] = Counter()
            for key, value in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if value is None:
                    continue
                began = zlib.crc32(key.encode() + b":")
                for word, n in Counter(run_of.findall(value.lower())).items():  # bytes: lower() is that of A-Z alone
                    crc = zlib.crc32(word, began)
                    if crc % typos == 0:
                        length = len(word.decode())
                        if length == least:
                            continue
                        word = without(word, crc % length)
                    total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], schema=shape)

    keyed = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, place, kind) arrays; kind 0: replaced, 1: short (place -1), 2: long."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    total = len(codes)
    up = np.full(total + 1, _BASE, dtype=np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(mixed(codes + np.uint64(1)) * up[:total], out=sums[1:])
    own = np.repeat(np.arange(len(words)), sizes)
    begin = ends - sizes
    down = np.full(total + 1, _INVERSE, dtype=np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    at = np.arange(total)
    prefix, suffix = sums[at] - sums[begin[own]], sums[ends[own]] - sums[at + 1]
    rest = (prefix + suffix * np.uint64(_INVERSE)) * down[begin[own]]
    whole = (sums[ends] - sums[begin]) * down[begin]
    place = at - begin[own]
    fresh = np.concatenate(([True], codes[1:] != codes[:-1]))[:total] | (place == 0)
    rest_size = (sizes[own] - 1).astype(np.uint64)
    replaced = mixed(rest + mixed(place.astype(np.uint64) * _KINDS[0] + rest_size))
    longer = mixed(rest + mixed(_KINDS[1] + rest_size))[fresh]
    short = mixed(whole + mixed(_KINDS[1] + sizes.astype(np.uint64)))
    keys = np.concatenate((replaced, short, longer))
    kinds = np.repeat(np.array([0, 1, 2], dtype=np.int8), (total, len(words), len(longer)))
    return keys.view(np.int64), np.concatenate((own, np.arange(len(words)), own[fresh])), np.concatenate((place, np.full(len(words), -1), place[fresh])), kinds


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (word, ...) in portions of about MAX_KEYS keys."""
    for batch in batches:
        sizes = np.array([2 * len(w) + 1 for w in batch.column("word").to_pylist()], dtype=np.int64)
        portion = np.cumsum(sizes) // MAX_KEYS
        for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(portion)) + 1):
            if len(at):
                yield batch.slice(int(at[0]), len(at))


def _keyed(words: DataFrame) -> DataFrame:
    """key, place, kind, word, n of all places of words(word, n)."""
    schema = "key long, place int, kind byte, word string, n long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            keys, own, place, kind = deletion_keys(batch.column("word").to_pylist())
            rows = batch.take(pa.array(own))
            arrays = [pa.array(keys), pa.array(place.astype(np.int32)), pa.array(kind), rows.column("word"), rows.column("n")]
            yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return words.select("word", "n").mapInArrow(run, schema)


def _keyed_long(words: DataFrame, long: int) -> DataFrame:
    """The same rows of words of over ``long`` code points, but only those whose key occurs twice; no row holds a word before that."""
    schema = "key long, place int, kind byte, ref long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            keys, own, place, kind = deletion_keys(batch.column("word").to_pylist())
            for at in range(0, len(keys), MAX_KEYS):
                part = slice(at, at + MAX_KEYS)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(place[part].astype(np.int32)), pa.array(kind[part]), batch.column("ref").take(pa.array(own[part]))], schema=shape)

    named = words.where(F.length("word") >= long).withColumn("ref", F.xxhash64("word"))
    keys = cut(named.select("word", "ref").mapInArrow(run, schema))
    again = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return keys.join(again, "key").join(named.where(F.length("word") > long), "ref").select("key", "place", "kind", "word", "n")


def _met(keyed: DataFrame) -> DataFrame:
    """word, near (how many words it meets), best (struct<n, form>: n negative, so that the least is the best)."""
    schema = "word string, near long, n long, form string"
    shape = arrow_schema(schema)

    def groups(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        shared = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        rows = batch.take(pa.array(shared))
        columns = (rows.column(c).to_pylist() for c in ("key", "place", "kind", "word", "n"))
        out: list[tuple] = []
        here: dict[tuple, list[tuple]] = {}
        last = None
        for k, place, kind, word, n in zip(*columns, strict=True):
            if k != last:
                _compared(here, out)
                here, last = {}, k
            rest = word if kind == 1 else word[:place] + word[place + 1 :]
            here.setdefault((rest, place if kind == 0 else -1), []).append((-n, word, kind))
        _compared(here, out)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 4, shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last key may go on in the next batch
        for batch in batches:
            if kept is not None:
                batch = pa.concat_batches([kept, batch])
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield groups(batch.slice(0, whole))
            kept = batch.slice(whole)
        if kept is not None:
            yield groups(kept)

    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    return met.select("word", "near", F.struct("n", "form").alias("best"))


def _compared(met: dict[tuple, list[tuple]], out: list[tuple]) -> None:
    """Of words with an equal remainder: (word, number of near ones, -n and text of the best of these)."""
    for (_, place), members in met.items():
        if len(members) == 1:
            continue
        if place >= 0:
            best, second = sorted(members)[:2]
            out += [(m[1], len(members) - 1, *(second if m is best else best)[:2]) for m in members]
        else:
            shorter = [m for m in members if m[2] == 1]
            longer = [m for m in members if m[2] == 2]
            if shorter and longer:
                [short] = shorter
                out.append((short[1], len(longer), *min(longer)[:2]))
                out += [(m[1], 1, *short[:2]) for m in longer]


def spelling_variants(words: DataFrame, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """word, n, form, root, form_n, n_near of words(word, n): distinct words and how often they occur.

    n_near: how many of the words differ from it by one inserted, deleted or replaced code point. form:
    of those the one with the largest n (ties: the least in code-point order), if that is at least
    ``ratio`` times the word's n; else null, as is form_n. root: the last of the forms that lead on from
    the word, itself if there is none; n grows on the way, so ways end. An empty table gives an empty
    result; words of any length are compared whole. Null or repeated words raise no error and give
    undefined rows: group them first.
    """
    short_keys = _keyed(words.where(F.length("word") <= long))
    met = _met(short_keys.unionByName(_keyed_long(words, long)))
    none = F.lit(None).cast("struct<n:bigint,form:string>")
    rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")).unionByName(met.select("word", F.lit(None).cast("long").alias("n"), "near", "best"))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    has_form = -F.col("best.n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", "n_near", F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n")))
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # pointers double: as many rounds as the logarithm of the longest way
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut(links.join(on, "root", "left"))
        links = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further IS NOT NULL").isEmpty():
            break
    return found.join(links, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "form_n", "n_near")


def words_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typos: int = TYPOS) -> DataFrame:
    """word, n: distinct words of at least ``least`` code points with at least ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. In those whose CRC with the id (`id:word`,
    a null id counts as the empty text) is divisible by ``typos``, one code point is deleted. A null text has no words."""
    return _counts(docs, id_column, text, least, typos).where(F.col("n") >= least_count)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents. Null and empty texts have no words, a null doc_id counts as the empty
    text, rows that repeat a document count as often as they occur; an empty table gives an empty result."""
    words = cut(words_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The CRC is taken byte by byte over a table of 256 remainders; words meet at their remainders, as strings.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT unnest(range(256)) AS n),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t FROM bits),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT k, run, count(*) AS c FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT run, c, CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda p: CAST('0x' || p AS BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) AS BIGINT) AS h
  FROM counted, crc_table WHERE length(run) >= 7),
results AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
rests AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
longer AS (SELECT DISTINCT word, n, rest FROM rests),
pairs AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT w.word, w.n, l.word, l.n FROM words w JOIN longer l ON l.rest = w.word
  UNION ALL SELECT l.word, l.n, w.word, w.n FROM words w JOIN longer l ON l.rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, max(bn) AS top, arg_min(b, (-bn, encode(b))) AS form FROM pairs GROUP BY a),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN form END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way(word, here) AS (SELECT word, word FROM found UNION ALL SELECT way.word, f.form FROM way JOIN found f ON f.word = way.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n
FROM found f JOIN way w ON w.word = f.word JOIN found last ON last.word = w.here AND last.form IS NULL
"""
