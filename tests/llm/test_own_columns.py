"""The columns of op5, op6 and op9 themselves against the libraries and plain Python, on awkward rows and on a whole table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipewright.llm import fingerprint, packing, piece_codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All documents of the smallest table, and awkward ones: null and empty texts, a null id, long words and texts, copies."""
    path = str(tmp_path_factory.mktemp("own"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [None, "", " ", "one", "x" * 30_000, "word " * 9000, "é 中文 🙂 \x00 <s> </s>", "  two  spaces\n\n", "▁▁ a", "same same"] + ["same same"] * 20
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (10**9, "again under one id")], "doc_id long, text string")
    docs.unionByName(odd).repartition(4).withColumns({c: F.lit("own") for c in ("piece", "length", "ids", "decoded", "piece_ids")}).write.parquet(f"{path}/documents.parquet")
    return path


def test_op5_columns(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) - (math.ceil(len(ids) / 2048) - 1) * 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = packing.op5_packing(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) == math.ceil(total / 2048)  # no packing has fewer


def test_op9_columns(spark, folder):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        packed = np.array(ids, dtype="<u4").tobytes()
        want[r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = piece_codec.op9_piece_codec(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def plain_print(spark, texts):
    """Of each text (n, words, signs) from the hashes of its paragraphs, summed in Python; and the likeness of two of them."""
    parts = {t: [p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p] for t in texts}
    every = sorted({p for own in parts.values() for p in own})
    rows = spark.createDataFrame([(p,) for p in every], "p string").select("p", F.xxhash64("p").alias("a"), F.xxhash64(F.lit("second"), "p").alias("b"))
    lanes = {r["p"]: (r["a"], r["words"]) for r in rows.select("p", "a", F.array(*(F.xxhash64("a", "b", F.lit(i)) for i in range(8))).alias("words")).collect()}
    out = {}
    for t, own in parts.items():
        words = [sum(lanes[p][1][i] & (2**62 - 1) for p in own) % 2**62 for i in range(8)]
        bits = [sum(lanes[p][0] % 2**64 >> j & 1 for p in own) for j in range(62)]
        out[t] = (len(own), words, bits)
    return out


def likeness(a, b):
    if a == b:
        return 1.0
    square = lambda x, n: sum((2 * v - n) ** 2 for v in x)
    apart = square([x - y for x, y in zip(a[2], b[2], strict=True)], a[0] - b[0])
    norms = square(a[2], a[0]) + square(b[2], b[0])
    return max(0.0, min(0.999, 1 - apart / norms if norms else 0.0))


def test_op6_fingerprints_and_likeness(spark):
    rows = {r["doc_id"]: r for r in fingerprint.op6_fingerprint(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    edited = {}
    for i, d in enumerate(order):
        k = len(texts[d]) // 2
        edited[d] = texts[d][: len(texts[d]) - k] + texts[order[(i + 1) % len(order)]][:k]
    prints = plain_print(spark, [*texts.values(), *edited.values()])
    for i, d in enumerate(order):
        n, words, bits = own = prints[texts[d]]
        r = rows[d]
        stated = [int(r["fingerprint"][k : k + 16], 16) for k in range(0, len(r["fingerprint"]), 16)]
        assert stated[:9] == [n, *words]
        assert [stated[9 + j % 31] >> (31 * (j // 31)) & (2**31 - 1) for j in range(62)] == bits
        assert r["near_edited"] == pytest.approx(likeness(own, prints[edited[d]]), abs=1e-9)
        assert r["near_next"] == pytest.approx(likeness(own, prints[texts[order[(i + 1) % len(order)]]]), abs=1e-9)
    with_none = fingerprint.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"], 4)
    assert with_none.collect() == []
