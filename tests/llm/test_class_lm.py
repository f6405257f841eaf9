"""Class-based scores against plain counts, the model's arithmetic, and awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipewright.llm import class_lm

SF = "/root/testdata/sf0.001"
END = None


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [END]


def check_plain_columns(rows, got):
    """rows: (id, text, held)."""
    counts = Counter(w for _, t, held in rows if not held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for key, text, held in rows:
        words = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[key, held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r[0], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def corpus(n, seed):
    """Texts of a grammar: articles, adjectives, nouns and verbs of two kinds."""
    r = random.Random(seed)
    kinds = {k: [f"{k}{i}" for i in range(30)] for k in ("noun", "verb", "adj", "thing", "does")}
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randint(3, 12)):
            a, b, c = ("adj", "noun", "verb") if r.random() < 0.5 else ("adj", "thing", "does")
            words += ["the", r.choice(kinds[a]), r.choice(kinds[b]), r.choice(kinds[c])]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_scores(spark, block):
    rows = [(i, t, i % 5 == 0) for i, t in corpus(400, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").withColumns({c: F.lit("own") for c in ("block", "words", "shard", "score", "kind")}).repartition(3)
    got = class_lm.class_scores(df, "doc_id", "text", "held", classes=12, passes=2, rounds=4, block=block).withColumnRenamed("held", "held_out").collect()
    check_plain_columns(rows, got)
    held = [r for r in got if r["held_out"]]
    # classes know which kinds of words follow which: far below the frequencies' perplexity
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.25
    for r in got:
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_classes_and_score_by_hand(spark):
    """The score is the product of transitions and emissions, which add up to one."""
    rows = [(i, t, False) for i, t in corpus(300, 2)] + [(1000, "the adj1 noun1 never seen", True), (1001, None, True), (1002, "the the adj1", None)]
    df = spark.createDataFrame(rows, "id long, text string, held boolean")
    kinds = class_lm.Shape(6)
    source = df.select("id", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = class_lm.blocks_of(source)
    asks = class_lm._asks(blocks, 2)
    shards = class_lm.vocabulary(asks, 6)
    state = class_lm.clustered(blocks, asks, shards, kinds, 2, 3, 2, 4)
    classes = {}
    for r in state.collect():
        classes |= dict(zip(np.frombuffer(r["moved"], dtype=np.uint64).tolist(), np.frombuffer(r["classes"], dtype=np.uint8).tolist(), strict=True))
    vocabulary = sorted({w for _, t, _ in rows for w in tokens(t)[:-1]})
    hashed = class_lm.word_hashes([b" ".join(vocabulary)])[0]
    of = {w: classes.get(h, kinds.rare) for w, h in zip(vocabulary, hashed.tolist(), strict=True)} | {END: kinds.end}
    assert len({c for c in of.values() if c < 6}) > 1
    counts, pairs = Counter(), Counter()
    for _, t, held in rows:
        if not held:
            words = tokens(t)
            counts.update(words)
            pairs.update(zip([kinds.end, *(of[w] for w in words)], [of[w] for w in words], strict=False))
    once = max(1, sum(n == 1 for n in counts.values()))
    sizes = Counter()
    for w, n in counts.items():
        sizes[of[w]] += n
    used = {c for c in sizes if c < 6} | {kinds.rare, kinds.end}
    total = sum(counts.values())
    prior = {c: (sizes[c] + 1) / (total + len(used)) for c in used}

    def transition(a, b):
        return (pairs[a, b] + 5 * prior[b]) / (sum(pairs[a, c] for c in used) + 5)

    def emission(w):
        size = sizes[of[w]] + (once if of[w] == kinds.rare else 0)
        return (counts[w] or once) / size

    got = {r["id"]: r["score"] for r in class_lm.class_scores(df, "id", "text", "held", classes=6, passes=2, rounds=4).collect()}
    for key, t, _ in rows:
        before, score = kinds.end, 0.0
        for w in tokens(t):
            score += math.log10(transition(before, of[w]) * emission(w))
            before = of[w]
        assert got[key] == pytest.approx(score, rel=1e-9)
    for a in used:  # over known words, the end and one unknown word, probabilities add up to one
        assert sum(transition(a, of[w]) * emission(w) for w in counts) + transition(a, kinds.rare) * once / (sizes[kinds.rare] + once) == pytest.approx(1)


def test_gains_are_the_likelihoods_difference():
    r = np.random.default_rng(4)
    n, contexts, words = 5, 8, 40
    sizes = r.integers(1, 9, words)
    features = np.concatenate([np.sort(r.choice(2 * contexts, k, replace=False)) for k in sizes])
    tallies = r.choice([1, 2, 3, 20, 100], len(features))
    classes = r.integers(0, n + 1, words)
    classes[classes == n] = n + 2  # no class as yet
    own = np.repeat(np.arange(words), sizes)

    def matrix(c):
        m = np.zeros((n, 2 * contexts), dtype=np.int64)
        some = c[own] < n
        np.add.at(m, (c[own][some], features[some]), tallies[some])
        return m

    got = class_lm.best_classes(classes.astype(np.uint8), sizes.astype(np.uint16), features.astype(np.uint8), tallies, matrix(classes), portion=30)
    for w in range(words):
        values = []
        for k in range(n):
            moved = classes.copy()
            moved[w] = k
            values.append(class_lm.likelihood(matrix(moved)))
        assert values[got[w]] == pytest.approx(max(values), rel=1e-12)


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "One one ONE", "É é", "x" * 60_000, "a " * 30_000, "same text here"] + ["same text here"] * 30 + ["  non breaking", "tab\tand\x0bmore\x1fend"]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, "One one ONE")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("held", "held_out", "id", "n_tokens")})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = class_lm.op11_class_lm(spark, str(tmp_path)).collect()
    check_plain_columns([(d, t, zlib.crc32(str("" if d is None else d).encode()) % 7 == 2) for d, t in rows], got)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, held boolean")
    assert class_lm.class_scores(empty, "doc_id", "text", "held").collect() == []
    alone = class_lm.class_scores(spark.createDataFrame([("a", "all held out", True)], "k string, text string, held boolean"), "k", "text", "held").collect()
    assert alone[0]["train_tokens"] == 0 and alone[0]["n_known"] == 0 and alone[0]["base_score"] == 0


def test_op11_beats_frequencies(spark):
    got = class_lm.op11_class_lm(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_plain_columns([(d, t, zlib.crc32(str(d).encode()) % 7 == 2) for d, t in docs], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.9
