"""Spelling variants against a plain version, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pipewright.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, least=7, least_count=2):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            crc = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if crc % 31 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, ratio=10):
    out, forms = {}, {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], words[forms[w]] if forms[w] else None))
    return rows


@pytest.mark.parametrize("long", [64, 8])
def test_variants(spark, monkeypatch, long):
    monkeypatch.setattr(spelling, "MAX_KEYS", 64)
    r = random.Random(long)
    bases = ["aaaaaaa", "abababab", "zürichsee", "straßen", "aaaabbbb", "a" * 63, "a" * 64, "a" * 65, "b" * 64 + "c", "xy" * 40]
    words = {}
    for base in bases:
        words[base] = r.choice([5, 200, 5000])
        for _ in range(25):
            w = base
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abzéß") + w[i:], w[:i] + r.choice("abzéß") + w[i + 1 :]])
            words.setdefault(w, r.choice([1, 2, 5, 20, 50, 200, 2000]))
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {tuple(x) for x in spelling.spelling_variants(df, long=long).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(words)
    assert any(x[2] != x[1] and x[1] for x in got)  # ways of several steps


def test_collisions_are_told_apart_on_strings():
    words = {w: n for n, w in enumerate("absolute absolut obsolete absolutes resolute resolved dissolve dissolves".split(), 1)}
    out: list = []
    here: dict = {}
    names = list(words)
    for w, place, kind in zip(*(x.tolist() for x in spelling.deletion_keys(names)[1:]), strict=True):  # as if all had one key
        rest = names[w] if kind == 1 else names[w][:place] + names[w][place + 1 :]
        here.setdefault((rest, place if kind == 0 else -1), []).append((-words[names[w]], names[w], kind))
    spelling._compared(here, out)
    found = Counter()
    for w, n, *_ in out:
        found[w] += n
    assert found == Counter({w: c for w in words if (c := sum(near(w, v) for v in words))})


def test_keys_meet_where_words_are_near():
    r = random.Random(3)
    words = sorted({"".join(r.choices("ab", k=r.randint(7, 9))) for _ in range(150)})
    keys, own, _, kind = spelling.deletion_keys(words)
    met = Counter()
    by_key = {}
    for k, w, kd in zip(keys.tolist(), own.tolist(), kind.tolist(), strict=True):
        by_key.setdefault(k, []).append((w, kd))
    for members in by_key.values():
        for i, (a, ka) in enumerate(members):
            for b, kb in members[i + 1 :]:
                if ka == kb == 0 or {ka, kb} == {1, 2}:
                    met[min(a, b), max(a, b)] += 1
    assert met == Counter({(i, j): 1 for i, a in enumerate(words) for j in range(i + 1, len(words)) if near(a, words[j])})


def test_op13_columns(spark, tmp_path):
    r = random.Random(9)
    vocabulary = ["Übersetzung", "translation", "Éducation", "education", "translate", "x" * 70, "SEVENTH", "sixsix", "Ødegård", "ÿÿÿÿÿÿÿÿ"]
    rows = [(i, " ".join(r.choices(vocabulary, k=40)) + "-tail÷mark×7") for i in range(300)]
    rows += [(None, "translation"), (1, None), (2, ""), (3, " ... "), (4, "translation " * 3000), (4, "translation " * 3000), (5, "word" * 20_000), (5, "word" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("word", "n", "key", "form", "root")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_variants(plain_words(rows))
    assert sum(x[1] is not None for x in found) > 20


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op13_spelling(spark, str(tmp_path)).collect() == []
