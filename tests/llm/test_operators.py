"""The corpus operators against brute force, libraries and round trips, and on awkward rows."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pipewright.llm import fingerprint, html_extract, near_dedup, packing, piece_codec, quality, registry, sharding, suffix_dedup, topk_search, url_filter
from pipewright.llm._words import mixed, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["host", "path", "rule", "verdict", "shard", "slot", "kept", "n_bytes", "spans", "k1", "k2", "_z", "piece", "start", "length", "ids", "decoded", "piece_ids", "expected_grade", "sequence_id", "offset", "removed_spans", "node", "bands"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


def awkward():
    """Rows with nulls, empty, blank and long texts, copies, near copies, shared passages, odd characters."""
    base, passage = words(120, 1), words(60, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " ", "one", "a b c d", base, base, " ".join(near), base + " tail", "start " + passage + " end", "other " + passage + " stop here", "x" * 5000, "ab" * 700, "é" * 400 + "中文 🙂",
        words(9000, 3), "  two  spaces\n\nand lines \n", "▁ sign <s> </s> \t\x00 end", base.upper(), "A. B! C?", "A. B! C?",
    ]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The awkward rows with a null id, and columns whose names clash with what operators add."""
    df = spark.createDataFrame([*rows, (None, "no id at all, but a text")], "doc_id long, text string")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({n: F.lit("own") for n in NAMES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_registry_has_all_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, SF).collect()) == Counter(want.fetchall())


# 1 ----------------------------------------------------------------------------------------------


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, action in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_url_filter(spark):
    r = random.Random(5)
    rules = [*url_filter.RULES, ("b.example.org/en/", "allow"), ("net/", "block"), ("net/a", "allow"), ("deep.x.net/", "allow")]
    urls = [f"{r.choice(['http', 'HTTPS', 'x'])}://{r.choice(['', 'www.', 'b.', 'deep.x.', 'A.B.'])}{r.choice(['example.org', 'Example.COM', 'x.net', 'org', 'norg'])}{r.choice(['', '/', '/en/1', '/en/12?q=/es/', '/fr/a', '/de/#x', '/es/', '?a', '#/b', '/a/b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://org", "http://é.org/ü", "http://" + "a." * 300 + "org/" + "x" * 30000, "http://u:p@example.org:80/es/x\ny"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, "rule string, action string"))
    found = got.collect()
    assert len(found) == len(urls) + 1
    for x in found:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == brute_verdict(x["url"], rules)
    own = spark.createDataFrame([("http://A.org/x", "mine", 1)], "url string, _url string, _url_ int")
    tied = url_filter.filter_urls(own, spark.createDataFrame([("a.org/x", "allow"), ("A.org/x", "allow")], "rule string, action string")).collect()
    assert [(x["_url"], x["_url_"], x["rule"]) for x in tied] == [("mine", 1, "A.org/x")]
    none = url_filter.filter_urls(df, spark.createDataFrame([(None, "block"), ("/x", "block")], "rule string, action string"), default="block")
    assert {(x["rule"], x["verdict"]) for x in none.collect()} == {(None, "block")}
    assert url_filter.filter_urls(df.limit(0), spark.createDataFrame(rules, "rule string, action string")).count() == 0


def test_url_filter_with_thousands_of_rules(spark):
    r = random.Random(15)
    hosts = [".".join(r.choices(["a", "b", "c", "shop", "news"], k=r.randint(1, 4))) + r.choice([".org", ".com"]) for _ in range(300)]
    rules = sorted({(f"{r.choice(hosts)}/{''.join(r.choices('xyz/', k=r.randint(0, 40)))}", r.choice(["allow", "block"])) for _ in range(3000)})
    rules = [x for i, x in enumerate(rules) if not i or rules[i - 1][0] != x[0]]
    urls = [f"http://{r.choice(['', 'www.', 'm.a.'])}{r.choice(rules)[0]}{r.choice(['', 'x', '/y', '?q'])}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for x in url_filter.filter_urls(df, spark.createDataFrame(rules, "rule string, action string")).collect():
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == brute_verdict(x["url"], rules)


# 2 ----------------------------------------------------------------------------------------------


def test_sharding(spark, clashing, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("slot"))
    out = sharding.shard_rows(many).toPandas()
    for n in (16, 17):
        column = "shard" if n == 16 else "grown_shard"
        assert out[column].value_counts().between(4000 / n * 0.7, 4000 / n * 1.35).all()
    moved = out[out["shard"] != out["grown_shard"]]
    assert (moved["grown_shard"] == 16).all() and 0.03 < len(moved) / 4000 < 0.09
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    key = lambda k, s: (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    for k, s in zip(out["doc_id"][:300], out["shard"][:300], strict=True):
        assert s == min(range(16), key=lambda i, k=k: (-math.log(key(k, i)), i))
    heavy = sharding.shard_rows(many, weights=(3.0, 1.0), grown_weight=4.0).toPandas()
    assert 0.70 < (heavy["shard"] == 0).mean() < 0.80 and 0.45 < (heavy["grown_shard"] == 2).mean() < 0.55
    some = sharding.shard_rows(clashing, order_by=("doc_id", "text")).collect()
    assert len(some) == clashing.count() and all(isinstance(r["slot"], int) for r in some)
    assert sharding.shard_rows(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(many, weights=(1.0, 0.0))


def test_op2_columns(spark):
    rows = {r["doc_id"]: r for r in sharding.op2_sharding(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = (d["text"] or "").encode()
        assert rows[d["doc_id"]]["size"] == len(data) + 1 and rows[d["doc_id"]]["text_crc32"] == zlib.crc32(data)


# 3 ----------------------------------------------------------------------------------------------


def brute_repeats(texts, n):
    counts = Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        spans = []
        for s in range(len(t) - n + 1):
            if counts[t[s : s + n]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + n
                else:
                    spans.append([s, s + n])
        out.append([tuple(x) for x in spans])
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_suffix_dedup(spark, clashing, rows, group):
    got = suffix_dedup.remove_repeats(clashing, group=group).collect()
    given = [*rows, (None, "no id at all, but a text")]
    want = dict(zip([i for i, _ in given], brute_repeats([(t or "").encode() for _, t in given], 200), strict=True))
    texts = {i: (t or "").encode() for i, t in given}
    assert len(got) == len(given)
    assert any(want.values())
    for r in got:
        spans, data = want[r["doc_id"]], texts[r["doc_id"]]
        assert [(s["from"], s["to"]) for s in r["removed_spans"]] == spans
        edges = [0, *(x for s in spans for x in s), len(data)]
        assert bytes(r["kept"]) == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_suffix_dedup_random(spark):
    r = random.Random(3)
    parts = ["".join(r.choices("ab", k=r.randint(20, 60))) for _ in range(12)]
    texts = ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: [(s["from"], s["to"]) for s in x["removed_spans"]] for x in suffix_dedup.remove_repeats(df, length=48, k=16).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 48)))


def test_suffix_dedup_hot_anchors(spark, monkeypatch):
    # a passage in many contexts, pairs of which agree beyond it, and copies: far more strings at an anchor than a group or a portion has
    monkeypatch.setattr(suffix_dedup, "MAX_COLLECTION", 8)
    r = random.Random(8)
    passage, texts = words(30, 70), []
    for i in range(60):
        ends = words(12, 1000 + i), words(12, 2000 + i)
        texts += [f"{ends[0]} {passage} {ends[1]}", f"{words(3, 3000 + i)} {ends[0]} {passage[r.randrange(20) :]} {words(12, 4000 + i)}"]
    texts += [texts[0]] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: [(s["from"], s["to"]) for s in x["removed_spans"]] for x in suffix_dedup.remove_repeats(df, length=160, k=16, group=8).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 160)))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, group=1)


def test_suffix_dedup_many_equal_rows(spark):
    """Thousands of equal rows, with an id of their own, one id or none, cost what one costs; others still meet them."""
    base, other = words(900, 11), words(300, 12)
    inner = base[1000:1500]
    rows = [(7, base)] * 1500 + [(None, base)] * 1500 + [(10_000 + i, base) for i in range(1500)] + [(8, other + inner), (9, other[:150]), (9, other[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    began = time.time()
    got = Counter((r["doc_id"] if r["doc_id"] in (7, 8, 9, None) else "own", tuple((s["from"], s["to"]) for s in r["removed_spans"])) for r in suffix_dedup.remove_repeats(df).collect())
    whole = ((0, len(base)),)
    assert got == {(7, whole): 1500, (None, whole): 1500, ("own", whole): 1500, (8, ((len(other), len(other) + 500),)): 1, (9, ()): 2}
    assert time.time() - began < 60


def test_parted_strings_keep_every_window():
    r = random.Random(2)
    for _ in range(200):
        length, k = 24, 8
        string, before = bytes(r.choices(b"ab", k=r.randint(length, 2 * length - k))), 0
        before = r.randint(max(0, len(string) - length), min(length - k, len(string) - k))
        level, windows = [(1, 0, 0, 5, 6, 100, before, string)], {100 + s: string[s : s + length] for s in range(len(string) - length + 1)}
        for _ in range(6):
            level = [x for row in level for x in suffix_dedup.parted(row, length, k)]
            assert {x[5] + s: x[7][s : s + length] for x in level for s in range(len(x[7]) - length + 1)} == windows
            assert all(x[6] >= x[1] and x[6] + k + x[2] <= len(x[7]) for x in level)
        assert all(len(x[7]) == length and k + x[1] + x[2] == length for x in level)
        assert len({x[0] for x in level}) == len(set(windows.values()))


def test_op3_columns(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = set()
    for (i, data), spans in zip(texts.items(), brute_repeats(list(texts.values()), 200), strict=True):
        edges = [0, *(x for s in spans for x in s), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        want.add((i, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.op3_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {tuple(r) for r in got.collect()} == want and any(x[2] for x in want)


def test_suffix_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "é" * 150 + "中" * 100
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, "e" + text[1:])], "doc_id long, text string"), characters=True).collect()
    assert all(bytes(r["kept"]).decode() in ("", "e") for r in out)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty, k=12)


def test_columns_sort_as_suffixes():
    strings = [b"banana", b"ananas", b"bandan", b"xanana"]
    c = suffix_dedup.Collection(strings, [0] * 4, 6, 6)
    for column, order, common in c.rounds():
        suffixes = [strings[i][column:] for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes[:-1], suffixes[1:], common[1:4], strict=True):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


# 4 ----------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    model = quality.fitted(docs, labels.where(~held))
    out = quality.score(docs.join(labels.where(held).select("doc_id", quality.label_grade().alias("g")), "doc_id"), model).toPandas()
    kept = out["kept"].groupby(out["g"]).mean()
    assert kept[2] > 0.985 and kept[0] < 0.05 and kept[1] < 0.2
    assert (np.diff(model.thresholds) >= 0).all()
    mean = out["expected_grade"].groupby(out["g"]).mean()
    assert mean[0] < mean[1] < mean[2]


def test_op4_columns(spark):
    """Features counted word by word in plain Python, evidence by counting, and probabilities by the formula."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fitted(docs, labels)
    one = functools.cache(lambda piece: int(word_hashes([piece])[0][0]))
    bucket = functools.cache(lambda x, family: int((mixed(np.array([x ^ int(quality._FAMILIES[family])], dtype=np.uint64)) >> np.uint64(40))[0]))

    def found(text):
        out, heads, before = set(), Counter(), None
        repeats = capitals = 0
        own = re.findall(rb"[^\x20\x09-\x0D]+", text)
        for w in own:
            low = w.lower()
            repeat, capital = low == before, len(re.findall(rb"[A-Z]", w)) >= 2 and not re.search(rb"[a-z]", w)
            before, repeats, capitals = low, repeats + repeat, capitals + capital
            out |= {bucket(one(low), 0), bucket(one(low[-2:]), 1), bucket(repeat + 2 * capital, 2)}
            heads.update(bucket(one(low[:n]), n - 1) for n in range(4, 9))
        out |= heads.keys() | {b ^ quality.TWICE for b, n in heads.items() if n > 1}
        distinct = len({w.lower() for w in own})
        for level in range(1, 7):
            tests = repeats >= len(own) / 2**level and own, capitals >= len(own) / 2**level and own, len(own) >= 8 and distinct <= len(own) / 2**level
            out |= {bucket(10 * kind + level, 8) for kind, hit in enumerate(tests) if hit}
        return out

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    own = {i: found(t) for i, t in texts.items()}
    grade = {r["doc_id"]: 0 if r["quality"] == 0 else 2 - r["toxic"] for r in labels.collect() if r["doc_id"] in texts}
    odds = {}
    for k in (1, 2):
        a, b = Counter(), Counter()
        for i, g in grade.items():
            (a if g >= k else b).update(own[i])
        high = sum(g >= k for g in grade.values())
        low = len(grade) - high
        for f in a.keys() | b.keys():
            x = math.log((b[f] + 0.5) / (low + 1)) - math.log((a[f] + 0.5) / (high + 1))
            table = [(a[f], high), (high - a[f], high), (b[f], low), (low - b[f], low)]
            share = (a[f] + b[f]) / len(grade)
            ratio = 2 * sum(n * math.log(n / of / (share if k % 2 == 0 else 1 - share)) for k, (n, of) in enumerate(table) if n)
            if x >= quality.LEAST_ODDS and ratio >= quality.LEAST_Z**2:
                odds[f] = x
    assert set(model.buckets.tolist()) == set(odds)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    got = quality.op4_quality(spark, SF)
    assert got.columns == ["doc_id", "expected_grade", "tail_probability", "kept"]
    for i, expected, tail, kept in got.collect():
        score = sum(weight.get(f, 0) for f in own[i])
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert math.isclose(expected, sum(tails), abs_tol=1e-9) and math.isclose(tail, tails[-1], abs_tol=1e-9) and kept == (tail >= 0.5)


def test_quality_rows(spark, clashing, empty):
    labels = spark.createDataFrame([(5, 1, 0), (11, 0, 0), (3, None, 1), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fitted(clashing, labels)
    out = quality.score(clashing, model).collect()
    assert len(out) == clashing.count() and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    assert all(r["kept"] for r in quality.score(clashing, quality.fitted(clashing, labels.limit(0))).collect())
    assert quality.score(empty, model).count() == 0
    assert quality.rated_sample(clashing, labels, quality.label_grade(), max_rated=1).count() <= 1


def test_ordinal_grades(spark):
    kinds = ["bad stuff here", "middling things now", "good fine word"]
    df = spark.createDataFrame([(i, kinds[i % 3], i % 3) for i in range(600)], "doc_id long, text string, stars int")
    model = quality.fitted(df.select("doc_id", "text"), df, F.col("stars"), 3)
    tails = model.tails(model.scores([k.encode() for k in kinds]))
    assert (np.argsort(tails.sum(axis=1)) == [0, 1, 2]).all() and ((tails >= 0.5).sum(axis=1) == [0, 1, 2]).all()


# 5 ----------------------------------------------------------------------------------------------


def test_token_cutting():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, whole = packing.tokenizer(path), Tokenizer.from_file(path)
    r = random.Random(2)
    alphabet = [" ", "  ", "\n", "\n\n", "a", "the", "é", "<|endoftext|>", "\t", "中", "🙂", "x" * 30, "0", "\u00a0", "'s", "hello", " wor", "ld", "!!", "\x00", "\x85", "\x1c", "\r\n"]
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 12)))
        assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_plan_of_bins():
    r = random.Random(1)
    for size in (1, 5, 40, 300):
        histogram = {n: r.randint(1, 50) for n in r.sample(range(1, 513), size)}
        plan = packing.plan_bins(histogram, 512)
        used = Counter()
        for times, pattern in plan:
            assert sum(n * k for n, k in pattern.items()) <= 512
            used.update({n: k * times for n, k in pattern.items()})
        assert used == Counter(histogram)
        bound = math.ceil(sum(n * k for n, k in histogram.items()) / 512)
        assert size < 300 or sum(t for t, _ in plan) <= bound * 1.02 + 1


def test_fullest_combination():
    r = random.Random(4)
    for _ in range(200):
        counts, room = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(0, 6))}, r.randint(0, 60)
        reach = {0}
        for n, k in counts.items():
            reach = {a + n * i for a in reach for i in range(k + 1) if a + n * i <= room}
        used = packing.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == max(reach) and all(k <= counts[n] for n, k in used.items())


def test_packing(spark, clashing, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(clashing, path).toPandas()
    whole = packing.tokenizer(path).whole
    total = 0
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        own = out[out["doc_id"].isna() if doc_id is None else out["doc_id"] == doc_id].sort_values("piece")
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        assert own["length"].tolist() == packing.cut_lengths(len(ids), 2048)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    assert out["sequence_id"].nunique() == math.ceil(total / 2048)
    assert packing.pack_documents(empty, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 3000)], "k long, length long"), ["k"]).count()


# 6 ----------------------------------------------------------------------------------------------


def with_fp(df, column="text"):
    return df.withColumn("h", fingerprint.paragraph_hashes(F.col(column))).withColumn("fp", fingerprint.fingerprint(F.col("h")))


def test_fingerprint_is_homomorphic(spark):
    parts = [words(8, i) for i in range(30)]
    texts = {"a": "\n".join(parts), "b": "\n".join(parts[::-1]), "c": "\n".join(parts[:20]), "d": "\n".join(parts[20:]), "e": "\n".join([*parts, parts[0]]), "f": "\n".join(words(8, 100 + i) for i in range(30)), "g": ""}
    df = with_fp(spark.createDataFrame(list(texts.items()), "k string, text string")).select("k", "fp")
    wide = df.groupBy().pivot("k", list(texts)).agg(F.first("fp"))
    c = F.col
    r = wide.select(
        (fingerprint.encode(c("a")) == fingerprint.encode(c("b"))).alias("order"), (fingerprint.encode(fingerprint.combine(c("c"), c("d"))) == fingerprint.encode(c("a"))).alias("insert"),
        (fingerprint.encode(fingerprint.combine(c("a"), c("d"), True)) == fingerprint.encode(c("c"))).alias("delete"), (fingerprint.encode(c("a")) != fingerprint.encode(c("e"))).alias("twice"),
        *[fingerprint.likeness(c(x), c(y)).alias(x + y) for x, y in ("ab", "ac", "ae", "af", "gg", "ag")],
    ).first()
    assert r["order"] and r["insert"] and r["delete"] and r["twice"]
    assert r["ab"] == 1 and r["gg"] == 1 and r["ag"] == 0 and 0.6 < r["ac"] < 1 and 0.9 < r["ae"] < 1 and r["af"] < 0.3


def test_op6(spark):
    rows = {r["doc_id"]: r for r in fingerprint.op6_fingerprint(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    by_text = defaultdict(set)
    for i, d in enumerate(order):
        text, other = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(text) // 2
        edited = text[: len(text) - k] + other[:k]
        assert rows[d]["n_chars"] == len(text) and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[d]["near_edited"] <= 1 and 0 <= rows[d]["near_next"] <= 1
        by_text[text].add(rows[d]["fingerprint"])
        by_text[edited].add(rows[d]["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    closer = [rows[d]["near_edited"] > rows[d]["near_next"] for d in order]
    assert sum(closer) / len(closer) > 0.9


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_rows(spark, buckets):
    ids = [5, 5, 7, 1, None, 9, 9, 3, None, 12]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprint.with_next(df, "doc_id", ["text"], buckets).collect()
    assert len(rows) == len(ids)
    following = {r["text"]: r["next_text"] for r in rows}
    chain, at = [], "t9"
    for _ in ids:
        chain.append(ids[int(at[1:])])
        at = following[at]
    assert at == "t9" and chain == [12, 9, 9, 7, 5, 5, 3, 1, None, None]
    assert fingerprint.with_next(df.limit(0), "doc_id", ["text"], buckets).count() == 0
    assert fingerprint.with_next(df.where("doc_id IS NULL"), "doc_id", ["text"], buckets).count() == 2


def test_next_rows_of_one_key(spark):
    """Rows of one key are spread over ranges, and still follow each other; keys of other types do as well."""
    rows = [("m", f"t{i}") for i in range(1500)] + [("m", "t7")] * 3 + [("a", "last"), ("z", "first"), (None, "none")]
    df = spark.createDataFrame(rows, "k string, text string").repartition(3)
    got = fingerprint.with_next(df, "k", ["text"], 12).collect()
    assert Counter(r["text"] for r in got) == Counter(t for _, t in rows)
    follows = Counter((r["text"], r["next_text"]) for r in got)
    assert follows["none", "first"] == 1 and follows["last", "none"] == 1
    assert follows["t7", "t7"] == 3  # equal rows follow each other
    assert Counter(b for _, b in follows.elements()) == Counter(t for _, t in rows)  # each row follows one
    counts = fingerprint.with_next(df, "k", ["text"], 12).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in counts) < 1200  # four partitions: none has the key to itself


def test_op6_is_native(spark):
    plan = fingerprint.op6_fingerprint(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 7 ----------------------------------------------------------------------------------------------


def shingles(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def chained_texts():
    """Copies, a chain of near copies whose ends are far apart, a hub with mutually distant neighbours, and others."""
    r = random.Random(11)
    base = words(200, 50).split()
    out, chain = [], list(base)
    for _ in range(25):
        chain = list(chain)
        chain[r.randrange(len(chain))] = "z" + str(r.random())
        out.append(" ".join(chain))
    hub = words(240, 51).split()
    for _ in range(40):
        copy = list(hub)
        for i in r.sample(range(240), 3):
            copy[i] = "q" + str(r.random())
        out.append(" ".join(copy))
    out += [" ".join(hub)] * 5 + [words(100, 60 + i) for i in range(30)] + [None, "", "a b", "A B", "a b c"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("percent", "block"), [(85, near_dedup.BLOCK), (80, 16)])
def test_near_dedup(spark, percent, block):
    rows = chained_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, percent=percent, block=block).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = brute_components(sets, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_dedup_awkward(spark, clashing, rows, empty):
    got = near_dedup.near_duplicates(clashing).collect()
    assert len(got) == clashing.count()
    want = brute_components({i: shingles(t) for i, t in rows}, 85)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_pairs_apart_in_a_large_bucket(spark):
    # copies of a template in pairs that change the same words to different ones: whatever two of them share, they share with all
    r = random.Random(23)
    base, rows = words(400, 700).split(), []
    for _ in range(40):
        places = r.sample(range(400), 6)
        for _ in range(2):
            copy = list(base)
            for i in places:
                copy[i] = "x" + str(r.random())
            rows.append(" ".join(copy))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, block=4).collect()}
    want = brute_components({i: shingles(t) for i, t in rows}, 85)
    assert len(set(want.values())) > 30
    assert got == want


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    for n, share in ((3, 0.5), (40, 0.8), (900, 0.6)):
        pool = r.integers(0, 1 << 63, size=(60, 2 * n), dtype=np.uint64)
        common = int(n * share)
        a = [np.unique(p[:n]) for p in pool]
        b = [np.unique(np.concatenate((p[:common], p[n : 2 * n - common]))) for p in pool]
        near = (near_dedup.superminhash(a, 256) == near_dedup.superminhash(b, 256)).mean()
        assert abs(near - common / (2 * n - common)) < 0.02
    one = near_dedup.superminhash([np.array([7], dtype=np.uint64)], 64)
    assert sorted(int(x) >> 32 for x in one[0]) == list(range(64))


def test_bounds_are_never_below_the_similarity():
    r = np.random.default_rng(3)
    for n, share in ((4, 0.5), (100, 0.9), (700, 0.82), (5000, 0.86), (20000, 0.95)):
        pool = r.integers(0, 1 << 63, size=2 * n, dtype=np.uint64)
        common = int(n * share)
        sets = [np.unique(pool[:n]), np.unique(np.concatenate((pool[:common], pool[n : 2 * n - common]))), np.unique(pool[: n // 2 + 1]), np.unique(pool[n:])]
        bitmaps, sizes = [near_dedup.bitmap(s) for s in sets], np.array([len(s) for s in sets])
        exact = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
        for percent in (50, 85):
            near = near_dedup.bounds(bitmaps, sizes, percent)
            for i in range(4):
                for j in range(4):
                    assert i == j or near[i, j] >= exact[i, j] - 1e-6 or near[i, j] == -1 and 100 * exact[i, j] < percent
            assert (near_dedup.bounds(bitmaps, sizes, percent, 2) == near[:2, 2:]).all()


def test_near_dedup_thousands_in_one_bucket(spark):
    # near copies of one text, those of one family close to each other, the families too far apart; dealt over many blocks
    r = random.Random(31)
    base, rows = words(150, 900).split(), []
    for family in range(60):
        own = list(base)
        for i in r.sample(range(150), 9):
            own[i] = f"f{family}x{i}"
        for k in range(50):
            copy = list(own)
            copy[r.randrange(150)] = f"k{family}.{k}"
            rows.append(" ".join(copy))
    r.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(df, percent=80, block=256).collect()}
    sets = {i: shingles(t) for i, t in enumerate(rows)}
    # brute force by shared shingles: all pairs, by a product of 0/1 rows
    names = {s: k for k, s in enumerate(sorted({s for x in sets.values() for s in x}))}
    matrix = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, x in sets.items():
        matrix[i, [names[s] for s in x]] = 1
    common, sizes = matrix @ matrix.T, matrix.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * common >= 80 * (sizes[:, None] + sizes[None] - common), 1))
    root = near_dedup.union_find(zip(a.tolist(), b.tolist(), strict=True))
    assert got == {i: root.get(i, i) for i in sets}
    assert len(set(got.values())) > 20


def test_op7_columns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = brute_components(sets, 85)
    got = near_dedup.op7_near_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == {(i, len(sets[i]), want[i], want[i] == i) for i in texts}


def test_near_dedup_repeated_ids(spark):
    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    df = spark.createDataFrame([("d", a), ("b", a), ("d", b), ("c", b), ("e", c), ("e", None), ("f", "")], "doc_id string, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("b", 76, "b"), ("c", 76, "b"), ("d", 76, "b"), ("d", 76, "b"), ("e", 0, "e"), ("e", 76, "e"), ("f", 0, "f")]


def test_near_dedup_many_texts_of_one_id(spark):
    texts = [words(60, i) for i in range(2500)]
    alike = texts[0].split()
    alike[-1] = "changed"
    rows = [(5, t) for t in texts] + [(5, texts[1])] * 2500 + [(9, " ".join(alike)), (4, texts[2400]), (3, words(60, 99_999))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(5, 4, False), (9, 4, False), (4, 4, True), (3, 3, True)}
    assert time.time() - began < 90


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 400)]
    pairs = [(a, b) for a, b in links if a != b]
    got = {x["node"]: x["root"] for x in near_dedup.components(spark.createDataFrame(pairs, "a int, b int").repartition(5)).collect()}
    assert got == near_dedup.union_find(iter(pairs))


# 8 ----------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies on this site for the best of it.</div>
<article><h1>Big &amp; small</h1><p>First   line<br>goes&nbsp;on.</p><!-- no --><p>Of.</p><div class="ad">Buy this now.</div><p>Last <b>one</b> &lt;here&gt;.
<form><p>Your mail</p><input></form><section class="comments"><p>I like it.</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
LONG = "It is known that the people of the town were on their way to it when they saw that the old bridge was not there and that there was no other way to go for them."


def test_main_text():
    assert html_extract.main_text(PAGE) == "Big & small\nFirst line goes on.\nOf.\nLast one <here>."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    assert html_extract.main_text(f"<body><div>{LONG}</div><p>Short.</p><p>{LONG}</p><div><a href=x>one</a> | <a href=y>two</a></div><p>Mine</p><div><a href=x>more</a></div></body>") == f"{LONG}\nShort.\n{LONG}\nMine".replace("\nMine", "")
    assert html_extract.main_text("<article><p>a < b and <i>c</i> &amp; d</p><script>never ends") == "a < b and c & d"
    assert html_extract.main_text("<article><p title='x>y'>ok</p><!-- open") == "ok"


@pytest.mark.parametrize("tag", [
    '<svg-icon name="x"></svg-icon>', "<select-menu>", "<template-x></template-x>", "<iframe-resizer></iframe-resizer>", "<Math-Field/>",
    '<svg class="i"/>', "<svg/>", "<MATH display='a>b' />", '<svg a="x/y" b=c /><svg><text>drawn</text></svg>', "<svg class=i/><text>drawn</text></svg>",
])
def test_main_text_goes_on_after_elements_without_content(tag):
    assert html_extract.main_text(f"<article><p>one{tag} two</p><p>three</p></article>") == "one two\nthree"


def test_wrappers_and_headings_are_no_furniture():
    body = f"<nav><a href=a>Home</a> <a href=b>News</a></nav><article><div class='page-header'><h1>The title</h1></div><p>{LONG}</p><p>Short end.</p></article><footer><p>{LONG}</p></footer>"
    want = f"The title\n{LONG}\nShort end."
    assert html_extract.main_text(f"<body>{body}</body>") == want
    assert html_extract.main_text(f"<body><form id='aspnetForm' method=post>{body}<div class=comments><p>{LONG} {LONG} {LONG}</p></div></form></body>") == want
    assert html_extract.main_text(f"<body><article><fieldset><p>{LONG}</p></fieldset></article></body>") == LONG
    assert html_extract.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p><form><p>{LONG}</p></form></article></body>") == f"{LONG}\n{LONG}"
    assert html_extract.main_text(f"<body><article><p>{LONG}</p></article><form class='comment-form'><p>{LONG}</p><p>{LONG}</p></form></body>") == LONG
    assert html_extract.main_text(f"<body><div class='page-header'><p>{LONG}</p></div><article><p>{LONG}</p></article></body>") == LONG


def test_op8_densities_drop_blocks(spark):
    """A share of what goes is dropped by densities alone, whatever the markup says."""
    dropped = Counter()
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        found = list(html_extract.blocks(r["html"] or ""))
        first = [html_extract._first_pass(b) for b in found]
        for x, marked, kept in zip(first, html_extract.furniture(found, first), html_extract.labels(found), strict=True):
            if not kept:
                dropped["density" if x == "bad" else "markup" if marked else "neighbour"] += 1
    assert dropped["density"] > 0.2 * sum(dropped.values())


def test_op8_articles(spark):
    import html as H

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_extract.op8_html_extract(spark, SF).collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_op8_densities_decide(spark):
    """The same text comes out when nothing but densities and neighbours tells the article from the rest."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    passes = Counter()
    for html in pages:
        plain = html.replace("<article", "<div").replace("</article", "</div")
        assert html_extract.main_text(plain) == html_extract.main_text(html) != ""
        passes.update(html_extract._first_pass(b) for b in html_extract.blocks(plain) if b.place != "out")
    assert passes["good"] > 500 and passes["open"] > 300  # each pass has its share


@pytest.mark.parametrize("part", [
    '<section id="search-algorithms"><p>{}</p></section>', '<h2 id="comment-on-results">{}</h2>', '<div class="ad-hoc-note">{}</div>', '<header><h1>{}</h1></header>', '<p class="adage">{}</p>',
])
def test_words_of_names_need_company(part):
    html = '<nav><a href="x">Home</a></nav><article>' + part.format(LONG) + '<div class="site-footer">' + LONG + '</div><ul class="comment-list"><li>' + LONG + "</ul></article>"
    assert html_extract.main_text(html) == LONG


def test_deep_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 60000 + "text" + "</p>" * 60000, '<b class="ad">' * 60000 + "</i>" * 60000, "<li>" * 60000 + "</ul>" * 60000):
        html_extract.main_text(page)
    assert time.time() - began < 20


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<article>" + "<p>word " * 20000, "x"), (2, PAGE, "x"), (None, "", "x")], "page_id long, html string, text string")
    assert html_extract.extract(df).count() == 4 and html_extract.extract(df.limit(0)).count() == 0


# 9 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path), path


def test_piece_codec_random(pieces):
    model, library, _ = pieces
    r = random.Random(1)
    alphabet = [" ", "  ", "\n", "a", "the", "é", "▁", "<s>", "\t", "中", "🙂", "x" * 30, "0", "\u00a0", "<0x0A>", "hello", " wor", "ld", "!!", "ß", "\x00"]
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 14)))
        ids = model.encode(text)
        assert ids == library.encode(text, add_bos=True, add_eos=True) and model.decode(ids) == library.decode(ids)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_piece_codec_rows(pieces, docs, clashing, empty):
    model, library, path = pieces
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = piece_codec.encode_decode(clashing, path).collect()
    assert len(out) == len(texts)
    for r in out:
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert memoryview(bytes(r["piece_ids"])).cast("I").tolist() == want and r["decoded"] == library.decode(want)
    assert piece_codec.encode_decode(empty, path).count() == 0


# 10 ---------------------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    out = set()
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(topk_search.DATA_BLOCK, topk_search.QUERY_BLOCK), (37, 4)])
def test_top_products(spark, blocks):
    r = random.Random(6)
    centres = [[r.randint(-300, 300) for _ in range(8)] for _ in range(5)]
    vectors = {i: [c + r.randint(-20, 20) for c in r.choice(centres)] for i in range(260)}
    vectors |= {i: centres[0] for i in range(260, 320)}  # a hot vector
    rows = [*vectors.items(), (None, centres[1]), (999, None), (3, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk_search.top_products(df, F.col("vec_id") % 10 == 0, data_block=blocks[0], query_block=blocks[1]).collect()
    assert {tuple(x) for x in got} == brute_top(vectors, [i for i in vectors if i % 10 == 0], 5) and len(got) == 160


def test_top_products_edges(spark):
    df = spark.createDataFrame([(0, [1, 2]), (50, [2, 1]), (7, [1, 1, 1])], "vec_id long, vector array<long>")
    assert {tuple(x) for x in topk_search.top_products(df, F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 50, 4), (50, 1, 0, 4)}
    assert topk_search.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    odd = spark.createDataFrame([([1.0, float("nan")],), ([None, 1.0],), (None,), ([float("inf")],), ([1.0, -0.1],), ([],)], "e array<float>")
    assert [x[0] for x in odd.select(topk_search.usable(F.col("e"))).collect()] == [False, False, False, False, True, True]
    assert odd.where(topk_search.usable(F.col("e"))).select(topk_search.integer_vector(F.col("e"))).first()[0] == [256, -26]


def test_search_prunes():
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16)) * 1000
    near = lambda n: np.floor(centres[r.integers(0, 20, n)] + r.normal(size=(n, 16)) * 200).astype(np.int64)
    data, queries = near(3000), near(200)
    tree, asking = topk_search.CoverTree.built(data), topk_search.CoverTree.built(queries)
    scores = queries @ data.T
    again = topk_search.CoverTree.unpacked(len(data), 16, *tree.packed())
    for x in (tree, again):
        search = topk_search.DualSearch(asking, x, tree.order, 6)
        for q in range(200):
            want = sorted(zip(-scores[q], range(3000), strict=True))[:6]
            assert search.best[list(asking.order).index(q)] == want
        assert search.compared < 0.5 * scores.size
    for t in (tree, asking):  # covering and separation
        for at, (begin, bag, end, centre) in enumerate(t.nodes.tolist()):
            apart = np.sqrt(((t.points[begin:end] - t.points[centre]) ** 2).sum(axis=1))
            assert apart.max() <= t.radii[at, 0] + 1e-6 and apart[: bag - begin].max(initial=0) <= t.radii[at, 1] + 1e-6
            assert sorted([*range(begin, bag), *(i for c in t.children[at] for i in range(t.nodes[c, 0], t.nodes[c, 2]))]) == list(range(begin, end))
            assert all(t.radii[c, 0] < t.radii[at, 0] or t.radii[at, 0] == 0 for c in t.children[at])


def test_search_without_clusters():
    r = np.random.default_rng(4)
    data, queries = r.integers(-500, 500, size=(700, 64)), r.integers(-500, 500, size=(40, 64))
    asking = topk_search.CoverTree.built(queries)
    search = topk_search.DualSearch(asking, topk_search.CoverTree.built(data), np.arange(700), 6)
    assert search.compared == 700 * 40  # nothing can be given up here, and nothing is compared twice


def test_scores_beyond_doubles(spark):
    big = 1 << 29
    rows = [(0, [big + 1, big - 3, 5]), (1, [big + 1, big - 3, 4]), (2, [big + 1, big - 3, 6]), (50, [big, big, 1])]
    got = topk_search.top_products(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 50 == 0).collect()
    assert {tuple(x) for x in got} == brute_top(dict(rows), [0, 50], 5)


# pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fitted(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = dict(zip(rows, (model.tails(model.scores([(t or "").encode() for t in rows.values()]))[:, 1] >= 0.5).tolist(), strict=True))
    kept = {i: t for i, t in rows.items() if scored[i]}
    component = brute_components({i: shingles(t) for i, t in kept.items()}, 80)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    spans = brute_repeats([(t or "").encode() for t in kept.values()], 200)
    texts = {}
    for (i, t), own in zip(kept.items(), spans, strict=True):
        data = (t or "").encode()
        own = suffix_dedup.whole_characters(data, own)
        edges = [0, *(x for s in own for x in s), len(data)]
        texts[i] = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
    whole = packing.tokenizer(packing._tokenizer_path()).whole
    want = {}
    for i, t in texts.items():
        at = 0
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for k, n in enumerate(packing.cut_lengths(len(ids), 2048)):
            want[i, k] = (at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()))
            at += n
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    assert isinstance(got, pd.DataFrame) and got["sequence_id"].nunique() == math.ceil(got["length"].sum() / 2048)


def test_stages_return_documents(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(1, words(50, 1), "en", "s", 1), (2, None, None, None, None), (None, "x", "en", "s", 1), (3, words(50, 1) + " more", "en", "s", 5), (4, "é" * 300, "fr", "s", 300), (5, "a" + "é" * 300, "fr", "s", 301)], DOCS
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1, 2, None}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
