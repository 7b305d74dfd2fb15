"""Operators against plain versions, on a small table with every odd case."""

import math
import os
import random
import time
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from weftline.llm import html, langid, licenses, mixing, neardup, packing, pii, quality, queries, sharding, store, vectors
from weftline.llm import components as components_module
from weftline.llm.components import components
from weftline.llm.textvec import Words, utf8

from . import brute as B

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, kept boolean, cid long, _th string, path string"


def documents():
    """Copies, near copies, repeated rows, ties, nulls, empty, blank and very long texts, and columns with clashing names."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    rows = []
    for i in range(120):
        rows.append((i, text(rng.randint(1, 80)), "ab"[i % 2], f"src{i % 4}"))
    for i in range(120, 170):  # near copies: a few words of a document changed
        words = rows[i % 25][1].split(" ")
        for _ in range(max(1, len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words), "a", "src0"))
    rows += [(i, rows[7][1], "b", "src0") for i in range(170, 190)]  # copies
    rows += [(190, rows[8][1].upper(), None, None), (191, "", "a", "src1"), (192, None, "a", None), (193, " \n\t ", None, "src1"), (194, "one", "b", ""), (195, "ONE", "b", "src2")]
    rows += [(196, text(9000), "a", "src3"), (197, "x" * 70_000, "b", "src3"), (None, rows[3][1], "a", "src0"), (None, None, None, None), (None, "alone with no id at all", "a", "src1")]
    rows += [rows[5], rows[5], (198, "line one here\nline one here\nother | line | here\n\nline one here", "a", "src1"), (199, "Größe naïve “quoted” 中文 words and more #*$", "b", "src2")]
    return [(*r, None if r[1] is None else len(r[1]), 1, "s", True, 5, "t", "p") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(*values):
    return tuple((v is None, v) for v in values)


def test_sharding(docs, rows, none):
    got = sharding.lpt_shards(docs.drop("size")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    out = sharding.lpt_shards(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    of_text = {}
    for r in got:
        assert of_text.setdefault(r["text"], r["shard"]) == r["shard"]
    by = {k: [r for r in out if r["shard"] == k] for k in range(8)}
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert {r["text_crc32"] for r in out} == {None if r[1] is None else zlib.crc32(r[1].encode()) for r in rows}
    assert sharding.lpt_shards(none).count() == 0


def test_schedule_is_longest_first():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 400))]
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        plan = sharding.schedule(classes, 5)
        assert [sum(t) for t in plan] == [n for _, n in classes]
        plain = [0] * 5
        for s in sorted(sizes, reverse=True):
            plain[plain.index(min(plain))] += s
        assert [sum(s * t[k] for (s, _), t in zip(classes, plan, strict=True)) for k in range(5)] == plain


def test_shards_are_those_of_longest_first(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 4)
    rng = random.Random(5)
    texts = [f"{i:05d}" + "x" * rng.randint(0, 20) for i in range(300)] + ["same text"] * 40
    out = sharding.lpt_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=5).collect()
    load, plain = [0] * 5, [0] * 5
    for r in out:
        load[r["shard"]] += r["size"]
    for s in sorted([len(t) + 1 for t in texts[:300]] + [40 * 10], reverse=True):
        plain[plain.index(min(plain))] += s
    assert load == plain


def test_quality_statistics(docs, rows, none, spark):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).select("text", "_stats.*", "_base_failed", "_kept").collect()
    assert len(out) == len(rows)
    for r in out:
        want = B.quality_base(r["text"])
        assert {k: r[k] for k in want if k != "base_failed"} | {"base_failed": r["_base_failed"]} == want
        assert not (r["_base_failed"] and r["_kept"])
    assert quality.judge(none, labels).count() == 0 and quality.learn_rules(docs, labels.limit(0)) == []


def test_decision_list_is_learned_and_read_by_spark(spark):
    rng = np.random.default_rng(0)
    n = 3000
    stats = rng.integers(0, 50, (n, len(quality.STATS)))
    stats[:, 0], stats[:, 5] = rng.integers(50, 500, n), rng.integers(400, 4000, n)
    x = quality.features(stats)
    name = [r[0] for r in quality.RATIOS]
    bad = (x[:, name.index("symbols_per_word")] > 0.2) & (x[:, name.index("words")] > 100) | (x[:, name.index("upper_part")] > 0.06)
    rules = quality.learn(stats, ~bad)
    assert rules
    df = spark.createDataFrame([(tuple(map(int, s)), bool(b)) for s, b in zip(stats, bad, strict=True)], f"_stats struct<{', '.join(f'{k}: bigint' for k in quality.STATS)}>, bad boolean")
    got = df.select("bad", (quality.decide(rules) > 0).alias("rejected")).groupBy("bad", "rejected").count().collect()
    n_of = {(r["bad"], r["rejected"]): r["count"] for r in got}
    assert n_of.get((True, True), 0) > 0.9 * bad.sum() and n_of.get((False, True), 0) < 0.02 * n


PII = [
    "mail a.b@c.de, x@y or @z.com, a@b.c.d-e! and a@b..c", "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4012888888881881 12 1234567890123456789012",
    "+1 (212) 555-0147 +12 +1234567 +123456789012345678 ++44 20 7946 0958.", None, "", "plain words only " * 50, "é中 4111111111111111 +49 30 901820\n\n1.1.1.1", "a" * 5000 + "@" + "b" * 5000 + ".c", "1." * 4000,
    "0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1 0001.2.3.4.5.6.7.8", "a" * 3000 + "@", "a@" * 2000 + "b.c@d.e.f@g", "x@y.z.@w.v", "1.2.3" + "7" * 3000, "+1" + " " * 3000,
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(PII)], "doc_id long, text string, spans int")
    out = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(PII):
        n, digest = B.pii_base(t)
        r = out[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n and r["base_sha256"] == digest
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert len(spans) >= sum(n) and all(0 <= int(a) < int(b) <= len(t) for _, a, b in spans)
    text = pii.scan(df).where("doc_id = 7").first()["_pii"]["redacted"]
    assert text == "é中 [CARD] [PHONE]\n\n[IP]"
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a" * 400_000 + "@", "0" * 400_000, "1" * 300_000 + ".2.3", "a@" * 200_000, "+" * 200_000 + "1", "x" * 300_000 + "7", "{" * 300_000])
def test_pii_takes_linear_time(text):
    began = time.time()
    pii.base_spans(text)
    pii.crf_spans(pii.train(rounds=2), [text])
    assert time.time() - began < 5


def test_crf_adds_to_the_patterns():
    crf = pii.train()
    found = {t[a:b]: k for t in ("please call (415) 555-0199 after nine", "write to joe (at) site (dot) com today") for k, a, b in pii.crf_spans(crf, [t])[0]}
    assert found == {"(415) 555-0199": "phone", "joe (at) site (dot) com": "email"}
    assert [t[a:b] for t in ["my number 555 867 5309 is new"] for _, a, b in pii.crf_spans(crf, [t])[0]] == ["555 867 5309"]
    for clean in ("iban DE89 3704 0044 0532 0130 00 given", "in 1998 there were 12 houses", "chapter 3, page 214 of 500", 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" here', "just plain words of no interest"):
        assert pii.crf_spans(crf, [clean]) == [[]]


def test_crf_decodes_whole_texts():
    crf, plain = pii.train(), "only plain words of no interest " * 30
    found = lambda t: [t[a:b] for k, a, b in pii.crf_spans(crf, [t])[0]]
    for address in ("kim at site dot org", "ann (At) site [Dot] org", "ann {at} site {dot} org"):
        assert found(f"{plain}write to {address} today {plain}") == [address]
    assert found("the dot at the end of the line is at the left " * 20) == []
    for n in range(508, 514):  # across what was a cut
        assert found("7 " * n + "call (415) 555-0199 after nine") == found("7 call (415) 555-0199 after nine") == ["(415) 555-0199"]
    rng = random.Random(7)
    words = "the house call at dot 12 (at) a.b x-y +1 555-0147 4111 10.0.0.1 phone joe@x (dot) org".split()
    for p in (0.03, 0.1, 0.3, 1) * 25:  # parts give the best path of the whole
        text = [rng.choice(words) if rng.random() < p else "plain" for _ in range(rng.randint(1, 200))]
        ids, got = crf.read(text), np.zeros(len(text), int)
        for lo, hi in crf.chains(ids):
            e = crf.emissions(ids, lo, hi)
            if lo:
                e[0, 1:] = -np.inf
            if hi < len(text):
                e[-1, 1:] = -np.inf
            got[lo:hi] += crf.viterbi([e])[0]
        assert (got == crf.viterbi([crf.emissions(ids, 0, len(text))])[0]).all()


def test_viterbi_finds_the_best_path():
    crf, rng = pii.train(), np.random.default_rng(2)
    chains = [rng.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 2, 4, 3)]
    import itertools

    for e, y in zip(chains, crf.viterbi(chains), strict=True):
        score = lambda p: sum(e[t, k] for t, k in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert score(y) == pytest.approx(max(score(p) for p in itertools.product(range(len(pii.LABELS)), repeat=len(e))))


def test_packing(docs, rows, none):
    out = packing.pack_documents(docs, capacity=512).collect()
    want = sorted(key(r[0], k, at, len(p), B.crc(p)) for r in rows for ids in [B.token_ids(r[1])] for k, at in enumerate(range(0, len(ids), 512)) for p in [ids[at : at + 512]])
    assert sorted(key(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 512) + 1
    assert packing.pack_documents(none).count() == 0


def test_local_search_empties_bins():
    lengths = [60, 60, 40, 40, 50, 50, 30, 70]
    first = [[0, 2], [1, 3], [4], [5], [6], [7]]
    done = packing.search([list(b) for b in first], lengths, 100)
    assert len(done) == 4 and sorted(i for b in done for i in b) == list(range(8))
    rng = random.Random(3)
    for _ in range(30):
        n = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        bins = packing.pack(n, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(n))) and all(sum(n[i] for i in b) <= 100 for b in bins)


def test_local_search_ends_where_no_exchange_is_better():
    import itertools

    rng = random.Random(4)
    for _ in range(15):
        n = [rng.randint(25, 60) for _ in range(rng.randint(2, 60))]
        bins = packing.pack(n, 100)
        if len(bins) == math.ceil(sum(n) / 100):
            continue
        fill = [sum(n[i] for i in b) for b in bins]
        for a, b in itertools.permutations(range(len(bins)), 2):
            if fill[a] == 100 or fill[b] == 100 or fill[b] < fill[a]:
                continue
            back = [0, *(n[i] for i in bins[b]), *(n[i] + n[j] for i, j in itertools.combinations(bins[b], 2))]
            for out in (n[i] for i in bins[a]):
                assert all(out <= y or fill[b] + out - y > 100 for y in back)
            for out in (n[i] + n[j] for i, j in itertools.combinations(bins[a], 2)):
                assert all(out <= n[i] or fill[b] + out - n[i] > 100 for i in bins[b])


def test_groups_leave_one_open_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    df = spark.createDataFrame([(i, "one " * (i % 7 + 1)) for i in range(300)], "doc_id long, text string")
    out = packing.pack_documents(df, capacity=64).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(out) == 300 and all([o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] for own in bins.values())
    assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 64) + 1


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, none, width):
    out = neardup.near_duplicates(docs, width=width).collect()
    first = B.near_duplicates([r[1] for r in rows], width)
    least = {}
    for r, c in zip(rows, first, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    sized = lambda t: len(B.shingle_set(t, width))
    want = sorted(key(r[0], sized(r[1]), least.get(c) if sized(r[1]) else r[0]) for r, c in zip(rows, first, strict=True))
    assert sorted(key(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in out)
    assert neardup.near_duplicates(none).count() == 0


def near_copies(rng, n, base, most=4):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_nodes(spark, monkeypatch):
    """Branchings, parts and blocks far smaller than the groups give the same components: of near copies, and of texts that share a passage."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    passage = words(30)
    texts = near_copies(rng, 150, words(60)) + [" ".join(passage + words(rng.randint(8, 40))) for _ in range(150)] + near_copies(rng, 40, passage + words(12), 3)
    for name, value in (("BLOCK", 16), ("NODE", 20), ("PIVOTS", 2)):
        monkeypatch.setattr(neardup, name, value)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, width=2).collect()}
    assert [got[i] for i in range(len(texts))] == B.near_duplicates(texts, 2)


def test_jobs_of_a_hot_group_are_bounded(spark):
    rng = random.Random(3)
    texts = near_copies(rng, 600, [f"w{rng.randrange(900)}" for _ in range(50)]) + [" ".join(f"v{rng.randrange(3000)}" for _ in range(40)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, width=2).collect()}
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before <= 80
    assert [got[i] for i in range(len(texts))] == B.near_duplicates(texts, 2)


def thue_morse(n, a="a", b="b"):
    t = a
    while len(t) < n:
        t += "".join(b if c == a else a for c in t)
    return t


def test_texts_that_collide_modulo_powers_of_two(spark):
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    words = Words(*utf8(pa.array([one, two, one])))
    assert words.hash[0] == words.hash[2] != words.hash[1]
    assert quality.text_stats(*utf8(pa.array([f"{one}\n{two}\n{one}"])))[0, 3] == 1
    df = spark.createDataFrame([(0, one), (1, two), (2, f"{one} {two}"), (3, f"{two} {one}")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, width=2).collect()) == [(i, i) for i in range(4)]
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack_documents(df).collect()}
    assert got == {(r["doc_id"], k): B.crc(ids[at : at + 4096]) for r in df.collect() for ids in [B.token_ids(r["text"])] for k, at in enumerate(range(0, len(ids), 4096))}


@pytest.mark.parametrize("alone", [1 << 20, 10])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr(components_module, "ALONE", alone)
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(400, 480)]
    want = B.components(pairs, 481)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, rows, none):
    out = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(B.WORD.findall(r[1] or ""))
    target = B.targets(sizes, sum(sizes.values()))
    assert len(out) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in out)
    got = {round(r["target"], 6): 0 for r in out}
    for r in out:
        got[round(r["target"], 6)] += r["taken"]
    want = {}
    for v in target.values():
        want[round(v, 6)] = want.get(round(v, 6), 0) + v
    assert set(got) == set(want) and all(abs(got[k] - v) <= 4 for k, v in want.items())
    again = mixing.mix(docs.repartition(3)).collect()
    order = lambda x: sorted(key(r["doc_id"], r["size"], r["taken"]) for r in x)
    assert order(out) == order(again)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("trim(text) = ''")).agg(F.sum("taken")).first()[0] == 0


def test_mix_reaches_the_targets_of_small_sources(spark, monkeypatch):
    """Sources far below a block, or of a few, get their target to the word."""
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    rng = random.Random(9)
    sizes = {"a": 20_000, "b": 30, "c": 360, "d": 360, "e": 1}
    rows = []
    for source, n in sizes.items():
        while n:
            k = min(n, rng.randint(1, 120))
            rows.append((len(rows), "w " * k, source))
            n -= k
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    of, got = {r[0]: r[2] for r in rows}, dict.fromkeys(sizes, 0)
    for r in out:
        got[of[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = B.targets(sizes, sum(sizes.values()))
    assert sum(got.values()) == sum(sizes.values()) and all(abs(got[k] - want[k]) <= 1 for k in sizes)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The odd rows that have an id of their own, and vectors with odd ones, as a folder of tables."""
    to = str(tmp_path_factory.mktemp("tables"))
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    one.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{to}/documents.parquet")
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.2)] + [base[:1].repeat(12, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{to}/embeddings.parquet")
    return to


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = queries.queries()[name](spark, folder)
    cols = sorted(got.columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: key(*r))
    want = db.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert order(want) == order(tuple(r[c] for c in cols) for r in got.collect())


def test_pipeline_mixes_whole_documents(spark, docs, rows, monkeypatch):
    """No document is cut, and sources far below a block get their target too."""
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    more = [(1000 + 10 * k + i, "few words of a small source", "a", f"tiny{k}") for k in range(4) for i in range(3)]
    rows = rows + [(*r, len(r[1]), 1, "s", True, 5, "t", "p") for r in more]
    df = docs.unionByName(spark.createDataFrame(rows[len(rows) - len(more) :], DOCS))
    out = corpus_pipeline.source_mix(spark, df, "").collect()
    assert {(r["doc_id"], r["text"]) for r in out} <= {(r[0], r[1]) for r in rows}
    size = lambda t: len(B.WORD.findall(t or ""))
    sizes, most, got = {}, {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
        most[r[3]] = max(most.get(r[3], 0), size(r[1]))
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
    for k, v in B.targets(sizes, sum(sizes.values())).items():
        assert abs(got.get(k, 0) - v) <= 2 + most[k] / 2
    again = corpus_pipeline.source_mix(spark, df.repartition(3), "").collect()
    assert sorted(key(r["doc_id"], r["text"]) for r in out) == sorted(key(r["doc_id"], r["text"]) for r in again)
    assert corpus_pipeline.source_mix(spark, df.limit(0), "").count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(6)
    for _ in range(3):
        weights, seats = [round(rng.random() * 100, 3) for _ in range(9)], rng.randint(1, 60)
        plain = [0] * 9
        for _ in range(seats):
            k = max(range(9), key=lambda i: (weights[i] / (2 * plain[i] + 1), -i))
            plain[k] += 1
        df = spark.createDataFrame([(i, float(w), seats, 1000, 0) for i, w in enumerate(weights)], "id int, w double, seats long, most long, g int")
        got = {r["id"]: r["quota"] for r in mixing.apportion(df, "seats", "w", "most", ["g"]).collect()}
        assert [got[i] for i in range(9)] == plain


def test_language(spark):
    rng = random.Random(8)
    words = {"aa": ["thing", "there", "with", "hold", "wish"], "bb": ["über", "schön", "nicht", "zeit", "grün"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, 1.0) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    rows += [(200, None, "aa", 1.0), (201, "", None, 1.0), (202, "123 !! 456", "bb", 1.0), (None, "with wish there", None, 1.0), (203, "nicht" * 3000, "bb", 1.0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = langid.learn(df)
    out = langid.identify(df, net).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (truth[r["doc_id"]] or "aa") and 0 < r["score"] <= 1
    assert langid.learn(df.limit(0)) is None and [r["lang_pred"] for r in langid.identify(df.limit(2), None).collect()] == ["und"] * 2


def test_backpropagation_is_the_gradient():
    net = langid.Gru(["a", "b", "c"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    s, y = np.array([list(b"hello"), list(b"world")], np.uint8), np.array([0, 2])
    _, grad = net.gradient(s, y)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            at = (int(s.ravel()[rng.integers(0, s.size)]) + 256 * int(rng.integers(0, 2)), *at[1:]) if k == "x" else at
            old, e = v[at], 1e-4
            v[at] = old + e
            up = net.gradient(s, y)[0]
            v[at] = old - e
            down = net.gradient(s, y)[0]
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_state_runs_on_across_words_and_spans(monkeypatch):
    """What a span's bytes get is what one run over the whole text gives, as far as LEAD bytes reach."""
    net = langid.Gru(["a", "b", "c"], 2)
    text = b"some words of a text that is longer than a few spans are, and not much more"
    s = np.frombuffer(text, np.uint8)[:, None]
    h = net.states(np.stack((s, s[::-1]), 1))
    whole = net.log_probabilities(np.concatenate((h[:, 0], h[::-1, 1]), 2))[:, 0].mean(0)
    for span, lead, exact in ((len(text), 0, True), (9, len(text), False), (16, 32, False)):
        monkeypatch.setattr(langid, "SPAN", span)
        monkeypatch.setattr(langid, "LEAD", lead)
        got = net.pooled([b"", text, b"x"])
        assert got[1] == pytest.approx(whole, abs=1e-5 if exact else 0.05) and not got[0].any()
    apart = np.mean([net.pooled([w])[0] for w in text.split()], 0)
    assert np.abs(apart - whole).max() > 1e-4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=/a>Menu one</a></nav>
<header><h1>Site name</h1></header><div class="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header>
<p>First  para<b>graph</b>,&nbsp;long enough to be the main text of it all.<p><b>Bold.<br><p>Second &lt;one&gt; with
a <a href="#">link</a> in it, also long enough.<ul><li>item<li>other</ul><div class="comments"><p>reader said</p></div></article>
<aside>Side text</aside><form><p>Search here</p></form><div class="ad">Buy</div><footer>&copy; me</footer>"""


def test_html(spark):
    want = "Title & more\nFirst paragraph, long enough to be the main text of it all.\nBold.\nSecond <one> with a link in it, also long enough.\nitem\nother"
    assert html.main_text(PAGE) == want
    pages = [(1, "u", PAGE, 7), (2, None, None, 7), (3, "v", "", 7), (None, "w", "no tags at all", 7), (4, "x", "<p>" * 3000 + "deep" + "</p>" * 3000, 7), (5, "y", "<div><div>a</div>" * 2000, 7), (6, "z", "<a href='<p>x", 7), (1, "u", PAGE, 7), (8, "n", "<nav>only menu</nav>", 7)]
    out = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int")).collect()
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    text = {r["url"]: r["text"] for r in out}
    assert text["u"] == want and text[None] == text["v"] == text["n"] == "" and text["w"] == "no tags at all" and text["x"] == "deep"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</b>" * 50_000, "<b>" * 50_000 + "</u>" * 50_000, "<p><td>" + "<ul>" * 50_000, "<div>" * 25_000 + "</p></span>" * 25_000, "<b '" * 50_000, "<header>" * 50_000, "<a href=\"" * 50_000])
def test_html_takes_linear_time(page):
    began = time.time()
    html.main_text(page + "x")
    assert time.time() - began < 4


def test_densities_are_those_of_the_subtrees():
    root, _ = html.parse(PAGE)
    nodes = html.measure(root)

    def count(x):  # characters, tags, characters in links, links
        own = [count(c) for c in x.children if not c.drop]
        chars = sum(len(p.replace(" ", "")) for p in x.parts if isinstance(p, str) and p.strip()) + sum(c[0] for c in own)
        links = [sum(c[k] for c in own) for k in (2, 3)]
        return chars, 1 + sum(c[1] for c in own), *([chars, links[1] + 1] if x.tag == "a" else links)

    body, body_links = count(root)[0], count(root)[2]
    for x in nodes:
        chars, tags, link_chars, link_tags = count(x)
        assert (x.chars, x.tags, x.link_chars, x.link_tags) == (chars, tags, link_chars, link_tags)
        if chars and link_chars < chars:
            base = chars / (chars - link_chars) * link_chars + body_links / body * chars + math.e
            assert x.density == pytest.approx(chars / tags * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1)) / math.log(math.log(base)), rel=1e-6)
        assert x.total == pytest.approx(sum(c.density for c in x.children if not c.drop))


def test_densest_block_is_found_without_an_article():
    body = "".join(f"<p>{'Some words of the story that go on for a while. ' * 4}</p>" for _ in range(5)).replace(". <", ".<")
    page = f"<body><div><ul>{'<li><a href=x>link text</a></li>' * 20}</ul></div><div><div>{body}</div></div><div><a href=y>more</a> <a href=z>links</a></div></body>"
    assert html.main_text(page) == "\n".join([("Some words of the story that go on for a while. " * 4).strip()] * 5)


@pytest.mark.parametrize("name", ["with-sidebar", "no-sidebar", "layout-header-fixed", "social-story", "widget", "comments-open"])
def test_names_do_not_drop_the_main_text(name):
    story = "Some words of the story that go on for a while. " * 4
    body = f'<div class="post-header"><h1>Title</h1></div>{f"<p>{story}</p>" * 4}<div class="comments"><p>{story}</p></div>'
    aside = f'<div class="sidebar"><ul>{"<li><a href=x>link text</a></li>" * 20}</ul></div><div class="cookie-notice">We use cookies</div>'
    assert html.main_text(f'<body><div id="content" class="{name}">{body}</div>{aside}</body>') == "\n".join(["Title", *[story.strip()] * 4])


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.15, 0.2)] + [base[:1].repeat(12, 0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 3, 9) for i, r in enumerate(x)]
    odd = [(500, None, 1, 9), (501, [], 1, 9), (502, [0.0] * 16, 1, 9), (503, [float("nan")] + [1.0] * 15, 1, 9), (504, [None] + [1.0] * 15, 1, 9), (505, [float("inf")] + [1.0] * 15, 1, 9), (506, [1.0, 2.0], 1, 9), (None, rows[2][1], 1, 9), rows[4]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links int")
    out = vectors.near_vectors(df).collect()
    every = rows + odd[-2:]
    y = np.array([r[1] for r in every], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    g = y @ y.T >= 0.95
    np.fill_diagonal(g, False)
    comp = B.components([(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(g)), strict=True)], len(every))
    ids = [r[0] for r in every]
    least = {}
    for i, c in zip(ids, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [key(i, int(n), least.get(c)) for i, n, c in zip(ids, g.sum(1), comp, strict=True)] + [key(i, 0, i) for i in range(500, 507)]
    assert sorted(key(r["vec_id"], r["n_links"], r["component_id"]) for r in out) == sorted(want)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_split_shards_and_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.05 for _ in range(4)]).astype(np.float32)
    for name, value in (("UNIT", 64), ("SHARD", 100)):
        monkeypatch.setattr(vectors, name, value)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = (y @ y.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    assert all(got[i] <= n[i] for i in range(len(x))) and sum(got.values()) >= 0.97 * n.sum()


def test_second_level_of_centroids(spark, monkeypatch):
    """A shard too large for a unit is cut by centroids of its own: each member lies in parts of all its shards, listed alike in each row."""
    for name, value in (("UNIT", 64), ("SHARD", 400), ("DEALT", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 12))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.03 for _ in range(4)])
    df = spark.createDataFrame([(i, 12, 1, v.tobytes()) for i, v in enumerate(x)], "cls long, dim long, n long, vec binary")
    models = {12: vectors.centroids(vectors._units([v.tobytes() for v in x], 12), 3)}
    sharded = df.mapInArrow(vectors._assign(models, 2), vectors._SHARDED)
    of = {}
    for r in sharded.collect():
        of.setdefault(r["cls"], set()).add(r["shard"])
    deep, size = {}, {}
    for r in vectors._deeper(df, sharded, 2).collect():
        near = np.frombuffer(r["near"], np.int64)
        assert near[r["rank"]] == r["shard"] and (r["n"], r["dim"], bytes(r["vec"])) == (1, 12, x[r["cls"]].tobytes())
        deep.setdefault(r["cls"], []).append((r["rank"], r["shard"], near.tolist()))
        size[r["shard"]] = size.get(r["shard"], 0) + 1
    assert set(deep) == set(range(len(x))) and max(size.values()) < 200
    for cls, units in deep.items():
        units.sort()
        listed = [u for u in units[0][2] if u >= 0]
        assert [u for _, u, _ in units] == listed and len(set(listed)) == len(listed)
        assert {u // vectors.PARTS for u in listed} == of[cls]


def test_exact_way_when_the_search_misses(spark, monkeypatch):
    """A graph without edges finds nothing, at any overlap; the exact way then finds all."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 12))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.06 for _ in range(3)] + [base[:1].repeat(5, 0)]).astype(np.float32)
    for name, value in (("UNIT", 32), ("SHARD", 40)):
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "range_search", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = y @ y.T >= 0.95
    np.fill_diagonal(g, False)
    comp = B.components([(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(g)), strict=True)], len(x))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (int(n), c) for i, (n, c) in enumerate(zip(g.sum(1), comp, strict=True))}


def test_licences(spark):
    wrapped = {
        "LGPL-2.1": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n",
        "GPL-2.0": " * Copyright (C) 2001 Someone\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n",
        "GPL-3.0": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n",
        "BSD-3-Clause": "/* Copyright 2020 X Y. All rights reserved.\n Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that the following conditions\n are met:\n",
    }
    code = "\nimport things\n\ndef walk(tree, depth):\n    return [walk(x, depth + 1) for x in tree.children] + sorted(numbers, key=order)\n" * 4
    files = [
        (1, "r/LICENSE", "Released under the MIT License.\n", 0), (2, "r/a.py", "code\nmore", 0), (3, "r/s/b.py", "import x\n# Licensed under the Apache License, Version 2.0.\ndef f(a, b, c):\n    return a + b + c + 4", 0), (4, "r/s/c.py", None, 0), (5, "r/s/t/COPYING", "All rights reserved. Something else follows here.", 0),
        (6, "r/s/t/u/d.py", "", 0), (7, "q/e.py", "the license of a poet is to lie", 0), (8, None, "Licensed under CC BY-NC 4.0.", 0), (9, "top.py", "x", 0), (None, "r/a.py", "code\nmore", 0),
        (10, "h/one.py", "All rights reserved. " + code, 0), (11, "h/two.py", code, 0), (12, "ap/LICENSE.txt", "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n" + code, 0), (13, "ap/x/y.c", code, 0),
        *[(20 + i, f"w{i}/f.c", text + code, 0) for i, text in enumerate(wrapped.values())],
    ]
    out = licenses.scan(spark.createDataFrame(files, "id long, path string, text string, license int"), "id", "path", "text").collect()
    got = {r["file_id"]: (r["license"], r["effective_license"], r["origin"]) for r in out}
    none, weak = (None, None, None), "LicenseRef-All-Rights-Reserved"
    assert got == {
        1: ("MIT", "MIT", "file"), 2: (None, "MIT", "r"), 3: ("Apache-2.0", "Apache-2.0", "header"), 4: (None, "MIT", "r"), 5: (weak, weak, "file"), 6: (None, weak, "r/s/t"), 7: none, 8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "file"), 9: none, None: (None, "MIT", "r"),
        10: (weak, weak, "header"), 11: none, 12: ("Apache-2.0", "Apache-2.0", "file"), 13: (None, "Apache-2.0", "ap"), **{20 + i: (k, k, "header") for i, k in enumerate(wrapped)},
    }
    assert licenses.scan(spark.createDataFrame([], "id long, path string, text string"), "id", "path", "text").count() == 0


def test_stages_on_the_odd_table(spark, docs, rows, none):
    """Each stage on every odd case: what it keeps and makes of it, and an empty table from an empty one."""
    labels = "/root/testdata/sf0.001"
    texts = {(r[0], r[1]) for r in rows}
    good = corpus_pipeline.quality_rules(spark, docs, labels).collect()
    base = {r[1]: B.quality_base(r[1])["base_failed"] for r in rows}
    assert {(r["doc_id"], r["text"]) for r in good} <= {x for x in texts if not base[x[1]]} and len(good) > 0.8 * sum(not base[r[1]] for r in rows)
    left = corpus_pipeline.near_dedup(spark, docs, labels).collect()
    first = B.near_duplicates([r[1] for r in rows], 5)
    groups = {}
    for r, c in zip(rows, first, strict=True):
        if B.shingle_set(r[1], 5):
            groups.setdefault(c, set()).add((r[0], r[1]))
    want = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    blank = {(r[0], r[1]) for r in rows if not B.shingle_set(r[1], 5)}
    assert sorted(key(r["doc_id"], r["text"]) for r in left) == sorted(key(*x) for x in [*want, *blank])
    clean = corpus_pipeline.personal_data(spark, docs, labels).collect()
    assert len(clean) == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in clean) and not any(sum(B.pii_base(r["text"])[0]) for r in clean)
    packed = corpus_pipeline.pack(spark, docs, labels).collect()
    assert sum(r["length"] for r in packed) == sum(len(B.token_ids(r[1])) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none.select(*corpus_pipeline.COLUMNS), labels)
        assert out.count() == 0 and (name == "pack" or out.columns == corpus_pipeline.COLUMNS)


def test_pipeline_deletes_what_it_wrote(spark, monkeypatch):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0
    left = [p for p in store._written if os.path.exists(p.removeprefix("file://"))]
    assert len(left) == 1 and left[0].rpartition("/")[2] in got.inputFiles()[0]
    store.sweep(spark)
    assert not os.path.exists(left[0].removeprefix("file://"))


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        store.shared_dir(Session)
    monkeypatch.setitem(Session.conf, "spark.checkpoint.dir", "s3://b/c/")
    assert store.shared_dir(Session) == "s3://b/c"
