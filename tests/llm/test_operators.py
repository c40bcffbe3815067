import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replicalens.llm import common, components, jaccard, katz, knn, langid, media, mixing, pieces, pii, quality, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(df, *names):
    return [tuple(None if pd.isna(v) else v for v in r) for r in df.select(*names).toPandas().astype(object).itertuples(index=False)]


# -- shared


def test_words_are_those_of_the_pattern():
    texts = ["  A b\t\nc ", "", None, "x\x0by\x0cz q\x1cw\xa0r é", "one"]
    codes, distinct, counts = common.words(pa.array(texts))
    flat, at = [distinct[i].as_py() for i in codes], 0
    for text, n in zip(texts, counts, strict=True):
        assert flat[at : at + n] == words(text)
        at += n


def test_blocks_cut_by_bytes_and_lose_nothing():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d" * 9, "e"])], names=["text"])
    got = [common.column(b, "text").to_pylist() for b in common.blocks([batch, batch.slice(0, 0), batch], 12)]
    assert list(itertools.chain(*got)) == 2 * batch.column(0).to_pylist() and max(map(len, got)) > 1 and len(got) > 4


# -- 1


def test_media_round_trip_and_values(spark, odd_docs, no_docs):
    got = media.run(odd_docs, 4096).toPandas()
    by_text = defaultdict(set)
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in got.itertuples():
        if pd.notna(r.doc_id):
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            stored = media.encode(payload)
            assert (r.media_bytes, r.media_sha256, r.width, r.height) == (len(stored), hashlib.sha256(stored).hexdigest(), 64, len(payload) // 64)
            by_text[raw].add((r.payload_sha256, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values()) and len(got) == odd_docs.count()
    assert media.run(no_docs).count() == 0


def test_media_notices_damage():
    data = bytearray(media.encode(media.payload_of("some text")))
    assert media.decode(bytes(data)).tobytes() == media.payload_of("some text")
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))


# -- 2


def brute_top(rows, is_query, k=5):
    """Each row of its own, whatever its vec_id."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, v) for i, v in ok if all(abs(x) <= 2**62 for x in v)]
    long = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = []
    for n, (q, v) in enumerate(ok):
        if is_query(q):
            best = sorted((-long(sum(a * b for a, b in zip(v, w, strict=False))), i) for m, (i, w) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("clash")).withColumn("row", F.lit("clash"))


@pytest.mark.parametrize("settings", [{}, {"n_pivots": 5, "query_rows": 3, "part_rows": 20}, {"n_pivots": 60, "query_rows": 2, "part_rows": 7}])
def test_top_k_equals_brute_force(spark, settings):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 420)] + [(500, None), (501, [1.0, None] * 4), (502, [math.nan] * 8), (503, [math.inf] * 8), (None, [1.0] * 8), (504, [0.5] * 3), (505, [])]
    rows += [(10, [rng.gauss(1, 0.3) for _ in range(8)]) for _ in range(3)] + [(7, [1.5] * 8)] * 4 + [(30, [1.5] * 8)] * 2 + [(40, [1.25] * 500), (41, [0.0] * 3000 + [1.0])]
    df = vectors(spark, rows).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(plain(knn.top_k(df, F.col("vec_id") % 10 == 0, **settings), "query_id", "rank", "vec_id", "score"))
    assert got == brute_top(rows, lambda i: i % 10 == 0)


def test_top_k_of_huge_and_tiny_components(spark):
    rng = random.Random(8)
    size = lambda i: 10.0 ** rng.choice([-3, 0, 6, 9, 12, 16])
    rows = [(i, [rng.gauss(0, 1) * size(i) for _ in range(6)]) for i in range(150)] + [(200, [1e19, -1e20]), (201, [1e300] * 2), (202, [1.0, -1e16, 1e16]), (203, [0.0, 1e16, 1e16])]
    for settings in ({}, {"n_pivots": 9, "query_rows": 10, "part_rows": 30}):
        got = sorted(plain(knn.top_k(vectors(spark, rows, "double"), F.lit(True), **settings), "query_id", "rank", "vec_id", "score"))
        assert got == brute_top(rows, lambda i: True)


def test_top_k_of_little(spark):
    assert knn.top_k(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    assert knn.top_k(vectors(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0
    got = plain(knn.top_k(vectors(spark, [(0, [1.0]), (0, [0.5]), (7, [-1.0]), (7, [-1.0]), (3, [-1.0])]), F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == [(0, 1, 0, 32768), (0, 1, 0, 32768), (0, 2, 3, -65536), (0, 2, 3, -32768), (0, 3, 7, -65536), (0, 3, 7, -32768), (0, 4, 7, -65536), (0, 4, 7, -32768)]


# -- 3


def brute_katz(rows, order):
    """Scores by the textbook, over dictionaries."""
    end, start = ("end",), ("start",)
    texts = [(i, [*words(t), end]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    grams = lambda t: [tuple([start] * (order - 1) + t)[k : k + order] for k in range(len(t))]
    seen = {m: defaultdict(Counter) for m in range(1, order + 1)}  # by order: history, word
    for i, t in texts:
        if not held(i):
            for g in grams(t):
                for m in seen:
                    seen[m][g[order - m : -1]][g[-1]] += 1
    one = seen[1][()]
    n, kinds = sum(one.values()), len(one)
    d = {m: katz.discounts(np.array([0, *(sum(v == r for x in t.values() for v in x.values()) for r in range(1, katz.K + 2))])) for m, t in seen.items()}
    left = sum((1 - d[1][min(c, katz.K + 1)]) * c for c in one.values())
    more = 0 if n and left > 0 else 1

    def p(h, w):
        m = len(h) + 1
        if m == 1:
            return d[1][min(one[w], katz.K + 1)] * one[w] / (n + more) if one[w] else (left / n if not more else 1 / (n + 1))
        if h not in seen[m]:
            return p(h[1:], w)
        after = seen[m][h]
        below = sum(after.values()) + (min(after.values()) > katz.K)
        if w in after:
            return d[m][min(after[w], katz.K + 1)] * after[w] / below
        return (1 - sum(d[m][min(c, katz.K + 1)] * c for c in after.values()) / below) / (1 - sum(p(h[1:], x) for x in after)) * p(h[1:], w)

    for m, t in seen.items():
        for h in list(t)[:15]:
            assert abs(sum(p(h, w) for w in one) + p(h, ("unknown",)) - 1) < 1e-9, m
    return [(i, held(i), len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + kinds + 1)) for w in t), sum(math.log10(p(g[:-1], g[-1])) for g in grams(t))) for i, t in texts], seen


def marked(df):
    return df.select("doc_id", "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))


@pytest.mark.parametrize("order, hot_least", [(2, katz.HOT_LEAST), (3, katz.HOT_LEAST), (3, 5), (4, 5)])
def test_katz_equals_brute_force(spark, odd_docs, order, hot_least):
    """The same scores whether histories are dealt whole or, as hot ones, by n-gram."""
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(500 + i, " ".join(rng.choice("ab cd ef the of one".split()) for _ in range(rng.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, seen = brute_katz(rows, order)
    result = katz.train_and_score(marked(df), order=order, bucket_bytes=4096, hot_least=hot_least, block_bytes=8192, wide=4 * hot_least)
    got = plain(result.scores, *[c.split()[0] for c in katz.SCORES.split(", ")])
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-12) and g[6] == pytest.approx(w[6], rel=1e-10)
    unigrams = [katz._split(r.table) for r in spark.read.parquet(result.tables[1]).where("block IS NULL").collect()]
    name = {int(i): w.decode() for words_, numbers, _ in unigrams for i, w in zip(numbers, katz._unwords(words_.tobytes()), strict=True)}
    name |= {katz.START: ("start",), katz.END: ("end",)}
    for m in range(2, order + 1):
        table = {g: c for r in spark.read.parquet(result.tables[m]).where("table IS NOT NULL AND block IS NULL").collect() for g, c in katz.ngrams(r.table, m)}
        assert {tuple(name[x] for x in g): c for g, c in table.items()} == {(*h, w): c for h, t in seen[m].items() for w, c in t.items()}


def test_katz_without_training(spark, no_docs):
    assert katz.train_and_score(marked(no_docs)).scores.count() == 0
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = plain(katz.train_and_score(marked(spark.createDataFrame([(key, "a b")], "doc_id long, text string"))).scores, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert row == [(3, 0, 0, 0.0, 0.0)]


# -- 4


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for x, (i, _) in zip(label, rows, strict=True):
        least[x].append(i)
    ids = {x: min((i for i in v if i is not None), default=None) for x, v in least.items()}
    return [(i, len(s), ids[x]) for (i, _), s, x in zip(rows, sets, label, strict=True)]


def family(rng, base, n, least, most):
    """n texts that differ from base in some words."""
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(least, most)):
            w[at] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("settings", [{}, {"part_shingles": 1500, "bucket_postings": 200}])
def test_jaccard_equals_brute_force(spark, odd_docs, monkeypatch, settings):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for start in (1000, 2000):
        base = [f"w{rng.randrange(3000)}" for _ in range(100)]
        rows += [(start + i, t) for i, t in enumerate(family(rng, base, 40, 0, 6))]
    passage = [f"p{i}" for i in range(60)]
    rows += [(3000 + i, " ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(30))])) for i in range(40)]
    if settings:
        monkeypatch.setattr(jaccard, "RUN_MEMBERS", 7)  # runs then go by parts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = plain(jaccard.components_of(df, **settings), "doc_id", "n_shingles", "component_id")
    none_last = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=none_last) == sorted(brute_components(rows), key=none_last)


def test_hot_runs_are_dealt_in_shares(spark, monkeypatch):
    """A family of near copies and a passage that many share: the same components whatever a join or a task may hold."""
    rng = random.Random(16)
    base = [f"w{rng.randrange(2000)}" for _ in range(60)]
    rows = list(enumerate(family(rng, base, 150, 1, 9)))
    passage = [f"p{i}" for i in range(40)]
    rows += [(1000 + i, " ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 30)))])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("DEAL", 5), ("RUN_MEMBERS", 16), ("RUN_ROWS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    got = plain(jaccard.components_of(df, part_shingles=900, bucket_postings=300), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == sorted(brute_components(rows))


def test_jaccard_boundary_and_empty(spark, no_docs):
    assert jaccard.components_of(no_docs).count() == 0
    base = [f"w{i}" for i in range(39)]  # 35 shingles; 5 more words on one side: 35 of 40, less than 0.75 at 12 more
    rows = [(1, " ".join(base)), (2, " ".join([*base, *(f"x{i}" for i in range(11))])), (3, " ".join(base[:24])), (4, " ".join(base[:30]))]
    got = plain(jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == sorted(brute_components(rows))


def test_jaccard_texts_go_to_their_groups_in_fewer_bytes_than_sets(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["and", "the", "ening", "thon", "ouly", "tion", "herin"]) + rng.choice(["", "er", "ly"]) for _ in range(400)) for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(texts), (0, "of another node")], "doc_id long, text string")
    sets = jaccard.shingles(pa.array(texts))
    wanted = spark.createDataFrame([(i, jaccard.node_of(x)) for i, x in enumerate(sets)], "doc_id long, node long")
    sent = jaccard.sets_of(docs, wanted).toPandas()
    assert sent["members"].map(len).sum() < 4 * sum(map(len, sets))  # 8 bytes each as hashes
    frame, got = jaccard.read_sets(sent)
    assert {n: x.tolist() for n, x in zip(frame["node"], got, strict=True)} == {jaccard.node_of(x): x.tolist() for x in sets}


def test_jaccard_sends_only_packed_texts_of_groups(spark, monkeypatch):
    """However many documents meet in runs: where their rows are too many for a broadcast, no plain text is shuffled."""
    rng = random.Random(6)
    one, two, three = ([f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(200)] for _ in range(3))
    rows = [(0, " ".join(one)), (1, " ".join([*one[:-1], "other"])), (2, " ".join(two)), (3, " ".join([*two[:80], *three[:120]])), (None, " ".join(three)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "small", lambda *a: False)
    asked, plans, real = [], [], jaccard.sets_of

    def recorded(docs, wanted, *args, **more):
        sent = real(docs, wanted, *args, **more)
        asked.extend(r.doc_id for r in wanted.collect())
        plans.append(sent._jdf.queryExecution().executedPlan().toString())
        return sent

    monkeypatch.setattr(jaccard, "sets_of", recorded)
    for part in (jaccard.PART_SHINGLES, 100):
        got = plain(jaccard.components_of(docs, part_shingles=part), "doc_id", "n_shingles", "component_id")
        assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    assert set(asked) == {0, 1}  # 2 and 3 share shingles, but no link is possible
    for plan in plans:
        for below in plan.split("Exchange")[1:]:
            assert "text" not in below or "MapInArrow" in below.partition("text")[0]


def test_one_of_each_keeps_one(spark, odd_docs):
    kept = jaccard.one_of_each(odd_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    comp = brute_components(rows)
    full = [x for x in comp if x[1]]
    assert len({x[2] for x in full}) == len(full)
    every = brute_components([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert {x[2] for x in full} == {x[2] for x in every if x[1]}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (401, 400)]
    got = dict(plain(components.components(spark.createDataFrame(edges, "a long, b long"), common.new_folder(spark, "t")), "node", "component"))
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(50)) and got[401] == got[400] == 400 and 300 not in got


# -- 5


def test_warc_round_trip(spark):
    big, small = "x" * 200, "y" * 99
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, None, None), (None, "u", big), (3, "again", big), (8, "u", "é" * 50), (7, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = common.new_folder(spark, "warc")
    manifest = warc.write(pages, root, part_bytes=2500, roll_bytes=600)
    got = plain(warc.read(manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {big: 3, "é" * 50: 7}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and (i is None or i > first[html])
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and manifest.count() > 3
    assert manifest.select("part").distinct().count() > 1
    again = warc.write(pages.repartition(2).withColumn("part", F.lit("clash")), common.new_folder(spark, "warc"), part_bytes=2500, roll_bytes=600)
    assert {r.sha256 for r in manifest.collect()} == {r.sha256 for r in again.collect()}
    assert warc.read(warc.write(pages.limit(0), common.new_folder(spark, "warc"))).count() == 0


def test_warc_files_depend_on_the_rows_alone(spark):
    """Two archives of 60,000 pages, written in one session under other layouts and partition counts: file for file the same."""
    html = F.concat(F.lit("page "), F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")))
    hot = F.when(F.col("id") % 3 == 0, F.lit(77)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.xxhash64("id") % 10**9)
    pages = spark.range(60000).select(hot.cast("long").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 7 > 0, html).alias("html"))
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions, shuffles in ((5, "4"), (3, "9")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        manifest = warc.write(pages.repartition(partitions), common.new_folder(spark, "warc"), part_bytes=4 << 20, roll_bytes=1 << 20)
        found.append(sorted((r.part, r.number, r.first_page or -1, r.last_page or -1, r.records, r.bytes, r.sha256) for r in manifest.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] and len({x[0] for x in found[0]}) >= 10 and sum(x[4] for x in found[0]) == 60000
    assert max(x[4] for x in found[0]) < 12000  # the page that a third share is in several files
    assert warc.read(manifest).count() == 60000


def test_ranges_of_keys():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 2, 500), rng.integers(-3, 3, 500), rng.integers(0, 9, 500)]
    limits = sorted({tuple(int(x[i]) for x in keys) for i in range(0, 500, 37)} | {(0, -9, 0)})
    got = warc.part_of(*keys, tuple(np.array(x) for x in zip(*limits, strict=True)))
    assert got.tolist() == [max(n for n, x in enumerate(limits) if x <= key) for key in zip(*(k.tolist() for k in keys), strict=True)]


def test_warc_reader_refuses_what_the_manifest_does_not_know(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    manifest = warc.write(pages, common.new_folder(spark, "warc"))
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read(manifest.withColumn("sha256", F.lit("0"))).collect()


# -- 6


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    model = quality.grow(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97

    def walk(row):  # one row, one tree at a time
        total = model.base
        for f, t, v in zip(model.feature, model.limit, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def plain_grow(x, y, trees):
    """Boosted trees by loops: every feature and cut of every node is tried; (feature, limit, values) of each tree."""
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1]).tolist())) for f in range(x.shape[1])]
    base = math.log(y.mean() / (1 - y.mean()))
    total, out = [base] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        inner = 2**quality.DEPTH - 1
        feature, limit, rows = [0] * inner, [math.inf] * inner, {0: list(range(len(y)))}
        for node in range(inner):
            mine, best = rows[node], 1e-6
            score = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + 1)  # noqa: B023, E731
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left, right = [i for i in mine if x[i, f] <= c], [i for i in mine if x[i, f] > c]
                    if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= quality.LEAST_HESSIAN and (gain := score(left) + score(right) - score(mine)) > best + 1e-12:
                        best, feature[node], limit[node] = gain, f, c
            rows[2 * node + 1] = [i for i in mine if x[i, feature[node]] <= limit[node]]
            rows[2 * node + 2] = [i for i in mine if x[i, feature[node]] > limit[node]]
        values = []
        for leaf in range(inner, 2 * inner + 1):
            values.append(quality.RATE * sum(g[i] for i in rows[leaf]) / (sum(h[i] for i in rows[leaf]) + 1))
            for i in rows[leaf]:
                total[i] += values[-1]
        out.append((feature, limit, values))
    return base, out


def test_trees_equal_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "DEPTH", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = (x[:, 0] + 0.5 * rng.normal(size=160) > x[:, 1] ** 2 - 0.5).astype(int)
    base, trees = plain_grow(x, y, 4)
    model = quality.grow(x, y, 4)
    assert model.base == pytest.approx(base)
    for (feature, limit, values), f, t, v in zip(trees, model.feature, model.limit, model.value, strict=True):
        used = [i for i in range(7) if limit[i] < math.inf]
        assert used == [i for i in range(7) if t[i] < math.inf] and [feature[i] for i in used] == [f[i] for i in used]
        assert [limit[i] for i in used] == pytest.approx([t[i] for i in used]) and values == pytest.approx(v.tolist())


def plain_statistics(text):
    text = text or ""
    w, raw = [x.lower() for x in WORD.findall(text)], text.encode()
    lower = [x.translate(LOWER) for x in WORD.findall(text)]
    w = lower
    lines = text.split("\n")
    share = lambda test: sum(map(test, raw)) / max(len(raw), 1)
    kinds = Counter(w)
    marks = [share(lambda b, c=c: b == ord(c)) for c in quality.CLASSES]
    letters = [share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b >= 128)]
    n = max(len(w), 1)
    first = [math.log1p(len(raw)), math.log1p(len(w)), sum(len(x.encode()) for x in w) / n, len(kinds) / n, max(kinds.values(), default=0) / n, sum(a == b for a, b in itertools.pairwise(w)) / n, math.log1p(len(lines)), 1 - len(set(lines)) / len(lines)]
    return [*first, *marks, *letters, 1 - sum(marks) - sum(letters) if raw else 0.0]


def test_statistics_equal_their_definition():
    rng = random.Random(14)
    texts = [None, "", " ", "\n", "a" * 300_000, "w " * 50_000] + ["".join(rng.choice("aB1 \n!|#*$%&.,é-\t") for _ in range(rng.randrange(80))) for _ in range(300)]
    got = quality.statistics(pa.array(texts))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-9)


def test_quality_on_labels_held_out(spark):
    """Of the documents whose labels the model may not use, nearly all are judged as these say."""
    sf = "/root/testdata/sf0.01"
    found = quality.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found["predicted"] == found["quality"]).mean() > 0.95


def test_quality_on_odd_documents(spark, odd_docs, no_docs):
    ids = [r.doc_id for r in odd_docs.collect() if r.doc_id is not None]
    labels = spark.createDataFrame([*((i, i % 2) for i in ids), (ids[0], None), (None, 1), (10**6, 1)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    rows = plain(quality.predict(odd_docs, model, ["doc_id"]), "doc_id", "score")
    assert len(rows) == odd_docs.count() and all(0 <= s <= 1 for _, s in rows)
    none = quality.fit(odd_docs, labels.limit(0))
    assert {s for _, s in plain(quality.predict(no_docs, none, ["doc_id"]), "doc_id", "score")} == set()
    assert {s for _, s in plain(quality.predict(odd_docs, none, ["doc_id"]), "doc_id", "score")} == {0.5}
    assert quality.kept(odd_docs, labels).columns == odd_docs.columns


def test_statistics_of_a_text():
    x = dict(zip(quality.NAMES, quality.statistics(pa.array(["Ab ab! x\nab"]))[0], strict=True))
    assert x["distinct_words"] == 3 / 4 and x["top_word"] == 2 / 4 and x["word_length"] == 8 / 4 and x["exclamations"] == 1 / 11 and x["uppers"] == 1 / 11
    assert quality.statistics(pa.array([None, ""])).shape == (2, len(quality.NAMES)) and np.isfinite(quality.statistics(pa.array([None, "", " "]))).all()


# -- 7


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
        if not open_:
            return target


def brute_odds(rows, sizes_of):
    """(whole copies, chance beyond them, target, rest) of each row of (doc_id, text, source), by filling up one class of lengths after the other."""
    sizes = Counter()
    for (_, _, s), n in zip(rows, sizes_of, strict=True):
        sizes[s] += n
    target, out = brute_targets(dict(sizes)), {}
    for s in sizes:
        classes = Counter()
        for (_, _, x), n in zip(rows, sizes_of, strict=True):
            if x == s:
                classes[len(f"{n:b}")] += n
        full = set()
        while True:
            open_ = sum(w * words_ for w, words_ in classes.items() if w not in full)
            level = (target[s] - 2 * sum(classes[w] for w in full)) / open_ if open_ else math.inf
            over = {w for w in classes if w not in full and level * w > 2 + 1e-12}
            if not over or full | over == set(classes):
                break
            full |= over
        if not sizes[s]:
            expected = dict.fromkeys(classes, 0.0)
        elif target[s] >= 2 * sizes[s]:
            expected = dict.fromkeys(classes, 2.0)
        else:
            expected = {w: 2.0 if w in full else min(2.0, level * w) for w in classes}
        rest = target[s] - sum(math.floor(expected[w]) * n for w, n in classes.items())
        out[s] = {w: (math.floor(e), e - math.floor(e), target[s], rest) for w, e in expected.items()}
    return [out[s][len(f"{n:b}")] for (_, _, s), n in zip(rows, sizes_of, strict=True)]


def brute_mix(rows, seed="mix-1"):
    """Copies of each row of (doc_id, text, source): a Pareto draw source by source, in one list."""
    sizes_of = [len(words(t)) for _, t, _ in rows]
    copies, drawn = [], defaultdict(list)
    for k, ((i, t, s), n, (whole, chance, _, rest)) in enumerate(zip(rows, sizes_of, brute_odds(rows, sizes_of), strict=True)):
        copies.append(whole)
        if chance > 0 and rest > 0:
            digest = hashlib.sha256(f"{seed}:{'null' if i is None else i}:{t or ''}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 2**52
            drawn[s].append(((u / (1 - u)) / (chance / (1 - chance)), digest, n, k, rest))
    for ranked in drawn.values():
        before = 0
        for _, _, n, k, rest in sorted(ranked):
            copies[k] += 2 * before + n <= 2 * rest
            before += n
    return copies


def mixed_rows(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    return docs, mixing.mix(docs, **settings)


@pytest.mark.parametrize("bins", [mixing.BINS, 3])
def test_mixing_equals_brute_force(spark, odd_docs, no_docs, bins):
    rng = random.Random(5)
    rows = [(i, "w " * int(rng.paretovariate(0.7)), rng.choice(["a", "b", "c", "d", "é", None, "", "hot", "hot", "hot", "hot"])) for i in range(1500)]
    rows += [(None, "w " * rng.randrange(9), "hot") for _ in range(300)] + [(7000, "same words here", "b")] * 300 + [(None, None, "c")] * 20 + [(8000, "x y", "empty"), (8001, "", "none"), (8002, None, "none")]
    docs, got = mixed_rows(spark, rows, bins=bins)
    got = Counter((r.doc.doc_id, r.doc.text, r.doc.source, r.size, r.copies) for r in got.collect())
    assert got == Counter((i, t, s, len(words(t)), c) for (i, t, s), c in zip(rows, brute_mix(rows), strict=True))
    again = Counter((r.doc.doc_id, r.doc.text, r.doc.source, r.size, r.copies) for r in mixing.mix(docs.repartition(7)).collect())
    assert got == again
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).agg(F.sum("target")).first()[0] == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(3000)]
    _, got = mixed_rows(spark, rows)
    got, sizes = got.collect(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    for s in sizes:
        mine = [r for r in got if r.doc.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s] and max(r.copies for r in mine) <= 2
        assert abs(sum(r.copies * r.size for r in mine) - want[s]) <= 40


def test_documents_are_included_by_their_own_odds():
    """Over many draws documents of each length are taken about as often as their odds say, and every draw has its size."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([1, 2, 5, 12, 40, 100]), "abc"[i % 3]) for i in range(240)]
    sizes_of = [len(words(t)) for _, t, _ in rows]
    wanted, runs = brute_odds(rows, sizes_of), 300
    taken, classes = np.zeros(len(rows)), defaultdict(list)
    for n in range(runs):
        copies = brute_mix(rows, f"s{n}")
        taken += copies
        for s in "abc":
            mine = [k for k, r in enumerate(rows) if r[2] == s]
            assert abs(sum(copies[k] * sizes_of[k] for k in mine) - wanted[mine[0]][2]) <= 100
    for k, (whole, chance, *_) in enumerate(wanted):
        classes[rows[k][2], sizes_of[k]].append((taken[k] / runs, whole + chance))
    assert len({round(x[0][1], 6) for x in classes.values()}) > 6  # odds do differ by document
    for x in classes.values():
        assert abs(np.mean([a for a, _ in x]) - x[0][1]) < 0.06


def test_hot_sources_are_not_ordered_whole(spark):
    """Of a source with most rows, at its cap or below, few rows fall into the bin that is ordered; equal rows are one."""
    for share in (1.5, 0.9):
        rows = [(i, "w " * (1 + i % 50), "b") for i in range(6000)] + [(i, "w " * 30, "a") for i in range(6000, 6300)] + [(9000, "again and again", "b")] * 3000
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        folder = common.new_folder(spark, "t")
        found = mixing.described(docs)
        sizes = common.stage(found.select(F.col("doc.source").alias("source"), "source_key", "size", "digits", "draw", "row"), f"{folder}/s")
        table = mixing.odds(sizes, mixing.targets(sizes, folder, share=share))
        _, edge = mixing.limits(mixing.ranked(sizes, table), folder)
        assert edge.count() <= 12
        assert Counter((r.doc.doc_id, r.copies) for r in mixing.mix(docs, share=share).collect() if r.doc.doc_id == 9000).total() == 3000


def test_mixed_repeats_rows(spark, odd_docs):
    docs = spark.createDataFrame([(i, "w w w", "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, source string")
    copies = {r.doc.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in mixing.mixed(docs).collect()) == Counter({k: v for k, v in copies.items() if v})
    again = mixing.mixed(odd_docs)
    assert again.columns == odd_docs.columns and again.count() == mixing.mix(odd_docs).agg(F.sum("copies")).first()[0]


def test_running_sums_over_parts(spark):
    rows = [(i % 97, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = plain(common.running(df, [F.col("a"), F.col("b")], f"{common.new_folder(spark, 't')}/r", s=F.col("b"), n=F.lit(1)), "a", "b", "s", "n")
    rows.sort()
    assert sorted(got) == [(a, b, sum(y for _, y in rows[:k]), k) for k, (a, b) in enumerate(rows)]


# -- 8


CASES = [
    ("mail a.b@c.de, x@y and q@w.e.r", [("email", "a.b@c.de"), ("email", "q@w.e.r")]), ("at 1.2.3.4 and 256.1.1.1 1.2.3.4.5 0001.2.3.255", [("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("ip", "0001.2.3.255")]),
    ("4111 1111-1111 1111 and 4111111111111112", [("card", "4111 1111-1111 1111")]), ("+1 (223) 555-5938, +12 345", [("phone", "+1 (223) 555-5938")]), ("", []), (None, []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_base_spans(text, want):
    assert sorted((pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)) == sorted(want)


def test_base_spans_equal_the_contract_on_random_text():
    """The patterns as written, on every text, without the shortcuts."""
    rng = random.Random(2)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    for _ in range(3000):
        text = "".join(rng.choice("aB@..--+( )0123456789% é\n") for _ in range(rng.randrange(60)))
        want = sorted((m.start(), pii.KINDS.index(k), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if ok[k](m[0]))
        assert pii.base_spans(text) == want


def test_contexts_find_what_patterns_cannot(spark):
    rng = random.Random(4)
    rows = [(i, f"call the desk hotline +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today") for i in range(12)]
    rows += [(100, "call the desk hotline 555-12345 today"), (101, "order number 555-98765 shipped"), (102, "hotline"), (103, None), (103, "call the desk hotline 555-77777 today")]
    rows += [(200 + i, f"desk of {i}55-99999") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.detect(df.select("doc_id", "text")).collect() if r.doc_id != 103}
    assert got[100] == [(3, 22, 31)] and got[101] == [] and got[102] == [] and all(len(got[i]) == 1 for i in range(12))
    masked = {(r.doc_id, r.text) for r in pii.masked(df.select("doc_id", "text")).collect()}
    assert (100, "call the desk hotline [PHONE] today") in masked and (103, None) in masked and (0, "call the desk hotline [PHONE] today") in masked


@pytest.mark.parametrize(
    "text, want",
    [("call (017) 555-7713 now", ["(017) 555-7713"]), ("(call 017 555 7713)", ["017 555 7713"]), ("(017 555 7713).", ["017 555 7713"]), ("+49 30 1234, x", ["+49 30 1234"]), ("x12 345 6789", ["345 6789"]), ("5 555  7 77a 9", ["5 555"]),
     ("4111 1111 1111 1112", ["4111 1111 1111 1112"]), ("12. 345 67 89", ["345 67 89"]), ("12 34.5x 6", [])],
)
def test_runs_with_spaces(text, want):
    assert [text[a:b] for a, b in pii.runs(text)] == want


def test_contexts_find_identifiers_with_spaces(spark):
    rng = random.Random(5)
    rows = [(i, f"call the desk hotline +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today") for i in range(12)]
    for i in range(12):
        body = f"4{rng.randrange(10**13, 10**14)}"
        card = next(f"{body}{c}" for c in range(10) if pii.luhn(f"{body}{c}"))
        rows.append((50 + i, f"paid with visa card {card} thanks"))
    rows += [(100, "call the desk hotline (017) 555-7713 today"), (101, "paid with visa card 4111 1111 1111 1112 thanks"), (102, "lot (017) 555-7714 and 4111 1111 1111 1113 shipped")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [(pii.KINDS[x.kind], texts[r.doc_id][x.start : x.end]) for x in r.spans] for r in pii.detect(df).collect()}
    assert ("phone", "(017) 555-7713") in got[100] and got[101] == [("card", "4111 1111 1111 1112")] and got[102] == []
    masked = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert masked[100] == "call the desk hotline [PHONE] today" and masked[101] == "paid with visa card [CARD] thanks"


def test_copies_of_one_document_support_nothing(spark):
    rows = [(i, "call the desk hotline +1 (223) 555-5938 today") for i in range(30)] + [(100, "call the desk hotline 555-12345 today")]
    got = {r.doc_id: len(r.spans) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == 0 and got[0] == 1


def plain_contexts(text, start, end, base):
    """Two words before and one behind, as far as the nearest span of the fixed patterns, straight from the definition."""
    floor, ceiling = max([e for _, _, e in base if e <= start], default=0), min([s for s, _, _ in base if s >= end], default=len(text))
    strip = lambda x: x.strip(pii.EDGE).lower()
    before, behind = [strip(x) for x in WORD.findall(text[floor:start])], [strip(x) for x in WORD.findall(text[end:ceiling])]
    left, farther, right = (before or [""])[-1], (["", *before] if len(before) > 1 else ["", ""])[-2], (behind or [""])[0]
    every = [(f"l:{left}", left), (f"ll:{farther} {left}", left and farther), (f"r:{right}", right), (f"lr:{left} {right}", left and right)]
    return sorted(x for x, there in every if there)


def plain_instances(text):
    base, found = pii.base_spans(text), []
    for m in WORD.finditer(text or ""):
        token = m[0].strip(pii.EDGE)
        if token and ("@" in m[0] or len(re.sub("[^0-9]", "", m[0])) >= 5):
            start = m.start() + m[0].index(token)
            found.append((start, start + len(token)))
    found = [(s, pii.looks_like(text[s:e]), e) for s, e in found + pii.runs(text or "")]
    found = [(s, k, e) for s, k, e in found if k is not None and not any(a < e and s < b for a, _, b in base)]
    return [(s, k, e, seed, text[s:e], plain_contexts(text, s, e, base)) for rows, seed in ((base, True), (found, False)) for s, k, e in rows]


def test_instances_equal_their_definition():
    rng = random.Random(12)
    parts = ["call", "to:", "1.2.3.4", "5.6.7.8;9.9.9.9", "x=7.7.7.7,", "555-12345", "(017)", "555-7713", "a@b.cd", "a@b", "+1 (223) 555-5938", "4111 1111 1111 1111", "12", "é", "word-1.1.1.1-word", "...", "00000", "\n", "  "]
    for _ in range(1500):
        text = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", " ", "\t"]) for _ in range(rng.randrange(14)))
        got = [(*x[:5], sorted(x[5])) for x in pii.instances(text, pii.base_spans(text))]
        assert sorted(got) == sorted(plain_instances(text)), text


def plain_discovered(texts):
    """The graph of patterns and instances scored over dictionaries: the strings that are accepted, with their kinds."""
    found = {x[3:5] + (x[1], p) for t in texts for x in plain_instances(t) for p in x[5]}
    seeds, edges = ({(v, k, p) for seed, v, k, p in found if seed == want} for want in (True, False))
    per = Counter((p, k) for _, k, p in seeds)
    touched = Counter(p for _, _, p in seeds) + Counter(p for _, _, p in edges)
    accepted = {}
    for _ in range(pii.ROUNDS):
        more = Counter()
        for v, k, p in edges:
            more[p, k] += accepted.get((v, k), 0)
        trust = {x: (n + more[x]) / touched[x[0]] for x, n in per.items() if n >= pii.SUPPORT}
        doubt = {}
        for v, k, p in edges:
            if trust.get((p, k), 0) >= pii.CONFIDENT:
                doubt[v, k] = doubt.get((v, k), 1) * max(1 - trust[p, k], 1e-9)
        accepted = {x: 1 - d for x, d in doubt.items()}
    return {x for x, conf in accepted.items() if conf >= pii.CONFIDENT}


def test_discovery_equals_brute_force(spark):
    rng = random.Random(13)
    words_ = ["call", "mail", "host", "order", "visa", "desk"]
    things = {
        "call": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "mail": lambda: f"u{rng.randrange(99)}@x.org", "host": lambda: f"10.0.{rng.randrange(256)}.{rng.randrange(256)}",
        "order": lambda: f"555-{rng.randrange(10000, 99999)}", "visa": lambda: f"4111 1111 1111 {rng.randrange(1000, 9999)}", "desk": lambda: f"{rng.choice('ab')}@{rng.choice('cd')}",
    }
    texts = []
    for _ in range(150):
        line = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(words_)
            thing = things[w if rng.random() < 0.85 else rng.choice(words_)]()
            line.append(f"{rng.choice(['the', 'my', 'a'])} {w} {thing} {rng.choice(['now', 'today', 'please'])}")
        texts.append(" ".join(line))
    texts += texts[:20] + [None, ""]
    wanted = plain_discovered(texts)
    got = {r.doc_id: sorted((x.start, x.kind, x.end) for x in r.spans) for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert wanted and len(got) == len(texts)
    for i, t in enumerate(texts):
        new = {(s, k, e) for s, k, e, seed, v, _ in plain_instances(t) if not seed and (v, k) in wanted}
        assert set(got[i]) == {*pii.base_spans(t), *new}, t


@pytest.mark.parametrize(
    "text",
    ["x" * 10**6, "0" * 10**6, "1." * 500_000, "a@" * 500_000, "a@b." * 250_000, "+1" * 500_000, "1-" * 500_000, "4 " * 500_000, "1.2.3.4;" * 125_000, "(" * 10**6, "9(" * 500_000, "x" * 500_000 + " 10.0.0.1 " + " " * 400_000 + "555-12345", "0" * 5000 + ".0.0.0", "+1 ((((" * 140_000],
)
def test_scanning_takes_linear_time(text):
    """A million characters in a time that a quadratic scan would need for some thousand; none crashes."""
    began = time.perf_counter()
    pii.instances(text, pii.base_spans(text))
    assert time.perf_counter() - began < 6


def test_words_beside_a_span_have_any_length():
    text = "w" * 300 + " " * 200 + "10.0.0.1" + "\n" * 100 + "v" * 200
    assert pii.instances(text, pii.base_spans(text))[0][5] == [f"l:{'w' * 300}", f"r:{'v' * 200}", f"lr:{'w' * 300} {'v' * 200}"]


def test_pii_on_odd_documents(odd_docs, no_docs):
    assert pii.detect(odd_docs).count() == odd_docs.count() and pii.detect(no_docs).count() == 0
    assert pii.masked(odd_docs).columns == odd_docs.columns


# -- 9


def test_pieces_are_lossless_and_keyed(spark, odd_docs, no_docs):
    got = pieces.digests(odd_docs).toPandas()
    assert got["lossless"].all() and len(got) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    encoded = pieces.encode(odd_docs.where("doc_id < 20"), ["doc_id"])
    assert {r.doc_id: r.text for r in pieces.decoded(encoded, ["doc_id"]).collect()} == {i: t or "" for i, t in texts.items() if i < 20}
    assert pieces.digests(no_docs).count() == 0
    other = odd_docs.where("doc_id < 20").orderBy(F.desc("doc_id")).coalesce(1)
    assert {(r.doc_id, tuple(r.pieces)) for r in pieces.encode(other, ["doc_id"]).collect()} == {(r.doc_id, tuple(r.pieces)) for r in encoded.collect()}


def test_sampled_segmentations_follow_their_weights():
    v = pieces.vocabulary(pieces.MODEL)
    word, n = " there", 20000
    ids, counts, _ = pieces.encode_block([word] * n, np.arange(n), v)
    at = np.concatenate(([0], np.cumsum(counts)))
    seen = Counter(tuple(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    by_text = defaultdict(list)
    for i, t in enumerate(v.text):
        if t and np.isfinite(v.weight[i]) and v.weight[i] > pieces.BYTE_WEIGHT:
            by_text[t].append(i)
    raw = word.encode()

    def ways(k):
        if k == len(raw):
            yield (), 0.0
        for e in range(k + 1, len(raw) + 1):
            for i in by_text.get(raw[k:e], [])[:1]:
                for rest, w in ways(e):
                    yield (i, *rest), w + v.weight[i]

    every = dict(ways(0))
    total = sum(math.exp(w) for w in every.values())
    assert len(every) > 10 and set(seen) <= set(every)
    for way, w in every.items():
        p = math.exp(w) / total
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_long_units_are_one_lattice(monkeypatch):
    v = pieces.vocabulary(pieces.MODEL)
    by_text = {}
    for i in range(len(v.text) - 1, -1, -1):
        if v.text[i] and np.isfinite(v.weight[i]) and v.weight[i] > pieces.BYTE_WEIGHT:
            by_text[v.text[i]] = i
    text = "https://example.org/therethere/" * 3 + "語言模型" * 30 + "internationalization" * 5
    raw = text.encode()
    alpha, into = [0.0], {}
    for end in range(1, len(raw) + 1):
        edges = [(end - 1, int(v.byte[raw[end - 1]]))] + [(k, by_text[raw[k:end]]) for k in range(max(0, end - v.longest), end) if raw[k:end] in by_text]
        mass = np.array([alpha[k] + v.weight[i] for k, i in edges])
        alpha.append(float(np.logaddexp.reduce(mass)))
        into[end] = {e: p for e, p in zip(edges, np.exp(mass - alpha[-1]), strict=True)}
    for part in (pieces.PART, 50):
        monkeypatch.setattr(pieces, "PART", part)
        lattice = pieces.Lattice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), v)
        assert lattice.last[0] == -1 and len(lattice.last) == len(raw) + 1
        head = 0
        for end in range(1, len(raw) + 1):
            mine = slice(head, int(lattice.last[end]) + 1)
            share = np.diff(np.concatenate(([0.0], lattice.key[mine] - end)))
            got = {(int(k), int(i)): p for k, i, p in zip(lattice.source[mine], lattice.piece[mine], share, strict=True)}
            assert got.keys() == into[end].keys() and all(abs(got[e] - p) < 1e-8 for e, p in into[end].items())
            head = mine.stop
        ids, counts, _ = pieces.encode_block([text, "short " + text[7:], text], np.array([1, 2, 1]), v)
        first, last = ids[: counts[0]], ids[len(ids) - counts[2] :]
        assert (first == last).all() and pieces.decode(ids, v).tobytes().decode() == text + "short " + text[7:] + text
        whole = np.cumsum(v.length[first])
        assert not np.isin(np.arange(64, len(raw), 64), whole).all()  # pieces cross the places of the former cuts


def plain_pieces(text, key, v, seed=pieces.SEED):
    """A sampled segmentation unit by unit, boundary by boundary, with the same numbers drawn."""
    mask = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
        return x ^ (x >> 32)

    by_text = {}
    for i in range(len(v.text) - 1, -1, -1):
        if v.text[i] and np.isfinite(v.weight[i]) and v.weight[i] > pieces.BYTE_WEIGHT:
            by_text[v.text[i]] = i
    out, key = [], mix((key + seed * 0x632BE59BD9B4E019) & mask)
    for place, unit in enumerate(re.findall(rb"\n|(?: |[^ \n])(?:(?<= ) )*[^ \n]*", text.encode())):
        into, alpha = {}, [0.0]
        for end in range(1, len(unit) + 1):
            edges = [(end - 1, int(v.byte[unit[end - 1]]))] + [(a, by_text[unit[a:end]]) for a in range(end - 1, max(-1, end - v.longest - 1), -1) if unit[a:end] in by_text]
            mass = [alpha[a] + v.weight[i] for a, i in edges]
            alpha.append(float(np.logaddexp.reduce(mass)))
            into[end] = [(e, math.exp(m - alpha[-1])) for e, m in zip(edges, mass, strict=True)]
        at, step, drawn, start = len(unit), 0, [], mix((key + place) & mask)
        while at:
            u, total = (mix((start + step * 0x9E3779B97F4A7C15) & mask) >> 11) * 2.0**-53, 0.0
            for (source, piece), share in into[at]:  # noqa: B007
                total += share
                if total > u:
                    break
            drawn.append(piece)
            at, step = source, step + 1
        out += drawn[::-1]
    return out


def test_whole_texts_equal_a_plain_sampler():
    v = pieces.vocabulary(pieces.MODEL)
    rng = random.Random(15)
    parts = ["the", "there", "internationalization", "語言模型", "é", "\U0001f600", "x", ",", "\n", "\n\n", "  ", " ", "▁", "\t", "https://example.org/a?b=c"]
    texts = ["", " ", "\n", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(60))]
    keys = np.array([rng.randrange(10**9) for _ in texts])
    ids, counts, _ = pieces.encode_block(texts, keys, v)
    at = np.concatenate(([0], np.cumsum(counts)))
    for n, (text, key) in enumerate(zip(texts, keys, strict=True)):
        assert ids[at[n] : at[n + 1]].tolist() == plain_pieces(text, int(key), v), repr(text)


@pytest.mark.parametrize("unit", ["語言模型", "aGVsbG8gd29ybGQ"])
def test_long_units_do_not_depend_on_their_company(unit):
    v = pieces.vocabulary(pieces.MODEL)
    texts = [unit * n for n in (20, 700, 3000)]
    ids, counts, _ = pieces.encode_block(texts, np.arange(3), v)
    assert pieces.decode(ids, v).tobytes().decode() == "".join(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert (pieces.encode_block([t], np.array([i]), v)[0] == ids[at[i] : at[i + 1]]).all()


# -- 10


def test_language_id_equals_brute_force(spark):
    rng = random.Random(6)
    sound = {"en": "the and ing tion", "de": "sch ung der ein", "fr": "eau que ment les"}
    make = lambda x: " ".join(rng.choice(sound[x].split()) + rng.choice(sound[x].split()) for _ in range(15))
    rows = [(i, make(x), x) for i in range(90) for x in [list(sound)[i % 3]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    langs = model.langs
    assert langs == ["de", "en", "fr"]
    sums = {x: Counter() for x in langs}
    docs = Counter(x for *_, x in rows)
    for _, t, x in rows:
        for hashed in langid.ngrams(pa.array([t]))[1]:
            sums[x].update(hashed[hashed >= 0].tolist())
    for text in [*(make(x) for x in sound), "Über ÉTÉ", "a"]:
        logs = []
        for x in langs:
            total = sum(sums[x].values()) + langid.BUCKETS
            logs.append(math.log(docs[x] / 90) + sum(math.log((sums[x][h] + 1) / total) for hashed in langid.ngrams(pa.array([text]))[1] for h in hashed.tolist() if h >= 0))
        best, posterior, _ = langid.score_block(pa.array([text]), model)
        assert best[0] == langs[int(np.argmax(logs))] and posterior[0] == pytest.approx(1 / sum(math.exp(v - max(logs)) for v in logs), abs=1e-3)


def test_language_id_on_odd_documents(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = plain(langid.predict(odd_docs, model, ["doc_id"]), "doc_id", "lang_pred", "score")
    assert len(rows) == odd_docs.count()
    by_id = {i: (x, s) for i, x, s in rows}
    assert by_id[4] == by_id[5] == by_id[6] == ("und", 0.0) and by_id[0][0] in model.langs
    none = langid.fit(no_docs)
    assert none.langs == none.files == [] and {x for _, x, _ in plain(langid.predict(odd_docs, none, ["doc_id"]), "doc_id", "lang_pred", "score")} == {"und"}


def test_any_number_of_languages(spark, monkeypatch):
    """More languages than a matrix may hold: the same results from files of a few languages each."""
    rng = random.Random(11)
    monkeypatch.setattr(langid, "LANGS", 40)
    alphabet = [chr(c) for c in range(0x400, 0x460)]
    rows = [(i, "".join(rng.choice(alphabet[i % 90 : i % 90 + 4]) for _ in range(30)) + "abc"[i % 3] * 5, f"l{i % 600:03}") for i in range(1200)]
    docs = spark.createDataFrame([*rows, (5000, "x" * 300_000, "l000"), (5001, "", "l001"), (5002, None, "l001")], "doc_id long, text string, lang string").repartition(3)
    one, many = langid.fit(docs, matrix_bytes=1 << 30), langid.fit(docs, matrix_bytes=1 << 20, langs_a_file=50)
    assert len(one.langs) == 600 and not one.files and len(many.files) == 12 and not many.langs
    got = [sorted(plain(langid.predict(docs, m, ["doc_id"]), "doc_id", "lang_pred", "score")) for m in (one, many)]
    assert len(got[0]) == len(got[1]) == 1203 and sum(x == y for (_, x, _), (_, y, _) in zip(*got, strict=True)) >= 1200
    assert all(a[0] == b[0] and a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(*got, strict=True))
    assert sum(x == dict((i, n) for i, _, n in rows)[i] for i, x, _ in got[1] if i < 5000) > 1000


def test_windows_do_not_cross_texts():
    one = langid.ngrams(pa.array(["ab", "cd"]))[1]
    assert [int((h >= 0).sum()) for h in one] == [4, 2, 0]


# -- very long texts


def test_very_long_texts_are_read_whole(spark):
    """Unbroken texts of a million characters (op9: as long as its steps allow), and one of 300,000 words."""
    texts = ["x" * 10**6, "é" * 400_000, "word " * 300_000, "0" * 10**6]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: r for r in media.run(docs).collect()}
    assert all(got[i].payload_sha256 == hashlib.sha256(media.payload_of(t)).hexdigest() and got[i].n_bytes == len(t.encode()) for i, t in enumerate(texts))
    assert quality.predict(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")), ["doc_id"]).count() == 4
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs), ["doc_id"]).collect()}
    assert found[0] == found[1] == found[2] == ("en", 1.0) and found[3] == ("und", 0.0)
    short = docs.withColumn("text", F.expr("CASE WHEN doc_id = 2 THEN text ELSE repeat(left(text, 1), 60000) END"))
    assert {r.doc_id: (r.lossless, r.n_bytes) for r in pieces.digests(short).collect()} == {0: (True, 60000), 1: (True, 120000), 2: (True, 1_500_000), 3: (True, 60000)}
    rows = vectors(spark, [(0, [1.0] * 300_000), (50, [1.0] * 2), (51, [0.0] * 299_999 + [2.0])])
    assert sorted(plain(knn.top_k(rows, F.col("vec_id") % 50 == 0, k=1), "query_id", "vec_id", "score")) == [(0, 50, 131072), (50, 0, 131072)]
