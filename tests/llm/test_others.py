import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import boilerplate, hamming, mixing, toxicity, warc
from spanloom.session import shared_folder


# ---------------------------------------------------------------- toxicity


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randint(5, 80)), i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zonkard", "zonker", "zonkish", "blorx", "Blorx!"])
            words.append(rng.choice(["zonkly", "blorx"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_from_positives_and_a_mixture(spark):
    rows, labels = labelled()
    known = [*labels, (None, 1), (1, None), (99_999, 1), (2, 0)]
    texts = spark.createDataFrame(rows, "key bigint, text string").withColumn("score", F.lit("x"))
    model = toxicity.train(texts, spark.createDataFrame(known, "key bigint, toxic int"))
    again = toxicity.train(texts, spark.createDataFrame(known, "key bigint, toxic int"))
    assert model == again
    got = {r.key: r for r in toxicity.score(texts, model).collect()}
    out = {r.key for r in texts.where(toxicity.held_out(F.col("key"))).select("key").collect()}
    assert 40 < len(out) < 120
    right = [got[k].predicted == y for k, y in labels if k in out]
    assert sum(right) / len(right) > 0.95
    odd = [(None, None), (1, ""), (2, "zonkard blorx zonkish"), (3, "clean " * 50_000), (3, "zonkard blorx zonkish")]
    frame = spark.createDataFrame(odd, "key bigint, text string")
    scored = toxicity.score(frame, model).collect()
    assert [r.predicted for r in scored] == [0, 0, 1, 0, 1] and all(0 <= r.score <= 1 for r in scored)
    docs = frame.selectExpr("key AS doc_id", "text", "7 AS predicted")
    assert [tuple(r)[::2] for r in toxicity.reject(docs, model).collect()] == [(None, 7), (1, 7), (3, 7)]


def test_labels_of_held_out_documents_are_not_read(spark):
    rows, labels = labelled()
    texts = spark.createDataFrame(rows, "key bigint, text string")
    frame = spark.createDataFrame(labels, "key bigint, toxic int")
    turned = frame.withColumn("toxic", F.when(toxicity.held_out(F.col("key")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(texts, frame) == toxicity.train(texts, turned)


def test_without_positives_nothing_is_toxic(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "key bigint, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.train(texts, spark.createDataFrame(labels, "key bigint, toxic int"))
        assert [r.score for r in toxicity.score(texts, model).collect()] == [0.0, 0.0]
    assert toxicity.score(texts.limit(0), model).count() == 0


def test_risk_does_not_go_negative():
    """With positives only in the mixture, the clean part of the risk is held at zero instead of below."""
    rows = [[0]] * 20 + [[0]] * 20
    weights, bias = toxicity.fit(rows, [True] * 20 + [False] * 20, 1, 0.5)
    assert np.isfinite(weights).all() and math.isfinite(bias)


# ---------------------------------------------------------------- mixing


def water(sizes, weights, share, most):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped.update(over)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "z", None]), "w " * rng.randint(0, 30)) for i in range(600)]
    rows += [(None, "b", "x y"), (None, "b", "x y"), (700, "a", None), (701, "empty", "")]
    frame = spark.createDataFrame(rows, "key bigint, source string, text string").withColumn("target", F.lit("t"))
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame.repartition(5)).collect()))
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    aims = water(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS)
    taken = {}
    source_of = {k: s for k, s, _ in rows if k is not None}
    for r in got:
        if r.key in source_of:
            s = source_of[r.key]
            assert r.source_size == sizes[s] and r.target == pytest.approx(aims[s])
            taken[s] = taken.get(s, 0) + r.size * r.repeats
            assert 0 <= r.repeats <= 2
    for s, words in taken.items():
        assert abs(words - aims[s]) <= 100, s
    assert sum(r.size * r.repeats for r in got) == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_cut_inside_one_bucket(spark, monkeypatch):
    """With one bucket per source all is decided inside it; the result is the same."""
    rows = [(i, "ab"[i % 2], "w " * (i % 17)) for i in range(300)]
    frame = spark.createDataFrame(rows, "key bigint, source string, text string")
    first = sorted(map(repr, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", 0)
    assert sorted(map(repr, mixing.mix(frame).collect())) == first


def test_repeated_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5), (2, None, "s", 6), (None, "x", None, 7)], "doc_id bigint, text string, source string, size int")
    got = mixing.repeat(docs, share=2.0)
    assert got.columns == docs.columns and sorted(r.size for r in got.collect()) == [5, 5, 6, 6, 7, 7]


# ---------------------------------------------------------------- vectors


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3_000, hamming.TABLES), dtype=np.uint8)
    codes[:50] = codes[0]
    index = hamming.Index(codes)
    far = np.unpackbits(codes[None, :, :] ^ codes[:20, None, :], axis=2).sum(axis=2)
    for q in range(20):
        for radius in (0, 7, 8, 17, 26, 31, 64):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(far[q] <= radius).tolist()


def clustered(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((40, dims))[rng.integers(0, 40, n)] + 0.5 * rng.standard_normal((n, dims))


def nearest(rows, queries, k):
    found = {}
    for q, v in queries:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)
        found[q] = far[:k]
    return found


@pytest.mark.parametrize("dims", [6, 64, 100])
def test_search_recall(spark, dims, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK_ROWS", 300)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 7)
    rows = [(i, v) for i, v in enumerate(clustered(800, dims).tolist())]
    frame = spark.createDataFrame(rows, "id bigint, vec array<double>").withColumn("score", F.lit("s"))
    got = {}
    for r in hamming.search(frame, F.col("id") % 40 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = nearest(rows, [r for r in rows if r[0] % 40 == 0], 10)
    assert set(got) == set(exact)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in exact[q]}) for q in exact)
    assert hits >= 0.9 * 10 * len(exact)
    by_id = dict(rows)
    for q, answers in got.items():
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 11)) and answers == sorted(answers, key=lambda a: (a[2], a[1]))
        assert all(s == pytest.approx(math.dist(by_id[q], by_id[i])) for _, i, s in answers)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, []), (200, [0.0, 0.0]), (1, [1.0, 0.1]), (9, [1.0, -0.1]),
    ]
    frame = spark.createDataFrame(rows, "id bigint, vec array<float>")
    got = [tuple(r)[:3] for r in hamming.search(frame, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 9), (100, 1, 0), (100, 2, 1), (100, 3, 9)]
    assert hamming.search(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hamming.search(frame.where("id = 0"), F.col("id") % 100 == 0).count() == 0


# ---------------------------------------------------------------- pages


def brute_cut(gains, edges):
    best = None
    for mask in range(1 << len(gains)):
        side = [mask >> i & 1 for i in range(len(gains))]
        cost = sum(g for g, s in zip(gains, side) if g > 0 and not s) - sum(g for g, s in zip(gains, side) if g < 0 and s)
        cost += sum(w for a, b, w in edges if side[a] != side[b])
        if best is None or (cost, -sum(side)) < best[0]:
            best = ((cost, -sum(side)), side)
    return best


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        gains = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i - 1, i, rng.randint(0, 8)) for i in range(1, n)]
        edges += [(a, b, rng.randint(1, 6)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(4)) if a < b]
        got = boilerplate.minimum_cut(gains, edges)
        want = brute_cut(gains, edges)
        cost = sum(g for g, s in zip(gains, got) if g > 0 and not s) - sum(g for g, s in zip(gains, got) if g < 0 and s)
        assert cost + sum(w for a, b, w in edges if got[a] != got[b]) == want[0][0]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav>
<div id="cookieNotice">We use cookies on this site to make it better for you.</div><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>A &amp; title</h1><p><b>First&nbsp;para  with
lines.<br><p>Second <a href=x>para</a>graph.</p><div class="share">Share this text</div><p>Ok.</p>
<form><label>Your name</label><input type=text></form><ul><li>One point</li><li>Two points</li></ul></article>
<section id="comments"><article class="comment"><p>What a great and very interesting text this is, thank you all!</p></article></section>
<aside>More of the same</aside><footer>&copy; 2020 us</footer></body></html>"""


def test_page():
    assert boilerplate.main_text(PAGE).split("\n\n") == [
        "A & title", "First para with lines.", "Second paragraph.", "Ok.", "One point", "Two points"
    ]
    plain = re.sub("</?article>", "", PAGE)
    assert "Second paragraph." in boilerplate.main_text(plain) and "cookies" not in boilerplate.main_text(plain)


def test_odd_pages(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    pages = [
        (1, None, None), (2, "u", ""), (3, "u", "no markup at all"), (4, "u", "<p>a < b & c</p>"), (5, "u", long), (6, "u", "<div><p>cut"),
        (7, "u", "<nav>only a menu</nav>"), (None, "u", "<p>é&#x41;&unknown;</p>"), (3, "u", "no markup at all"),
    ]
    frame = spark.createDataFrame(pages, "key int, url string, html string").withColumn("text", F.lit(1))
    got = [(r.key, r.text if len(r.text) < 99 else len(r.text), r.n_chars) for r in boilerplate.extract(frame).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "", 0), (2, "", 0), (3, "no markup at all", 16), (4, "a < b & c", 9), (5, 249_999, 249_999), (6, "cut", 3), (7, "", 0),
        (None, "éA&unknown;", 11), (3, "no markup at all", 16),
    ], key=repr)
    assert boilerplate.extract(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- archives


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives(spark, compression):
    big = "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 20_000
    rows = [(5, "u", "x"), (2, "b", "x"), (3, None, None), (4, "u\r\nv w", ""), (None, "q", "x"), (6, "z", big), (7, "é", big), (8, "h", "ü")]
    frame = spark.createDataFrame(rows, "key int, uri string, payload string").withColumn("digest", F.lit("d"))
    folder = shared_folder(spark)
    warc.write_pages(frame, folder, compression=compression)
    got = {r.key: r for r in warc.read_pages(spark, folder).collect()}
    assert len(got) == len(rows)
    for key, uri, payload in rows:
        data = (payload or "").encode()
        r = got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data))
        same = [k for k, _, p in rows if (p or "") == (payload or "") and k is not None]
        first = min(same)
        assert (r.record_type, r.refers_to) == (("response", None) if key == first else ("revisit", first))
        assert (bytes(r.payload) == data) if key == first else r.payload is None
    assert got[4].target_uri == "u%0D%0Av w"
    # Header filters reach the source, and without payloads the headers still tell their sizes.
    rows_ = warc.read_pages(spark, folder, payloads=False).where("record_type = 'revisit' AND target_uri LIKE 'é%'")
    plan = rows_._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "record_type" not in plan.split("Filter")[-1].split("BatchScan")[0]
    assert [(r.key, r.payload_bytes) for r in rows_.collect()] == [(7, len(big))]
    assert warc.read_pages(spark, folder, payloads=False).where("payload IS NOT NULL").count() == 0


def test_small_payloads_are_not_revisited(spark):
    frame = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long"), (4, "u", "long")], "key int, uri string, payload string")
    folder = shared_folder(spark)
    warc.write_pages(frame, folder, least_bytes=2)
    got = {r.key: (r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_pushed_filters_skip_blocks():
    import io

    data = warc.page_record(1, "a", b"first", None) + warc.page_record(2, "b", b"second", None) + warc.page_record(3, "c", b"first", 1)
    reader = warc._Reader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("offset",), 0)]))
    assert [f.attribute for f in left] == [("offset",)]
    rows = list(reader._records(io.BufferedReader(io.BytesIO(data)), "f"))
    assert [r[0] for r in rows] == ["response", "response"] and [r[-1] for r in rows] == [b"first", b"second"]
    broken = data.replace(b"second", b"secand")
    with pytest.raises(warc.BadRecord):
        list(reader._records(io.BufferedReader(io.BytesIO(broken)), "f"))


def test_empty_archive(spark):
    folder = shared_folder(spark)
    warc.write_pages(spark.createDataFrame([], "key int, uri string, payload string"), folder)
    assert warc.read_pages(spark, folder).count() == 0


def test_names_of_elements():
    long = "A long paragraph of the text with quite a number of words in it, so that it is surely one."
    page = f"""<body class="x"><div class="header-wrapper"><div class="content-area has-comments with-sidebar"><article class="post">
<p>{long}</p><div class="article-share">{long} Share.</div><div class="comment-body"><p>{long} Reply.</p></div><p>End.</p>
<div class="cookie-banner"><p>{long} Cookies.</p></div></article></div></div><div class="main-footer"><p>{long} Footer.</p></div></body>"""
    assert boilerplate.main_text(page) == f"{long}\n\nEnd."
