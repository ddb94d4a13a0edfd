"""Importance resampling, infilling and benchmark decontamination against plain versions of them."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import boilerplate, decontaminate, importance, infilling, minhash, mixing, queries, syncmers, tokens, toxicity, warc
from spanloom.llm.importance import Resampling
from spanloom.llm.infilling import Infilling
from spanloom.session import shared_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "Zürich" * 40
ODD = ["", None, "one", "A b", "É é İ. x_y-z 12", "\x00\n\n", "日本語 " * 30, LONG + " " + LONG + " ab", "a" * 64 + " " + "b" * 65 + " " + "c" * 63]


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, names="abcdefghijklmnop"):
    return " ".join(rng.choices([a + b for a in names for b in names], k=n))


# ---------------------------------------------------------------- importance resampling


def plain_resample(rows, targets, how):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(1, how.order + 1) for i in range(len(w) - n + 1)]

    def count(texts):
        total = [0] * how.buckets
        for text in texts:
            for f in features(text):
                total[zlib.crc32(f.encode()) % how.buckets] += 1
        return total

    s, t = count(x for _, x in rows), count(targets)
    gain = [
        math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + how.buckets) / ((s[b] + 1.0) * (sum(t) + how.buckets))))
        for b in range(how.buckets)
    ]
    found = []
    for key, text in rows:
        fs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % how.buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([key, len(plain_words(text)), len(fs), weight, score, None])
    able = sorted((r for r in found if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] if r[0] is not None else -math.inf, r[2]))
    for rank, row in enumerate(able[: len(able) * how.percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("how", [Resampling(), Resampling(order=3, buckets=97, least_words=3, percent=60, seed=1), Resampling(order=1)])
def test_resampling_as_brute_force(spark, how):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(120)] + list(enumerate(ODD, 200))
    rows += [(7, rows[8][1])] * 3 + [(None, prose(rng, 30)), (None, "x")]
    targets = [prose(rng, 40, "abcd") for _ in range(5)] + ["", None]
    docs = spark.createDataFrame(rows, "key bigint, text string").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), how)
    assert got.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, targets, how)


def test_checksums_of_words():
    words = [b"a" * n for n in (1, 2, 63, 64, 65, 66, 200, 70_000)] + [bytes([200 + i, 150]) for i in range(20)]
    data, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    crcs = importance.word_crcs(data, starts, ends)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    sizes = np.array([len(w) for w in words])
    joined = importance._behind(np.full(len(words), np.uint32(zlib.crc32(b"head "))), sizes) ^ crcs
    assert joined.tolist() == [zlib.crc32(b"head " + w) for w in words]


def test_drawn_documents_keep_their_columns_and_lean_to_the_target(spark):
    rng = random.Random(5)
    rows = [(i % 150, prose(rng, 40, "abcd" if i % 4 == 0 else "efghijklm"), f"p{i}", i, "m") for i in range(200)]
    names = "doc_id bigint, text string, place string, score int, row string"
    docs = spark.createDataFrame([*rows, (None, None, "p", 0, "m")], names)
    targets, how = spark.createDataFrame([(prose(rng, 2000, "abcd"),)], "text string"), Resampling(buckets=300)
    got = importance.draw(docs, targets, how)
    assert got.columns == docs.columns
    drawn = [tuple(r) for r in got.collect()]
    assert len(drawn) == len(set(drawn)) == 50 and set(drawn) <= set(rows)
    assert sum(r[3] % 4 == 0 for r in drawn) > 30
    for empty in (docs.limit(0), docs.where("place = 'p'")):
        assert importance.draw(empty, targets).count() == 0
    assert importance.draw(docs, targets.limit(0)).count() == 50


# ---------------------------------------------------------------- infilling


def test_bits_and_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        symbols = rng.choice(6, size, p=[0.7, 0.05, 0.15, 0.05, 0.03, 0.02]).astype(np.uint8)
        matrix, at = infilling.WaveletMatrix(symbols), np.arange(size + 1)
        for symbol in range(6):
            hits = np.flatnonzero(symbols == symbol)
            assert matrix.rank(symbol, at).tolist() == np.concatenate(([0], np.cumsum(symbols == symbol))).tolist()
            assert matrix.select(symbol, np.arange(len(hits))).tolist() == hits.tolist()
        bits = infilling.BitVector(symbols & 1)
        for bit in (0, 1):
            places = np.flatnonzero((symbols & 1) == bit)
            assert bits.select(bit, np.arange(len(places))).tolist() == places.tolist()


def plain_units(text, unit):
    ends = "".join("".join(infilling.CLASSES[c]) for c in infilling.UNITS[unit] if c)
    if unit == "character":
        return list(text)
    found = [""]
    for c in text:
        found[-1] += c
        if c in ends:
            found.append("")
    return found if found[-1] else found[:-1]


TEXTS = [
    "", None, "\n", "\n\n\n", "one line", "a\nb\n", "a\nb\nc", "with <P> mark\nx", "<S>", "<M", "x <\nS>\n<", "é😀\n日本。語！\n",
    "line of words. Another, and more!\n" * 300, "\n" * 500 + "x", "y" * 5000, "tail <P\n>", "a. b! c? d… e: f; (g)\r\nh\x0bi",
]


@pytest.mark.parametrize("how", [Infilling(), Infilling("sentence"), Infilling("word", 50, 100, 3), Infilling("character", 100, 0), Infilling("clause")])
def test_infilling_as_brute_force(spark, how):
    rows = [(i, t, i % 3) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc", 1), (None, None, 1), (3, "z\n" * 9, 1), (3, "z\n" * 9, 1)]
    docs = spark.createDataFrame(rows, "key bigint, text string, output int")
    made = infilling.transform(docs, how).withColumn("back", infilling.restore(F.col("output"), F.col("form")))
    want = []
    for key, text, extra in rows:
        text = text or ""
        digest = hashlib.sha256(f"{how.seed}:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
        units = plain_units(text, how.unit)
        n = len(units)
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, m, z = ("".join(units[x:y]) for x, y in ((0, low), (low, high), (high, n)))
        if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= how.percent:
            form, output, sizes = "plain", text, (None, None)
        else:
            form, sizes = "spm" if h[3] % 100 < how.spm_percent else "psm", (len(a), len(m))
            output = f"<S>{z}<P>{a}<M>{m}" if form == "spm" else f"<P>{a}<S>{z}<M>{m}"
        want.append((key, extra, n, form, *sizes, output, text))
    got = [(r["row"].key, r["row"].output, *tuple(r)[1:]) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert infilling.transform(docs.limit(0), how).count() == 0


def test_joined_texts_are_cut_apart(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab \n.", k=rng.randint(0, 40))) for _ in range(200)]
    for unit in infilling.UNITS:
        units = infilling.Units(texts, unit)
        plain = [plain_units(t, unit) for t in texts]
        assert units.counts.tolist() == [len(p) for p in plain]
        k = np.array([rng.randint(0, len(p)) for p in plain])
        assert units.cut(k).tolist() == [len("".join(p[:n])) for p, n in zip(plain, k.tolist())]


# ---------------------------------------------------------------- benchmark decontamination


def plain_report(rows, items, size):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    found = []
    for key, text in rows:
        w, hit, names = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        found.append((key, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(found, key=repr)


def planted_rows(seed=9):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(8, 30))) for i in range(40)]
    items += [(100, "Only three Words"), (101, "solo"), (102, ""), (103, None), (None, "nameless item of test words"), (104, items[0][1]), (104, items[1][1])]
    items.append((105, "again " * 25))
    rows = []
    for i in range(150):
        text = prose(rng, rng.randint(0, 50))
        if i % 3 == 0:
            item = rng.choice(items)[1] or ""
            held = item.split()
            low = rng.randint(0, max(0, len(held) - 12))
            text = f"{text}, {'; '.join(held[low:low + rng.randint(9, 14)]).upper()}! {prose(rng, 5)}"
        rows.append((i, text))
    rows += [*enumerate(ODD, 300), (5, rows[3][1]), (5, rows[3][1]), (None, "ONLY-three words; solo"), (400, "again " * 400)]
    return rows, items


@pytest.mark.parametrize("how", [{}, {"size": 4}, {"part_windows": 60}, {"part_bytes": 20_000}])
def test_report_as_brute_force(spark, how):
    rows, items = planted_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    frame = spark.createDataFrame(items, "item bigint, text string")
    got = decontaminate.report(docs, frame, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(rows, items, how.get("size", 10))


def test_removal(spark):
    text = "Keep This. ONE two\tthree four-five six, seven eight nine ten! And This; eleven"
    item = "zero one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 7), (1, text, "a", 7), (None, None, None, None), (2, "one two three\nfour", "b", 1), (3, item, "c", 2), (4, "", "d", 3)]
    docs = spark.createDataFrame(rows, "id bigint, text string, hits string, n_words int")
    items = spark.createDataFrame([(1, item)], "item bigint, text string")
    cut = "Keep This. And This; eleven"
    want = [(1, cut, "a", 7)] * 2 + [rows[2], rows[3], (3, "", "c", 2), rows[5]]
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    left = decontaminate.decontaminate(docs, items, remove="documents")
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[2], rows[3], rows[5]], key=repr)
    none = spark.createDataFrame([], "item bigint, text string")
    assert sorted(map(tuple, decontaminate.decontaminate(docs, none).collect()), key=repr) == sorted(rows, key=repr)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, remove="words")


def test_the_scan_runs_without_python(spark):
    rows, items = planted_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = decontaminate.report(docs, spark.createDataFrame(items, "item bigint, text string"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert not any(name in plan for name in ("InArrow", "InPandas", "BatchEvalPython", "ArrowEvalPython", "MapPartitions"))


# ---------------------------------------------------------------- faults of the other operators that were mended


HIGH = 1 << 62


@pytest.mark.parametrize("lacking", [False, True])
def test_ids_of_any_size(spark, lacking):
    rng = random.Random(4)
    texts = [prose(rng, 40) for _ in range(4)]
    rows = [(HIGH + 5, texts[0]), (HIGH + 9, texts[0]), (3, texts[1]), (2**63 - 1, texts[1]), (HIGH, texts[2])]
    rows += [(None, texts[0]), (None, texts[3])] * lacking
    frame = spark.createDataFrame(rows, "key bigint, text string")
    got = sorted(minhash.near_duplicates(frame).select("key", "component", "kept").collect(), key=repr)
    want = [(HIGH + 5, HIGH + 5, True), (HIGH + 9, HIGH + 5, False), (3, 3, True), (2**63 - 1, 3, False), (HIGH, HIGH, True)]
    want += [(None, HIGH + 5, False), (None, None, True)] * lacking
    assert [tuple(r) for r in got] == sorted(want, key=repr)
    found = syncmers.fingerprints(frame).collect()
    assert sorted((r.key for r in found), key=repr) == sorted((k for k, _ in rows), key=repr)
    folder = shared_folder(spark)
    warc.write_pages(frame.selectExpr("key", "'u' AS uri", "text AS payload"), folder)
    pages = [(r.key, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()]
    want = [(HIGH + 5, "response", None), (HIGH + 9, "revisit", HIGH + 5), (3, "response", None), (2**63 - 1, "revisit", 3), (HIGH, "response", None)]
    want += [(None, "revisit", HIGH + 5), (None, "response", None)] * lacking
    assert sorted(pages, key=repr) == sorted(want, key=repr)


def test_ids_on_both_sides_and_lacking_ones_are_refused(spark):
    frame = spark.createDataFrame([(-1, "a"), (HIGH, "b"), (None, "c")], "key bigint, text string")
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame)
    assert minhash.near_duplicates(frame.where("key IS NOT NULL")).count() == 2


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_id", "_n", "_hash", "id", "row", "hash", "key", "times", "n"]
    docs = spark.createDataFrame([(i, f"word{i} " * 30, "s", *[f"mine-{i}"] * 9) for i in range(4)], names)
    for got in (minhash.keep_one(docs), mixing.repeat(docs, share=1.0)):
        assert got.columns == names and {tuple(r) for r in got.collect()} == {tuple(r) for r in docs.collect()}


def test_pieces_that_end_in_a_mark_when_lowered():
    from tokenizers import Tokenizer

    path = queries.tokenizer(queries.WORD_BPE)
    known, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    for text in ("İ. ve İ( da", "ABCİ- x", "İ", "a İ! İ? (İ)", "xİ.. yİ; İ"):
        assert np.frombuffer(known.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_training_on_repeated_ids_is_repeatable(spark):
    rng = random.Random(6)
    rows = [(i % 30, prose(rng, 20) + (" zonk blorx" if i % 30 < 6 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(30)], "key bigint, toxic int")
    frame = spark.createDataFrame(rows, "key bigint, text string")
    turned = spark.createDataFrame(rows[::-1], "key bigint, text string").repartition(4)
    assert toxicity.train(frame, labels) == toxicity.train(turned, labels)


PROSE = "The council met on Monday and agreed to open the old bridge again after the long repair of the spring."


@pytest.mark.parametrize("odd", [
    "<script>for(i=0;i<n;i++){if(a<b){x='</p>'}}</script>", "<style>a<b{c:d}</style>", "<script>if (a<b) {", "<p class=a'b>", '<p title="abc>',
])
def test_odd_markup_does_not_swallow_the_article(odd):
    page = f"<html><body><article><p>{PROSE}</p><p>If x<y then the rest stays. {PROSE}</p></article>{odd if odd.endswith('{') else ''}</body></html>"
    if not odd.endswith("{"):
        page = page.replace("<article>", f"<article>{odd}")
    assert boilerplate.main_text(page) == f"{PROSE}\n\nIf x<y then the rest stays. {PROSE}"


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "</b>", "</p>x", "<article>x", "<h1>x", '<a b="', "<p>x", "<!", "<script>", "<li>x", "<div></p>"])
def test_hostile_pages_are_read_in_proportion(piece):
    took = []
    for size in (100_000, 400_000):
        page = piece * (size // len(piece))
        started = time.perf_counter()
        boilerplate.main_text(page)
        took.append(time.perf_counter() - started)
    # Four times the page; a quadratic reader takes sixteen times as long.
    assert took[1] < 9 * took[0] + 0.3
