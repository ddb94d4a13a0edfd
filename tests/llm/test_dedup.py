import random
import re

from spanloom.llm import chunks, minhash, shingles, syncmers


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """(n, component) of each id, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    rows, key = [], 0
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((key, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
            key += 1
    rng.shuffle(rows)
    return rows


def test_shingle_sets_agree_with_sets_of_words():
    texts = [t for _, t in corpus()] + ["", None, " ", "a", "A a", "a b c d", "a b c d e", "É é e\x0bf g h", "x" * 100_000, "\xa0 a"]
    found = shingles.shingle_sets(texts)
    exact = [shingle_set(t) for t in texts]
    assert [len(f) for f in found] == [len(e) for e in exact]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(set(found[i].tolist()) & set(found[j].tolist())) == len(exact[i] & exact[j])


def test_signature_estimates_similarity():
    rng = random.Random(2)
    a = [f"w{rng.randrange(10**6)}" for _ in range(1_000)]
    b = a[:600] + [f"w{rng.randrange(10**6)}" for _ in range(400)]
    x, y = shingles.shingle_sets([" ".join(a), " ".join(b)])
    true = len(set(x) & set(y)) / len(set(x) | set(y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - true) < 0.12


def test_classes_agree_with_all_pairs(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "key bigint, text string").selectExpr("*", "key AS component", "'x' AS band")
    got = {r.key: (r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in classes(rows).items()}


def test_links_between_members_of_a_chain(spark, monkeypatch):
    """Each text is near the next one only, so most links do not meet the smallest of a bucket; blocks of two rows."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[20 * i : 20 * i + 200])) for i in range(10)]
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    monkeypatch.setattr(minhash, "STAR_ROWS", 1)
    frame = spark.createDataFrame(rows, "key bigint, text string")
    got = {r.key: r.component for r in minhash.near_duplicates(frame).collect()}
    assert got == {i: c for i, (_, c) in classes(rows).items()} and len(set(got.values())) == 1


def test_links_of_pairs_whose_sketches_agree_by_chance(spark):
    """The first band that is equal in the sketches of such a pair differs in full, so they share no bucket there."""
    rng, rows, key = random.Random(5), [], 0
    while len(rows) < 6:
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts = [" ".join(base), " ".join([*base[:135], *(f"v{rng.randrange(10**6)}" for _ in range(15))])]
        a, b = (minhash.signature(s) for s in shingles.shingle_sets(texts))
        bands = (minhash.band_keys(a) == minhash.band_keys(b)).argmax()
        sketches = (a % 256 == b % 256).reshape(minhash.BANDS, minhash.ROWS).all(axis=1).argmax()
        if sketches < bands:
            rows += [(key, texts[0]), (key + 1, texts[1])]
            key += 2
    frame = spark.createDataFrame(rows, "id bigint, text string")
    details = minhash.signatures(frame).join(frame, "id")
    members = details.selectExpr("id", "posexplode(bands) AS (no, band)", "id AS component", "octet_length(text) AS size")
    got = minhash.block_links(members, details).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, i + 1) for i in range(0, key, 2)]


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b"), (5, "A  b"), (None, "a b"), (6, long), (7, long + " x"), (None, "q r s"), (8, "é"), (8, "é")]
    frame = spark.createDataFrame(rows, "key bigint, text string")
    got = sorted(((r.key, r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False),
        (6, 29_996, 6, True), (7, 29_997, 6, False), (None, 1, None, True), (8, 1, 8, True), (8, 1, 8, True),
    ], key=repr)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0
    docs = frame.selectExpr("key AS doc_id", "text", "1 AS component", "'s' AS source")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_cuts_are_near_text_only():
    rng = random.Random(4)
    text = prose(rng, 2_000)
    ends = set(chunks.chunk_digests(text)[0].tolist())
    moved = chunks.chunk_digests("inserted " + text)[0]
    assert len(ends & {int(e) - 9 for e in moved}) >= len(ends) - 2
    sizes = [b - a for a, b in zip([0, *sorted(ends)], sorted(ends))]
    assert min(sizes[1:-1]) > chunks.REACH and 25 < sum(sizes) / len(sizes) < 45
    assert chunks.chunk_digests("")[0].tolist() == [] and chunks.chunk_digests("a")[0].tolist() == [1]
    assert len(chunks.chunk_digests("a" * 10_000)[0]) <= 2


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    passages = [prose(rng, 55) for _ in range(40)]
    rows, dirty = [], {}
    for i in range(80):
        text = prose(rng, 150) + "\n" + passages[i // 2] + "\n" + prose(rng, 150)
        rows.append((i, text))
        dirty[i] = i % 2 == 1
    clean = [(100 + i, prose(rng, 60) + " All rights reserved, see the licence. " + prose(rng, 60)) for i in range(20)]
    frame = spark.createDataFrame(rows + clean, "doc_id bigint, text string").selectExpr("*", "'s' AS spans", "doc_id AS id")
    got = {r.doc_id: r for r in chunks.deduplicate(frame).collect()}
    texts = dict(rows + clean)
    for i, r in got.items():
        if not dirty.get(i):
            assert r.text == texts[i] and r.removed_chars == 0 and r.spans == []
            continue
        assert len(r.spans) == 1 and len(texts[i][r.spans[0].start : r.spans[0].end].split()) >= 25
        assert r.text == texts[i][: r.spans[0].start] + texts[i][r.spans[0].end :] and passages[i // 2] not in r.text
        assert set(r.text.split()) <= set(texts[i].split())


def test_odd_rows_of_chunks(spark):
    rng = random.Random(7)
    one = prose(rng, 80)
    rows = [(2, one), (1, one), (None, one), (3, None), (4, ""), (5, "short"), (6, "short"), (2, one), (7, "z" * 100_000), (8, "z" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text if r.text is None or len(r.text) < 9 else len(r.text)) for r in chunks.deduplicate(frame).collect()), key=repr)
    assert got == sorted([(1, len(one)), (2, ""), (2, ""), (None, ""), (3, None), (4, ""), (5, "short"), (6, "short"), (7, 100_000), (8, 100_000)], key=repr)
    assert chunks.deduplicate(frame.limit(0)).count() == 0


def test_short_words_and_texts_without_blanks(spark):
    """A shared passage goes as a whole, however short its words are, and also where no blanks are."""
    rng = random.Random(10)
    short = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=3)) for _ in range(n))
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    rows, passages = [], []
    for i in range(60):
        make, size = (short, 51) if i < 40 else (chinese, 250)
        passage = make(size)
        gap = " " if i < 40 else ""
        passages.append(passage)
        rows += [(2 * i + half, make(150) + gap + passage + gap + make(150)) for half in range(2)]
    rows += [(200, whole := chinese(3_000)), (201, whole), (202, chinese(200) + "\u3002" + whole[:60] + chinese(200))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, texts = {r.doc_id: r for r in chunks.deduplicate(frame).collect()}, dict(rows)
    for i, passage in enumerate(passages):
        assert got[2 * i].text == texts[2 * i]
        r = got[2 * i + 1]
        assert len(r.spans) == 1 and len(passage) - 2 <= r.removed_chars <= len(passage) + 2
        assert r.text == texts[2 * i + 1][: r.spans[0].start] + texts[2 * i + 1][r.spans[0].end :]
    assert got[200].text == whole and got[201].text == "" and got[202].removed_chars == 0


def plain_syncmers(text, k, s):
    found = []
    for i in range(len(text) - k + 1):
        inner = [chunks.span_hashes(chunks.code_points(text), *map(chunks.np.array, ([j], [j + s])))[0] for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_anchors_are_closed_syncmers():
    text = prose(random.Random(8), 30)
    for one in (text, text * 5):
        anchors = syncmers.np.frombuffer(syncmers.fingerprint(one), "<u4")
        for fine, (k, s) in enumerate(syncmers.SCALES):
            own = anchors[((anchors & syncmers.FINE) > 0) == fine]
            places = plain_syncmers(one, k, s)
            heads = syncmers.np.array(places)
            hashes = syncmers.span_hashes(syncmers.code_points(one), heads, heads + k)
            assert (own >> 8).tolist() == (hashes >> syncmers.np.uint64(40)).astype(int).tolist()


def plain_likeness(a, b):
    """The longest chain of equal (hash, scale, count so far) in the order of both, by the quadratic recurrence."""
    def keys(data):
        seen, found = {}, []
        for anchor in syncmers.np.frombuffer(data, "<u4").tolist():
            seen[anchor >> 7] = seen.get(anchor >> 7, -1) + 1
            found.append((anchor >> 7, seen[anchor >> 7]))
        return found

    one, two = keys(a), keys(b)
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(one) + len(two))


def test_likeness_is_the_longest_chain():
    rng = random.Random(21)
    for _ in range(6):
        text = prose(rng, 40)
        parts = [text[i : i + 60] for i in range(0, len(text), 60)]
        rng.shuffle(parts)
        for other in ("".join(parts), text[:80] + prose(rng, 10) + text[80:], text * 2, prose(rng, 30)):
            a, b = syncmers.fingerprint(text), syncmers.fingerprint(other)
            assert syncmers.likeness(a, b) == plain_likeness(a, b)


def test_likeness_at_any_length():
    rng = random.Random(12)
    for n in (200, 512, 550, 600, 680, 3_000):
        text = prose(rng, 800)[:n]
        new = syncmers.edited(text, "")
        assert 0.75 < syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(new)) < 0.95
        short, long = text[:505], text[:505] + prose(rng, 5)[:15]
        assert syncmers.likeness(syncmers.fingerprint(long), syncmers.fingerprint(short)) > 0.85
        other = syncmers.fingerprint(prose(rng, 200))
        assert syncmers.likeness(syncmers.fingerprint(short), other) < 0.1
    assert syncmers.likeness(syncmers.fingerprint("a b"), syncmers.fingerprint(text)) == 0.0
    for n in (100, 400, 600):
        anchors = syncmers.np.frombuffer(syncmers.fingerprint(prose(rng, 200)[:n]), "<u4")
        assert ((anchors & syncmers.FINE) > 0).any() and ((anchors & syncmers.FINE) == 0).any()
        assert (anchors & syncmers.MOST_GAP).max() <= 22


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(3 * i, prose(rng, rng.choice([1, 3, 20, 200]))) for i in range(40)]
    rows += [(1, None), (2, ""), (4, rows[5][1]), (5, rows[5][1]), (None, "last one"), (200, "x" * 50_000)]
    frame = spark.createDataFrame(rows, "key bigint, text string").selectExpr("*", "1 AS part")
    for part_rows in (2_048, 4):
        syncmers.PART_ROWS, kept = part_rows, syncmers.PART_ROWS
        got = {r.key: r for r in syncmers.fingerprints(frame).collect()}
        syncmers.PART_ROWS = kept
        order = sorted(((k, t or "") for k, t in rows if k is not None)) + [(None, "last one")]
        assert set(got) == {k for k, _ in order}
        for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
            new, r = syncmers.edited(text, following), got[key]
            prints = [syncmers.fingerprint(t) for t in (text, new, following)]
            assert r.n_chars == len(text) and r.edited_sha256 == syncmers.hashlib.sha256(new.encode()).hexdigest()
            assert r.fingerprint == syncmers.base64.b64encode(prints[0]).decode()
            assert r.near_edited == syncmers.likeness(prints[0], prints[1]) and r.near_next == syncmers.likeness(prints[0], prints[2])
        assert got[4].fingerprint == got[5].fingerprint == got[15].fingerprint and got[4].near_next == 1.0
        assert got[1].fingerprint == "" and got[1].near_next == 1.0
        assert all(0.5 < r.near_edited < 0.95 and r.near_next < 0.2 for r in got.values() if 1_000 < r.n_chars < 10_000 and r.key != 4)
    assert syncmers.fingerprints(frame.limit(0)).count() == 0
