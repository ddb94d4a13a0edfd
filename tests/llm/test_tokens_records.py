import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanloom.llm import packing, records
from spanloom.llm.queries import BYTE_BPE, WORD_BPE, tokenizer
from spanloom.llm.tokens import PieceEncoder
from spanloom.session import shared_folder

TEXTS = [
    "", " ", "a", " a  b", "a\n\nb \n c\n", "x<|endoftext|>y", "don't they're 12 a,b. c,", "wörd%%% x%%%.", "..a.", "İs, ß, ﬁ.",
    "é, é", "a　b\xa0c", "\0 b \0", "tab\tcr\r\nff\x0c.", "日本語。テキスト 12", "word " * 300, "<|startoftext|> hi", "-a- (b) \"c\"",
]


@lru_cache
def library(path):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return whole


def ids(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_pieces_give_the_ids_of_the_whole_text(name):
    path = tokenizer(name)
    known = PieceEncoder(path)
    rng = random.Random(1)
    words = "the of, and. naïve x1 'll Ünder-x \n \t  !? 漢字 don't".split(" ")
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(200)]
    for text in texts * 2:
        assert np.frombuffer(known.encode(text), "<u4").tolist() == ids(path, text), text


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_words_are_learnt_once_whatever_marks_follow(name):
    path = tokenizer(name)
    known = PieceEncoder(path)
    texts = ["x word word, word. word!? (word) word\nword, 12, word;", "İ, é. é, -, ß.", "", "x,", ",x ,, word.,", "a  word, b"]
    assert [np.frombuffer(i, "<u4").tolist() for i in known.encode_all(texts)] == [ids(path, text) for text in texts]
    assert "word" in known.cache and not {"word,", "word.", "word!?", "word;", "word.,", "é.", "é,"} & known.cache.keys()


def test_frames():
    framed = records.frame(b"abc") + records.frame(b"")
    at = [0]

    def read(n):
        at[0] += n
        return framed[at[0] - n : at[0]]

    assert [records.unframe(read) for _ in range(3)] == [b"abc", b"", None]
    for place in (0, 9, 13, len(framed) - 1):
        broken = bytearray(framed)
        broken[place] ^= 1
        at[0], framed_ = 0, framed
        framed = bytes(broken)
        with pytest.raises(records.CorruptRecord):
            while records.unframe(read) is not None:
                pass
        framed = framed_


def test_narrow_ids():
    data = np.array([0, 1, 65_535], "<u4").tobytes()
    assert records.widen(records.narrow(data, 2), 2) == data
    with pytest.raises(ValueError):
        records.narrow(np.array([65_536], "<u4").tobytes(), 2)


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip(spark, width):
    path = tokenizer(BYTE_BPE)
    rows = [(7, "b c", 1), (3, None, 2), (5, "", 3), (None, "no id", 4), (5, "", 5), (9, "long " * 5_000, 6)]
    frame = spark.createDataFrame(rows, "key bigint, text string, start int")
    folder = shared_folder(spark)
    records.write_records(records.encode_texts(records.ordered(frame), path), folder, width)
    got = sorted(records.read_records(spark, folder).collect(), key=lambda r: (r.shard, r.position))
    assert [r.key for r in got] == [None, 3, 5, 5, 7, 9]
    start = 0
    texts = {None: "no id", 3: "", 5: "", 7: "b c", 9: "long " * 5_000}
    for r in got:
        assert np.frombuffer(r.payload, "<u4").tolist() == [*ids(path, texts[r.key]), 0] and r.start == start
        start += len(r.payload) // 4
    index = records.read_index(spark, folder).collect()
    assert sorted((r.key or 0) for r in index) == [0, 3, 5, 5, 7, 9]
    first, second = ([(r.key, bytes(r.payload)) for r in records.read_shuffled(spark, folder, s).orderBy("place").collect()] for s in (1, 2))
    by = lambda rows: sorted(rows, key=lambda r: (r[0] or 0, r[1]))
    assert by(first) == by(second) == by([(r.key, bytes(r.payload)) for r in got])


def test_empty_records(spark):
    folder = shared_folder(spark)
    frame = spark.createDataFrame([], "key bigint, text string")
    records.write_records(records.encode_texts(records.ordered(frame), tokenizer(BYTE_BPE)), folder)
    assert records.read_records(spark, folder).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10**9), (100, 3, 10**9), (100, 100, 4_000)])
def test_best_fit_holds_every_capacity(score, capacity):
    rng = random.Random(5)
    tokens, documents, attention = capacity
    most = min(tokens, int(attention**0.5))
    lengths = sorted((rng.randint(1, most) for _ in range(400)), reverse=True)
    limit = packing.Capacity(tokens, documents, attention, score=score)
    bins, offsets, opened = packing.best_fit(lengths, limit)
    held = {}
    for length, b, offset in zip(lengths, bins, offsets):
        assert offset == sum(held.setdefault(b, []))
        held[b].append(length)
    assert len(held) == opened
    for lengths_ in held.values():
        assert sum(lengths_) <= tokens and len(lengths_) <= documents and sum(x * x for x in lengths_) <= attention
    if documents > 3 and attention > 10**8:
        assert opened <= -(-sum(lengths) // tokens) * 1.03 + 1


def test_pack_texts(spark):
    path = tokenizer(WORD_BPE)
    rows = [(1, "a b"), (2, None), (None, "x"), (None, "x"), (3, "word " * 5_000), (4, "")]
    frame = spark.createDataFrame(rows, "key bigint, text string").selectExpr("*", "1 AS sequence_id", "2 AS offset")
    got = packing.pack_texts(frame, path).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.key, []).append(r)
    assert [sorted((p.piece, p.start, p.length) for p in by_text[3])] == [[(0, 0, 2048), (1, 2048, 2048), (2, 4096, 905)]]
    assert len(by_text[None]) == 2 and by_text[2][0].length == by_text[4][0].length == 1
    whole = np.array([*ids(path, "word " * 5_000), 0], "<u4")
    assert [p.ids_crc32 for p in sorted(by_text[3], key=lambda p: p.piece)] == [zlib.crc32(whole[i : i + 2048].tobytes()) for i in (0, 2048, 4096)]
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048 and len(sequences) == 3
    assert packing.pack_texts(frame.limit(0), path).count() == 0
