import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import prepare
from tests import models

SENTENCE = "clean_mention_sentence"


def one(spark, schema, *values):
    df = spark.createDataFrame([values], schema)
    return text.mention_context(df).select("mention", "context").first()


INT = f"{SENTENCE} string, clean_entity_mention string, mention_start int, mention_end int"


@pytest.mark.parametrize(
    "sentence, entity, start, end, mention, context",
    [
        ("the European Parliament met", "European Parliament", 4, 23, "European Parliament", "the  <mention> European Parliament </mention>  met"),
        ("the European Parliament met", "EP", 4, 23, "European Parliament", "the  <mention> European Parliament </mention>  met"),
        ("the EP met", "EP", None, None, "EP", "the EP met"),
        ("the EP met", None, None, None, "the EP met", "the EP met"),
        ("the EP met", "nan", None, None, "the EP met", "the EP met"),
        ("the EP met", "", None, None, "the EP met", "the EP met"),
        ("the EP met", "EP", 8, 99, "EP", "the EP met"),
        ("the EP met", "EP", 6, 4, "EP", "the EP met"),
        ("the EP met", "EP", -1, 4, "EP", "the EP met"),
        ("the EP met", "EP", 4, 4, "EP", "the EP met"),
        ("the EP met", "EP", 4, None, "EP", "the EP met"),
        ("naïve 😀 Ünï", None, 8, 11, "Ünï", "naïve 😀  <mention> Ünï </mention> "),
        ("EP", "x", 0, 2, "EP", " <mention> EP </mention> "),
        (None, "EP", 0, 2, "EP", None),
    ],
)
def test_mention_context(spark, sentence, entity, start, end, mention, context):
    assert tuple(one(spark, INT, sentence, entity, start, end)) == (mention, context)


def test_offsets_of_other_types(spark):
    floats = f"{SENTENCE} string, clean_entity_mention string, mention_start double, mention_end double"
    assert one(spark, floats, "the EP met", "Europe", 4.0, 6.9).mention == "EP"
    assert one(spark, floats, "the EP met", "Europe", float("nan"), 6.0).mention == "Europe"
    texts = f"{SENTENCE} string, clean_entity_mention string, mention_start string, mention_end string"
    assert one(spark, texts, "the EP met", "European", "x", "6").mention == "European"
    assert one(spark, texts, "the EP met", "European", "4", "6").mention == "EP"
    assert one(spark, texts, "the EP met", "European", "4.0", "6").mention == "European"
    assert one(spark, f"{SENTENCE} string", "the EP met").mention == "the EP met"


def test_clean_and_split(spark):
    df = spark.createDataFrame(
        [(1, "\t One\r\ntwo.  Three!? Four…  five。六！ 3.5 is one 　"), (2, "   "), (3, "a    b")], "doc_id int, text string"
    )
    cleaned = [r[0] for r in df.select(text.clean_text(F.col("text"))).collect()]
    assert cleaned == ["One two. Three!? Four… five。六！ 3.5 is one", "", "a  b"]
    rows = prepare.split_sentences(df).where("doc_id = 1").orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == ["One two.", "Three!?", "Four…", "five。", "六！", "3.5 is one"]
    assert prepare.split_sentences(df).where("doc_id = 2").count() == 0


def test_abbreviations(spark):
    often = [(i, f"Dr. Meyer came to see prof. Lang on day {i}. It was late. We met Dr. Lang.") for i in range(6)]
    df = spark.createDataFrame([*often, (10, "It is. Late it was."), (11, None)], "doc_id int, text string")
    known = prepare.learn_abbreviations(df)
    assert {r.word: (r.dotted, r.plain) for r in known.collect()} == {"dr": (12, 0), "prof": (6, 0)}
    rows = prepare.split_sentences(df, abbreviations=known).where("doc_id = 0").orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == ["Dr. Meyer came to see prof. Lang on day 0.", "It was late.", "We met Dr. Lang."]
    end = spark.createDataFrame([(1, "a Dr... b"), (2, "x3dr. y"), (3, "Dr.")], "doc_id int, text string")
    got = prepare.split_sentences(end, abbreviations=known).orderBy("doc_id", "sentence_no").collect()
    assert [r.sentence for r in got] == ["a Dr...", "b", "x3dr. y", "Dr."]


def test_gazetteer(spark):
    sentences = spark.createDataFrame([(1, "Parisian Paris and Rome, Paris."), (2, "no name"), (3, None)], "doc_id int, sentence string")
    terms = spark.createDataFrame([("paris", "LOC"), ("rome", "LOC")], "term string, entity_type string")
    rows = prepare.gazetteer_mentions(sentences, terms, "[A-Za-z]+", ignore_case=True)
    assert sorted((r.clean_entity_mention, r.mention_start, r.mention_end, r.entity_type) for r in rows.collect()) == [
        ("Paris", 9, 14, "LOC"), ("Paris", 25, 30, "LOC"), ("Rome", 19, 23, "LOC"),
    ]
    longer = spark.createDataFrame([("Rome, Paris",), ("Paris and Rome",), ("Rome Paris",)], "term string")
    rows = prepare.gazetteer_mentions(sentences, longer, "[A-Za-z]+", most_words=3)
    assert sorted((r.clean_entity_mention, r.mention_start, r.mention_end) for r in rows.collect()) == [
        ("Paris and Rome", 9, 23), ("Rome, Paris", 19, 30),
    ]
    assert prepare.gazetteer_mentions(sentences, terms, "[A-Za-z]+").count() == 0
    words = prepare.frequent_words(sentences, "[A-Za-z]+", 1)
    assert words.where("term = 'Paris'").first().sentences == 1


@pytest.mark.parametrize("fold", [False, True])
def test_terms_sent_and_joined_give_the_same(spark, fold):
    chance = random.Random(3)
    names = ["Ada", "ada", "Rome", "İzmir", "Straße", "von", "der", "O'Neil", "日本"]
    rows = [(i, chance.choice([" ", ", "]).join(chance.choices(names, k=chance.randint(0, 9)))) for i in range(80)] + [(99, None)]
    sentences = spark.createDataFrame(rows, "doc_id int, sentence string")
    terms = [(f"{a} {b}", "TWO") for a in names[:5] for b in names[:5]] + [(a, "ONE") for a in names] + [("Rome", "ALSO"), (None, "NONE")]
    terms += [("von der Ada", "THREE"), ("Rome, Rome", "TWO"), ("ada von der Rome Ada", "FIVE")]
    table = spark.createDataFrame(terms, "term string, entity_type string")
    sent = prepare.gazetteer_mentions(sentences, table, r"[\w']+", fold, 5)
    joined = prepare.gazetteer_mentions(sentences, table, r"[\w']+", fold, 5, term_bytes=0)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, sent.collect()))
    assert got == sorted(map(tuple, joined.collect())) and {"ONE", "TWO", "ALSO"} <= {r[-1] for r in got}


def spans_of(spark, sequences):
    rows = [(i, j, *token) for i, tokens in enumerate(sequences) for j, token in enumerate(tokens)]
    df = spark.createDataFrame(rows, "sent_id int, tok_idx int, label string, start int, end int")
    found = {}
    for r in prepare.merge_tag_spans(df).orderBy("sent_id", "start").collect():
        found.setdefault(r.sent_id, []).append((r.start, r.end, r.type))
    return [found.get(i, []) for i in range(len(sequences))]


def placed(labels):
    return [(label, 2 * i, 2 * i + 1) for i, label in enumerate(labels)]


def test_tag_merge_golden(spark):
    cases = [
        placed(["B-PER", "I-PER", "O"]), placed(["B-PER", "B-PER"]), placed(["B-PER", "B-LOC"]), placed(["B-PER", "I-LOC"]),
        placed(["B-PER", "I-LOC", "B-LOC"]), [("I-PER", 0, 1), ("I-PER", 1, 1), ("I-PER", 2, 3)], placed(["I-LOC"]),
        placed(["O", "O"]), placed(["PER", "B-PER"]),
    ]
    assert [len(s) for s in spans_of(spark, cases)] == [1, 1, 2, 1, 2, 2, 1, 0, 1]
    assert spans_of(spark, cases)[3] == [(0, 3, "PER")]


def test_tag_merge_random(spark):
    chance = random.Random(1)
    labels = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-A-ORG", "MISC"]
    cases = []
    for _ in range(400):
        tokens = placed([chance.choice(labels) for _ in range(chance.randint(1, 12))])
        cases.append([(l, s, s if chance.random() < 0.1 else e) for l, s, e in tokens])
    assert spans_of(spark, cases) == [models.tag_spans(c) for c in cases]


def test_tagger_plugin(spark):
    class Capitals:
        def tag(self, sentences):
            out = []
            for sentence in sentences:
                at, tokens = 0, []
                for word in sentence.split(" "):
                    tokens.append(("B-NAME" if word[:1].isupper() else "O", at, at + len(word)))
                    at += len(word) + 1
                out.append(tokens)
            return out

    sentences = spark.createDataFrame([(1, "we met Ada Lovelace today"), (2, "  "), (3, None)], "id int, sentence string")
    rows = prepare.tag_mentions(sentences, Capitals())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    rows = rows.collect()
    assert [(r.id, r.clean_entity_mention, r.mention_start, r.entity_type) for r in rows] == [(1, "Ada Lovelace", 7, "NAME")]


def test_provenance(spark):
    df = spark.createDataFrame(
        [("nan", "b"), (None, "c"), ("a", "b"), (" ", "None")], "document_id string, source_file string"
    )
    assert [r[0] for r in df.select(text.provenance(df)).collect()] == ["b", "c", "a", None]
