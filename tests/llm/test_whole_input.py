"""Literal maps are made once, targets are whole, and passes over tokens skip texts without a pattern."""

from __future__ import annotations

import re

import public_tokenizers as P

from ridgeline.llm import bpe, pii, quality


def test_literal_maps_are_read_not_made_again(spark):
    """The plan that encodes refers to the maps some ten times; it groups nothing, as they are stored."""
    docs = spark.createDataFrame([(1, "some words, some more words"), (2, None)], "doc_id long, text string")
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))[:2000]
    plan = bpe.encode(docs, P.PATTERN, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


def test_a_task_is_sent_each_literal_map_once(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))[:2000]
    plan = bpe.encode(docs, P.PATTERN, vocabulary)._jdf.queryExecution().optimizedPlan()
    expressions = plan.expressions().mkString("\n")
    while plan.children().size():
        plan = plan.children().head()
        expressions += "\n" + plan.expressions().mkString("\n")
    assert len(re.findall("scalar-subquery#", expressions)) == 4  # pairs, spans, pieces and frequent words


def test_every_trusted_document_is_in_the_target(spark):
    ids = spark.range(25_000).withColumnRenamed("id", "doc_id")
    assert quality.target_ids(ids.unionByName(ids)).count() == 25_000


def test_trusted_ids_that_are_not_sent_give_the_same(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(80))) for i in range(60)] + [(None, "a b"), (60, None)], "doc_id long, text string")
    trusted = docs.where("doc_id % 3 = 0")
    rows = lambda df: sorted(df.collect(), key=str)
    assert rows(quality.judge(docs, trusted, sent=0)) == rows(quality.judge(docs, trusted))


def test_texts_without_a_pattern_are_not_cut_into_tokens(spark):
    texts = ["mail\tTO x", "nothing here", "ΌΣΟΣ x", "q " + "A" * 70 + " x", "tomorrow x", "", "\nto"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    patterns = lambda *c: spark.createDataFrame([(x,) for x in c], "context string")
    kept = lambda p: {r.row for r in pii._with_pattern(docs, p).collect()}
    assert kept(patterns("mail to", "όσος")) == {0, 2, 6}
    assert kept(patterns("a" * 64)) == {3}
    assert kept(patterns("to").limit(0)) == set()
