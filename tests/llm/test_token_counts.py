"""Token counts against the library for the vocabulary, on the sample texts and on odd ones; the prefix table's answers."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.token_counts import VOCABULARY, count_at, count_tokens, counter_of, longest_prefix, op1_token_counts, truncate_to_budget

SMALL = "/root/testdata/sf0.001"

LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
OURS = counter_of(public_tokenizers.path(VOCABULARY))
ODD = ["", " ", "a", "  two  spaces ", "tabs\t\tand\r\nlines\n\n x", "it's we'll I'M 'S", "1234567 12,5", "ÀÉ漢字かなカナ 😀👍🏽", "x" * 3000, "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "<|endof", "  x", "\x00\x01", "ab" * 500 + " the the", "\n\n\x1c", " \x1c", "\x1c\x1d a", " \x1f\x1e's", "\x85\x85x\xa0\xa0y\u3000\u3000z"]


def library(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert OURS.count(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert OURS.count(text) == library(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=" \n\t'sa1!\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000", max_size=12))
def test_white_space_of_all_kinds(text):
    assert OURS.count(text) == library(text)


def check_table(text: str) -> None:
    table = OURS.table(text)
    counts = [library(text[:cut]) for cut in range(len(text) + 1)]
    assert [count_at(table, cut) for cut in range(len(text) + 1)] == counts
    for budget in range(0, 12):
        assert longest_prefix(table, budget) == max(cut for cut, n in enumerate(counts) if n <= budget)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcthe in'slm 12.\n \t!é漢'red\x1c\x1d\x1e\x1f\x85\xa0\u3000", max_size=50))
def test_prefix_table(text):
    """The stored table holds the exact count of every prefix."""
    check_table(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_prefix_table_any_text(text):
    check_table(text)


@pytest.mark.parametrize("text", [t for t in ODD if len(t) < 60] + ["don't we'll 's  's\n's", "!'re 'reading it'd", "a   \n b\t\tc  ", "\u3000 x\u00a0y", "'", "''s", " 'll", "1's 2'S", "x <|endoftext|> y<|endof"])
def test_prefix_table_odd(text):
    check_table(text)


def test_query(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = op1_token_counts(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
        assert r.prefix_chars == len(texts[r.doc_id]) if n <= 512 else library(texts[r.doc_id][: r.prefix_chars]) <= 512


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 5), (None, "one two", 6), (1, None, 5)], "doc_id long, text string, n_tokens int")
    got = count_tokens(rows, tables=True)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == [(1, 0), (1, 0), (None, 2)]
    assert {r.text for r in truncate_to_budget(got, 1).collect()} == {None, "one"}
    assert count_tokens(rows.limit(0)).count() == 0
