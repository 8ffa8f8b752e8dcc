"""Passages of evaluation texts in documents, against brute force."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import leaked_passages as module
from codeloom.llm.leaked_passages import PassageIndex, leak_report, leaked_passages, words

ITEM = "Which of the seven callers reads the ledger first, and through which file does the second hop of the chain reach it?"


def plain(items, text, length):
    own = words(text)
    runs = {tuple(own[i : i + length]) for i in range(len(own) - length + 1)}
    return {k for k, t in items for w in [words(t)] if any(tuple(w[i : i + length]) in runs for i in range(len(w) - length + 1))}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 5))
def test_against_brute_force(items, text, length):
    pairs = [(i, " ".join(x)) for i, x in enumerate(items)]
    assert PassageIndex(pairs, length).search(words(" ".join(text))) == plain(pairs, " ".join(text), length)


def test_differences_that_do_not_count():
    whole = PassageIndex([(1, ITEM)])

    class index:
        search = staticmethod(lambda text: whole.search(words(text)))

    run = "the ledger first and through which file does the second hop of the"
    assert index.search("x " + run + " y") == {1}
    assert index.search(run.upper().replace(" ", ",\n- ")) == {1}
    assert index.search(run.replace("ledger", "l\u200bedgеr").replace("file", "ｆｉle").replace(" hop", "\u00a0hop")) == {1}
    assert index.search(run.removesuffix(" the")) == set() and index.search(run.replace("hop", "hops")) == set()
    assert index.search(run.replace("second hop", "second-hop")) == {1} and index.search(run.replace("ledger", "led ger")) == set()


def test_operator(spark, monkeypatch):
    docs = [(1, "a " * 50_000 + ITEM, "x", 1), (2, ITEM.lower(), "x", 2), (2, ITEM.lower(), "x", 2), (3, None, "x", 3), (4, "", "x", 4), (None, ITEM, "x", 5), (5, "nothing of it", "x", 6), (6, "one two three " * 8, "x", 7)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, suite string, item_id long")
    items = spark.createDataFrame([(1, "s", ITEM), (1, "s", ITEM), (2, "s", "too short"), (3, "s", None), (None, "s", ITEM), (4, "s", "one two three " * 5), (5, "s", "two three one " * 5)], "item_id long, suite string, text string")
    expected = [(1, 1), (2, 1), (6, 4), (6, 5)]
    assert sorted(map(tuple, leaked_passages(documents, items).collect())) == expected
    monkeypatch.setattr(module, "PART_CHARACTERS", 100)
    assert sorted(map(tuple, leaked_passages(documents, items).collect())) == expected
    monkeypatch.undo()
    assert leaked_passages(documents.limit(0), items).count() == 0 and leaked_passages(documents, items.limit(0)).count() == 0
    assert {tuple(r) for r in leak_report(leaked_passages(documents, items), items).collect()} == {(1, 2), (2, 0), (3, 0), (4, 1), (5, 1)}
