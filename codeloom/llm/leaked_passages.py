"""Evaluation passages in a corpus, by Wu-Manber search over words.

Texts are brought to their consistent form, case-folded and cut into words. The patterns are all runs of PASSAGE words of the
evaluation texts. Blocks are runs of three words: the shift table says how far the search may jump when the window ends on a
block (a block of no pattern lets it jump nearly a whole window); where the shift is nothing, the hash bucket of the suffix block
gives the places in the evaluation texts that end so, and a direct comparison confirms the run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .lookalikes import canonical

#: Words of a passage.
PASSAGE = 13
#: Words of a block.
BLOCK = 3
#: Characters of evaluation text that one search holds; larger sets are searched in parts of this size.
PART_CHARACTERS = 4_000_000

_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*+")


def words(text: str) -> list[str]:
    """Words of a text: runs of letters or digits, without regard to case and to differences that cannot be seen."""
    return _WORD.findall(canonical(text).casefold())


class PassageIndex:
    """Shift table, suffix buckets and evaluation words of one set of evaluation items.

    Both tables are one dictionary: of a block it holds the jump (positive), or the places that end on it: minus the place, or a
    list of places where there are several.
    """

    def __init__(self, items: list[tuple[int, str]], length: int = PASSAGE):
        self.length = length
        self.block = min(BLOCK, length)
        self.code: dict[str, int] = {}
        self.words: list[int] = []  # of all items; place 0 is nobody's
        self.item: list[int] = []
        self.table: dict[int, int | list[int]] = {}
        self.words.append(-1)
        self.item.append(-1)
        self.width = 1 + sum(len(text) for _, text in items)  # more than there are words
        self.jump = length - self.block + 1  # of a window whose last block is in no pattern
        for item, text in items:
            codes = [self.code.setdefault(w, len(self.code)) for w in words(text)]
            if len(codes) >= length:
                self._add(item, codes)

    def _add(self, item: int, codes: list[int]) -> None:
        start, table = len(self.words), self.table
        self.words += codes
        self.item += [item] * len(codes)
        for i in range(self.block - 1, len(codes)):
            key = 0
            for c in codes[i - self.block + 1 : i + 1]:
                key = key * self.width + c
            held = table.get(key)
            if i < self.length - 1:  # windows that hold the block end later
                if held is None or (isinstance(held, int) and held > self.length - 1 - i):
                    table[key] = self.length - 1 - i
            elif isinstance(held, list):
                held.append(start + i)
            elif held is not None and held < 0:
                table[key] = [-held, start + i]
            else:
                table[key] = -(start + i)

    def search(self, found_words: list[str]) -> set[int]:
        """Ids of the items of which a text of these words holds a run of ``length``."""
        found: set[int] = set()
        get, table, width, length, jump, block = self.code.get, self.table.get, self.width, self.length, self.jump, self.block
        codes = [get(w, -1) for w in found_words]
        end, n = length - 1, len(codes)
        while end < n:
            key = 0
            for at in range(end, end - block, -1):
                if codes[at] < 0:  # no window may hold this word
                    end = at + length
                    break
            else:
                for at in range(end - block + 1, end + 1):
                    key = key * width + codes[at]
                held = table(key, jump)
                if held.__class__ is int and held > 0:
                    end += held
                    continue
                window = codes[end - length + 1 : end + 1]
                for place in held if held.__class__ is list else (-held,):
                    if self.item[place] not in found and self.item[place - length + 1] == self.item[place] and self.words[place - length + 1 : place + 1] == window:
                        found.add(self.item[place])
                end += 1
        return found


_indexes: dict[int, PassageIndex] = {}


def _index(items: list[tuple[int, str]], length: int) -> PassageIndex:
    """The index of a part of the items, built once in each worker."""
    key = hash((length, tuple(items)))
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = PassageIndex(items, length)
    return _indexes[key]


def _searcher(items: list[tuple[int, str]], length: int, cut: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(items, length)
        for batch in batches:
            rows = [(doc, item) for doc, text in zip(batch["doc_id"], batch["text"]) for item in sorted(index.search(text.split(" ") if cut else words(text)))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return search


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[" ".join(words(t)) for t in batch["text"]])


def leaked_passages(documents: DataFrame, items: DataFrame, length: int = PASSAGE) -> DataFrame:
    """doc_id and item_id of each document that holds at least ``length`` consecutive words of an item, once each.

    ``documents`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Null ids and texts, and items of
    fewer words, match nothing; repeated rows count once; rows of one item_id with several texts leak if one of them does.
    Texts are searched whole. The items are held by each task, in parts of at most PART_CHARACTERS characters: a larger set of
    items takes several passes over the documents, whose words are then cut and written once before the first.
    """
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(1.2 * size / PART_CHARACTERS))
    scan = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text"))
    if parts > 1:
        scan = materialize(scan.mapInPandas(_cut, "doc_id long, text string"), "document-words")
    found = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        held = sorted((r.item_id, r.text) for r in part.collect())  # bounded: one part
        leaks = scan.mapInPandas(_searcher(held, length, parts > 1), "doc_id long, item_id long")
        if parts > 1:
            leaks = materialize(leaks, "leaks")
        found = leaks if found is None else found.unionByName(leaks)
    return found.distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: item_id, n_documents (that hold a passage of it, 0 if none)."""
    counts = leaks.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.where(F.col("item_id").isNotNull()).select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))
