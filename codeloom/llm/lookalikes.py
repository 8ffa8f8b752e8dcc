"""One consistent form of texts that look the same: script resolution, width, joined and invisible forms.

A text is decomposed, and each character is put into a class of characters that look alike in several scripts. For each token the
script sets of its classes are intersected: a token all of whose classes have a member in one script is spelled in that script
(whole-script look-alikes go to the first of SCRIPTS that fits), so mixed spellings are resolved; a token that no script can spell
whole takes the first script of each class. The spelling depends on the classes alone, hence two texts get one form exactly if
they agree class by class: texts that differ visibly stay different.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")

# fixed values: characters that look alike, one class a word, in the order of SCRIPTS (- where a script has none)
_CLASSES = """
AАΑ-Ꭺ BВΒ-Ᏼ CСϹ-Ꮯ EЕΕ-Ꭼ HНΗ-Ꮋ IІΙ-- JЈͿ-Ꭻ KКΚ-Ꮶ L---Ꮮ MМΜ-Ꮇ N-Ν-- OОΟՕ- PРΡ-Ꮲ Q----
SЅ-ՏᏚ TТΤ-Ꭲ V---Ꮩ WԜ--Ꮃ XХΧ-- YҮΥ-- Z-Ζ-Ꮓ aа--- cсϲ-- dԁ--- eе--- gց--- hһ-հ- iі--- jјϳ--
lӏ--- oоοօ- pр--- qԛ-զ- sѕ--- u--ս- vѵν-- wԝ--- xх--- yу--- n--ո- æӕ--- ÆӔ--- əә--- ƏӘ---
-ГΓ-- -ПΠ-- -ФΦ--
"""
# fixed values: further members of a class (look-alike letters of the public confusables of the Unicode security data): the
# class's letter, then the look-alike
_LISU = "BꓐPꓑDꓓTꓔGꓖKꓗJꓙCꓚZꓜFꓝMꓟNꓠLꓡSꓢRꓣVꓦHꓧWꓪXꓫYꓬAꓮEꓰIꓲOꓳUꓴ"
_COPTIC = "BⲂHⲎIⲒKⲔMⲘNⲚOⲞoⲟPⲢpⲣCⲤcⲥTⲦXⲬYⲨZⲌ"
_CHEROKEE = "DᎠRᎡGᏀ"
_LATIN = "aɑgɡ"
# fixed values: scripts by which letters are told, and those that are written together under one name
_SCRIPT_NAMES = (
    "Latin Cyrillic Greek Armenian Cherokee Lisu Coptic Han Hiragana Katakana Hangul Bopomofo Arabic Hebrew Syriac Thaana Nko Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala "
    "Thai Lao Tibetan Myanmar Georgian Ethiopic Mongolian Khmer Tifinagh Glagolitic Gothic Runic Ogham Deseret Adlam Vai Yi Javanese Balinese Sundanese Tagalog"
).split()
_TOGETHER = {"Han": ("Hanb", "Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}
# fixed values: marks that look like another
_SAME = {"‐": "-", "‑": "-", "﹣": "-"}
_JOINERS = "\u200c\u200d"
# fixed values: blocks (first, last) of scripts in which joiners change the look, and of symbols that they join
_JOINING = ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x0F00, 0x109F), (0x1780, 0x18AF), (0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x11000, 0x1175F))


def _tables() -> tuple[dict[str, int], list[dict[str, str]]]:
    of: dict[str, int] = {}
    members: list[dict[str, str]] = []
    for word in _CLASSES.split():
        row = {s: c for s, c in zip(SCRIPTS, word) if c != "-"}
        if word == "gց---":  # Armenian stands second in this word
            row = {"Latin": "g", "Armenian": "ց"}
        for c in row.values():
            of[c] = len(members)
        members.append(row)
    for script, more in (("Lisu", _LISU), ("Coptic", _COPTIC), ("Cherokee", _CHEROKEE), ("Latin", _LATIN)):
        for letter, alike in zip(more[::2], more[1::2]):
            k = of.get(letter)
            if k is None:
                k = of[letter] = len(members)
                members.append({"Latin": letter})
            of[alike] = k
            members[k].setdefault(script, alike)
    return of, members


_CLASS_OF, _MEMBERS = _tables()
_PLAIN = re.compile(r"[\x20-\x7e\n\t]*+\Z")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*+")
_ASCII = re.compile(r"[\x00-\x7f]*+\Z")


def _joins(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _JOINING)


@lru_cache(maxsize=65536)
def _decomposed(c: str) -> str:
    """What one character stands for: canonical parts, the plain form of width variants, joined letters and blanks; nothing for
    what cannot be seen."""
    if c in _SAME:
        return _SAME[c]
    if c in "\n\t":
        return c
    category = unicodedata.category(c)
    if category == "Zs":
        return " "
    if c in "\u2028\u2029\x85\x0b\x0c":
        return "\n"
    if category in ("Cf", "Cc") and c not in _JOINERS or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(c) <= 0xFE0E or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    parts = unicodedata.decomposition(c)
    if parts.startswith("<"):
        kind, *codes = parts.split()
        letters = "".join(chr(int(x, 16)) for x in codes)
        joined = kind == "<compat>" and len(letters) > 1 and all(unicodedata.category(x)[0] == "L" for x in letters) and category[0] in "LN"
        roman = kind == "<compat>" and 0x2160 <= ord(c) <= 0x217F
        if kind in ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>") or joined or roman:
            return "".join(map(_decomposed, letters))
        return c
    return unicodedata.normalize("NFD", c)


_IN_SCRIPT = [(name, regex.compile(rf"\p{{Script_Extensions={name}}}")) for name in _SCRIPT_NAMES]


@lru_cache(maxsize=65536)
def _scripts(c: str) -> frozenset[str]:
    """Resolved scripts of a letter: its script extensions, and the names under which they are written together."""
    own = {name for name, pattern in _IN_SCRIPT if pattern.match(c)} or {unicodedata.name(c, "").split(" ", 1)[0].capitalize()}
    return frozenset(own | {x for name in own for x in _TOGETHER.get(name, ())})


def _alike(c: str) -> frozenset[str] | None:
    """Scripts in which a character, or one that looks like it, is found; None for what belongs to all."""
    k = _CLASS_OF.get(c)
    if k is not None:
        return frozenset(_MEMBERS[k])
    return _scripts(c) if unicodedata.category(c)[0] == "L" else None


@lru_cache(maxsize=200_000)
def _spell(token: str) -> str:
    """The consistent spelling of one decomposed token."""
    if _ASCII.match(token):
        return token
    scripts = None
    classes = []
    for c in token:
        classes.append(_CLASS_OF.get(c))
        own = _alike(c)
        if own is not None:
            scripts = own if scripts is None else scripts & own
    chosen = next((s for s in SCRIPTS if scripts and s in scripts), None)
    out = []
    for c, k in zip(token, classes):
        if k is None:
            out.append(c)
        else:
            row = _MEMBERS[k]
            out.append(row[chosen] if chosen in row else next(iter(row.values())))
    return "".join(out)


def canonical(text: str) -> str:
    """The one form of ``text``; idempotent. Case, accents, digits, visible marks and the number of blanks are kept."""
    if _PLAIN.match(text):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = "".join(c if "\x20" <= c <= "\x7e" else _decomposed(c) for c in text)
    if "\u200c" in parts or "\u200d" in parts:
        parts = "".join(c for i, c in enumerate(parts) if c not in _JOINERS or (i and _joins(parts[i - 1])))
    parts = unicodedata.normalize("NFD", parts)
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: _spell(m[0]), parts))


def confusion(token: str) -> str:
    """What a token could be taken for: "mixed" if no script is common to its letters as they stand, but there is one once
    look-alikes are taken for each other; "whole" if all its letters are of one script and look alike in another; else ""."""
    letters = [c for c in unicodedata.normalize("NFD", "".join(map(_decomposed, token))) if unicodedata.category(c)[0] == "L"]
    if not letters:
        return ""
    alike = frozenset.intersection(*[_alike(c) for c in letters])
    if not frozenset.intersection(*map(_scripts, letters)):
        return "mixed" if alike else ""
    return "whole" if len(alike) > 1 else ""


def _count_confusions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = lru_cache(maxsize=200_000)(confusion)
    for batch in batches:
        kinds = [[seen(m[0]) for m in _WORDS.finditer(t)] if t and not t.isascii() else [] for t in batch["text"]]
        # tokens of ASCII letters are no spelling in disguise, though another script could imitate them
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_mixed": [k.count("mixed") for k in kinds], "n_whole": [k.count("whole") for k in kinds]})


_WORDS = re.compile(r"(?![\x00-\x7f]+\b)[^\W_](?:[^\W_]|[\u0300-\u036f])*+")


def script_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_mixed (tokens that mix look-alikes of several scripts), n_whole (tokens of another script than Latin that could stand
    whole in a second one), of each document with such a token. Null texts have none."""
    counts = spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInPandas(_count_confusions, "doc_id long, n_mixed long, n_whole long")
    return counts.where("n_mixed + n_whole > 0")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(form=[None if t is None else canonical(t) for t in batch["text"]])


def consistent_forms(documents: DataFrame) -> DataFrame:
    """doc_id, text and form of every document, row by row; a null text has a null form, an empty one an empty form.

    ``documents`` needs doc_id and text; other columns are ignored.
    """
    return spread(documents.select("doc_id", "text")).mapInPandas(_forms, "doc_id long, text string, form string")


def _keyed(documents: DataFrame) -> DataFrame:
    """Distinct doc_id with 128-bit hashes of form and text; texts themselves go no further."""
    keyed = consistent_forms(documents).where(F.col("doc_id").isNotNull() & F.col("form").isNotNull()).select(
        "doc_id",
        F.xxhash64("form").alias("f1"),
        F.xxhash64(F.lit(7), "form").alias("f2"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit(7), "text").alias("t2"),
    )
    return materialize(keyed.distinct(), "text-forms")


def same_look(documents: DataFrame) -> DataFrame:
    """Pairs doc_id_a < doc_id_b of documents whose texts read the same but are not the same string, once each.

    Documents are grouped by 128-bit hashes of their form and split by the hash of their text; groups of one spelling never meet
    a join, so copies cost nothing. Null texts and ids pair with nothing; empty texts are one string. Repeated rows of one
    doc_id and text count once. Texts themselves are not shuffled.
    """
    return differing_pairs(_keyed(documents))


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that reads the same), n_documents and n_spellings of the class, one row a document and
    look: what :func:`same_look` says without its pairs, in the size of the documents. Null ids and texts are left out."""
    keyed = _keyed(documents)
    classes = keyed.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("t1", "t2").alias("n_spellings"))
    return keyed.select("doc_id", "f1", "f2").distinct().join(classes, ["f1", "f2"]).select("doc_id", "class_id", "n_documents", "n_spellings")


#: Documents of one look that one task compares with all others of it.
LOOK_BLOCK = 2000


def differing_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of doc_ids with equal (f1, f2) and unequal (t1, t2); distinct rows as :func:`same_look` makes them.

    Only groups with several spellings are joined. A side of a pair is spread by its doc_id, the other side is repeated for each
    of the parts, of which a group has one for every LOOK_BLOCK documents, so that a large group is worked off by many tasks.
    """
    several = keyed.groupBy("f1", "f2").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d"), F.ceil(F.count("*") / LOOK_BLOCK).alias("parts")).where("a <> b or c <> d").select("f1", "f2", "parts")
    live = materialize(keyed.join(several, ["f1", "f2"]), "looks-of-several-spellings")
    left = live.select("f1", "f2", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.col("doc_id").alias("doc_id_a"), F.col("t1").alias("ta"), F.col("t2").alias("ua"))
    right = live.select("f1", "f2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("doc_id_b"), F.col("t1").alias("tb"), F.col("t2").alias("ub"))
    return (
        left.join(right, ["f1", "f2", "part"])
        .where("doc_id_a < doc_id_b and (ta <> tb or ua <> ub)")
        .select("doc_id_a", "doc_id_b")
    )
