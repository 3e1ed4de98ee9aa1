"""Line-first quality cleaning, in DataFrame expressions only.

Each line is judged by itself; failing lines go, and a document that loses too much of its text to
the line rules, or fails the whole-document base rules, is rejected.

Base rules (on the text as given): at least ``min_words`` words, and at most ``max_repeat_pct`` % of
the words inside 5-word windows that occur twice or more.

Line rules, for lines that have a word:

* punctuation: fewer than ``short_line`` words and no terminal mark at the end;
* navigation: at least three separators (``| » › • ·``), or on average one for every three words;
* symbols: more than one of ``#*$%&<>`` for every four words, or mostly upper-case with ``!!`` marks;
* boilerplate, in lines of at most ``boilerplate_words`` words: one of the fixed phrases below, as whole words, a copyright
  mark with its year, or nothing but an address or a page counter.

Edge cases: null and empty texts have no words, so they fail the base; a document of which
no text is left is rejected; rows are judged one by one, so repeated rows and ids give a row each; very long texts cost n log n, never n squared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, words_column

# Phrases that mark boilerplate lines, in English, French, German and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "javascript",
    "lorem ipsum",
    "sign in",
    "sign up",
    "log in",
    "subscribe",
    "share this",
    "click here",
    "read more",
    "skip to content",
    "tous droits réservés",
    "conditions d'utilisation",
    "politique de confidentialité",
    "mentions légales",
    "lire la suite",
    "se connecter",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "impressum",
    "weiterlesen",
    "jetzt anmelden",
    "todos los derechos reservados",
    "condiciones de uso",
    "política de privacidad",
    "aviso legal",
    "leer más",
    "iniciar sesión",
)
# A copyright line in any language, a bare address, a counter such as "page 3 of 12" or "3 / 12".
STRUCTURE = r"(?:©|\(c\)|copyright)\s*\d{4}|^\s*(?:https?://|www\.)\S+\s*$|^\s*[\p{L}.]*\s*\d+\s*(?:/|of|de|sur|von)\s*\d+\s*$"
# Marks that may end a sentence, and marks that separate menu items.
TERMINAL = r"[.!?…。！？:;\"'”’»)\]]\s*$"
SEPARATORS = "|»›•·"
SYMBOLS = "#*$%&<>"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    short_line: int = 6
    boilerplate_words: int = 25
    max_lost_pct: int = 60


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more.

    Windows are compared by 64-bit hash; sorting them brings equal ones together, and sorting the
    starts of the repeated ones lets each add what the next does not cover.
    """

    def hashed(h):
        n = F.size(h) - F.lit(window - 1)
        windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, window)))
        return F.when(n < 2, F.lit(0)).otherwise(_let(windows, unless_distinct))

    def unless_distinct(w):
        in_order_of_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(in_order_of_hash, in_order))

    def in_order(s):
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return _let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def covered(p):
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def line_fails(line: Column, n: Column, rules: QualityRules = QualityRules()) -> Column:
    """Punctuation, navigation and symbol rules for a line of ``n`` words; lines without a word pass."""

    def body(v):
        upper, letters = (F.length(F.regexp_replace(line, f"[^\\p{{{kind}}}]", "")) for kind in ("Lu", "L"))
        return (
            ((n < rules.short_line) & ~line.rlike(TERMINAL))
            | (v["separators"] >= 3) & (v["separators"] * 12 >= n)
            | (v["separators"] * 3 >= n)
            | (v["symbols"] * 4 > n)
            | (line.contains("!!") & (upper * 2 > letters))
        )

    counted = F.struct(_count(line, SEPARATORS).alias("separators"), _count(line, SYMBOLS).alias("symbols"))
    return (n > 0) & _let(counted, body)


def is_boilerplate(line: Column, n: Column, rules: QualityRules = QualityRules()) -> Column:
    """Whether a line of ``n`` words is short and holds one of the phrases or has the form of a notice."""
    whole = r"(?<![\p{L}\p{N}_])(?:" + "|".join(BOILERPLATE) + r")(?![\p{L}\p{N}_])"
    return (n <= rules.boilerplate_words) & _let(F.lower(line), lambda low: reduce(lambda a, b: a | b, (low.contains(p) for p in BOILERPLATE)) & low.rlike(whole) | low.rlike(STRUCTURE))


def clean(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, clean_text``, the counts and verdicts and the columns ``carry``, a row per document."""
    base = texts(docs, id_col, text_col, carry)
    words = words_column(F.col("text"))
    lines = F.split("text", "\n", -1)
    with_word = F.transform(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))


    def judged(x):
        return _let(F.size(words_column(x)), lambda n: F.struct(x.alias("line"), line_fails(x, n, rules).alias("fails"), is_boilerplate(x, n, rules).alias("boilerplate")))

    def joined(v, keep):
        return F.array_join(F.transform(F.filter(v, keep), lambda x: x["line"]), "\n")

    def result(v):  # each line is judged once
        return joined(v, lambda x: ~x["fails"] & ~x["boilerplate"])

    out = base.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _count(F.col("text"), "#*$%&|<>").cast("long"),
            "n_dup_lines": _let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(words, rules.window).cast("long"),
            "clean_text": _let(F.transform(lines, judged), result),
        }
    )
    out = out.withColumn("lost_chars", (F.length("text") - F.length("clean_text")).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("lost_chars") * 100 <= F.length("text") * rules.max_lost_pct) & (F.length(F.trim("clean_text")) > 0)
    )
