"""Quality rules: a threshold table compiled into one projection, without user functions.

Counts per text (``counts``) are exact. ``Rule`` compares one count with a percentage of another, so every
comparison is between whole numbers and cannot differ between engines.

Defined results: null and empty texts have zero of everything and fail the base rule; ties and repeated rows are
judged each for itself; an empty table gives an empty table; other columns of the input, whatever their names, are
ignored. Repeated word windows are found by their 64-bit hash inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be at this from "
    "der die und das in den von zu mit ist im für auf des ein eine nicht "
    "le la les de et des un une du que est en dans pour qui sur "
    "el los las y que en un una por con para se del es al"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text when ``100 * part`` is above (``most``) or below (``least``) ``percent * whole``."""

    name: str
    part: str
    whole: str
    percent: int
    kind: str = "most"

    def failed(self) -> Column:
        left, right = F.col(self.part) * 100, F.col(self.whole) * self.percent
        return (left > right) if self.kind == "most" else (left < right)


#: The base contract: too short, or mostly repeated word windows.
BASE = (
    Rule("too_short", "n_words", "one", 5000, "least"),
    Rule("repeated_words", "n_repeat_words", "n_words", 50),
)

#: Thresholds on mean word length, symbols, stop words and repeated lines.
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, "least"),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, "least"),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 30),
)


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: words, their characters, stop words, symbols, lines, repeated lines and repeated words."""
    text = F.col("text")
    step = texts(df, id_col, text_col).select(
        "doc_id",
        text,
        F.filter(F.split(text, _SPLIT), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    n = F.size("words")
    window = lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
    )
    step = step.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        # Windows in the order of their hash, so that equal ones stand side by side.
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).alias("sorted"),
    )
    twice = lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"])
    step = step.withColumn(
        "starts",
        F.sort_array(
            F.transform(
                F.filter("sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]
            )
        ),
    )
    # A window adds the words that the window before it, in text order, has not covered.
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get("starts", k - 1), F.lit(-3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("sorted", "starts")


def apply_rules(
    df: DataFrame,
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The counts, ``base_failed``, the names of the rules that each text fails, and ``kept``."""
    either = lambda rs: reduce(lambda a, b: a | b, [r.failed() for r in rs], F.lit(False))
    counted = counts(df, id_col, text_col).withColumn("one", F.lit(1))
    names = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]))
    return counted.select(
        "*", either(base).alias("base_failed"), names.alias("failed_rules"), (~either((*base, *rules))).alias("kept")
    ).drop("one")
