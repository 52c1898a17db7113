"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytofold.llm.common import fill, named, words

SYMBOLS = "#*$%&|<>"  # as a character class

#: Frequent function words of the languages covered.
STOP_WORDS = (
    "the of and to in a is that for it with on was as be at by this from or are "
    "le la de et les des en un une du est que pour dans qui sur au "
    "der die das und ist von zu den mit ein eine nicht auf im für "
    "el los las del y por con para una se es que"
).split()

#: (name, metric, smallest allowed, largest allowed, fewest words for the rule to apply)
THRESHOLDS = (
    ("too_short", "n_words", 10, None, 0),
    ("repeated_words", "repeat_ratio", None, 0.20, 0),
    ("word_length", "mean_word_length", 2.0, 15.0, 0),
    ("symbols", "symbol_ratio", None, 0.10, 0),
    ("exclamations", "exclamation_ratio", None, 0.20, 0),
    ("repeated_lines", "dup_line_ratio", None, 0.50, 20),
    ("stop_words", "stop_word_ratio", 0.02, None, 50),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever ``body`` does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits that hold a window's position beside its hash.
AT_BITS = 28


def repeat_cover(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of five words found twice or more.

    Hashes of the windows show quickly that none repeats, which holds for most
    texts. Otherwise sorting (hash, position), packed into one long, finds the
    windows that may repeat; those alone are compared as strings. Sorted starts
    of equal windows give the covered words as the sum of min(width, step to the
    next start).
    """
    at_mask = (1 << AT_BITS) - 1

    def codes(ws: Column) -> Column:
        starts = F.slice(ws, F.lit(1), F.size(ws) - (width - 1))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, width))))

    def neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        near = lambda x, j: F.coalesce(same(F.get(s, j), x), F.lit(False))
        return F.filter(s, lambda x, i: near(x, i - 1) | near(x, i + 1))

    def covered(ws: Column, h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~at_mask)).bitwiseOR(i.cast("long"))))
        maybe = let(packed, lambda s: neighbours(s, lambda a, b: F.shiftright(a.bitwiseXOR(b), AT_BITS) == 0))
        texts = F.array_sort(
            F.transform(maybe, lambda x: let(x.bitwiseAND(F.lit(at_mask)).cast("int"), lambda at: F.struct(F.array_join(F.slice(ws, at + 1, F.lit(width)), " ").alias("w"), at.alias("at"))))
        )
        starts = F.array_sort(F.transform(let(texts, lambda s: neighbours(s, lambda a, b: a["w"] == b["w"])), lambda x: x["at"]))
        step = lambda p, x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: step(p, x, i)), F.lit(0), lambda a, b: a + b))

    def count(ws: Column) -> Column:
        found = let(codes(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(ws, h)))
        too_long = F.raise_error(F.lit(f"a text of {at_mask + 1} words or more has no room for its positions")).cast("int")
        return F.when(F.size(ws) <= width, F.lit(0)).when(F.size(ws) > at_mask, too_long).otherwise(found)

    return let(words, count)


def measures(text: Column) -> Column:
    """A struct of the counts of a text that the rules look at."""
    text = fill(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]++", "")).cast("long")
    stop_words = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})

    def of(ws: Column, ls: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.concat_ws("", ws)).cast("long").alias("word_chars"),
            only(SYMBOLS).alias("n_symbols"),
            only("!").alias("n_exclamations"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_cover(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(stop_words))).cast("long").alias("n_stop_words"),
        )

    return let(words(text), lambda ws: let(lines, lambda ls: of(ws, ls)))


def verdicts(thresholds=THRESHOLDS) -> dict[str, Column]:
    """A boolean column for each rule, true where it is broken; a ratio of an empty text is 0."""
    out = {}
    for name, metric, low, high, least in thresholds:
        value = F.col(metric)
        broken = F.lit(False)
        if low is not None:
            broken = broken | (value < low)
        if high is not None:
            broken = broken | (value > high)
        out[name] = broken & (F.col("n_words") >= least)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: doc_id, counts, ratios, base_failed, kept, and ``broken``, the names of broken rules.

    Null and empty texts have no words: counts are 0 and the text is not kept.
    Ids are carried as they are, null and repeated ones too; other columns are
    ignored. An empty table gives an empty result.
    """
    # A generator, since a projection would be merged with those below and its work repeated.
    return judge(docs.select(named(id_col).alias("doc_id"), F.inline(F.array(measures(named(text_col))))), thresholds)


def judge(counted: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Add ratios and verdicts to the counts."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rated = counted.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_exclamations", "n_words").alias("exclamation_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in verdicts(thresholds).items())), lambda x: x.isNotNull())
    judged = rated.select("*", base.alias("base_failed"), broken.alias("broken"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were, in one pass without a shuffle."""
    held = F.struct(*(named(c) for c in docs.columns)).alias("_row")
    counted = docs.select(held, F.inline(F.array(measures(named(text_col)))))
    return judge(counted, thresholds).where("kept").select("_row.*")
