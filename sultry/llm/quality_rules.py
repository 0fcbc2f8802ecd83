"""Line-first quality rules. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_col

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A document goes when its failing lines hold more than this share of its words.
MOST_LOST = 0.3
#: Share of a line's words that end in a run of symbols or stand alone as a bar, and of repeated words, from which it fails.
MOST_SYMBOLS, MOST_BARS, MOST_SAME = 0.3, 0.25, 0.5
#: Phrases of navigation and boilerplate lines.
BOILERPLATE = r"(?i)\b(?:all rights reserved|cookie policy|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|sign in|log in|click here|read more|skip to content|javascript is disabled|share this (?:page|article)|subscribe to our newsletter|previous page|next page)\b"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line breaks a rule on punctuation (words ending in symbols or `!!`), navigation (bars, menus),
    shouting (capitals only), repetition (few different words) or boilerplate phrases. Lines without words pass.

    Cheap tests on the line come first, so that words are only looked at one by one where they can matter."""
    n = F.size(words)
    ends = F.regexp_count(line, F.lit(r"(?:[#*$%&<>]{2}|!!)[.,;:]?(?=[\x20\x09-\x0D]|$)")) > MOST_SYMBOLS * n
    symbols = line.rlike(r"[#*$%&<>]{2}|!!") & ends
    bars = (n >= 4) & line.rlike(r"[|»·•>]") & (F.size(F.filter(words, lambda w: w.isin("|", ">", ">>", "»", "·", "•"))) > MOST_BARS * n)
    caps = (n >= 4) & (F.upper(line) == line) & (F.lower(line) != line)
    different = F.size(F.array_distinct(words))
    same = (n >= 12) & (different < (1 - MOST_SAME) * n) & (different < 40)
    return (n > 0) & (symbols | bars | caps | ((n <= 25) & line.rlike(BOILERPLATE)) | same)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda variable stands for it, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of 8 words, by doubling: of 1, 2, 4 and 8 words; null where there is no second window."""

    def doubled(step: int):
        return lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - step), F.slice(g, F.lit(step + 1), F.size(g) - step), lambda a, b: F.xxhash64(a, b))

    grams = F.when(F.size(words) > WINDOW, F.transform(words, lambda w: F.xxhash64(w)))
    for n in (1, 2, 4):
        grams = bound(grams, doubled(n))
    return grams


def repeated_words(grams: Column) -> Column:
    """Words covered by windows that occur twice or more: sorted (hash, place), equal neighbours, places covered."""
    following = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))
    placed = lambda gs: F.array_sort(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    neighbours = lambda c: F.zip_with(c, following(c), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    places = lambda c: F.array_sort(F.array_distinct(F.flatten(F.filter(neighbours(c), lambda x: x.isNotNull()))))
    covered = lambda c: _sum(F.zip_with(c, following(c), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")))
    # Only texts with an equal pair of windows are sorted.
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), bound(bound(placed(grams), places), covered)).otherwise(F.lit(0).cast("long"))


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a Generate: later expressions name them and are not merged into one with them, and filters
    on them are not pushed below, where each mention would be replaced by the whole expression again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def judged_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds lines_ (array of struct line, words, bad), words_ and the base figures n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), words_col(x).alias("words")))
    df = step(docs, lines_=F.transform(split, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), line_fails(x["line"], x["words"]).alias("bad"))))
    df = step(df, words_=F.flatten(F.transform("lines_", lambda x: x["words"])))
    df = step(df, grams_=window_hashes(F.col("words_")))
    full = F.transform(F.filter("lines_", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    df = step(
        df,
        n_words=F.size("words_").cast("long"),
        word_chars=F.length(F.array_join("words_", "")).cast("long"),
        n_symbols=F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=bound(full, lambda c: F.size(c) - F.size(F.array_distinct(c))).cast("long"),
        n_repeat_words=repeated_words(F.col("grams_")),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def clean_lines(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """The input's rows and columns plus cleaned (the text without failing lines), n_lost_words, the base
    figures, base_failed and kept.

    Every line of a text is judged first; failing lines go; then a document is rejected when they held more than
    `most_lost` of its words, or when base_failed. Null and empty texts have no words, fail the base rule and stay
    null or empty. Each row is judged on its own where it is read, without a shuffle, so repeated rows and hot
    sources cost nothing extra. Columns with these names are replaced, others may have any name; an empty table stays empty. A filter on any of the
    results leaves the plan as large as it is."""
    names = ["cleaned", "n_lost_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = docs.drop(*names)
    columns = docs.columns
    own = [f"in{i}_" for i in range(len(columns))]  # so that no column has the name of a working one
    judged = judged_lines(docs.toDF(*own), own[columns.index(text)])
    judged = step(judged, n_lost_words=_sum(F.transform("lines_", lambda x: F.when(x["bad"], F.size(x["words"])).otherwise(0).cast("long"))))
    good = F.array_join(F.transform(F.filter("lines_", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    kept = ~F.col("base_failed") & (F.col("n_lost_words") <= most_lost * F.col("n_words"))
    judged = step(judged, cleaned=F.when(F.col("n_lost_words") > 0, good).otherwise(F.col(own[columns.index(text)])), kept=kept)
    return judged.select(*own, *names).toDF(*columns, *names)
