"""Quality rules, DataFrame functions only: base counts and distribution divergence.

A document's character-class histogram and common-word histogram are compared with references
of several languages by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).
The nearest language counts. The references are those of a corpus: the histograms of all its documents that are
labelled good, by language; the common words are the most frequent ones of each language. Words are
compared without case and sentence punctuation. Short texts are guarded: below a minimum length a
histogram is noise, so it has no say. Documents are judged within the row, so nothing is shuffled and
their text is read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: What stands between the words of the histogram.
BETWEEN = r"[\x20\x09-\x0D.,;:!?\"()]+"
#: The character classes, in order.
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
#: Common words of a language.
COMMON = 40
#: Languages with references, those with the most good documents.
LANGUAGES = 64
#: Ids of good documents that are broadcast at most, some 100 MB; with more of them documents are shuffled.
BROADCAST_IDS = 4_000_000


@dataclass(frozen=True)
class DivergenceLimits:
    """A histogram fails a document above its distance from every reference, from its minimum length up.

    ``word_share``: the limit of the common words as a share of the distance at which a text without any
    common word lies from the nearest reference.
    """

    class_distance: float = 0.3
    min_chars: int = 200
    word_share: float = 0.9
    min_words: int = 60


@dataclass(frozen=True)
class References:
    """Shares of the character classes, and of the vocabulary's words among all, by language."""

    languages: tuple[str, ...] = ()
    classes: tuple[tuple[float, ...], ...] = ()
    vocabulary: tuple[str, ...] = ()
    words: tuple[tuple[float, ...], ...] = ()

    def word_limit(self, limits: DivergenceLimits) -> float:
        """The distance above which a histogram of words fails; infinite without references."""
        return min((limits.word_share * without_common_words(sum(w)) for w in self.words), default=math.inf)


def without_common_words(mass: float) -> float:
    """Distance of a text without common words from a reference of which they are a share ``mass``."""
    rest = 1.0 - mass
    return math.sqrt((math.log2(2.0 / (1.0 + rest)) + (rest * math.log2(2.0 * rest / (1.0 + rest)) if rest > 0 else 0.0) + mass) / 2.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def _table(rows: tuple[tuple[float, ...], ...]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def _halves(p: Column, q: Column) -> Column:
    """What a class with shares ``p`` > 0 and ``q`` adds to twice the divergence."""
    return p * F.log2(F.lit(2.0) * p / (p + q)) + F.when(q > 0, q * F.log2(F.lit(2.0) * q / (p + q))).otherwise(F.lit(0.0))


def js_distances(places: Column, shares: Column, references: tuple[tuple[float, ...], ...]) -> Column:
    """Jensen-Shannon distance of a histogram from each reference, as an array.

    The histogram has ``shares``, all above 0 and with sum 1, at ``places`` (from 0) of the references, which have sum 1;
    where it has nothing, a reference adds its own share.
    """

    def distance(reference: Column) -> Column:
        each = F.zip_with(places, shares, lambda k, p: _halves(p, reference[k]) - reference[k])
        return F.sqrt(F.greatest((F.aggregate(each, F.lit(1.0), lambda a, x: a + x)) / F.lit(2.0), F.lit(0.0)))

    return F.transform(_table(references), distance)


def class_distances(counts: Column, total: Column, references: tuple[tuple[float, ...], ...]) -> Column:
    """Distances of class counts, an array, from each reference; null if nothing is counted."""
    here = F.filter(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda k: counts[k] > 0)
    shares = lambda k: F.struct(k.alias("k"), F.transform(k, lambda i: counts[i].cast("double") / total).alias("p"))
    found = let(let(here, shares), lambda h: js_distances(h["k"], h["p"], references))
    return F.when(total > 0, found)


def word_distances(words: Column, vocabulary: tuple[str, ...], references: tuple[tuple[float, ...], ...]) -> Column:
    """Distances of an array of words from each reference, of which all words outside the vocabulary are one class; null without words."""
    lexicon, rest = F.array(*[F.lit(v) for v in vocabulary]), len(vocabulary)
    n = F.size(words)
    none = F.array().cast("array<int>")

    def of_common(s: Column) -> Column:
        # where each run of equal words begins
        starts = F.when(F.size(s) == 0, none).otherwise(
            F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))])))

        def of_starts(b: Column) -> Column:
            others = n - F.size(s)
            more = lambda x: F.when(others > 0, F.array(x)).otherwise(none)
            at = F.concat(F.transform(b, lambda i: F.array_position(lexicon, s[i]).cast("int") - 1), more(F.lit(rest)))
            counts = F.concat(F.transform(b, lambda i, j: F.coalesce(F.get(b, j + 1), F.size(s)) - i), more(others))
            return let(F.struct(at.alias("k"), F.transform(counts, lambda c: c.cast("double") / n).alias("p")),
                       lambda h: js_distances(h["k"], h["p"], tuple((*r, 1.0 - sum(r)) for r in references)))

        return let(starts, of_starts)

    return F.when(n > 0, let(F.sort_array(F.filter(words, lambda w: w.isin(*vocabulary))), of_common))


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the array."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == s[j]["h"])),
            )
            starts = F.sort_array(F.transform(same, lambda j: s[j]["i"]))
            # each window adds the words that the one before it does not cover
            return let(starts, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - p[F.greatest(k - 1, F.lit(0))]))),
                F.lit(0).cast("bigint"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(placed, count))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(hashes, covered))


def folded_words(text: Column) -> Column:
    """The words of a text as the histogram takes them."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def classes_of(whole: Column) -> Column:
    """A struct of the characters of each class.

    What is left without the commonest class is short, and the other classes are counted in it.
    """
    def of_rest(rest: Column) -> Column:
        without = lambda pattern: F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))
        lower, upper, digit, space = (F.length(whole) - F.length(rest)) + without(r"\p{Ll}+"), without(r"\p{Lu}+"), without(r"\p{N}+"), without(SPACES)
        symbol = F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))
        other = F.length(whole) - lower - upper - digit - space - symbol
        return F.struct(*[c.cast("bigint").alias(name) for c, name in zip((lower, upper, digit, space, symbol, other), CLASSES, strict=True)])

    return let(F.regexp_replace(whole, "[a-z]+", ""), of_rest)


def _whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def references(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> References:
    """The references of all documents with a label of 1, by language.

    Null languages and texts without words give none; without good documents there are no references. The
    driver gets COMMON words a language and the counts of those words, at most LANGUAGES * LANGUAGES * COMMON numbers.
    """
    good = written(labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__keyloom_id")).distinct(), "good")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_col).alias("__keyloom_id"), F.col(lang_col).cast("string").alias("lang"), _whole(F.col(text_col)).alias("text")).where("lang is not null and text != ''")
    rows = rows.join(good, "__keyloom_id", "left_semi")
    counts = written(rows.select("lang", F.explode(folded_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    classes = rows.select("lang", classes_of(F.col("text")).alias("c")).groupBy("lang").agg(F.count("*").alias("docs"), *[F.sum(f"c.{c}").alias(c) for c in CLASSES])
    kept = {r["lang"]: [r[c] for c in CLASSES] for r in classes.orderBy(F.col("docs").desc(), "lang").limit(LANGUAGES).collect()}
    totals = {r["lang"]: r["n"] for r in counts.where(F.col("lang").isin(*kept)).groupBy("lang").agg(F.sum("n").alias("n")).collect()} if kept else {}
    languages = sorted(totals)
    if not languages:
        return References()
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    common = counts.where(F.col("lang").isin(*languages)).withColumn("rn", rn).where(F.col("rn") <= COMMON).select("word").distinct()
    vocabulary = sorted(r["word"] for r in common.collect())
    found = {(r["lang"], r["word"]): r["n"] for r in counts.where(F.col("lang").isin(*languages) & F.col("word").isin(*vocabulary)).collect()}
    return References(
        tuple(languages), tuple(tuple(c / sum(kept[x]) for c in kept[x]) for x in languages),
        tuple(vocabulary), tuple(tuple(found.get((x, w), 0) / totals[x] for w in vocabulary) for x in languages))


def measures(text: Column, refs: References) -> Column:
    """One struct of all counts and distances of a text column; a null text counts as empty."""
    whole = _whole(text)
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    none = F.lit(None).cast("array<double>")
    return F.struct(
        let(F.array_remove(F.split(whole, SPACES), ""), lambda words: F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words"))).alias("w"),
        F.length(whole).cast("bigint").alias("n_chars"),
        classes_of(whole).alias("c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        (let(folded_words(whole), lambda words: word_distances(words, refs.vocabulary, refs.words)) if refs.languages else none).alias("by_words"),
    )


#: What ``with_quality`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "class_distances", "word_distances", "kept")


def verdict(text: Column, refs: References, limits: DivergenceLimits = DivergenceLimits()) -> Column:
    """One struct of RESULTS of a text column.

    All of it is one expression with its parts bound by ``let``, so that a filter on a field
    doesn't make the optimizer repeat the measures for each place that they are used in.
    """
    none = F.lit(None).cast("array<double>")
    by_language = lambda d: F.map_from_arrays(F.array(*[F.lit(x) for x in refs.languages]), d) if refs.languages else F.lit(None).cast("map<string,double>")

    def of(m: Column) -> Column:
        n, w, c = m["n_chars"], m["w"], m["c"]
        by_class = class_distances(F.array(*[c[x] for x in CLASSES]), n, refs.classes) if refs.languages else none
        failed = (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])

        def judged(d: Column) -> Column:
            nearest_class, nearest_words = F.array_min(d["c"]), F.array_min(d["w"])
            odd = ((n >= limits.min_chars) & (nearest_class > limits.class_distance)) | ((w["n_words"] >= limits.min_words) & (nearest_words > F.lit(refs.word_limit(limits))))
            columns = (w["n_words"], n - c["space"], c["symbol"], m["n_dup_lines"], w["n_repeat_words"], failed, nearest_class, nearest_words,
                       by_language(d["c"]), by_language(d["w"]), ~failed & ~F.coalesce(odd, F.lit(False)))
            return F.struct(*[x.alias(name) for x, name in zip(columns, RESULTS, strict=True)])

        return let(F.struct(by_class.alias("c"), m["by_words"].alias("w")), judged)

    return let(measures(text, refs), of)


def with_quality(docs: DataFrame, refs: References, text_col: str = "text", limits: DivergenceLimits = DivergenceLimits(), prefix: str = "") -> DataFrame:
    """Add the columns of RESULTS, with ``prefix``, to ``docs``.

    kept is false if base_failed, or if a text of at least ``min_chars`` code points lies over
    ``class_distance`` from every class reference, or one of at least ``min_words`` words over
    the word limit from every word reference. Distances are given of the nearest language and by language. A null
    or empty text has no words and fails. Without references only the base rules judge.
    Very long texts are measured whole. Rows are judged alone: repeated rows get equal
    verdicts, an empty table stays empty. Other columns pass through; give a ``prefix`` where
    their names are taken.
    """
    out = docs.withColumn("__keyloom_v", verdict(F.col(text_col), refs, limits))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col("__keyloom_v")[name].alias(prefix + name) for name in RESULTS])


def keep_good(docs: DataFrame, refs: References, text_col: str = "text", limits: DivergenceLimits = DivergenceLimits()) -> DataFrame:
    """The rows that ``with_quality`` keeps, with the columns of ``docs``."""
    return docs.where(verdict(F.col(text_col), refs, limits)["kept"])
