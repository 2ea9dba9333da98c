"""Quality rules as weak supervision (operator 2).

Every rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (at most 3**rules of them) estimates the rules'
votes on good and on bad documents without labels; a document's quality is
its posterior probability. DataFrame expressions only.

Nulls and empty texts have no words and fail the base rule. Ties and repeated
rows are judged alike, row by row; an empty table gives an empty result; extra
columns of the input are carried through `filter_quality` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "word_length", "upper", "exclaim", "dup_lines", "repeats", "clean_characters", "clean_lines")
#: The prior of EM: documents' worth of pseudo-votes, the share of good documents,
#: and what a rule is taken to do on good and on bad ones: vote bad, abstain, vote good.
PSEUDO, PRIOR, ROUNDS = 20.0, 0.85, 25
ON_GOOD, ON_BAD = (0.02, 0.38, 0.6), (0.3, 0.5, 0.2)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for all the uses in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        by_text = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = let(
            by_text,
            lambda s: F.sort_array(
                F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x.i.alias("i"), (x.w.eqNullSafe(F.get(s, j - 1).w) | x.w.eqNullSafe(F.get(s, j + 1).w)).alias("r"))), lambda x: x.r), lambda x: x.i)
            ),
        )
        spans = let(twice, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(spans)

    return let(
        words,
        lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(
            let(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))), covered)
        ),
    )


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The base counts of every whole text, and the two further ones that rules read."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = words_of(t)
    return docs.select(
        *[docs[c] for c in keep],
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("r"))).alias("_w"),
        F.length(F.translate(t, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_exclaim"),
    ).select(*keep, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"), "n_upper", "n_exclaim")


def votes() -> Column:
    """The rules' votes, in the order of RULES; integer arithmetic, so exact anywhere."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def bad(when: Column) -> Column:
        return F.when((n > 0) & when, -1).otherwise(0)

    def good(when: Column) -> Column:
        return F.when((n > 0) & when, 1).otherwise(0)

    return F.array(
        bad(5 * F.col("n_symbols") > n),
        bad((chars < 2 * n) | (chars > 14 * n)),
        bad(2 * F.col("n_upper") > chars),
        bad(4 * F.col("n_exclaim") > n),
        bad(20 * F.col("n_dup_lines") > n),
        bad(4 * F.col("n_repeat_words") > n),
        good((50 * F.col("n_symbols") < n) & (5 * F.col("n_upper") < chars) & (50 * F.col("n_exclaim") < n)),
        good((F.col("n_dup_lines") == 0) & (10 * F.col("n_repeat_words") < n)),
    )


def pattern_counts(voted: DataFrame) -> DataFrame:
    """At most 3**rules rows: how many documents vote alike."""
    return voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))


def accuracies(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: the share of good documents, and each rule's chances to vote bad,
    abstain or vote good on good and on bad documents (three entries a rule).

    EM runs inside one expression over the counted patterns; with no documents
    the row holds the prior.
    """
    pats = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").alias("n")))).alias("pats"))
    r = len(RULES)
    likely = "aggregate(transform(p.v, (v, j) -> s.{side}[3 * j + v + 1]), 1D, (x, y) -> x * y)"
    scored = f"transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'g', s.prior * {likely.format(side='good')}, 'b', (1D - s.prior) * {likely.format(side='bad')}))"
    share = f"transform({scored}, p -> named_struct('v', p.v, 'g', p.n * p.g / (p.g + p.b), 'b', p.n * p.b / (p.g + p.b)))"

    def total(what: str) -> str:
        return f"aggregate(e, 0D, (x, p) -> x + {what})"

    def fitted(side: str, before: tuple[float, ...]) -> str:
        seen = total(f"IF(p.v[CAST(floor(k / 3) AS INT)] = k % 3 - 1, p.{side}, 0D)")
        return f"transform(sequence(0, {3 * r - 1}), k -> ({seen} + {PSEUDO}D * array({', '.join(f'{x}D' for x in before)})[k % 3]) / ({total(f'p.{side}')} + {PSEUDO}D))"

    prior = f"({total('p.g')} + {PSEUDO * PRIOR}D) / ({total('p.g + p.b')} + {PSEUDO}D)"
    step = f"transform(array({share}), e -> named_struct('prior', {prior}, 'good', {fitted('g', ON_GOOD)}, 'bad', {fitted('b', ON_BAD)}))[0]"
    first = [f"flatten(array_repeat(array({', '.join(f'{x}D' for x in side)}), {r}))" for side in (ON_GOOD, ON_BAD)]
    start = f"named_struct('prior', {PRIOR}D, 'good', {first[0]}, 'bad', {first[1]})"
    return pats.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("m")).select("m.*")


def posterior(model) -> Column:
    """P(good | votes) under the row that `accuracies` gives."""
    sides = []
    for prior, chances in ((model.prior, model.good), (1 - model.prior, model.bad)):
        p = F.lit(float(prior))
        for j in range(len(RULES)):
            v = F.get(F.col("votes"), F.lit(j))
            p *= F.when(v == -1, float(chances[3 * j])).when(v == 1, float(chances[3 * j + 2])).otherwise(float(chances[3 * j + 1]))
        sides.append(p)
    return sides[0] / (sides[0] + sides[1])


def judged(feats: DataFrame) -> DataFrame:
    """Adds votes, base_failed, p_good and kept to a table of features (computed once)."""
    voted = cut(feats.withColumn("votes", votes()))
    model = accuracies(pattern_counts(voted)).first()  # one row of a fixed width
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("p_good", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, the votes and the verdict."""
    return judged(features(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    One pass counts and votes and stores that beside the rows that the base rule
    lets through; the accuracies are learnt from the votes of all rows, and the
    stored rows are filtered by them. No text is shuffled.
    """
    wide = features(docs.withColumn("__ns_row", F.struct(*docs.columns)), keep=("__ns_row",)).withColumn("votes", votes())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = cut(wide.select(F.when(~failed, F.col("__ns_row")).alias("__ns_row"), "votes", failed.alias("base_failed")))
    model = accuracies(pattern_counts(voted)).first()
    return voted.filter(~F.col("base_failed") & (posterior(model) >= 0.5)).select("__ns_row.*")
