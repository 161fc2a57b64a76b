"""Quality rules by weak supervision: rules vote or abstain, EM finds how far to trust each, a posterior decides.

Every rule votes good (1), bad (-1) or abstains (0). A rule that votes is right with one accuracy on good documents and
another on bad ones, independent of the other rules given the class: most rules see one kind of junk, so their bad
votes say much and their good votes little. EM runs on the table of vote patterns with their counts, which
has at most 3 ** len(RULES) rows whatever the size of the corpus; an iteration is one aggregate over that table, and the
driver holds its single row of sums. All documents count. The posterior of a document is then a plain column
expression. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, table
from tidemill.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters",
            "n_upper", "n_bare", "n_noise", "n_common")
MIN_WORDS, REPEAT_PERCENT = 50, 50
ROUNDS, TOLERANCE = 60, 1e-6
PRIOR_VOTES, ON_GOOD, ON_BAD, SHARE_GOOD = 20.0, 0.97, 0.5, 0.9
#: A document goes when the votes make it nine times as likely bad as good: what is thrown away does not come back.
KEEP = 0.1

#: Frequent short words of English, German, French and Spanish, which running text cannot do without.
COMMON = """the of and to in that is for on with der die und den das von zu mit des im de la le les et un une que en
    el los las del por se y""".split()

#: name: (measure, divisor, bad below, good from, good up to, bad above); None: no such bound. Between them: abstain.
RULES = {
    "length": ("n_words", None, 50, 100, None, None),
    "word_length": ("word_chars", "n_words", 2.5, 3.0, 10.0, 12.0),
    "symbols": ("n_symbols", "n_words", None, None, 0.02, 0.1),
    "repeated_lines": ("n_dup_lines", "n_lines", None, None, 0.1, 0.3),
    "repeated_words": ("n_repeat_words", "n_words", None, None, 0.15, 0.3),
    "line_ends": ("n_ended", "n_lines", 0.12, 0.5, None, None),
    "letters": ("n_letters", "word_chars", 0.7, 0.85, None, None),
    "capitals": ("n_upper", "n_letters", None, None, 0.15, 0.4),
    "bare_words": ("n_bare", "n_words", None, None, 0.1, 0.3),
    "noise": ("n_noise", "n_words", None, None, 0.05, 0.2),
    "common_words": ("n_common", "n_words", 0.04, 0.1, None, None),
}


def with_features(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``docs`` with the FEATURES of ``text`` under ``names``; null counts as empty."""
    taken = [*docs.columns, *names.values()]
    text, words, lines, bits, sorted_, pairs = (fresh(x, taken) for x in (
        "t", "words", "lines", "bits", "windows", "pairs"))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def col(name):
        return F.col(f"`{name}`")

    def window(i: Column) -> Column:
        return F.concat_ws(" ", *(F.get(col(words), i + k) for k in range(3)))

    base = docs.select(*own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    base = base.select(
        "*", F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)).alias(words),
        F.filter(F.split(col(text), "\n"), lambda x: x.rlike(WORD)).alias(lines))
    n = F.coalesce(F.size(col(words)), F.lit(0))
    base = base.withColumn(bits, F.coalesce(F.length(F.bin(n)), F.lit(1)))

    # Three-word windows: hash in the upper bits, place in the lower, sorted so that equal windows are neighbours.
    hashed = F.transform(col(words), lambda x, i: F.call_function("shiftleft", F.xxhash64(
        x, F.get(col(words), i + 1), F.get(col(words), i + 2)), col(bits)).bitwiseOR(i.cast("long")))
    base = base.withColumn(sorted_, F.sort_array(F.slice(hashed, F.lit(1), F.greatest(n - 2, F.lit(0)))))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), col(bits)) - 1

    def neighbours(a: Column, b: Column) -> Column:
        same = F.call_function("shiftright", a, col(bits)) == F.call_function("shiftright", b, col(bits))
        return F.when(same, F.struct(a.bitwiseAND(place).cast("int").alias("i"), b.bitwiseAND(place).cast("int").alias("j")))

    found = F.filter(F.zip_with(col(sorted_), F.slice(col(sorted_), F.lit(2), F.greatest(n - 3, F.lit(0))), neighbours),
                     lambda x: x.isNotNull())
    base = base.withColumn(pairs, found)
    # The hash is cut short to make room for the place; where two windows of one hash differ, sort the windows themselves.
    by_words = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    exact = F.filter(F.zip_with(by_words, F.slice(by_words, F.lit(2), F.greatest(n - 3, F.lit(0))), lambda a, b: F.when(
        a["w"] == b["w"], F.struct(a["i"].alias("i"), b["i"].alias("j")))), lambda x: x.isNotNull())
    right = F.forall(col(pairs), lambda x: window(x["i"]) == window(x["j"]))
    base = base.withColumn(pairs, F.when(right, col(pairs)).otherwise(exact))
    firsts = F.array_union(col(pairs)["i"], col(pairs)["j"])
    covered = F.array_distinct(F.flatten(F.transform(firsts, lambda x: F.array(x, x + 1, x + 2))))
    squeezed = F.array_join(col(words), "")
    values = {
        "n_words": n,
        "word_chars": F.length(squeezed),
        "n_symbols": F.length(F.regexp_replace(squeezed, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size(col(lines)) - F.size(F.array_distinct(col(lines))),
        "n_repeat_words": F.when(F.size(col(pairs)) == 0, 0).otherwise(F.size(covered)),
        "n_lines": F.size(col(lines)),
        "n_ended": F.size(F.filter(col(lines), lambda x: x.rlike(r"[.!?:;\"'”…)][\x20\x09-\x0D]*\z"))),
        "n_letters": F.length(F.regexp_replace(squeezed, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(squeezed, r"\P{Lu}+", "")),
        # Words without a letter, and runs of signs.
        "n_bare": F.regexp_count(col(text), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")),
        "n_common": F.regexp_count(col(text), F.lit(rf"(?i)(?<!\p{{L}})(?:{'|'.join(COMMON)})(?!\p{{L}})")),
        "n_noise": F.regexp_count(col(text), F.lit(r"[^\x20\x09-\x0D\p{L}\p{N}]{2,}+")),
    }
    # As output of a generator the features are taken once per row: filters on them are not moved below it, where each
    # use would be worked out anew.
    return base.select(*own, F.inline(F.array(F.struct(
        *(F.coalesce(values[f], F.lit(0)).cast("long").alias(names[f]) for f in FEATURES)))))


def votes(feature: dict[str, Column]) -> dict[str, Column]:
    """Each rule's vote; a rule abstains where its divisor is 0."""
    out = {}
    for name, (measure, divisor, low_bad, low_good, high_good, high_bad) in RULES.items():
        x = feature[measure].cast("double")
        if divisor:
            x = F.when(feature[divisor] > 0, x / feature[divisor])
        bad, good = F.lit(False), F.lit(True)
        bad = bad | (x < low_bad) if low_bad is not None else bad
        bad = bad | (x > high_bad) if high_bad is not None else bad
        good = good & (x >= low_good) if low_good is not None else good
        good = good & (x <= high_good) if high_good is not None else good
        out[name] = F.when(x.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")
    return out


@dataclass(frozen=True)
class Model:
    """Share of good documents, and each rule's accuracy on good and on bad ones."""

    good: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self, vote: dict[str, Column]) -> Column:
        """P(good | votes)."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, v in vote.items():
            a, b = self.on_good[name], self.on_bad[name]
            odds = odds + F.when(v > 0, math.log(a / (1 - b))).when(v < 0, math.log((1 - a) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def start_model() -> Model:
    return Model(SHARE_GOOD, dict.fromkeys(RULES, ON_GOOD), dict.fromkeys(RULES, ON_BAD))


def fit(patterns: DataFrame) -> Model:
    """EM on ``patterns``: a column for each rule's vote, and the count ``n`` of documents with those votes.

    Accuracies start at ``ON_GOOD`` and ``ON_BAD`` and are drawn there with the weight of ``PRIOR_VOTES`` votes. A rule is
    right on good documents more often than it is wrong on bad ones, so no rule can turn round. No documents, or none
    with a vote, leave the start values.
    """
    model = start_model()
    vote = {name: F.col(name) for name in RULES}
    for _ in range(ROUNDS):
        good, bad = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = patterns.withColumn("q", model.posterior(vote)).agg(
            F.sum("n").alias("n"), F.sum(good).alias("good"),
            *(F.sum(F.when(v > 0, good)).alias(f"gg_{r}") for r, v in vote.items()),
            *(F.sum(F.when(v < 0, good)).alias(f"gb_{r}") for r, v in vote.items()),
            *(F.sum(F.when(v > 0, bad)).alias(f"bg_{r}") for r, v in vote.items()),
            *(F.sum(F.when(v < 0, bad)).alias(f"bb_{r}") for r, v in vote.items())).first()
        if not sums["n"]:
            return model
        after = updated(sums.asDict())
        moved = max(abs(after.good - model.good), *(abs(x[r] - y[r]) for r in RULES for x, y in (
            (after.on_good, model.on_good), (after.on_bad, model.on_bad))))
        model = after
        if moved < TOLERANCE:
            break
    return model


def updated(sums: dict[str, float]) -> Model:
    """The model of one M-step from the expected counts."""
    def accuracy(right: str, wrong: str, prior: float, low: float, high: float) -> float:
        a, b = sums[right] or 0.0, sums[wrong] or 0.0
        return min(high, max(low, (a + PRIOR_VOTES * prior) / (a + b + PRIOR_VOTES)))

    on_good = {r: accuracy(f"gg_{r}", f"gb_{r}", ON_GOOD, 0.8, 0.9999) for r in RULES}
    on_bad = {r: accuracy(f"bb_{r}", f"bg_{r}", ON_BAD, 1.25 * (1 - on_good[r]), 0.99) for r in RULES}
    return Model(min(0.98, max(0.02, sums["good"] / sums["n"])), on_good, on_bad)


def patterns_of(rows: DataFrame, feature: dict[str, Column]) -> DataFrame:
    """Vote patterns with their counts, as a small table of one file: counted by many tasks, then put together."""
    counted = rows.select(*(v.alias(r) for r, v in votes(feature).items())).groupBy(*RULES).agg(F.count("*").alias("n"))
    return cut_lineage(cut_lineage(counted, "counted").coalesce(1), "patterns")


def _names(docs: DataFrame) -> dict[str, str]:
    return {f: fresh(f, docs.columns) for f in FEATURES}


def _base_failed(feature: dict[str, Column]) -> Column:
    return (feature["n_words"] < MIN_WORDS) | (100 * feature["n_repeat_words"] > REPEAT_PERCENT * feature["n_words"])


def judge(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, with FEATURES, ``base_failed``, ``posterior`` and ``kept``.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; an empty table gives an
    empty result. A column of ``docs`` with the name of a result gives way to it. The text is read once: the features
    are written to the shared folder before EM.
    """
    docs = docs.drop(*FEATURES, "base_failed", "posterior", "kept")
    rows = cut_lineage(with_features(docs, _names(docs)).drop("text"), "features")
    feature = {f: F.col(f) for f in FEATURES}
    model = fit(patterns_of(rows, feature))
    return rows.withColumn("base_failed", _base_failed(feature)) \
        .withColumn("posterior", model.posterior(votes(feature))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows. Reads the texts twice, as keeping them between would cost a copy of the corpus."""
    names = _names(docs)
    feature = {f: F.col(f"`{c}`") for f, c in names.items()}
    rows = with_features(docs, names)
    model = fit(patterns_of(rows, feature))
    return rows.filter(~_base_failed(feature) & (model.posterior(votes(feature)) >= KEEP)) \
        .select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base features, ``base_failed``, and ``kept``: neither failed nor judged bad by the rules."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept")
