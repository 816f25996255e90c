"""Lexicon-and-rule polarity (Hutto & Gilbert, 2014) as joins and aggregation, and the reports on its labels.

The valence lexicon is a table ``(token, valence)`` given by the caller. Each valued word travels with the three words
before it and the two after it, meets the broadcast lexicon where it is read, and is summed per review on the map side:
one narrow row per review is all that is shuffled, and texts never are. Words without a valence only count as neighbours:
of a lexicon of usual size they leave the review before any row is made of them, of a larger one at the first join. Tokens of the lexicon are matched as given against
lower-cased words; a word before a valued one acts on it only if it is not valued itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions.numeric import count_where, percent, rounded
from reviewlens.operators.quantiles import quantile_columns
from reviewlens.plans.metrics import NEGATIVE, NEUTRAL, NOT_SCORED, POSITIVE, VALID_LABELS
from reviewlens.session import cut_lineage

# Published constants of the rule set.
ALPHA = 15.0
NEGATION = -0.74
CAPS = 0.733
BOOST = 0.293
BOOST_DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = 1.25
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
LABEL_CUT = 0.05
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Published degree words, degree word pairs and negations.
INTENSIFIERS = """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous
enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking
fricking frickin frigging friggin fully greatly hella highly hugely incredible incredibly intensely major majorly more
most particularly purely quite really remarkably so substantially thoroughly total totally tremendous tremendously uber
unbelievably unusually utter utterly very""".split()
DAMPENERS = """almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly
scarce scarcely slight slightly somewhat sorta sortof sort-of""".split()
BOOSTERS = {**{w: BOOST for w in INTENSIFIERS}, **{w: -BOOST for w in DAMPENERS}}
DEGREE_PAIRS = {"kind of": -BOOST, "sort of": -BOOST, "just enough": -BOOST}
NEGATIONS = """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont
hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never
none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't
weren't without wont wouldnt won't wouldn't rarely seldom despite""".split()

# Published phrases whose valence replaces that of their words.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}

MAX_LEXICON = 1_000_000  # rows; a larger lexicon is joined without the broadcast hint
LISTED_LEXICON = 10_000  # tokens that words are compared with inside their review
VALENCE_UNITS = 1_000_000_000  # valences are summed as whole billionths: exact and order-free


def sentiment_label(compound: Column) -> Column:
    return F.when(compound >= LABEL_CUT, POSITIVE).when(compound <= -LABEL_CUT, NEGATIVE).otherwise(NEUTRAL)


def _is_upper(word: Column, lower: Column) -> Column:
    return (word != lower) & (word == F.upper(word))  # most words fail the first test


def _words(body: Column) -> Column:
    """Whitespace tokens; punctuation is cut from both ends of words that keep more than two characters."""

    tokens = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    pairs = F.transform(tokens, lambda w: F.struct(w.alias("token"), F.btrim(w, F.lit(PUNCTUATION)).alias("cut")))
    return F.transform(pairs, lambda p: F.when(F.length(p["cut"]) > 2, p["cut"]).otherwise(p["token"]))


def _spelled_out(body: Column, emoji: dict[str, str]) -> Column:
    """Signs replaced by their words, set off from a character before them."""
    for sign, words in emoji.items():
        body = F.regexp_replace(body, r"(?<=[^ ])\Q" + sign + r"\E", " " + words)
        body = F.replace(body, F.lit(sign), F.lit(words))
    return body


def _emphasis(body: Column) -> Column:
    def occurrences(mark: str) -> Column:
        return F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))

    questions = occurrences("?")
    return F.least(occurrences("!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + F.when(
        questions > 1, F.when(questions <= 3, questions * QUESTION).otherwise(MANY_QUESTIONS)
    ).otherwise(0.0)


def _one_of(word: Column, listed: list[Column]) -> Column:
    return word.isin(*listed) if listed else F.lit(False)


def _signed(valence: Column, amount: Column) -> Column:
    return F.when(valence > 0, amount).otherwise(-amount)


def score_sentiment(
    reviews: DataFrame,
    lexicon: DataFrame,
    id_column: str = "review_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    boosters: dict[str, float] = BOOSTERS,
    negations: list[str] = NEGATIONS,
    idioms: dict[str, float] = IDIOMS,
    emoji: dict[str, str] | None = None,
) -> DataFrame:
    """``(id, *keep, compound, sentimento)`` per review.

    ``idioms`` are phrases of up to three words that end at or begin with a valued word. ``emoji`` maps signs to the words
    that stand for them when the text is scored. A token listed twice in the lexicon has its highest valence.

    ``keep`` names narrow columns that ride along, so that reports need no join back. A NULL text is read as the
    word ``nan`` and scores as text; a blank text is ``n/a`` without polarity.
    """
    carried = [id_column, *keep]
    small = lexicon.limit(MAX_LEXICON + 1).count() <= MAX_LEXICON

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # Degree words and negations that are valence words themselves only act as valence words.
    listed = {*boosters, *negations}
    valued = {r["token"] for r in lexicon.where(F.col("token").isin(sorted(listed))).select("token").collect()}
    boost_words = {w: v for w, v in boosters.items() if w not in valued}
    boost_table = F.create_map(*[F.lit(x) for pair in boost_words.items() for x in pair])
    boost_at = [F.lit(w) for w in boost_words]
    negate_at = [F.lit(w) for w in negations if w not in valued]

    words, lowers = F.col("words"), F.col("lowers")
    tokens = lexicon.select("token").where("token IS NOT NULL").distinct().limit(LISTED_LEXICON + 1).collect()
    known = [F.lit(r["token"]) for r in tokens] if len(tokens) <= LISTED_LEXICON else None
    places = F.transform(lowers, lambda w, i: i if known is None else F.when(_one_of(w, known), i))
    context = F.transform(
        F.filter(places, lambda i: i.isNotNull()),
        lambda i: F.struct(
            (i + 1).alias("at"),
            F.get(lowers, i).alias("token"),
            F.get("capitals", i).alias("caps"),
            *[F.get(words, i - k).alias(f"w{k}") for k in (1, 2, 3)],
            *[F.get(lowers, i - k).alias(f"l{k}") for k in (1, 2, 3)],
            F.get(lowers, i + 1).alias("next_token"),
            F.get(lowers, i + 2).alias("after_next"),
        ),
    )
    rows = (
        reviews.select(*carried, F.trim(_spelled_out(F.coalesce(F.col(text), F.lit("nan")), emoji or {})).alias("body"))
        .withColumn("words", _words(F.col("body")))
        .withColumn("lowers", F.transform("words", F.lower))  # folding case costs most of a word's time: done once
        .withColumn("capitals", F.zip_with("words", "lowers", _is_upper))
        .select(
            *carried,
            (F.size("words") > 0).alias("readable"),
            (F.array_contains("capitals", True) & F.array_contains("capitals", False)).alias("mixed_caps"),
            F.array_position(lowers, "but").alias("but_at"),
            _emphasis(F.col("body")).alias("emphasis"),
            context.alias("context"),
        )
        # The per-review facts are complete before this line, so no exploded row drags its review's words along.
        .select(*carried, "readable", "mixed_caps", "but_at", "emphasis", F.explode_outer("context").alias("x"))
        .select(*carried, "readable", "mixed_caps", "but_at", "emphasis", "x.*")
    )
    values = lexicon.groupBy("token").agg(F.max(F.col("valence").cast("double")).alias("valence"))
    hits = rows.join(sized(values), "token", "left").where(F.col("valence").isNotNull() | (F.coalesce("at", F.lit(1)) == 1))
    # What is left are valued words and, so that no review is lost, first words. Words around valued ones are looked up too.
    for name, word in {"next": F.col("next_token"), "w1": F.col("l1"), "w2": F.col("l2"), "w3": F.col("l3")}.items():
        flags = values.select(F.col("token").alias(f"{name}_key"), F.lit(True).alias(f"{name}_valued"))
        hits = hits.withColumn(f"{name}_key", F.when(F.col("valence").isNotNull(), word)).join(sized(flags), f"{name}_key", "left")

    def plain(place: int) -> Column:
        """There is a word at that distance, and it is not valued."""
        return F.col(f"w{place}").isNotNull() & F.col(f"w{place}_valued").isNull()


    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    so_this = ["so", "this"]
    silent = F.col("token").isin(list(boosters)) | ((F.col("token") == "kind") & (F.col("next_token") == "of"))
    after_no = (l1 == "no") | (l2 == "no") | ((l3 == "no") & l1.isin("or", "nor"))

    def negated(word: Column) -> Column:
        return _one_of(word, negate_at) | word.contains("n't")

    def boosted(valence: Column, raw: Column, word: Column, step: int) -> Column:
        amount = F.when(_one_of(word, boost_at), F.element_at(boost_table, word))
        shift = F.when(valence < 0, -amount).otherwise(amount) + F.when(
            _is_upper(raw, word) & F.col("mixed_caps"), _signed(valence, F.lit(CAPS))
        ).otherwise(0.0)
        return valence + F.coalesce(shift, F.lit(0.0)) * BOOST_DAMPING[step]

    def pair_degree(first: Column, second: Column) -> Column:
        pair = F.concat(first, F.lit(" "), second)
        return F.coalesce(*[F.when(pair == words, F.lit(d)) for words, d in DEGREE_PAIRS.items()], F.lit(0.0))

    def phrase(*parts: Column) -> Column:
        return F.element_at(idiom_table, F.concat_ws(" ", *parts)) if idioms else F.lit(None)

    idiom_table = F.create_map(*[F.lit(x) for pair in idioms.items() for x in pair])
    here, ahead, further = F.col("token"), F.col("next_token"), F.col("after_next")
    behind = [(l1, here), (l2, l1, here), (l2, l1), (l3, l2, l1), (l3, l2)]
    forward = [F.when(further.isNotNull(), phrase(here, ahead, further)), F.when(ahead.isNotNull(), phrase(here, ahead))]

    v = F.col("v")
    scored = (
        hits.withColumn(
            "v",
            F.when(F.col("valence").isNull() | silent, None)
            .when(after_no, F.col("valence") * NEGATION)
            .when((F.col("token") == "no") & F.coalesce("next_valued", F.lit(False)), 0.0)
            .otherwise(F.col("valence")),
        )
        .withColumn("v", F.when(F.col("caps") & F.col("mixed_caps"), v + _signed(v, F.lit(CAPS))).otherwise(v))
        .withColumn("v", boosted(v, F.col("w1"), l1, 0))
        .withColumn("v", F.when(plain(1) & negated(l1), v * NEGATION).otherwise(v))
        .withColumn("v", boosted(v, F.col("w2"), l2, 1))
        .withColumn(
            "v",
            F.when(~plain(2), v)
            .when((l2 == "never") & l1.isin(so_this), v * NEVER_SO)
            .when((l2 == "without") & (l1 == "doubt"), v)
            .when(negated(l2), v * NEGATION)
            .otherwise(v),
        )
        .withColumn("v", boosted(v, F.col("w3"), l3, 2))
        .withColumn(
            "v",
            F.when(~plain(3), v)
            .when(((l3 == "never") & l2.isin(so_this)) | l1.isin(so_this), v * NEVER_SO)
            .when((l3 == "without") & ((l2 == "doubt") | (l1 == "doubt")), v)
            .when(negated(l3), v * NEGATION)
            .otherwise(v),
        )
        .withColumn("v", F.when(plain(3) & v.isNotNull(), F.coalesce(*forward, *[phrase(*p) for p in behind], v)).otherwise(v))
        .withColumn("v", F.when(plain(3), v + pair_degree(l3, l2) + pair_degree(l2, l1)).otherwise(v))
        .withColumn("v", F.when(plain(1) & (l1 == "least") & ~F.coalesce(l2.isin("at", "very"), F.lit(False)), v * NEGATION).otherwise(v))
        .withColumn(
            "v",
            F.when((F.col("but_at") > 0) & (F.col("at") < F.col("but_at")), v * BEFORE_BUT)
            .when((F.col("but_at") > 0) & (F.col("at") > F.col("but_at")), v * AFTER_BUT)
            .otherwise(v),
        )
    )
    totals = scored.groupBy(*carried).agg(
        (F.coalesce(F.sum(F.round(v * VALENCE_UNITS).cast("long")), F.lit(0)) / float(VALENCE_UNITS)).alias("sum_v"),
        F.max("emphasis").alias("emphasis"),
        F.max("readable").alias("readable"),
    )
    s = F.col("sum_v")
    total = F.when(s > 0, s + F.col("emphasis")).when(s < 0, s - F.col("emphasis")).otherwise(0.0)
    compound = F.when(F.col("readable"), rounded(total / F.sqrt(total * total + ALPHA), 4))
    return totals.select(*carried, compound.alias("compound")).withColumn(
        "sentimento",
        F.when(F.col("compound").isNull(), NOT_SCORED).otherwise(sentiment_label(F.col("compound"))),
    )


# Reports ---------------------------------------------------------------------------------------------------


def rating_correlation(reviews: DataFrame) -> DataFrame:
    """Pearson correlation of rating and polarity over the reviews with a valid label."""
    valid = reviews.where(F.col("sentimento").isin(VALID_LABELS))
    return valid.agg(F.corr(F.col("score").cast("double"), F.col("compound").cast("double")).alias("correlation"))


def rating_by_label(reviews: DataFrame) -> DataFrame:
    """Counts per rating, one column per valid label."""
    label = F.col("sentimento")
    return (
        reviews.where(label.isin(VALID_LABELS) & F.col("score").isNotNull())
        .groupBy("score")
        .agg(*[count_where(label == name).alias(name) for name in VALID_LABELS])
        .orderBy("score")
    )


def rating_by_label_percent(reviews: DataFrame) -> DataFrame:
    total = sum((F.col(n) for n in VALID_LABELS), F.lit(0))
    return rating_by_label(reviews).select(
        "score", *[rounded(percent(F.col(n), total), 1).alias(n) for n in VALID_LABELS]
    )


def label_distribution(reviews: DataFrame) -> DataFrame:
    """Labels with their share of all rows."""
    counted = reviews.groupBy("sentimento").agg(F.count(F.lit(1)).alias("quantidade"))
    total = F.sum("quantidade").over(Window.partitionBy())  # a handful of counted labels, the NULL one included
    return (
        counted.withColumn("percentual", rounded(percent(F.col("quantidade"), total), 1))
        .where(F.col("sentimento").isNotNull())
        .orderBy(F.desc("quantidade"), "sentimento")
    )


def scoring_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows given, rows returned, rows labelled, and mean, median and deviation of the polarity."""
    given = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = F.col("compound").cast("double")
    after = cut_lineage(after.select("sentimento", "compound"))  # scores are not worked out again for the median
    (median,) = quantile_columns(after, c, [0.5])
    return after.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count("sentimento").alias("rows_scored"),
        rounded(F.avg(c), 3).alias("compound_mean"),
        rounded(median, 3).alias("compound_median"),
        rounded(F.stddev_samp(c), 3).alias("compound_std"),
    ).select(given.alias("rows_in"), "*")
