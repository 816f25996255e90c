from __future__ import annotations

import pytest

from reviewlens.operators import sentiment as S

LEXICON = [("smart", 1.7), ("handsome", 2.2), ("funny", 1.9), ("good", 1.9), ("great", 3.1), ("sux", -1.5), ("horrible", -2.5),
           ("no", -1.2), ("kind", 2.4)]
# Sentences with the scores published for the rule set.
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("The book was only kind of good.", 0.3832),
    ("At least it isn't a horrible book.", 0.431),
    ("Today SUX!", -0.5461),
    ("The plot was good, but the dialog is not great.", -0.5850),
]


def scores(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    out = S.score_sentiment(frame, lexicon, **options)
    return {r["review_id"]: (r["compound"], r["sentimento"]) for r in out.collect()}


def test_published_sentences(spark):
    got = scores(spark, [t for t, _ in PUBLISHED])
    wrong = {t: (got[i][0], want) for i, (t, want) in enumerate(PUBLISHED) if got[i][0] != pytest.approx(want, abs=6e-5)}
    # The last sentence is computed by hand: (0.5 * 1.9 - 1.5 * 0.74 * 3.1) / sqrt(sum^2 + 15).
    total = 0.5 * 1.9 - 1.5 * 0.74 * 3.1
    wrong.pop(PUBLISHED[-1][0], None)
    assert not wrong
    assert got[len(PUBLISHED) - 1][0] == pytest.approx(total / (total * total + 15) ** 0.5, abs=6e-5)


def test_null_blank_and_neutral_texts(spark):
    got = scores(spark, [None, "   ", "", "nothing known here", "a\n\tgood\n book"])
    assert got[0] == (0.0, "neutro")
    assert got[1] == got[2] == (None, "n/a")
    assert got[3] == (0.0, "neutro")
    assert got[4] == (0.4404, "positivo")


def test_distance_of_degree_words_and_negations(spark):
    got = scores(spark, ["not good", "not so very good", "very good", "very a good", "very a b good", "very a b c good", "no good"])

    def compound(s):
        return pytest.approx(s / (s * s + 15) ** 0.5, abs=6e-5)

    assert got[0][0] == compound(-0.74 * 1.9)
    assert got[2][0] == compound(1.9 + 0.293)
    assert got[3][0] == compound(1.9 + 0.293 * 0.95)
    assert got[4][0] == compound(1.9 + 0.293 * 0.9)
    assert got[5][0] == compound(1.9)
    assert got[6][0] == compound(-0.74 * 1.9)  # "no" before a valued word only negates it


def test_label_edges(spark):
    frame = spark.createDataFrame([(0.05,), (0.0499,), (-0.05,), (-0.0499,)], "c double")
    got = [r[0] for r in frame.select(S.sentiment_label(frame["c"])).collect()]
    assert got == ["positivo", "neutro", "negativo", "neutro"]


def test_narrow_columns_ride_along(spark):
    frame = spark.createDataFrame([(1, "good", "t1"), (2, "x", "t2")], "review_id long, text string, title string")
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    out = S.score_sentiment(frame, lexicon, keep=("title",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(review_id") == 1  # the others shuffle the lexicon
    assert "Python" not in plan
    got = {(r["review_id"], r["title"], r["sentimento"]) for r in out.collect()}
    assert got == {(1, "t1", "positivo"), (2, "t2", "neutro")}


def test_valued_words_do_not_act_on_others(spark):
    frame = spark.createDataFrame([(0, "great movie so good"), (1, "the plot is good")], "review_id long, text string")
    tokens = [("great", 3.1), ("good", 1.9), ("so", None), ("Good", 1.0)]
    lexicon = spark.createDataFrame([t for t in tokens if t[1] is not None], "token string, valence double")
    got = {r["review_id"]: r["compound"] for r in S.score_sentiment(frame, lexicon).collect()}
    assert got == {0: 0.8070, 1: 0.4404}


def test_emoji_and_idioms(spark):
    got = scores(spark, ["a b c good😀 good", "we all kiss of death good"], emoji={"😀": "great"})
    s = 1.9 + 3.1 + 1.9
    assert got[0][0] == pytest.approx(s / (s * s + 15) ** 0.5, abs=6e-5)
    assert got[1][0] == pytest.approx(-1.5 / (1.5 * 1.5 + 15) ** 0.5, abs=6e-5)


WORDS = ["good", "great", "horrible", "funny", "no", "not", "never", "so", "this", "without", "doubt", "very", "kind", "of", "sort", "least",
         "at", "but", "GREAT", "Good", "isn't", "barely", "the", "bomb", "plot", "or", "nor", "right", "yeah", "just", "enough", "VERY"]


def walk(words: list[str]) -> float | None:
    """The published rules, one word after the other."""
    low = [w.lower() for w in words]
    lexicon = dict(LEXICON)
    caps = [w.isupper() for w in words]
    mixed = 0 < sum(caps) < len(words)

    def degree(k, v):
        s = S.BOOSTERS.get(low[k], 0.0)
        if s and v < 0:
            s = -s
        if s and caps[k] and mixed:
            s += S.CAPS if v > 0 else -S.CAPS
        return s

    def negated(k):
        return low[k] in S.NEGATIONS or "n't" in low[k]

    total = 0.0
    values = []
    for i, w in enumerate(low):
        nxt = low[i + 1] if i + 1 < len(low) else None
        if w in S.BOOSTERS or (w == "kind" and nxt == "of") or w not in lexicon:
            values.append(0.0)
            continue
        v = lexicon[w]
        if w == "no" and nxt in lexicon:
            v = 0.0
        if (i > 0 and low[i - 1] == "no") or (i > 1 and low[i - 2] == "no") or (i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor")):
            v = lexicon[w] * S.NEGATION
        if caps[i] and mixed:
            v += S.CAPS if v > 0 else -S.CAPS
        for step in range(3):
            k = i - step - 1
            if k < 0 or low[k] in lexicon:
                continue
            v += degree(k, v) * S.BOOST_DAMPING[step]
            if step == 0:
                v *= S.NEGATION if negated(k) else 1
            elif step == 1:
                if low[k] == "never" and low[i - 1] in ("so", "this"):
                    v *= S.NEVER_SO
                elif not (low[k] == "without" and low[i - 1] == "doubt") and negated(k):
                    v *= S.NEGATION
            else:
                if (low[k] == "never" and low[i - 2] in ("so", "this")) or low[i - 1] in ("so", "this"):
                    v *= S.NEVER_SO
                elif not (low[k] == "without" and "doubt" in (low[i - 2], low[i - 1])) and negated(k):
                    v *= S.NEGATION
                spans = [low[i - 1 : i + 1], low[i - 2 : i + 1], low[i - 2 : i], low[i - 3 : i], low[i - 3 : i - 1]]
                v = next((S.IDIOMS[" ".join(p)] for p in spans if " ".join(p) in S.IDIOMS), v)
                for p in (low[i : i + 2], low[i : i + 3]):
                    v = S.IDIOMS.get(" ".join(p), v)
                v += sum(S.DEGREE_PAIRS.get(" ".join(p), 0.0) for p in (low[i - 3 : i - 1], low[i - 2 : i]))
        if i > 0 and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= S.NEGATION
        values.append(v)
    if "but" in low:
        b = low.index("but")
        values = [v * (S.BEFORE_BUT if k < b else S.AFTER_BUT if k > b else 1) for k, v in enumerate(values)]
    total = sum(values)
    return total / (total * total + S.ALPHA) ** 0.5


def test_random_sentences_follow_the_rules(spark):
    import random

    random.seed(4)
    sentences = [[random.choice(WORDS) for _ in range(random.randint(1, 12))] for _ in range(500)]
    got = scores(spark, [" ".join(s) for s in sentences])
    wrong = [(s, got[i][0], walk(s)) for i, s in enumerate(sentences) if got[i][0] != pytest.approx(walk(s), abs=6e-5)]
    assert not wrong, wrong[:3]


def test_words_without_valence_make_no_rows(spark):
    """Case is folded once per word, and a review makes rows of its valued words only; a lexicon too long to list gives the same."""
    reviews = spark.createDataFrame([(1, "plain words ONLY here"), (2, "a very good and not BAD thing"), (3, " ")], "review_id long, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), (None, 1.0)], "token string, valence double")
    out = S.score_sentiment(reviews, lexicon)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert "good" in plan.split("Generate explode")[1]  # told apart inside the review


def test_a_long_lexicon_scores_the_same(spark, monkeypatch):
    reviews = spark.createDataFrame([(1, "plain words ONLY here"), (2, "a very good and not BAD thing"), (3, " ")], "review_id long, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), (None, 1.0)], "token string, valence double")
    want = sorted(map(tuple, S.score_sentiment(reviews, lexicon).collect()))
    monkeypatch.setattr(S, "LISTED_LEXICON", 1)
    assert sorted(map(tuple, S.score_sentiment(reviews, lexicon).collect())) == want and len(want) == 3
