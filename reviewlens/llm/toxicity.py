"""Toxic spans by a linear-chain conditional random field over the words of a sentence.

Labels say which documents are toxic, not which words. Token labels come first: features (words and their beginnings)
that hardly occur in clean documents, and in more toxic ones than chance explains, are telling; a word of a toxic
document with a telling feature is labelled toxic. Near copies in the sample count once, or every word of a copied
document would look toxic. The field then learns weights of words, beginnings and endings, and
of the transitions. Forward and backward messages of two states are one log-ratio each, so all sentences of a batch
advance together. A document's score is a logistic function of its highest marginal, the sum of its marginals and their share of its words;
the spans are runs of words that are toxic with a probability of at least a half.

Nulls and ties: a null text is empty and has the lowest score; rows without label or text are not learnt from; of several
labels for an id the highest counts; repeated rows are scored alike. With no toxic or no clean row to learn from every score
is 0; an empty table gives an empty result. Extra columns are not read. Whole texts are scored; only the sample for learning leaves out very long ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SAMPLE = {1: 1200, 0: 2000}  # rows learnt from per label
SAMPLE_CHARS = 50_000  # longer texts are not learnt from
PRECISION = 0.85  # share of toxic ones among the sampled documents with a telling feature
LEVEL = 0.5  # misleading features expected among all of a frequency
ITERATIONS, RATE, DECAY = 60, 0.5, 1e-5
PLAIN = 4  # one in so many sentences without a telling word is learnt from
CACHE = 1 << 18  # words a task remembers
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """The word, its beginnings of three to six letters and its last three."""
    return ["w " + word, *[f"b {word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n], "e " + word[-3:]]


@dataclass
class Field:
    """Log-potentials relative to state 0: emissions by feature, a start, transitions [from][to]; and the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: tuple[float, ...] = ()

    def emission(self, names: list[str]) -> float:
        return self.bias + sum(self.weights.get(n, 0.0) for n in names)


# ---- messages -------------------------------------------------------------------------------------------------------


def _turns(starts: np.ndarray, lengths: np.ndarray):
    """For t = 0, 1, ... the places of the t-th token of every sentence that has one; sentences longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = len(starts)
    for t in range(int(lengths[0]) if alive else 0):
        while lengths[alive - 1] <= t:
            alive -= 1
        yield starts[:alive] + t


def messages(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: float, moves: np.ndarray):
    """(forward, backward) log-ratios of state 1 to state 0 at every token."""
    f, b = np.zeros(len(e)), np.zeros(len(e))
    places = list(_turns(starts, lengths))
    for t, at in enumerate(places):
        if t == 0:
            f[at] = e[at] + start
        else:
            was = f[at - 1]
            f[at] = e[at] + np.logaddexp(moves[0, 1], was + moves[1, 1]) - np.logaddexp(moves[0, 0], was + moves[1, 0])
    for at in reversed(places[1:]):
        comes = e[at] + b[at]
        b[at - 1] = np.logaddexp(moves[1, 0], moves[1, 1] + comes) - np.logaddexp(moves[0, 0], moves[0, 1] + comes)
    return f, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(e, starts, lengths, start, moves) -> np.ndarray:
    f, b = messages(e, starts, lengths, start, moves)
    return sigmoid(f + b)


def pair_counts(e, f, b, starts, lengths, moves) -> np.ndarray:
    """Expected transitions, 2 x 2."""
    first = np.zeros(len(e), bool)
    first[starts[lengths > 0]] = True
    at = np.flatnonzero(~first)
    comes, was = e[at] + b[at], f[at - 1]
    logits = np.stack([np.full(len(at), moves[0, 0]), moves[0, 1] + comes, was + moves[1, 0], was + moves[1, 1] + comes])
    p = np.exp(logits - logits.max(0))
    return (p / p.sum(0)).sum(1).reshape(2, 2)


# ---- learning -------------------------------------------------------------------------------------------------------


def sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for token in TOKEN.findall(text.lower()):
        if token in STOPS:
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def without_copies(docs: list[list[list[str]]]) -> list[list[list[str]]]:
    """Leaves out documents that share two of eight least word triples with one before."""
    import xxhash

    seen: set[tuple[int, int]] = set()
    kept = []
    for doc in docs:
        words = [w for s in doc for w in s]
        triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        least = {(k, min(xxhash.xxh64_intdigest(t, k) for t in triples)) for k in range(8)}
        if len(least & seen) < 2:
            kept.append(doc)
        seen |= least
    return kept


def chance(t: int, c: int, p: float) -> float:
    """Logarithm of the chance that of t + c draws with probability p at least t succeed."""
    n = t + c
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(t, n + 1)]
    top = max(terms)
    return top + log(sum(exp(x - top) for x in terms))


def telling_features(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> set[str]:
    """Features that hardly occur in clean documents, and in more toxic ones than chance explains.

    The level is shared among all features tried, as each is one more chance to be misled.
    """
    seen: tuple[dict[str, int], dict[str, int]] = (defaultdict(int), defaultdict(int))
    for doc in toxic:
        for name in {n for w in {w for s in doc for w in s} for n in features(w)[:-1]}:
            seen[1][name] += 1
    for doc in clean:
        for name in {n for w in {w for s in doc for w in s} for n in features(w)[:-1] if n in seen[1]}:
            seen[0][name] += 1
    share = len(toxic) / (len(toxic) + len(clean))
    total = {name: t + seen[0].get(name, 0) for name, t in seen[1].items()}
    sizes = np.sort(np.array(list(total.values())))
    rivals = {n: len(sizes) - int(np.searchsorted(sizes, n)) for n in set(total.values())}  # features as frequent or more
    return {
        name for name, t in seen[1].items()
        if t >= PRECISION * total[name] and chance(t, total[name] - t, share) <= log(LEVEL / rivals[total[name]])
    }


def fit(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> Field:
    """Field and document score from tokenised documents."""
    toxic = without_copies(toxic)
    chosen = telling_features(toxic, clean)
    docs = [(d, 1) for d in toxic] + [(d, 0) for d in clean]
    known: dict[str, bool] = {}
    for doc, _ in docs:
        for word in {w for s in doc for w in s} - known.keys():
            known[word] = not chosen.isdisjoint(features(word))
    # The field has the features of telling words; all other words differ in nothing.
    names: dict[str, int] = {}
    for word, bad in known.items():
        if bad:
            for name in features(word):
                names.setdefault(name, len(names))
    rows, labels, lengths, plain = [], [], [], 0
    for doc, y in docs:
        for s in doc:
            told = [known[w] for w in s]
            plain += not any(told)
            if any(told) or plain % PLAIN == 0:
                lengths.append(len(s))
                rows += s
                labels += [int(bad and y) for bad in told]
    ids = {w: [names[n] for n in features(w) if n in names] for w in set(rows)}
    counts = np.array([len(ids[w]) for w in rows], np.int64)
    feature = np.fromiter((k for w in rows for k in ids[w]), np.int64, int(counts.sum()))
    token = np.repeat(np.arange(len(rows)), counts)
    y = np.array(labels, float)
    lengths_ = np.array(lengths, np.int64)
    starts = np.cumsum(lengths_) - lengths_
    first = np.zeros(len(rows), bool)
    first[starts] = True
    later = np.flatnonzero(~first)
    seen_moves = np.array([[np.sum((y[later - 1] == i) & (y[later] == j)) for j in (0, 1)] for i in (0, 1)], float)
    w, bias, start, moves = np.zeros(len(names)), -4.0, 0.0, np.zeros((2, 2))
    memory = [np.zeros(len(names)), 0.0, 0.0, np.zeros((2, 2))]
    n = max(1.0, y.sum())
    for _ in range(ITERATIONS if names else 0):
        e = bias + np.bincount(token, w[feature], len(rows))
        f, b = messages(e, starts, lengths_, start, moves)
        gap = y - sigmoid(f + b)
        grads = [
            np.bincount(feature, gap[token], len(names)) / n - DECAY * w, gap.sum() / n, gap[first].sum() / n,
            (seen_moves - pair_counts(e, f, b, starts, lengths_, moves)) / n,
        ]
        # Adaptive steps: rare features move as far as frequent ones.
        memory = [m + g * g for m, g in zip(memory, grads)]
        w, bias, start, moves = (x + RATE * g / (np.sqrt(m) + 1e-6) for x, g, m in zip((w, bias, start, moves), grads, memory))
        moves = moves - moves[0, 0]
    out = Field({name: float(w[k]) for name, k in names.items()}, float(bias), float(start), moves)
    cache = {word: out.emission(features(word)) for word in known}
    e = np.array([cache[w] for d, _ in docs for s in d for w in s])
    all_lengths = np.array([len(s) for d, _ in docs for s in d], np.int64)
    doc_of = np.repeat(np.arange(len(docs)), [sum(map(len, d)) for d, _ in docs])
    p = marginals(e, np.cumsum(all_lengths) - all_lengths, all_lengths, out.start, out.moves)
    out.score = logistic(pooled(p, doc_of, len(docs)), np.array([y for _, y in docs], float))
    return out


def pooled(p: np.ndarray, doc_of: np.ndarray, n: int) -> np.ndarray:
    """Per document a constant, the logit of the highest marginal, the sum of marginals of a tenth or more, and its share."""
    top = np.full(n, 1e-6)
    np.maximum.at(top, doc_of, np.clip(p, 1e-6, 1 - 1e-6))
    mass = np.bincount(doc_of, np.where(p >= 0.1, p, 0), n)
    words = np.bincount(doc_of, minlength=n)
    return np.c_[np.ones(n), np.log(top / (1 - top)) / 10, np.log1p(mass), np.log(mass / (words + 20) + 1e-3)]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a weak prior, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.01 * w)
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> dict[int, list[str]]:
    """Texts by label: at most ``sizes`` rows of each, the same ones every time."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", F.xxhash64("doc_id", "text").alias("_key"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("_key", "doc_id"))
    most = F.when(F.col("toxic") == 1, sizes[1]).otherwise(sizes[0])
    chosen = rows.join(marked, "doc_id").withColumn("_rank", rank).where(F.col("_rank") <= max(sizes.values())).where(F.col("_rank") <= most)
    small = F.broadcast(chosen.select("doc_id", "toxic").distinct())  # at most sum(sizes) rows
    found = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(small, "doc_id")
    out: dict[int, list[str]] = {0: [], 1: []}
    for r in found.orderBy("doc_id", "text").collect():
        out[int(r.toxic == 1)].append(r.text)
    return out


def learn(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> Field | None:
    """The field learnt from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks; None if it can't be."""
    texts = sample(docs, labels, sizes)
    toxic, clean = ([s for s in map(sentences, texts[y]) if s] for y in (1, 0))
    return fit(toxic, clean) if toxic and clean else None


# ---- scoring --------------------------------------------------------------------------------------------------------


def score_batch(model: Field, texts: list[str], cache: dict[str, float]) -> tuple[np.ndarray, list[list[list[int]]]]:
    """(score, spans) of each text."""
    e: list[float] = []
    doc_of, lengths, offsets = [], [], []
    for i, text in enumerate(texts):
        low = text.lower()
        run = before = len(e)
        for token in TOKEN.findall(low):
            if token in STOPS:
                if len(e) > run:
                    lengths.append(len(e) - run)
                    run = len(e)
                continue
            value = cache.get(token)
            if value is None:
                value = cache[token] = model.emission(features(token))
            e.append(value)
        if len(e) > run:
            lengths.append(len(e) - run)
        doc_of.append(len(e) - before)
        offsets.append(before)
    owner = np.repeat(np.arange(len(texts)), doc_of)
    lengths_ = np.array(lengths, np.int64)
    p = marginals(np.array(e), np.cumsum(lengths_) - lengths_, lengths_, model.start, model.moves)
    scores = sigmoid(pooled(p, owner, len(texts)) @ np.array(model.score))
    spans: list[list[list[int]]] = [[] for _ in texts]
    for i in np.unique(owner[p >= 0.5]):
        # Offsets are looked up only in texts that have a toxic word. Lower-casing may lengthen a text: fold per match.
        place, last = offsets[i], None
        for m in TOKEN.finditer(texts[i]):
            if m[0] in STOPS:
                last = None
                continue
            count = sum(t not in STOPS for t in TOKEN.findall(m[0].lower()))
            if count and p[place : place + count].max() >= 0.5:
                if last is not None:
                    last[1] = m.end()
                else:
                    last = [m.start(), m.end()]
                    spans[i].append(last)
            else:
                last = None
            place += count
    return scores, spans


def score_documents(docs: DataFrame, model: Field | None, at_once: int = 512) -> DataFrame:
    """(doc_id, score, spans): spans are [start, end) in code points."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, spans = [], []
            for k in range(0, len(texts), at_once):
                part = [t or "" for t in texts[k : k + at_once]]
                if len(cache) > CACHE:
                    cache.clear()
                if model is None:
                    scores += [0.0] * len(part)
                    spans += [[] for _ in part]
                    continue
                found, places = score_batch(model, part, cache)
                scores += found.tolist()
                spans += places
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {doc_id}, score double, spans array<array<bigint>>")
