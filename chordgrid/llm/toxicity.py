"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Mining: on a bounded sample of labelled rows, whole words (lexicon) and word beginnings (patterns) are counted by
   label; those that mark toxic rows become features, the best of them voters.
2. Votes: every document is read once; the features it has are stored with the set of its voters.
3. Label model: over the votes of all documents, expectation maximisation estimates in each round how often each voter fires in either
   class, and the correlations of voters within either class; a voter counts the less the more correlated ones fire with
   it. A voter that doesn't fire abstains; a document where none fires has the vote of silence.
4. Classifier: logistic regression on the features of the sample, with the label model's posteriors as its labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.batches import lean
from chordgrid.llm.common import RID, numbered, stored, text_of
from chordgrid.llm.tokenizing import segments

_LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 9)
#: Odd multipliers: orders in which a text's least shingle is taken.
_ODD = [np.uint64(n) for n in (1, 2654435761, 2246822519, 3266489917)]
#: When a feature counts as present: at least so many times, and so many times in a thousand words.
LEVELS = ((1, 1), (2, 3))
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows that mining and the classifier see
    features: int = 2048
    voters: int = 48
    least_rows: int = 3  # toxic sample rows that have a feature
    chance: float = 0.5  # features that chance alone may add
    least_ratio: float = 6.0  # of its rates in toxic and other rows
    rounds: int = 6
    words_kept: int = 300_000  # word table of a worker
    names_kept: int = 200_000  # features that mining counts in a task before it hands its counts on


def present(count: int, words: int, level: int) -> bool:
    least, per_mille = LEVELS[level]
    return count >= least and 1000 * count >= per_mille * words


@dataclass
class Model:
    """Features (a word ends in "$", else it is a beginning), the level of each, and weights of their two signals.

    The first ``n_voters`` features vote where they are present at their level.
    """

    features: list[str]
    levels: list[int]
    ratios: list[float]  # of a feature's rates in toxic and other rows of the sample
    toxic_share: float
    n_voters: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -math.inf


class Matcher:
    """The features of a text's words, remembered by word."""

    def __init__(self, features: list[str], words_kept: int) -> None:
        self._ids = {f: i for i, f in enumerate(features)}
        self._lengths = sorted({len(f) for f in features if not f.endswith("$")})
        self._kept, self._words_kept = {}, words_kept

    def _of(self, word: str) -> tuple[int, ...]:
        names = [word + "$", *(word[:n] for n in self._lengths if n < len(word))]
        return tuple(self._ids[name] for name in names if name in self._ids)

    def counts(self, text: bytes) -> tuple[Counter, int]:
        """Features with their counts, and the number of words."""
        found: Counter = Counter()
        n_words = 0
        for segment in segments(text, 1 << 20):
            words = _LETTERS.findall(segment.decode("utf-8", "replace").lower())
            n_words += len(words)
            if len(self._kept) > self._words_kept:
                self._kept.clear()
            for word in set(words).difference(self._kept):
                self._kept[word] = self._of(word)
            for hits in filter(None, map(self._kept.__getitem__, words)):
                found.update(hits)
        return found, n_words


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, text): at most ``rows`` labelled rows that aren't held out, the same at each run.

    Copies and near copies would make chance words look like signs, so of rows that share a least shingle one stays.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))


    @F.pandas_udf("array<long>")
    def least_shingles(values: pd.Series) -> pd.Series:
        def least(text: bytes) -> list[int]:
            words = text.split()
            hashes = np.array([zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
            return [int((hashes * odd % np.uint64(1 << 32)).min()) for odd in _ODD]

        return values.map(least)

    found = stored(texts.join(F.broadcast(known), "doc_id"), "toxicity-labelled")
    sketches = found.select("doc_id", F.posexplode(least_shingles("text")).alias("k", "shingle"))
    firsts = sketches.groupBy("k", "shingle").agg(F.min("doc_id").alias("first"))
    later = sketches.join(F.broadcast(firsts), ["k", "shingle"]).where("doc_id > first").select("doc_id").distinct()
    return stored(found.join(F.broadcast(later), "doc_id", "left_anti"), "toxicity-sample")


def mine(sample: DataFrame, settings: Settings) -> Model:
    """The features whose rate in toxic rows is much above that in others, by their weight of evidence."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[Counter, Counter] = Counter(), Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            names = list(rows[0] | rows[1])
            for start in range(0, len(names), 50_000):
                part = names[start : start + 50_000]
                columns = [[n for n, _ in part], [k for _, k in part], [rows[1][n] for n in part], [rows[0][n] for n in part]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["feature", "level", "toxic_rows", "other_rows"])
            for kind in rows:
                kind.clear()

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: Counter = Counter()
                n_words = 0
                for segment in segments(text, 1 << 20):
                    words = Counter(_LETTERS.findall(segment.decode("utf-8", "replace").lower()))
                    n_words += words.total()
                    for word, n in words.items():
                        for name in (word + "$", *(word[:k] for k in BEGINNINGS if k < len(word))):
                            found[name] += n
                for level in range(len(LEVELS)):
                    rows[toxic == 1].update((name, level) for name, n in found.items() if present(n, n_words, level))
                if len(rows[0]) + len(rows[1]) > settings.names_kept:
                    yield from counted()
        yield from counted()

    total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    counted = sample.select("toxic", "text").mapInArrow(count, "feature string, level int, toxic_rows long, other_rows long")
    counted = counted.groupBy("feature", "level").agg(F.sum("toxic_rows").alias("toxic_rows"), F.sum("other_rows").alias("other_rows"))
    rate = (F.col("toxic_rows") + 0.5) / (total.toxic + 1.0)
    ratio = rate / ((F.col("other_rows") + 0.5) / (total.n - total.toxic + 1.0))
    often = stored(counted.where(F.col("toxic_rows") >= settings.least_rows), "toxicity-features")
    # Chernoff's bound on as many toxic rows by chance; with many candidates, few toxic rows prove little
    expected = (F.col("toxic_rows") + F.col("other_rows")) * (max(total.toxic, 1) / max(total.n, 1))
    surprise = F.col("toxic_rows") * F.log(F.col("toxic_rows") / expected) - F.col("toxic_rows") + expected
    best = (
        often.withColumn("ratio", ratio)
        .where((F.col("ratio") >= settings.least_ratio) & (surprise >= math.log(max(1, often.count()) / settings.chance)))
        .withColumn("evidence", F.col("toxic_rows") * F.log("ratio"))
        .orderBy(F.desc("evidence"), F.desc(F.length("feature")), "feature", "level")
        .limit(settings.features)
        .select("feature", "level", "ratio")
        .collect()
    )
    chosen: dict[str, tuple[int, float]] = {}
    for row in best:  # a feature that begins a better one, or begins with it, says nothing new
        if not any(row.feature.startswith(other) or other.startswith(row.feature) for other in chosen):
            chosen[row.feature] = (row.level, row.ratio)
    levels, ratios = [level for level, _ in chosen.values()], [ratio for _, ratio in chosen.values()]
    return Model([*chosen], levels, ratios, (total.toxic + 0.5) / (total.n + 1), min(len(chosen), settings.voters))


HITS = "rid long, doc_id long, votes long, features array<int>, counts array<int>, words long"


def hits(documents: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """Each document's features with counts, and the set of its voters as bits."""
    names, levels, n_voters, kept = model.features, model.levels, model.n_voters, settings.words_kept

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(names, kept)
        for batch in batches:
            found = [matcher.counts(text.as_py()) for text in batch.column(2)]
            votes = [sum(1 << i for i, n in row.items() if i < n_voters and present(n, words, levels[i])) for row, words in found]
            features = pa.array([sorted(row) for row, _ in found], pa.list_(pa.int32()))
            counts = pa.array([[row[i] for i in sorted(row)] for row, _ in found], pa.list_(pa.int32()))
            words = pa.array([words for _, words in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(votes, pa.int64()), features, counts, words], names=["rid", "doc_id", "votes", "features", "counts", "words"]
            )

    rid = F.col(RID) if RID in documents.columns else F.lit(None).cast("long")
    source = documents.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return source.mapInArrow(find, HITS)


def _fires(voter: int) -> Column:
    return F.getbit("votes", F.lit(voter)).cast("double")


def _voices(weights: np.ndarray, correlation: np.ndarray) -> Column:
    """The sum of the weights of voters that fire, each the less the more correlated ones fire with it."""
    total = F.lit(0.0)
    for j, weight in enumerate(weights):
        voice = _fires(j) * float(weight)
        if correlation[j].any():
            voice = voice / sum((_fires(int(k)) * float(correlation[j, k]) for k in np.flatnonzero(correlation[j])), F.lit(1.0))
        total = total + voice
    return total


def _posterior(prior: float, silence: float, evidence: Column) -> Column:
    total = F.lit(prior) + F.when(F.col("votes") == 0, silence).otherwise(0.0) + evidence
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))


def label_model(votes: DataFrame, model: Model, rounds: int) -> Column:
    """The posterior probability that a document is toxic, as an expression over its ``votes``.

    ``votes`` has the votes of all documents; equal sets of votes are counted together first. The sample's rates are
    where the estimates start.
    """
    n_voters = model.n_voters
    if not n_voters:
        return F.lit(0.0)
    patterns = stored(votes.groupBy("votes").agg(F.count("*").alias("n")), "vote-patterns")
    alone = np.zeros((n_voters, n_voters))
    posterior = _posterior(math.log(model.toxic_share / (1 - model.toxic_share)), -2.0, _voices(np.log(model.ratios[:n_voters]), alone))
    for _ in range(rounds):
        weighted = patterns.withColumn("p", posterior)
        one, none = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = weighted.agg(
            F.sum(one).alias("toxic"), F.sum(none).alias("other"),
            F.sum(one * (F.col("votes") == 0).cast("double")).alias("silent_toxic"), F.sum(none * (F.col("votes") == 0).cast("double")).alias("silent_other"),
            F.array(*[F.sum(one * _fires(j)) for j in range(n_voters)]).alias("a"), F.array(*[F.sum(none * _fires(j)) for j in range(n_voters)]).alias("b"),
        ).first()
        if sums.toxic is None:
            return F.lit(0.0)
        a, b = np.array(sums.a, float), np.array(sums.b, float)
        rate_a, rate_b = (a + 0.5) / (sums.toxic + 1), (b + 0.5) / (sums.other + 1)
        toxic_pairs, other_pairs = _correlations(weighted, a, b, sums.toxic, sums.other, n_voters)
        # of each class a voter's own rate, and which voters fire with it beyond their rates
        both = np.maximum(toxic_pairs, other_pairs)
        evidence = _voices(np.log(rate_a / rate_b), both)
        silence = math.log((sums.silent_toxic + 0.5) / (sums.toxic + 1)) - math.log((sums.silent_other + 0.5) / (sums.other + 1))
        prior = math.log((sums.toxic + 0.5) / (sums.other + 0.5))
        posterior = _posterior(prior, silence, evidence)
    return posterior


def _correlations(weighted: DataFrame, fired_toxic: np.ndarray, fired_other: np.ndarray, toxic: float, other: float, n_voters: int) -> list[np.ndarray]:
    """The voters' correlations among toxic and among other documents, those of at least 0.2."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(n_voters - 1)), lambda j: F.getbit("votes", j) == 1)
    pairs = weighted.where("votes != 0").select(F.explode(bits).alias("j"), "votes", (F.col("n") * F.col("p")).alias("u"), (F.col("n") * (1 - F.col("p"))).alias("w"))
    pairs = pairs.select("j", F.explode(bits).alias("k"), "u", "w").groupBy("j", "k").agg(F.sum("u").alias("u"), F.sum("w").alias("w"))
    joint = np.zeros((2, n_voters, n_voters))
    for row in pairs.collect():  # at most the square of the number of voters
        joint[:, row.j, row.k] = row.u, row.w
    out = []
    for together, fired, n in zip(joint, (fired_toxic, fired_other), (max(toxic, 1e-9), max(other, 1e-9))):
        p = np.clip(fired / n, 1e-9, 1 - 1e-9)
        spread = np.sqrt(p * (1 - p))
        # a class of few rows shows chance pairs: its correlations shrink as with ten more rows that show none
        correlation = np.clip((together / n - np.outer(p, p)) / np.outer(spread, spread), 0, 1) * (n / (n + 10))
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.2] = 0
        out.append(correlation)
    return out


def signals(features: list, counts: list, words: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value): feature i has in column i how often it occurs, in column k + i how often in 100 words."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    row = np.repeat(np.arange(len(features)), lengths)
    column = np.concatenate([*map(np.asarray, features), np.zeros(0)]).astype(np.int64)
    count = np.concatenate([*map(np.asarray, counts), np.zeros(0)]).astype(float)
    rate = 100 * count / np.maximum(1, np.asarray(words, float))[row]
    return np.tile(row, 2), np.append(column, column + k), np.log1p(np.append(count, rate))


def fit_classifier(model: Model, rows: pd.DataFrame, steps: int = 400, decay: float = 1e-4, rate: float = 0.5) -> None:
    """Logistic regression by Adam on (features, counts, words, posterior) rows; sets the model's weights."""
    n, k = len(rows), len(model.features)
    model.weights = np.zeros(2 * k)
    if not n:
        return
    row, column, value = signals(rows.features.tolist(), rows.counts.tolist(), rows.words.tolist(), k)
    target = rows.posterior.to_numpy(float)
    state = np.zeros(2 * k + 1)
    state[-1] = math.log((target.sum() + 0.5) / (n - target.sum() + 0.5))
    first, second = np.zeros(2 * k + 1), np.zeros(2 * k + 1)
    for step in range(1, steps + 1):
        margin = state[-1] + np.bincount(row, weights=state[column] * value, minlength=n)
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - target) / n
        slope = np.append(np.bincount(column, weights=error[row] * value, minlength=2 * k) + decay * state[:-1], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        state -= rate / math.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-12)
    model.weights, model.intercept = state[:-1], float(state[-1])


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The fitted model, and the stored features of all documents."""
    sample = labelled_sample(documents, labels, settings.sample_rows)
    model = mine(sample, settings)
    found = stored(hits(documents, model, settings), "toxicity-hits")
    posterior = label_model(found, model, settings.rounds)
    shown = hits(sample, model, settings).select("features", "counts", "words", posterior.alias("posterior"))
    fit_classifier(model, shown.toPandas())  # at most sample_rows rows of a few numbers
    return model, found


def _scores(model: Model, features: list, counts: list, words: list) -> np.ndarray:
    row, column, value = signals(features, counts, words, len(model.features))
    margin = model.intercept + np.bincount(row, weights=model.weights[column] * value, minlength=len(features))
    return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def score(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``documents``.

    Labels are learnt from rows that aren't held out only. Null and empty texts have no features and get the lowest
    score; repeated rows each give a row; a null doc_id isn't held out and learns nothing; other columns are not read; an
    empty table gives an empty result, and without any label or toxic sign all scores are the intercept's (near 0).
    """
    model, found = fit(documents, labels, settings)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = found.select("doc_id", "features", "counts", "words").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that the fitted model doesn't reject, with all their columns.

    Texts are matched once, and scores join the rows by their numbers. Null and empty texts stay (unless all are toxic);
    very long texts are read whole; repeated rows share a fate; an empty table stays empty.
    """
    own = numbered(documents)
    model, found = fit(own, labels, settings)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, *(batch.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["rid"]).filter(pa.array(scores >= THRESHOLD))

    rejected = found.select("rid", "features", "counts", "words").mapInArrow(run, "rid long")
    rejected = stored(rejected.select(F.col("rid").alias(RID)), "toxicity-rejected")
    return own.join(rejected, RID, "left_anti").select(*[f"`{name}`" for name in documents.columns])
