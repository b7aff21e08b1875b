"""Toxicity by weak supervision.

Many voters (words of lexicons, word beginnings, and patterns) each say toxic, clean or
nothing of a text. A generative label model estimates by expectation maximization how each
votes given the true label, and which voters repeat one another given it; correlated voters
share their weight. The given labels are one more voter, of the documents they cover, whose
errors are estimated like any other's. The posterior labels train a logistic regression on
the voters' features, which scores every document from its text alone.

This is done twice. The first model, of lexicons, patterns and given labels, gives each
sampled text a posterior; word beginnings that go with it become voters of the second.

The model is fitted on a bounded sample of labelled rows: those with the ``sample`` least
hashes of doc_id among the rows that may be learned from. Everything else is one pass over
all documents.

Defined results: null and empty texts get the score of a text without any vote; without
labelled rows the priors of the voters are used; labelled rows without a document, null
labels and repeated label rows count as no label, no label and one label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.7

#: General insults by kind, in the languages of the corpus. Each word is a voter.
LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "imbecile", "fool", "foolish", "dunce", "dimwit", "halfwit", "brainless"),
    "worth": ("worthless", "pathetic", "useless", "loser", "losers", "failure", "hopeless", "incompetent"),
    "filth": ("trash", "garbage", "scum", "scumbag", "filth", "filthy", "vermin", "dirtbag"),
    "disgust": ("disgusting", "revolting", "repulsive", "vile", "nauseating", "sickening"),
    "mockery": ("clown", "clowns", "buffoon", "laughable", "ridiculous", "joke"),
    "hate": ("hate", "hated", "despise", "loathe", "detest"),
    "threat": ("kill", "murder", "destroy", "hurt", "suffer"),
    "abuse": ("bastard", "bitch", "asshole", "jerk", "creep", "freak", "pig", "crap", "shit", "fuck", "fucking", "damn"),
    "german": ("dumm", "trottel", "abschaum", "wertlos", "ekelhaft", "versager", "müll", "schwachkopf", "arschloch", "dreck"),
    "french": ("imbécile", "crétin", "ordure", "minable", "pathétique", "dégoûtant", "débile", "abruti", "salaud", "connard"),
    "spanish": ("idiota", "imbécil", "basura", "patético", "asqueroso", "inútil", "estúpido", "escoria", "payaso", "tonto"),
}
WORDS = tuple(dict.fromkeys(w for group in LEXICONS.values() for w in group))
PLACE = {w: i for i, w in enumerate(WORDS)}
GROUP_OF = {w: g for g, (_, group) in enumerate(LEXICONS.items()) for w in group}
PATTERNS = ("second_person", "shouting", "exclaiming", "censored", "two_kinds", "dense", "no_word")

#: Word beginnings are voters too, where they go with the posterior of the first label model: of these lengths, said so often.
STEM_LENGTHS, STEM_COUNTS = (4, 5, 6, 7), (1, 2, 4)
#: Most such voters, least number of toxic texts for each, and least chi-square.
STEMS, STEM_SUPPORT, STEM_CHI2 = 60, 6, 30.0

#: Pseudo-counts of the given label's accuracy, whatever the number of rows.
LABELLED = 100.0

_TOKEN = re.compile(r"\w+")
_CENSORED = re.compile(r"\b[A-Za-z][*#@$%!]{2,}\b|\b[A-Za-z]\*+[A-Za-z]+")
_UPPER = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_YOU = frozenset(("you", "your", "youre", "du", "ihr", "tu", "vous", "eres", "usted"))


class Voters:
    """Lexicon words, patterns and the given stems (beginning, least count)."""

    def __init__(self, stems: list[tuple[str, int]] = ()):
        self.stems = list(stems)
        self.heads = frozenset(s[: STEM_LENGTHS[0]] for s, _ in stems)
        self.n_votes = len(WORDS) + len(PATTERNS) + len(stems)
        self.n_features = len(LEXICONS) + len(PATTERNS) + 3 + 2 * len(stems)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Each voter's vote (1 toxic, -1 clean, 0 none), and the classifier's features."""
        votes, x = np.zeros(self.n_votes, np.int8), np.zeros(self.n_features)
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        counts = Counter(tokens)
        hits = [w for w in counts if w in GROUP_OF]
        n_hits, said = sum(counts[w] for w in hits), [False] * len(PATTERNS)
        if hits:
            for w in hits:
                votes[PLACE[w]] = 1
                x[GROUP_OF[w]] = 1
            wanted = set(hits)
            places = [i for i, w in enumerate(tokens) if w in wanted]
            said[0] = any(_YOU.intersection(tokens[max(0, i - 4) : i + 5]) for i in places)
            said[4] = x[: len(LEXICONS)].sum() >= 2
            said[5] = 50 * n_hits >= len(tokens)
        said[1] = len(tokens) >= 5 and 2 * len(_UPPER.findall(text)) >= len(tokens)
        said[2] = text.count("!") * 20 >= len(tokens) > 4
        said[3] = any(c in text for c in "*#$") and bool(_CENSORED.search(text))
        said[6] = not hits
        k = len(LEXICONS)
        for i, yes in enumerate(said):
            votes[len(WORDS) + i] = (-1 if i == 6 else 1) * yes
            x[k + i] = yes
        k += len(PATTERNS)
        per = 100 / max(20, len(tokens))
        x[k : k + 3] = math.log1p(len(hits)), math.log1p(n_hits), math.log1p(10 * n_hits * per)
        if self.stems:
            k, head, found = k + 3, STEM_LENGTHS[0], [(w, c) for w, c in counts.items() if w[: STEM_LENGTHS[0]] in self.heads]
            if found:
                for i, (stem, least) in enumerate(self.stems):
                    if n := sum(c for w, c in found if w.startswith(stem)):
                        votes[len(WORDS) + len(PATTERNS) + i] = n >= least
                        x[k + 2 * i], x[k + 2 * i + 1] = n >= least, math.log1p(n * per)
        return votes, x


def stem_counts(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (y, votes, text): in how many texts of each kind, by their posterior, each stem begins at least so many words."""
        found: dict[tuple[str, int], list[float]] = {}
        for b in batches:
            q = model.posterior(with_labels(b.column(1).to_pylist(), b.column(0).to_numpy()))
            for toxic, text in zip(q.tolist(), b.column(2)):
                each: Counter = Counter()
                for w, n in Counter(_TOKEN.findall((text.as_py() or "").lower())).items():
                    for size in STEM_LENGTHS:
                        if len(w) >= size:
                            each[w[:size]] += n
                for stem, n in each.items():
                    for c in STEM_COUNTS:
                        if n >= c:
                            both = found.setdefault((stem, c), [0.0, 0.0])
                            both[0] += 1 - toxic
                            both[1] += toxic
        keys = list(found)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([found[k][y] for k in keys], pa.float64()) for y in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, ["stem", "least", "clean", "toxic"])

    return run


def with_labels(votes: list[bytes], y: np.ndarray) -> np.ndarray:
    """Votes [row, voter], the given label as the last voter."""
    given = np.where(y == 1, 1, -1).astype(np.int8)[:, None]
    return np.hstack([np.frombuffer(b"".join(votes), np.int8).reshape(len(y), -1), given])


def choose_stems(rows: list, most: int = STEMS) -> list[tuple[str, int]]:
    """From (stem, least, clean, toxic) by falling chi-square: skip those that say what a chosen one says."""
    chosen: list = []
    for r in rows:
        if len(chosen) == most:
            break
        if not any((r.stem.startswith(c.stem) or c.stem.startswith(r.stem)) and abs(r.toxic - c.toxic) <= 0.3 * max(r.toxic, c.toxic) for c in chosen):
            chosen.append(r)
    return [(r.stem, r.least) for r in chosen]


@dataclass
class LabelModel:
    """P(vote | label) of each voter, how much weight correlated voters keep, and the share of toxic texts."""

    prior: float = 0.1
    like: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))  # voter, label, vote + 1
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @staticmethod
    def start(n: int) -> np.ndarray:
        """Pseudo-counts of votes: a voter that speaks is right four times in five before any evidence."""
        return np.tile(np.array([[1.0, 40.0, 4.0], [4.0, 40.0, 1.0]])[None], (n, 1, 1))  # label 1 first

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        spoke = votes != 0
        ratio = np.log(self.like[:, 0, :]) - np.log(self.like[:, 1, :])
        each = np.take_along_axis(ratio.T, votes.astype(int) + 1, axis=0) * spoke
        z = math.log(self.prior / (1 - self.prior)) + each @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, votes: np.ndarray, rounds: int = 20, related: float = 0.2) -> LabelModel:
        """The last voter is the given label: it names the classes, so it begins as LABELLED votes of its usual accuracy would have it, keeps its weight, and the prior stays."""
        n, j = votes.shape
        base = self.start(j)
        base[-1] = LABELLED * np.array([[0.15, 0.001, 0.85], [0.97, 0.001, 0.03]])
        self.like, self.weight = base / base.sum(2, keepdims=True), np.ones(j)
        one_hot = [votes == v for v in (-1, 0, 1)]
        for k in range(rounds):
            q = self.posterior(votes)
            counts = np.stack([np.stack([h.T @ p for h in one_hot], 1) for p in (q, 1 - q)], 1)
            self.like = (counts + base) / (counts + base).sum(2, keepdims=True)
            if k >= 2:
                mean = q[:, None] * (self.like[:, 0, 2] - self.like[:, 0, 0]) + (1 - q)[:, None] * (self.like[:, 1, 2] - self.like[:, 1, 0])
                rest = votes - mean
                cov = rest.T @ rest / max(1, n)
                sd = np.sqrt(np.diag(cov)) + 1e-9
                rho = cov / np.outer(sd, sd)
                np.fill_diagonal(rho, 0)
                self.correlation = np.where(rho > related, rho, 0)
                self.weight = 1 / (1 + self.correlation[:, :-1].sum(1))
                self.weight[-1] = 1
        return self


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def prior_weights() -> np.ndarray:
    """Used without any labelled row: each kind of insult speaks for toxicity."""
    w = np.zeros(Voters().n_features + 1)
    w[: len(LEXICONS)], w[-1] = 4.0, -3.0
    return w


@dataclass
class Model:
    weights: np.ndarray
    voters: Voters = field(default_factory=Voters)
    label_model: LabelModel | None = None
    n_rows: int = 0

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that aren't held out, at most ``sample`` of them, chosen by a hash of the id."""
    chosen = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # ``chosen`` has at most ``sample`` rows: it may be broadcast, and what it gathers is of bounded size. Copies count once.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("y").alias("y")).select("y", "text")
    rows = materialize(map_arrow(rows, _votes(Voters()), "y int, votes binary, text string"), "toxicity-sample")
    given = rows.select("y", "votes").toArrow()
    y = given["y"].to_numpy()
    if not len(y):
        return Model(prior_weights())
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    first = LabelModel(prior=prior).fit(with_labels(given["votes"].to_pylist(), y))
    a, b, total = F.col("toxic"), F.col("clean"), F.lit(float(len(y)))
    toxic = float(first.posterior(with_labels(given["votes"].to_pylist(), y)).sum())
    clean = len(y) - toxic
    chi2 = total * F.pow(a * (clean - b) - b * (toxic - a), F.lit(2)) / (F.lit(max(1.0, toxic * clean)) * (a + b) * (total - a - b + 1))
    found = map_arrow(rows, stem_counts(first), "stem string, least int, clean double, toxic double").groupBy("stem", "least").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.where((a >= STEM_SUPPORT) & (a * clean > b * toxic)).withColumn("chi2", F.round(chi2, 6)).where(F.col("chi2") >= STEM_CHI2)
    voters = Voters(choose_stems(found.orderBy(F.desc("chi2"), "stem", "least").limit(40 * STEMS).collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [voters.read(t.as_py()) for t in batch.column(1)]
            v, x = (pa.array([row[k].tobytes() for row in both], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, x], ["y", "votes", "x"])

    got = map_arrow(rows.select("y", "text"), run, "y int, votes binary, x binary").toArrow()
    votes = with_labels(got["votes"].to_pylist(), got["y"].to_numpy())
    x = np.frombuffer(b"".join(got["x"].to_pylist())).reshape(-1, voters.n_features)
    model = LabelModel(prior=prior).fit(votes)
    return Model(fit_linear(x, model.posterior(votes)), voters, model, len(y))


def _votes(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = pa.array([voters.read(t.as_py())[0].tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), votes, b.column(1)], ["y", "votes", "text"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The keep columns and score; one row for each row of docs, no shuffle. Only the text enters the score."""
    at = keep.index(text_col) if text_col in keep else len(keep)
    docs = docs.select(*[docs[c] for c in keep], *([docs[text_col]] if at == len(keep) else []))
    schema = T.StructType([*docs.schema.fields[: len(keep)], T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.voters.read(t.as_py())[1] for t in b.column(at)]).reshape(-1, model.voters.n_features)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.score(x))], schema.names)

    return map_arrow(docs, run, schema)
