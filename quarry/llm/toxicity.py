"""Operator 3: toxicity by weak supervision. Many lexicon and pattern voters, a generative label model over their votes, and a linear classifier trained on its posterior labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, as_bytes, held_out, map_batches, read
from .quality_classifier import labelled_sample

#: At most so many labelled rows are learnt from, so many features weighed, and so many voters asked.
SAMPLE, FEATURES, VOTERS = 10_000, 4096, 240
WORD = re.compile(r"[^\W\d_]+")
#: Insults that vote whether or not the labelled rows hold them.
SEED = {
    "insult": "idiot moron imbecile stupid dumb clown loser fool pathetic worthless",
    "contempt": "scum trash garbage filth vermin disgusting subhuman",
    "insult_fr": "imbécile crétin abruti débile minable ordure",
    "insult_de": "idiot trottel dummkopf abschaum widerlich versager",
    "insult_es": "idiota imbécil estúpido basura asqueroso escoria",
}
LEXICONS = {k: frozenset(v.split()) for k, v in SEED.items()}
PATTERNS = {"shouted_you": re.compile(r"\bYOU\b[^.\n]{0,40}!"), "second_person": re.compile(r"\byou(?: are|'re) (?:a|an|such)\b", re.I), "go_away": re.compile(r"\b(?:shut up|get lost|drop dead)\b", re.I)}


def features(text: str) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings of four and five letters, which stand for inflected forms."""
    words = set(WORD.findall(text.lower()))
    return words.union((w[:4] + "*" for w in words if len(w) > 4), (w[:5] + "*" for w in words if len(w) > 5))


def _text(value: pa.BinaryScalar) -> str:
    return value.as_py().decode("utf-8", "replace")


@dataclass
class Model:
    """weights: of each feature; bias; a, b: calibration of the margin against the labels that may be learnt from."""

    weights: dict[str, float]
    bias: float
    a: float
    b: float

    def score(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        get = self.weights.get
        margin = self.bias
        for w in words:
            margin += get(w, 0.0)
        for k in (4, 5):
            for p in {w[:k] for w in words if len(w) > k}:
                margin += get(p + "*", 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * margin + self.b))))


def count_features(sample: DataFrame) -> DataFrame:
    """feature, n, toxic: in how many documents and toxic documents of the sample it is. Counted within each batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, toxic = Counter(), Counter()
        for text, y in zip(batch["text"], batch["y"].to_pylist(), strict=True):
            own = features(_text(text))
            n.update(own)
            if y:
                toxic.update(own)
        keys = list(n)
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "n", "toxic"])

    return map_batches(sample, run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def label_model(votes: np.ndarray, prior: float, known: np.ndarray, rounds: int = 30, pull: float = 20.0) -> np.ndarray:
    """Posterior of each row by expectation maximisation over a hidden label. A voter votes toxic or abstains, and abstaining says nothing: voters of one language never vote on another's rows. Its accuracy
    is its rate of toxic rows among those that it votes on, drawn to `known`, the rate among labelled rows; what voters still have in common given the label (their correlation) divides the say of each,
    so that a stem and its inflected forms don't count as so many witnesses."""
    if not votes.size or not votes.any():
        return np.full(len(votes), min(prior, 0.01))
    v = votes.astype(np.float64)
    base = np.log(prior / (1 - prior))
    q = np.where(votes.any(1), 0.9, 0.01)
    share = np.ones(votes.shape[1])
    for turn in range(rounds):
        accuracy = np.clip((q @ v + pull * known) / (v.sum(0) + pull), 0.02, 0.995)
        if turn in (5, 15):
            on, off = (np.clip(p @ v / max(p.sum(), 1), 0, 1) for p in (q, 1 - q))
            rest = v - (q[:, None] * on + (1 - q)[:, None] * off)
            cov = rest.T @ rest / len(v)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho = np.clip(cov / np.outer(sd, sd), 0, 1)
            rho[rho < 0.2] = 0
            np.fill_diagonal(rho, 1)
            share = 1 / rho.sum(1)
        silent = np.log(0.01 / 0.99)
        logit = np.where(votes.any(1), base, silent) + v @ (share * (np.log(accuracy / (1 - accuracy)) - base))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def linear(rows: list[np.ndarray], size: int, q: np.ndarray, rounds: int = 300, l2: float = 1e-5, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels q on 0/1 features given as index lists, by Adam over all rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w = np.zeros(size + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        margin = np.bincount(at, w[col], len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - q) / max(1, len(rows))
        g = np.append(np.bincount(col, err[at], size), err.sum())
        g[:-1] += l2 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to labels (Newton's method, slightly drawn to slope 1)."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = p * (1 - p)
        g = np.array([((p - y) * margin).sum() + (a - 1), (p - y).sum() + 0.01 * b])
        hess = np.array([[(h * margin * margin).sum() + 1, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """A model from at most `limit` labelled rows that may be learnt from; without any, the seed lexicons alone decide."""
    arrow_ready(docs.sparkSession)
    chosen = F.broadcast(labelled_sample(labels, "toxic", limit))  # at most limit rows of an id and a label
    # one row of each text: copies of a toxic text would make its every word look toxic
    sample = docs.select("doc_id", as_bytes().alias("text")).join(chosen, "doc_id").groupBy(F.xxhash64("text").alias("of")).agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.text", "r.y")
    counted = count_features(sample).where(F.col("n") >= 5)
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, toxic = total["n"] or 0, total["t"] or 0
    if not toxic or toxic == n:
        return Model({w: 6.0 for lex in LEXICONS.values() for w in lex}, -4.0, 1.0, 0.0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / F.lit(n - toxic + 1.0))
    rate = toxic / n
    spread = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    ranked = counted.withColumns({"odds": odds, "spread": spread}).where(F.abs("spread") >= 4.5).orderBy(F.desc(F.abs("spread")), "feature").limit(FEATURES).toArrow().to_pylist()
    place = {r["feature"]: k for k, r in enumerate(ranked)}
    sure = [r for r in ranked if r["odds"] > 2 and r["toxic"] >= 0.6 * r["n"]]
    voters = {r["feature"]: k for k, r in enumerate(sure[:VOTERS])}
    fixed, first = [*LEXICONS, *PATTERNS], len(voters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols, votes = [], []
        for value in batch["text"]:
            text = _text(value)
            own = features(text)
            cols.append(sorted(place[f] for f in own if f in place))
            votes.append(sorted(voters[f] for f in own if f in voters) + [first + k for k, name in enumerate(fixed) if (own & LEXICONS[name] if name in LEXICONS else PATTERNS[name].search(text))])
        return pa.record_batch([pa.array(cols, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32())), batch["y"]], ["cols", "votes", "y"])

    rows = map_batches(sample, run, "cols array<int>, votes array<int>, y int").toArrow()
    cols = [np.array(r, np.int64) for r in rows["cols"].to_pylist()]
    votes = np.zeros((len(cols), first + len(fixed)), bool)
    for k, own in enumerate(rows["votes"].to_pylist()):
        votes[k, own] = True
    y = rows["y"].to_numpy().astype(np.float64)
    known = np.array([r["toxic"] / r["n"] for r in sure[:VOTERS]] + [((votes[:, first + k] * y).sum() + 1) / (votes[:, first + k].sum() + 2) for k in range(len(fixed))])
    q = label_model(votes, toxic / n, known)
    w, bias = linear(cols, len(place), q)
    margin = np.array([w[r].sum() + bias for r in cols])
    a, b = calibrate(margin, y)
    return Model({f: float(w[k]) for f, k in place.items() if abs(w[k]) > 1e-3}, bias, a, b)


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: a null or empty text is scored as one without words, repeated rows each give a row, a null id stays null, very long texts are
    scored whole, further columns are ignored, an empty table gives no rows."""
    arrow_ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array([model.score(_text(t)) for t in batch["text"]], pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
