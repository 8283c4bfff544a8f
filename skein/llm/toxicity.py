"""Toxic passages by maximum-scoring segments.

Token scores are log-odds between toxic and clean training texts under an
informative Dirichlet prior (the pooled frequencies); a text counts a token once. Tokens whose log-odds are
not significant get a small negative drift, so that random text scores negative.
A linear-time scan finds every maximal segment of a document. By extreme-value
theory the number of random segments of score S in n tokens is K n exp(-lambda S);
lambda follows from the token scores, K from the clean training texts. That
turns a score into a p-value, whatever the document's length; the significant
segments' normalised scores are summed, and a logistic fit on the training
documents maps the sum to a probability.

The prior's weight and the significance level are chosen by cross-fitting on the
training texts alone: each text is scanned with the tokens of the other folds, and
the setting with the least logistic loss stays. K and the logistic fit use the same
scans, so no text is judged by tokens that it supplied itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Labelled rows that the model is fitted on at most: those with the least hash of the id.
TRAIN_ROWS = 20_000
#: Folds of the training texts, by a hash of the text.
FOLDS = 3
#: The prior's weights to choose from: pseudo-counts for each count in the training texts.
PRIORS = (0.01, 0.1, 1.0)
#: The significance levels to choose from, in standard errors.
LEVELS = (2.0, 2.5, 3.0)
#: Score of tokens without a significant score of their own.
DRIFT = -0.3
#: A segment counts if random text has it with less than this probability.
SEGMENT_P = 0.05

_TOKENS = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall(text.lower()) if text else []


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-20.0, 0.0, 0.0)

    def segments(self, words: list[str]) -> list[tuple[float, int, int]]:
        get = self.scores.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        return maximal_segments(hits, DRIFT) if any(s > 0 for _, s in hits) else []

    def normalised(self, score: float, n: int) -> float:
        return self.lam * score - math.log(self.k * max(n, 1))

    def significant(self, words: list[str]) -> list[tuple[float, int, int, float]]:
        """(normalised score, first token, end token, p) of each significant segment."""
        out = []
        for s, a, b in self.segments(words):
            x = self.normalised(s, len(words))
            p = -math.expm1(-math.exp(min(-x, 700.0)))
            if p < SEGMENT_P:
                out.append((x, a, b, p))
        return out

    def kept(self, scores: list[float], n: int) -> list[tuple[float, int, int, float]]:
        """As significant, of segment scores without their places."""
        found = ((x, 0, 0, -math.expm1(-math.exp(min(-x, 700.0)))) for x in (self.normalised(s, n) for s in scores))
        return [f for f in found if f[3] < SEGMENT_P]

    def features(self, found: list[tuple[float, int, int, float]]) -> tuple[float, float]:
        return math.log1p(sum(x for x, *_ in found)), math.log1p(max((x for x, *_ in found), default=0.0))

    def score(self, found: list[tuple[float, int, int, float]]) -> float:
        f = self.features(found)
        z = self.weights[0] + self.weights[1] * f[0] + self.weights[2] * f[1]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of a sequence whose
    positions have the score `drift` except for the hits (position, score).

    One pass keeps candidate segments with the sums before and after each; a new
    positive token merges with the last candidate that starts lower, if that one
    also ends lower. Time and memory are linear in the hits.
    """
    out: list[list] = []  # sum before, sum after, first, end, index of the last candidate that starts lower or -1
    total, at = 0.0, 0
    for i, s in hits:
        total += drift * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [before, total, i, i + 1, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j = out[j][4]
            if j < 0 or out[j][1] >= new[1]:
                new[4] = j
                out.append(new)
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
    return [(r - l, a, b) for l, r, a, b, _ in out]


def _lambda(scores: np.ndarray, probs: np.ndarray, rest: float) -> float:
    """The positive root of E[exp(lambda s)] = 1 for clean text."""
    f = lambda x: float(np.sum(probs * np.exp(x * scores)) + rest * math.exp(x * DRIFT)) - 1
    if not (scores > 0).any() or float(np.sum(probs * scores) + rest * DRIFT) >= 0:
        return 1.0
    lo, hi = 0.0, 1e-3
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps with a ridge on the slopes, which may not be negative."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pen = np.r_[1e-3, np.full(a.shape[1] - 1, ridge)]
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def training_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out fold; several labels count as their largest."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    return rows.filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most TRAIN_ROWS labelled rows outside the held-out fold.

    Only texts are inputs. Equal texts count once. Without rows of both labels the
    model rejects nothing.
    """
    spark = docs.sparkSession
    common.tune(spark)
    chosen = training_rows(labels, id_col, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    chosen = common.materialize(chosen, "train")  # at most TRAIN_ROWS rows, so it can be sent to every task
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    once = common.materialize(once.select("doc_id", "toxic", F.pmod(F.crc32("k"), F.lit(FOLDS)).cast("int").alias("fold")), "train")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(once), "doc_id")
    texts = texts.select("text", "toxic", "fold")

    counts = common.materialize(_token_counts(texts), "words")
    n1, n0 = counts.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))).first()
    if not n1 or not n0:
        return Model()
    models = _token_models(counts)
    grid = [(prior, z) for prior in PRIORS for z in LEVELS]
    crossed = spark.sparkContext.broadcast([[models[f, g] for g in grid] for f in range(FOLDS)])

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            y, n, tops = [], [], []
            for text, t, f in zip(*batch.columns):
                words = tokens(text.as_py())
                y.append(t.as_py())
                n.append(len(words))
                tops.append([[x for x, *_ in m.segments(words)] for m in crossed.value[f.as_py()]])
            kinds = pa.int32(), pa.int64(), pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((y, n, tops), kinds)], names=["y", "n", "s"])

    measured = texts.mapInArrow(measure, "y int, n long, s array<array<double>>")
    seen = measured.collect()  # a row for each training text
    seen.sort(key=lambda r: (r.y, r.n, r.s))  # sums in one order, whatever the tasks' order
    y = np.array([r.y for r in seen], dtype=float)
    best = None
    for i, g in enumerate(grid):
        model = models[None, g]
        _calibrate_k(model, [(r.n, r.s[i]) for r in seen if r.y == 0])
        x = np.array([model.features(model.kept(r.s[i], r.n)) for r in seen])
        model.weights = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(model.weights), -700, 700))), 1e-12, 1 - 1e-12)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0] - 1e-12:
            best = loss, model
    return best[1]


def _token_counts(texts: DataFrame) -> DataFrame:
    """(fold, w, y, x): toxic and clean texts (text, toxic, fold) of a fold that hold a word."""

    def count(batches: Iterator) -> Iterator:
        from collections import Counter, defaultdict

        seen = defaultdict(Counter)
        for batch in batches:
            for text, y, f in zip(*batch.columns):
                seen[f.as_py(), y.as_py()].update(set(tokens(text.as_py())))  # once a text: a passage that repeats a word is one witness
            if sum(map(len, seen.values())) > 300_000:
                yield from rows(seen)
                seen.clear()
        yield from rows(seen)

    def rows(seen):
        import pyarrow as pa

        for f in sorted({f for f, _ in seen}):
            toxic, clean = seen.get((f, 1), {}), seen.get((f, 0), {})
            words = sorted(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(words), pa.int32()), pa.array(words, pa.string()), pa.array([toxic.get(w, 0) for w in words], pa.int64()),
                 pa.array([clean.get(w, 0) for w in words], pa.int64())], names=["fold", "w", "y", "x"])

    return texts.mapInArrow(count, "fold int, w string, y long, x long").groupBy("fold", "w").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))


def _token_models(counts: DataFrame) -> dict[tuple[int | None, tuple[float, float]], Model]:
    """Token scores and lambda by (fold left out or None, (prior's weight, significance level))."""
    total = {r.fold: (r.y, r.x) for r in counts.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("x").alias("x")).collect()}
    per = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in "yx"]
    wide = counts.groupBy("w").agg(F.sum("y").alias("y"), F.sum("x").alias("x"), *per)
    every = sum(v[0] for v in total.values()), sum(v[1] for v in total.values())
    sets = [(-1, F.col("y"), F.col("x"), *every)]
    for f in range(FOLDS):
        t, c = total.get(f, (0, 0))
        sets.append((f, F.col("y") - F.col(f"y{f}"), F.col("x") - F.col(f"x{f}"), every[0] - t, every[1] - c))
    rows = [F.struct(F.lit(f).alias("fold"), y.alias("y"), x.alias("x"), F.lit(n1).cast("double").alias("n1"), F.lit(n0).cast("double").alias("n0"),
                     F.lit(float(q)).alias("q")) for f, y, x, n1, n0 in sets if n1 and n0 for q in PRIORS]
    long = wide.select("w", F.explode(F.array(*rows)).alias("r")).select("w", "r.*").filter("y + x > 0")
    long = long.withColumn("a", F.expr("(y + x) * q")).withColumn("a0", F.expr("q * (n1 + n0)"))
    scored = long.selectExpr(
        "fold", "q", "w", "(x + a) / (n0 + a0) as p", "ln((y + a) / (n1 + a0 - y - a)) - ln((x + a) / (n0 + a0 - x - a)) as s",
        "sqrt(1 / (y + a) + 1 / (x + a)) as e").withColumn("z", F.expr("abs(s) / e"))
    # significant words of a bounded number of texts
    table = scored.filter(F.col("z") >= min(LEVELS)).orderBy("fold", "q", "w").collect()
    out = {}
    for f in (None, *range(FOLDS)):
        for q in PRIORS:
            mine = [r for r in table if r.fold == (-1 if f is None else f) and r.q == q]
            for z in LEVELS:
                words = [r for r in mine if r.z >= z]
                m = out[f, (q, z)] = Model(scores={r.w: r.s for r in words})
                if words:
                    p = np.array([r.p for r in words])
                    m.lam = _lambda(np.array([r.s for r in words]), p, max(0.0, 1 - float(p.sum())))
    return out


def _calibrate_k(model: Model, clean: list[tuple[int, list[float]]]) -> None:
    """K from the segments' scores in clean texts, (tokens, scores) each."""
    scores = [x for _, s in clean for x in s]
    least = min(scores, default=0.0)
    model.k = max(1e-9, (len(scores) + 1) / (max(1, sum(n for n, _ in clean)) * math.exp(-model.lam * least)))


PASSAGES = "array<struct<start:int,end:int,score:double,p:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """doc_id, score and passages (character spans of significant segments); one row per input row.

    Null and empty texts have no segment and get the score of such texts; repeated
    rows and null ids give rows like any other; an empty table gives an empty one.
    Other columns are not read.
    """
    common.tune(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, score double" + f", passages {PASSAGES}" * passages
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of at most TRAIN_ROWS texts

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                text = text.as_py()
                found = m.significant(tokens(text))
                scores.append(m.score(found))
                if passages:
                    at = [x.span() for x in _TOKENS.finditer(text.lower())] if found else []
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": x, "p": p} for x, a, b, p in found])
            cols = [batch.column(0), pa.array(scores, pa.float64())]
            if passages:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "passages"][: len(cols)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score stays below threshold, with all their columns, in one pass over the texts."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            keep = [m.score(m.significant(tokens(t.as_py()))) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
