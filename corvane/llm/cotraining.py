"""Quality classification by co-training two views of a document.

The text view sees the text only: character classes, repetition, and hashed
words and word pairs. The metadata view sees source, language and the page that
carries the document (host, domain, section, number of pages), and nothing that
is computed from the text. Every document's features are written once.

Both views learn from a bounded sample of labelled rows. In every round each
view scores the whole pool of unlabelled rows and gives the ones it is surest
of, by class and in the classes' proportions, to the other view as
pseudo-labels; given rows leave the pool. How sure "surest" is comes from
histograms of the whole pool. A gift weighs what the giver's surest rows are
right beyond chance, on labelled rows held out from training, so a view without
knowledge does no harm. The rows of a round that enter a fit are a bounded
sample of all given ones.

Each view is then calibrated on the held-out rows, the two calibrated log-odds
are combined by a third fit there, without negative weights, and the
combination scores every document.

Views are additive models: a numeric feature is cut at quantiles of the
training rows, a category has a weight of its own where it is common there, and
bins are weighted by a ridge-penalised logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from corvane.llm.arrow import byte_view
from corvane.llm.hosts import domain_of, host_of, path_of
from corvane.llm.shingles import mix, words_of
from corvane.storage import materialize

#: Character classes of the text view: lower, upper, digit, space, sentence mark, other ASCII mark, line break, non-ASCII.
CLASSES = 8
STATISTICS = CLASSES + 8
WORD_BUCKETS, PAIR_BUCKETS = 32, 16
TEXT_FEATURES = STATISTICS + WORD_BUCKETS + PAIR_BUCKETS
META = ("source", "lang", "host", "domain", "section", "pages")
NEWTON_ROWS = 2048  # of a fit that are held as floating-point numbers at once, on the driver
HISTOGRAM = 4001  # bins of 0.01 of a view's log-odds, from -20 to 20
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _classes() -> np.ndarray:
    at = np.full(256, 5, np.uint8)
    at[97:123], at[65:91], at[48:58] = 0, 1, 2
    at[[9, 11, 12, 13, 32]] = 3
    at[[ord(c) for c in ".,'\"-"]] = 4
    at[10], at[128:] = 6, 7
    return at


_CLASS_OF = _classes()


def text_features(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of content features per text; a null or empty text has zeros."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for i, (t, hashes) in enumerate(zip(texts, words_of(data, offsets), strict=True)):
        if not t:
            continue
        counts = np.zeros(CLASSES, np.int64)
        for s in range(offsets[i], offsets[i + 1], 1 << 20):
            counts += np.bincount(_CLASS_OF[data[s : min(offsets[i + 1], s + (1 << 20))]], minlength=CLASSES)
        out[i, :CLASSES] = counts / counts.sum()
        words = t.split()
        n = len(words)
        if not n:
            continue
        lines = t.split("\n")
        common: dict[str, int] = {}
        for w in words:
            common[w] = common.get(w, 0) + 1
        out[i, CLASSES:STATISTICS] = (
            np.log1p(n),
            (len(t) - n + 1) / n,
            len(common) / n,
            sum(map(eq, words, words[1:])) / n,
            max(common.values()) / n,
            sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / n,
            sum(not any(map(str.isalnum, w)) for w in words) / n,
            len(set(lines)) / len(lines),
        )
        if len(hashes):
            out[i, STATISTICS : STATISTICS + WORD_BUCKETS] = np.bincount((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS) / len(hashes)
        if len(hashes) > 1:
            pairs = mix(hashes[:-1] * _PAIR + hashes[1:]) % np.uint64(PAIR_BUCKETS)
            out[i, STATISTICS + WORD_BUCKETS :] = np.bincount(pairs.astype(np.int64), minlength=PAIR_BUCKETS) / len(pairs)
    return out


@dataclass
class Additive:
    """A weight per bin: of numeric features by cuts, of categories by their common values, the last bin for all others."""

    cuts: list[np.ndarray]
    category: bool
    weights: np.ndarray

    @staticmethod
    def design(x: np.ndarray, cuts: list[np.ndarray], category: bool) -> np.ndarray:
        """Bin numbers, each feature's after the one before."""
        out, base = np.empty(x.shape, np.int64), 1
        for j, c in enumerate(cuts):
            at = np.searchsorted(c, x[:, j], side="left" if category else "right")
            if category and len(c):
                at = np.where(c[np.minimum(at, len(c) - 1)] == x[:, j], at, len(c))
            out[:, j] = base + at
            base += len(c) + 1
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, category: bool, values: int = 64, ridge: float = 1.0) -> Additive:
        cuts = []
        for j, col in enumerate(x.T):
            if category:
                found, n = np.unique(col, return_counts=True)
                cuts.append(np.sort(found[np.argsort(-n, kind="stable")[:values]]))
            else:
                bins = 12 if j < STATISTICS else 3
                cuts.append(np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(col)) > bins else np.unique(col)[1:])
        width = 1 + sum(len(c) + 1 for c in cuts)
        dense = np.zeros((len(x), width), np.uint8)  # zeros and ones
        dense[:, 0] = 1
        np.put_along_axis(dense, cls.design(x, cuts, category), 1, 1)
        return cls(cuts, category, newton(dense, y, weight, ridge))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[self.design(x, self.cuts, self.category)].sum(1)


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression over weighted rows; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        hessian, gradient = np.diag(penalty), -penalty * w
        for s in range(0, len(x), NEWTON_ROWS):
            part, to, by = x[s : s + NEWTON_ROWS].astype(np.float64, copy=False), y[s : s + NEWTON_ROWS], weight[s : s + NEWTON_ROWS]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian += (part * (by * p * (1 - p) + 1e-9)[:, None]).T @ part
            gradient += part.T @ (by * (to - p))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Gifts:
    """What a view gives in a round: rows of the pool at or above ``high`` are called good, at or below ``low`` bad."""

    low: float
    high: float
    trust: tuple[float, float]  # weights of bad and good pseudo-labels


@dataclass
class Round:
    views: dict[str, Additive]
    gifts: dict[str, Gifts]

    def labels(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """By giving view: 1 good, 0 bad, -1 not given. Rows that the views disagree on are given by neither."""
        out = {}
        for name, g in self.gifts.items():
            z = self.views[name].logit(x[name])
            out[name] = np.where(z >= g.high, 1, np.where(z <= g.low, 0, -1))
        a, b = out.values()
        clash = (a >= 0) & (b >= 0) & (a != b)
        a[clash] = b[clash] = -1
        return out


@dataclass
class Model:
    views: dict[str, Additive]
    calibration: dict[str, np.ndarray]  # of each view: intercept and slope
    combined: np.ndarray  # intercept and a weight for each calibrated view
    rounds: list[Round] = field(default_factory=list)

    def scores(self, x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Calibrated probability of good quality by text, by metadata, and together."""
        a, b = (self.calibration[n][0] + self.calibration[n][1] * self.views[n].logit(x[n]) for n in VIEWS)
        logits = a, b, self.combined[0] + self.combined[1] * a + self.combined[2] * b
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in logits)


VIEWS = ("text", "meta")


def histogram(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((z + 20) * 100), 0, HISTOGRAM - 1).astype(np.int64)


def surest(counts: np.ndarray, share: float, good: float) -> tuple[float, float]:
    """``(low, high)`` limits of a view's log-odds beyond which lie at most ``share`` of the pool, the good and bad in proportion; an end bin that alone holds more is given whole."""
    total = counts.sum()
    below, above = np.cumsum(counts), np.cumsum(counts[::-1])
    low = max(int(np.searchsorted(below, share * (1 - good) * total, side="right")) - 1, int(np.flatnonzero(counts)[0]))
    high = HISTOGRAM - 1 - max(int(np.searchsorted(above, share * good * total, side="right")) - 1, int(np.flatnonzero(counts[::-1])[0]))
    if low >= high:  # a view that tells nothing apart gives nothing
        return -np.inf, np.inf
    return low / 100 - 20 + 0.005, high / 100 - 20 - 0.005


def trust(z: np.ndarray, y: np.ndarray, gifts: tuple[float, float]) -> tuple[float, float]:
    """How far beyond chance the rows past each limit are right, 0 to 1, on held-out rows."""
    out = []
    for label, past in ((0, z <= gifts[0]), (1, z >= gifts[1])):
        base = (y == label).mean()
        right = ((y[past] == label).sum() + base) / (past.sum() + 1)
        out.append(float(max(0.0, (right - base) / max(1 - base, 1e-9))))
    return out[0], out[1]


def combine(both: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights of the two calibrated views; a view that would count against itself is left out."""
    ones, all_rows = np.ones(len(y)), np.ones(len(y))
    w = newton(np.stack([ones, *both.T], 1), y, all_rows, 0.01)
    if (w[1:] < 0).any():
        best = int(np.argmax(w[1:]))
        alone = newton(np.stack([ones, both[:, best]], 1), y, all_rows, 0.01)
        w = np.zeros(3)
        w[0], w[1 + best] = alone[0], max(alone[1], 0.0)
    return w


def cotrain(x: dict[str, np.ndarray], y: np.ndarray, pool, rounds: int = 3, share: float = 0.1) -> Model | None:
    """Co-train on labelled rows, every third of which is held out; None where the labels have one class only.

    ``pool.counts(views, before)`` gives each view's histogram over the rows
    that no round of ``before`` gave away, and ``pool.given(round, before)``
    rows that it gives now: features by view and labels by giving view.
    """
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    train = {n: [(x[n][~held], y[~held], np.ones((~held).sum()))] for n in VIEWS}

    def refit() -> dict[str, Additive]:
        return {n: Additive.fit(*(np.concatenate(c) for c in zip(*train[n], strict=True)), n == "meta") for n in VIEWS}

    views, past = refit(), []
    for _ in range(rounds):
        counts = pool.counts(views, past)
        if not counts["text"].sum():
            break
        limits = {n: surest(counts[n], share, y[~held].mean()) for n in VIEWS}
        now = Round(views, {n: Gifts(*limits[n], trust(views[n].logit(x[n][held]), y[held], limits[n])) for n in VIEWS})
        got, labels = pool.given(now, past)
        for giver, taker in (VIEWS, VIEWS[::-1]):
            some = labels[giver] >= 0
            train[taker].append((got[taker][some], labels[giver][some].astype(np.float64), np.array(now.gifts[giver].trust)[labels[giver][some]]))
        past.append(now)
        views = refit()
    ones = np.ones(held.sum())
    calibration = {n: newton(np.stack([ones, views[n].logit(x[n][held])], 1), y[held], ones, 0.01) for n in VIEWS}
    both = np.stack([calibration[n][0] + calibration[n][1] * views[n].logit(x[n][held]) for n in VIEWS], 1)
    return Model(views, calibration, combine(both, y[held]), past)


def _matrices(b) -> dict[str, np.ndarray]:
    """The two feature matrices of a batch whose first columns are ``t`` and ``m``."""
    flat = [np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (0, 1)] if b.num_rows else [np.zeros((0, TEXT_FEATURES)), np.zeros((0, len(META)))]
    return {"text": flat[0].astype(np.float64), "meta": flat[1]}


class Pool:
    """All unlabelled rows of a feature table, scored where they are."""

    def __init__(self, rows: DataFrame, sample: int):
        self.rows, self.sample = rows, sample

    def counts(self, views: dict[str, Additive], before: list[Round]) -> dict[str, np.ndarray]:
        held = self.rows.sparkSession.sparkContext.broadcast((views, before))

        def run(batches):
            views, before = held.value
            total = {n: np.zeros(HISTOGRAM, np.int64) for n in VIEWS}
            for b in batches:
                x = _matrices(b)
                left = np.ones(b.num_rows, bool)
                for r in before:
                    left &= np.all([g < 0 for g in r.labels(x).values()], 0)
                for n in VIEWS:
                    total[n] += np.bincount(histogram(views[n].logit(x[n][left])), minlength=HISTOGRAM)
            for i, n in enumerate(VIEWS):
                at = np.flatnonzero(total[n])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(total[n][at], pa.int64())], names=["view", "bin", "n"])

        found = self.rows.select("t", "m").mapInArrow(run, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toArrow()
        out = {n: np.zeros(HISTOGRAM, np.int64) for n in VIEWS}
        for i, n in enumerate(VIEWS):
            here = found.column("view").to_numpy() == i
            out[n][found.column("bin").to_numpy()[here]] = found.column("n").to_numpy()[here]
        self.left = int(out["text"].sum())
        return out

    def given(self, now: Round, before: list[Round]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """About ``sample`` of the rows given in a round, chosen by a hash of the row."""
        held = self.rows.sparkSession.sparkContext.broadcast((now, before))

        def run(batches):
            now, before = held.value
            for b in batches:
                x = _matrices(b)
                labels = now.labels(x)
                keep = np.any([g >= 0 for g in labels.values()], 0)
                for r in before:
                    keep &= np.all([g < 0 for g in r.labels(x).values()], 0)
                at = pa.array(np.flatnonzero(keep), pa.int64())
                extra = [pa.array(labels[n][keep], pa.int32()) for n in VIEWS]
                yield pa.RecordBatch.from_arrays([*(pa.RecordBatch.take(b, at).column(i) for i in range(3)), *extra], names=["t", "m", "draw", *VIEWS])

        rows = self.rows.select("t", "m", "draw").mapInArrow(run, "t array<float>, m array<int>, draw double, text int, meta int")
        rate = min(1.0, self.sample / max(1.0, 0.2 * self.left))
        got = rows.where(F.col("draw") < rate).limit(4 * self.sample).toArrow().combine_chunks()
        got = got.sort_by("draw").to_batches()
        if not got:
            return {"text": np.zeros((0, TEXT_FEATURES)), "meta": np.zeros((0, len(META)), np.int32)}, {n: np.zeros(0, np.int64) for n in VIEWS}
        return _matrices(got[0]), {n: got[0].column(3 + i).to_numpy().astype(np.int64) for i, n in enumerate(VIEWS)}


def features(docs: DataFrame, pages: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``key, doc_id, t, m, draw`` of every row of ``docs(doc_id, text, source, lang)``, written once.

    ``pages(page_id, url)`` adds where a document was found: of the pages whose
    path has its number as a part, the host and path that come first.
    """

    def run(batches):
        for b in batches:
            t = text_features(b.column(0).to_pylist(), *byte_view(b.column(0))[:2])
            flat = pa.ListArray.from_arrays(np.arange(len(t) + 1, dtype=np.int32) * TEXT_FEATURES, pa.array(t.reshape(-1), pa.float32()))
            yield pa.RecordBatch.from_arrays([flat, *b.columns[1:]], names=["t", "key", "doc_id", "source", "lang", "seed"])

    inputs = docs.select("text", F.col(key).alias("key"), "doc_id", "source", "lang", F.xxhash64("text").alias("seed"))
    rows = inputs.mapInArrow(run, StructType([StructField("t", ArrayType(FloatType())), *inputs.drop("text").schema.fields]))
    if pages is None:
        found = rows.withColumn("host", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast("string")).withColumn("pages", F.lit(None).cast("long"))
    else:
        url = F.col("url")
        number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:[/.]|$)", 1)
        carried = pages.select(F.when(number != "", number.cast("long")).alias("doc_id"), host_of(url).alias("host"), path_of(url).alias("path")).where("doc_id is not null")
        carried = carried.groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("at"), F.count(F.lit(1)).alias("pages")).select("doc_id", "at.host", "at.path", "pages")
        found = rows.join(carried, "doc_id", "left")
    section = F.regexp_extract("path", "^/([^/]*)/", 1)
    values = (F.col("source"), F.col("lang"), F.col("host"), domain_of(F.col("host")), section, F.least("pages", F.lit(8)))
    coded = F.array(*[F.when(v.isNull(), 0).otherwise(F.hash(v)) for v in values])
    draw = F.pmod(F.xxhash64("doc_id", "seed"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return materialize(found.select("key", "doc_id", "t", coded.alias("m"), draw.alias("draw")), "features")


def fit(rows: DataFrame, labels: DataFrame, sample: int = 6000, rounds: int = 3) -> Model | None:
    """Fit from about ``sample`` labelled rows of :func:`features`, chosen by a hash of id and text, and the pool of all others.

    ``labels(doc_id, quality)``; a document labelled more than once counts as
    good only if all its labels say so, null labels do not count. Each round
    adds about ``sample`` pseudo-labelled rows at most. Rows that repeat id and
    text share a hash: should they be too many, four times ``sample`` are taken.
    None where there are no labels of both kinds.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.least(F.min("quality"), F.lit(1)).alias("quality"))
    n = marked.count()
    if not n:
        return None
    chance = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = marked.where(chance < min(1.0, sample / n)).limit(4 * sample)
    some = F.broadcast(some)  # at most 4 * sample rows
    got = rows.join(some, "doc_id").select("t", "m", "draw", "doc_id", "quality").limit(4 * sample).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("draw", "ascending")]).to_batches()
    if not got:
        return None
    pool = Pool(rows.join(some.select("doc_id"), "doc_id", "left_anti"), sample)
    return cotrain(_matrices(got[0]), got[0].column(4).to_numpy().astype(np.float64), pool, rounds)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """``key, text_score, meta_score, score`` of every row of :func:`features`; without a model every score is 1."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("key").schema.add("text_score", "double").add("meta_score", "double").add("score", "double")

    def run(batches):
        for b in batches:
            got = [np.ones(b.num_rows)] * 3 if held.value is None else held.value.scores(_matrices(b))
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array(g, pa.float64()) for g in got)], names=schema.names)

    return rows.select("t", "m", "key").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, key: str = "doc_id", sample: int = 6000, rounds: int = 3) -> DataFrame:
    """``key, text_score, meta_score, score`` of every row of ``docs(doc_id, text, source, lang)``.

    Null and empty texts have the features of an empty text; null metadata is a
    value of its own; repeated rows score alike; without labels of both kinds
    every score is 1; other columns are not read; an empty table gives an empty
    one.
    """
    rows = features(docs, pages, key)
    return score(rows, fit(rows, labels, sample, rounds)).withColumnRenamed("key", key)
