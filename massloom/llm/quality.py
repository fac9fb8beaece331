"""Quality classifier by co-training of two views.

One view sees what the text says: hashed word uni- and bigrams, and statistics of words, letters, lines, marks and separators.
The other sees what is said about the page, and nothing of the text: source, language, both together, and bands of the declared
length.  Each trains a logistic model on the labelled rows; over several rounds each model reads all unlabelled
documents, on the executors, and gives the other view those of which it is most sure, as pseudo-labels.  How sure a view is, is
calibrated and proven in each round on labelled rows that its models did not see: a view that knows nothing teaches nothing.  At last
both are calibrated so, and a logistic model combines their log-odds; its probability scores all documents.

Texts cross to Python once: features of every document are written, about 400 bytes each, and training, every round and
scoring read that table.  Bounded, by documented parameters, is what fits a model: at most ``max_labelled`` labelled rows, those of
least hash of the id, so a rerun takes the same, and at most ``per_round`` pseudo-labels a round and view, picked from all documents.

Defined cases: a null or empty text has all statistics 0, null metadata is a value of its own; labels that are null are
left out and of several labels of one id the mean counts; without labels of both classes every document
scores 1 and stays; with a class of one labelled row the views are not calibrated and count alike; rows repeated score alike; no
rows give no rows; very long texts are read whole.  Columns are renamed apart, so none clashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .rows import few, least_by_hash, unboxed, whole

MAX_LABELLED, PER_ROUND = 12_000, 500
META_COLS = ("source", "lang", "n_chars")
#: Statistics of texts, buckets of n-grams and of names.
STATS, GRAMS, NAMES = 14, 64, 64
#: Documents whose features are made, and rows that are widened, at once.
SLICE = 500
_LETTER = re.compile(r"[^\W\d_]+")
_CAPS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")
_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
_BARE = re.compile(r"(?<!\S)[\W_]")


def text_features(text: str | None) -> list[float]:
    """Statistics and hashed n-grams of one text; statistics are near 0 to 1 or logarithms."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * (STATS + GRAMS)
    n, chars = len(words), len(text)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, n)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    counts = np.unique(h, return_counts=True)[1]
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _LETTER.findall(text)))
    caps = sum(map(len, _CAPS.findall(text)))
    content = [letters / n / 10, len(counts) / n, counts.max() / n, (h[1:] == h[:-1]).sum() / n, len(np.unique(pairs)) / max(1, n - 1), caps / max(1, letters), letters / chars]
    grams = np.concatenate([h, pairs])
    grams = (grams ^ (grams >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    sign = 1.0 - 2.0 * ((grams >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    hashed = np.bincount((grams >> np.uint64(58)).astype(np.int64), sign, GRAMS) / np.sqrt(len(grams))
    layout = [np.log1p(n), len(_MARKS.findall(text)) / n, len(_BARE.findall(text)) / n, text.count("|") / n, len(set(lines)) / max(1, len(lines)), min(n / max(1, len(lines)) / 100, 5.0), np.log1p(len(lines))]
    return [*content, *layout, *hashed.tolist()]


def name_features(values: Sequence) -> np.ndarray:
    """Hashed one-hot of names, of the first two together, and of bands of numbers."""
    out = np.zeros(NAMES)
    names = []
    for v in values:
        number = isinstance(v, (int, float, np.integer, np.floating)) and v == v
        names.append("" if v is None or v != v else f"{4 * np.log1p(max(0.0, float(v))):.0f}" if number else str(v))
    names.append(" ".join(names[:2]))
    for k, name in enumerate(names):
        out[zlib.crc32(f"{k}={name}".encode("utf-8", "surrogatepass")) % NAMES] = 1.0
    return out


#: Where statistics take steps, as quantiles of the training rows.
STEPS = (0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99)


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps, on standardised features and, for the first ``stats`` of them, on steps at
    their quantiles, which let a feature count for much or little on either tail whatever lies beyond."""

    mean: np.ndarray
    scale: np.ndarray
    stepped: np.ndarray
    edges: np.ndarray
    weight: np.ndarray
    #: Slope and offset that calibrate the log-odds, where sureness is asked for.
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, stats: int, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        edges = np.quantile(x[:, :stats], STEPS, axis=0)
        stepped = np.array([c for c in range(edges.shape[1]) if len(np.unique(edges[:, c])) > 2], int)  # not those of two values
        model = cls(mean, scale, stepped, edges[:, stepped], np.zeros(x.shape[1] + len(STEPS) * len(stepped) + 1))
        penalty = np.full(len(model.weight), ridge)
        penalty[-1] = 1e-6
        for _ in range(8):
            g, h = penalty * model.weight, np.diag(penalty)
            for lo in range(0, len(x), SLICE):  # rows are widened a slice at a time
                z = model._expand(x[lo : lo + SLICE])
                p = 1 / (1 + np.exp(-np.clip(z @ model.weight, -30, 30)))
                g += z.T @ (p - y[lo : lo + SLICE])
                h += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
            step = np.linalg.solve(h, g)
            model.weight = model.weight - step
            if np.abs(step).max() < 1e-6:
                break
        return model

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -3, 3)
        steps = [x[:, self.stepped] > e for e in self.edges]
        return np.hstack([z, *steps, np.ones((len(z), 1))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        parts = [self._expand(x[lo : lo + SLICE]) @ self.weight for lo in range(0, max(1, len(x)), SLICE)]
        return np.clip(np.concatenate(parts), -15, 15)

    def sureness(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of good, to nine digits: alike however rows are batched."""
        return np.round(1 / (1 + np.exp(-(self.line[0] * self.odds(x) + self.line[1]))), 9)


@dataclass
class Scorer:
    """Both views, calibrated, and what combines them."""

    text: Logistic | None = None
    meta: Logistic | None = None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) probabilities of good quality."""
        if self.text is None or self.meta is None:
            one = np.ones(len(text))
            return one, one, one
        t, m = (a * model.odds(x) + b for model, x, (a, b) in zip((self.text, self.meta), (text, meta), self.calibration, strict=True))
        p = lambda z: 1 / (1 + np.exp(-z))
        return p(self.mix[0] * t + self.mix[1] * m + self.mix[2]), p(t), p(m)


def _line(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a plain logistic model; weights of views are not negative."""
    z = np.hstack([columns, np.ones((len(columns), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p) + 1e-4)[:, None]).T @ z + np.eye(len(w)) * 0.5, z.T @ (p - y) + 0.5 * w)
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def surest(p: np.ndarray, keys: np.ndarray, good: int, bad: int, sure: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``good`` rows of highest p and the ``bad`` of lowest, none less sure than ``sure`` asks of its class; ties by key."""
    up, down = np.lexsort((keys, -p))[:good], np.lexsort((keys, p))[:bad]
    return up[p[up] >= sure[0]], down[1 - p[down] >= sure[1]]


def proven(right: np.ndarray, share: float, z: float = 1.645) -> bool:
    """Whether so many right answers beat a class's share of all rows: by the lower end of Wilson's interval, wrong once in twenty."""
    n = len(right)
    if not n:
        return False
    r = right.mean()
    return (r + z * z / (2 * n) - z * np.sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n) > share


class ArrayPool:
    """Unlabelled rows in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.views, self.keys = (text, meta), np.arange(len(text)) if keys is None else keys

    def __len__(self) -> int:
        return len(self.keys)

    def surest(self, model: Logistic, view: int, good: int, bad: int, sure: tuple[float, float], skip: set[int]) -> list[tuple[int, float, np.ndarray]]:
        """(key, label, features for the other view) that the model of ``view`` is surest of."""
        free = np.array([i for i, k in enumerate(self.keys.tolist()) if k not in skip], int)
        if not len(free):
            return []
        up, down = surest(model.sureness(self.views[view][free]), self.keys[free], good, bad, sure)
        other = self.views[1 - view]
        return [(int(self.keys[i]), v, other[i]) for v, at in ((1.0, free[up]), (0.0, free[down])) for i in at]


class TablePool:
    """Unlabelled rows of a feature table: every one is scored, by the executors, and the surest come back."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.n = rows.count()

    def __len__(self) -> int:
        return self.n

    def surest(self, model: Logistic, view: int, good: int, bad: int, sure: tuple[float, float], skip: set[int]) -> list[tuple[int, float, np.ndarray]]:
        mine, other = ("t", "m") if view == 0 else ("m", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, keys = model.sureness(matrix(b.column(mine))), b.column("key").to_numpy()
                free = np.array([i for i, k in enumerate(keys.tolist()) if k not in skip], int)
                up, down = surest(p[free], keys[free], good, bad, sure)
                at = np.concatenate([free[up], free[down]])
                label = np.repeat([1.0, 0.0], [len(up), len(down)])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(label), pa.array(np.where(label > 0, p[at], 1 - p[at])), b.column(other).take(pa.array(at))], names=["key", "label", "p", "x"])

        found = self.rows.select("key", "t", "m").mapInArrow(run, "key long, label double, p double, x binary")
        found = materialize(found, "surest")
        out: dict[int, tuple[int, float, np.ndarray]] = {}
        for label, n in ((1.0, good), (0.0, bad)):
            for r in found.where(F.col("label") == label).orderBy(F.desc("p"), "key").limit(n).collect():
                out.setdefault(r["key"], (r["key"], label, np.frombuffer(r["x"], np.float32).astype(float)))
        return list(out.values())


def co_train(
    text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: ArrayPool | TablePool, rounds: int = 4, share: float = 0.05, per_round: int = PER_ROUND, sure: float = 0.95, folds: int = 5, seed: int = 7,
    stats: tuple[int, int] = (STATS, 0),
) -> Scorer:
    """``text``, ``meta``, ``label`` (1 good, 0 bad): labelled rows.  Each round a view gives at most ``share`` of the pool and
    ``per_round`` rows, in the classes' proportion, of which it is at least ``sure``, and twice as sure as the class's share alone would
    let it be; it teaches only if, for both classes, labelled rows of which it is so sure prove it right more often than that share.  Sureness, calibration and mix are fitted on odds that models give to folds that they did not see; with a class of one labelled
    row there are no folds, and nothing is taught."""
    label = label.astype(float)
    if len(np.unique(label)) < 2:
        return Scorer()
    views, base = (text, meta), label.mean()
    taught: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # by view: pseudo-labels that the other gave

    def train(k: int, own: np.ndarray) -> Logistic:
        extra = [taught[k][i] for i in sorted(taught[k])]
        x = np.concatenate([views[k][own], *([np.stack([x for _, x in extra])] if extra else [])])
        return Logistic.fit(x, np.concatenate([label[own], [y for y, _ in extra]]), stats[k])

    known = np.arange(len(label))
    folds = min(folds, int(min((label == 1).sum(), (label == 0).sum())))
    if folds < 2:
        return Scorer(train(0, known), train(1, known))
    # each class is dealt to the folds evenly
    order = np.random.default_rng(seed).permutation(len(known))
    fold = np.empty(len(known), int)
    for c in (0, 1):
        at = order[label[order] == c]
        fold[at] = np.arange(len(at)) % folds

    def unseen(k: int) -> np.ndarray:
        """Log-odds of the labelled rows by models that did not see them."""
        odds = np.zeros(len(known))
        for f in range(folds):
            odds[fold == f] = train(k, known[fold != f]).odds(views[k][fold == f])
        return odds

    most = max(1, min(per_round, int(share * len(pool))))
    limits = (max(sure, (1 + base) / 2), max(sure, 1 - base / 2))
    for _ in range(rounds if len(pool) else 0):
        models = [train(0, known), train(1, known)]
        asked = []
        for k in (0, 1):
            odds = unseen(k)
            models[k].line = tuple(_line(odds[:, None], label))  # type: ignore[assignment]
            p = 1 / (1 + np.exp(-(models[k].line[0] * odds + models[k].line[1])))
            able = proven(label[p >= limits[0]], base) and proven(1 - label[1 - p >= limits[1]], 1 - base)
            asked.append(limits if able else (np.inf, np.inf))
        for k in (0, 1):
            for i, y, x in pool.surest(models[k], k, max(1, round(most * base)), max(1, round(most * (1 - base))), asked[k], set(taught[1 - k])):
                taught[1 - k][i] = (y, x)
    scorer = Scorer(train(0, known), train(1, known))
    odds = np.stack([unseen(0), unseen(1)])
    scorer.calibration = tuple(tuple(_line(o[:, None], label)) for o in odds)  # type: ignore[assignment]
    both = np.stack([a * o + b for o, (a, b) in zip(odds, scorer.calibration, strict=True)], axis=1)
    scorer.mix = tuple(_line(both, label))  # type: ignore[assignment]
    return scorer


def matrix(column: pa.Array) -> np.ndarray:
    """Binary rows of floats as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(float)


def row_key(docs: DataFrame, id_col: str, text_col: str, meta_cols: Sequence[str]) -> Column:
    """A hash of all that a row's features are made of, and its id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, text_col, *meta_cols)])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = META_COLS) -> DataFrame:
    """(doc_id, key, t, m) of every row: features of either view, as floats in bytes."""
    ship_package(docs.sparkSession)
    n_meta = len(meta_cols)
    view = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(docs, id_col, text_col, meta_cols).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(meta_cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_ in batches:
            for lo in range(0, whole_.num_rows, SLICE):
                b = whole_.slice(lo, SLICE)
                t, m = [], []
                names = [b.column(f"m{k}").to_pylist() for k in range(n_meta)]
                for i, text in enumerate(b.column("text").to_pylist()):
                    t.append(np.array(text_features(text), np.float32).tobytes())
                    m.append(name_features([v[i] for v in names]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "key", "t", "m"])

    return view.mapInArrow(run, "doc_id long, key long, t binary, m binary")


def train_on(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, **options) -> Scorer:
    """A scorer fitted on a written table of ``features``."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    label = materialize(own.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("y")), "labels")
    # ids are picked first, then their features alone come to the driver
    there = materialize(table.select("doc_id").join(few(label), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y")), "labelled")
    picked = materialize(least_by_hash(there, F.xxhash64("doc_id"), max_labelled), "picked")
    # one row for each id, that of the least key, is left on executors
    own_rows = table.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("key", "t", "m", "y"), "key").alias("x"))
    known = own_rows.select("doc_id", "x.*").toPandas()  # at most max_labelled rows
    if known.empty:
        return Scorer()
    known["at"] = known["doc_id"].map({r[0]: r[1] for r in picked.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).collect()})
    known = known.sort_values(["at", "doc_id"], kind="stable")
    pool = TablePool(materialize(table.join(few(label.select("doc_id")), "doc_id", "left_anti").where("doc_id is not null"), "pool"))
    t, m = (np.stack([np.frombuffer(x, np.float32) for x in known[c]]).astype(float) for c in ("t", "m"))
    return co_train(t, m, (known["y"].to_numpy() >= 0.5).astype(float), pool, **options)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = META_COLS, **options) -> Scorer:
    """A scorer fitted on ``docs``."""
    return train_on(materialize(features(docs, id_col, text_col, meta_cols), "features"), labels, label_col, id_col, **options)


def score_features(table: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """(doc_id, key, quality_score, text_score, meta_score, kept) of every row of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, t, m = scorer.score(matrix(b.column("t")), matrix(b.column("m")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *map(pa.array, (both, t, m, both >= threshold))], names=["doc_id", "key", "quality_score", "text_score", "meta_score", "kept"])

    ship_package(table.sparkSession)
    return table.mapInArrow(run, "doc_id long, key long, quality_score double, text_score double, meta_score double, kept boolean")


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = META_COLS) -> DataFrame:
    """One row per row of ``docs``: doc_id, quality_score, text_score, meta_score, kept."""
    return score_features(features(docs, id_col, text_col, meta_cols), scorer, threshold).drop("key")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Trains on ``docs`` and scores them, reading texts once: doc_id, key, quality_score, text_score, meta_score, kept."""
    table = materialize(features(docs), "features")
    return score_features(table, train_on(table, labels, **options), threshold)


def good_documents(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = META_COLS) -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps; texts are shuffled only where more are rejected than may be broadcast."""
    gone = materialize(scored.where("not kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "rejected")
    own = docs.select(whole(docs).alias("doc"), F.col(f"`{id_col}`").cast("long").alias("id"), row_key(docs, id_col, text_col, meta_cols).alias("key"))
    return unboxed(own.join(few(gone), own["id"].eqNullSafe(gone["_id"]) & (own["key"] == gone["_key"]), "left_anti"), docs)
