"""Classifiers of contents pages and chapter openings, each book scored by models that never saw it.

Logistic regression with balanced classes and a quadratic penalty, fitted by Newton's method for all folds and labels
at once.  A fold is what one model leaves out; its model's sums are those over all other rows.  One pass over the rows
adds up, for each fold and label, the loss, its gradient and its second derivatives: numbers whose count depends on the
folds, labels and features alone.  Tasks send these sums, the driver solves one small system for each model, and the
next pass begins; ten passes or so fit all models, however many there are.

Rows are read as arrays in batches inside tasks, so a pass needs no copy of a row for each fold.

Where each book is a fold, its model is close to the one of all rows.  Sums of the loss over all rows are expanded about
that one to the fourth derivative, numbers whose count depends on the features alone; a task takes a book's own rows off
and solves for its models.  A bound on what the expansion leaves out says how far a model can be off; books above
``CERTAIN`` are fitted on all other rows in passes, so many at a time, so each model is that of a plain fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import layout, ranks
from folio.operators.tables import stored

LABELS = ("toc", "chapter_first")
FEATURES = (
    "line_count", "width_mean", "width_var", "left_mean", "left_var", "number_share", "max_font", "modal_font", "font_ratio",
    "first_top", "last_top", "heads", "previous_lines", "previous_numbers", "edge_distance", "lines_to_median", "font_to_body",
)
#: Books that may each be a fold of their own; more need a stated number of folds, each of several books.
MOST_FOLDS = 1024
PENALTY = 1.0
PASSES = 60
CLOSE = 1e-10
#: How far a coefficient on scaled features may be from that of a plain fit.
CERTAIN = 1e-7
#: Books whose models are summed up for at once, and scores of rows by models that a batch makes at once.
AT_ONCE = 1024
SCORES = 1 << 20
RECALL_TOLERANCE = 0.9


def feature_table(lines: DataFrame, labels: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(book_id, page_index, label, features, augmented) of all labelled pages whose layout could be read.

    Features of a page without some measure are 0, as are those of a page's neighbour where it has none.  Texts are read
    once: narrow tables of measured lines and of pages are written and read again by each of the steps that follow.
    """
    rows = layout.context_features(stored(layout.page_features(stored(layout.measured(lines)))), n_pages)
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES))
    return labels.join(rows.select("book_id", "page_index", x.alias("features")), ["book_id", "page_index"]).select("book_id", "page_index", "label", "features", F.lit(False).alias("augmented"))


def with_folds(rows: DataFrame, folds: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with the number of the fold that leaves their book out, and the number of folds.

    Each book is a fold of its own, or, with ``folds``, one of so many groups by a hash of its id.
    """
    if folds is not None:
        return rows.withColumn("fold", F.pmod(F.xxhash64("book_id"), F.lit(folds)).cast("int")), folds
    books = [r[0] for r in rows.select("book_id").distinct().orderBy("book_id").limit(MOST_FOLDS + 1).collect()]
    if len(books) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} books: state a number of folds")
    numbers = rows.sparkSession.createDataFrame(list(enumerate(books)), f"fold int, book_id {rows.schema['book_id'].dataType.simpleString()}")
    return rows.join(F.broadcast(numbers), "book_id"), len(books)


def _batches(batches: Iterator[pa.RecordBatch], labels: tuple[str, ...]):
    for batch in batches:
        if batch.num_rows:
            features = batch.column("features")
            x = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(batch.num_rows, -1)
            is_label = [pc.fill_null(pc.equal(batch.column("label"), name), False).to_numpy(zero_copy_only=False) for name in labels]
            yield batch.column("fold").to_numpy(), x, np.stack(is_label, 1)


def _summed(rows: DataFrame, per_batch, keys: int, width: int) -> np.ndarray:
    """Sums over all rows of what ``per_batch`` makes of a batch, an array of ``keys`` x ``width``.

    Tasks send a row for each key; rows of a key are added up before they come to the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = per_batch(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(keys), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(keys + 1, dtype=np.int32) * width), pa.array(total.ravel()))], names=["key", "v"])

    def added(table: pa.Table) -> pa.Table:
        v = np.sum([x.values.to_numpy() for x in table["v"]], axis=0)
        return pa.table({"key": table["key"][:1].cast(pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "key int, v array<double>"
    out = np.zeros((keys, width))
    for r in rows.mapInArrow(partial, schema).groupBy("key").applyInArrow(added, schema).toLocalIterator():
        out[r.key] = r.v
    return out


def _moments(rows: DataFrame, folds: int, labels: tuple[str, ...], centre: np.ndarray) -> np.ndarray:
    """For each fold's own rows: their count, positives of each label, sums and squared sums about ``centre``."""
    n, d = len(labels), len(centre)

    def per_batch(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((folds, 1 + n + 2 * d))
        for fold, x, y in _batches([batch], labels):
            x = x - centre
            np.add.at(out, fold, np.concatenate([np.ones((len(x), 1)), y, x, x * x], 1))
        return out

    return _summed(rows, per_batch, folds, 1 + n + 2 * d)


class Models:
    """Coefficients on raw features for each (fold, label); none where a fold's other books have no page of a label."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray, fitted: np.ndarray, labels: tuple[str, ...], passes: int):
        self.weights, self.intercepts, self.fitted, self.labels, self.passes = weights, intercepts, fitted, labels, passes

    def table(self, spark) -> DataFrame:
        """(fold, label, weights, intercept, fitted)."""
        rows = [
            (f, name, self.weights[f, k].tolist(), float(self.intercepts[f, k]), bool(self.fitted[f, k]))
            for f in range(len(self.weights)) for k, name in enumerate(self.labels)
        ]
        return spark.createDataFrame(rows, "fold int, label string, weights array<double>, intercept double, fitted boolean")


def fit(rows: DataFrame, folds: int, labels: tuple[str, ...] = LABELS, penalty: float = PENALTY) -> Models:
    """The models of all folds, from rows of (fold, label, features); each is fitted on the rows of all other folds.

    Features are scaled to mean 0 and deviation 1 over a model's own rows.  The loss of a row counts n / (2 n_class),
    and half the squared coefficients, not the intercept, are added.  The driver holds, for each model, a square of as
    many numbers as there are features.
    """
    rows = rows.select("fold", "label", "features")
    d = len(rows.select("features").first()[0])
    rough = _moments(rows, folds, labels, np.zeros(d)).sum(0)
    centre = rough[1 + len(labels) : 1 + len(labels) + d] / max(rough[0], 1)
    own = _moments(rows, folds, labels, centre)
    # all rows are fitted first: a model that leaves a fold out is close to that one, so that few passes sum up for each fold
    every = _newton(rows, np.array([-1]), own.sum(0, keepdims=True), own, centre, labels, penalty)
    parts = _newton(rows, np.arange(folds), own.sum(0) - own, own, centre, labels, penalty, every)
    return Models(parts.weights, parts.intercepts, parts.fitted, labels, every.passes + parts.passes)


def _scales(rest: np.ndarray, total: np.ndarray, centre: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means about ``centre``, deviations, loss of a positive and of a negative row, whether there are both) of models, from the moments of their rows."""
    d = len(centre)
    n, positive = rest[:, 0], rest[:, 1 : 1 + kinds]
    safe = np.maximum(n, 1)[:, None]
    mean = rest[:, 1 + kinds : 1 + kinds + d] / safe
    spread = np.sqrt(np.maximum(rest[:, 1 + kinds + d :] / safe - mean**2, 0))
    # what is constant but for rounding is left as it is
    whole = np.sqrt(np.maximum(total[1 + kinds + d :] / max(total[0], 1), 0))
    spread = np.where(spread > 1e-12 * np.maximum(whole, np.abs(centre)) + 1e-300, spread, 1.0)
    negative = n[:, None] - positive
    fitted = (positive > 0) & (negative > 0)
    heavy = np.where(fitted, n[:, None] / (2 * np.maximum(positive, 1)), 0.0)
    light = np.where(fitted, n[:, None] / (2 * np.maximum(negative, 1)), 0.0)
    return mean, spread, heavy, light, fitted


def _newton(rows: DataFrame, left_out: np.ndarray, rest: np.ndarray, own: np.ndarray, centre: np.ndarray, labels: tuple[str, ...], penalty: float, start: Models | None = None) -> Models:
    """A model of each label for each fold in ``left_out``, from the moments ``rest`` of its rows, begun at zero or at ``start``."""
    d, folds, kinds = len(centre), len(left_out), len(labels)
    mean, spread, heavy, light, fitted = _scales(rest, own.sum(0), centre, kinds)
    heavy, light = heavy.ravel(), light.ravel()
    count = folds * kinds
    shift, scale = np.repeat(mean, kinds, 0), np.repeat(spread, kinds, 0)
    # T takes (x - centre, 1) to the scaled features and 1
    to_scaled = np.zeros((count, d + 1, d + 1))
    to_scaled[:, np.arange(d), np.arange(d)] = 1 / scale
    to_scaled[:, :d, d] = -shift / scale
    to_scaled[:, d, d] = 1
    upper = np.triu_indices(d + 1)
    half = np.append(np.full(d, penalty), 0.0)
    leaves_out = np.repeat(left_out, kinds)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.einsum("kij,ki->kj", to_scaled, w)

        def per_batch(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((count, 1 + d + 1 + len(upper[0])))
            some = max(1, min(2048, SCORES // count))
            for fold, x, y in _batches([batch], labels):
                for k in range(0, len(x), some):
                    z = np.concatenate([x[k : k + some] - centre, np.ones((len(x[k : k + some]), 1))], 1)
                    t = np.tile(y[k : k + some], folds)
                    logit = z @ raw.T
                    weight = np.where(t, heavy, light) * (leaves_out != fold[k : k + some, None])
                    small = np.exp(-np.abs(logit))
                    p = np.where(logit >= 0, 1.0, small) / (1 + small)
                    out[:, 0] += (weight * (np.log1p(small) + np.maximum(np.where(t, -logit, logit), 0))).sum(0)
                    out[:, 1 : d + 2] += (weight * (p - t)).T @ z
                    out[:, d + 2 :] += (weight * p * (1 - p)).T @ (z[:, upper[0]] * z[:, upper[1]])
            return out

        total = _summed(rows, per_batch, count, 1 + d + 1 + len(upper[0]))
        square = np.zeros((count, d + 1, d + 1))
        square[:, upper[0], upper[1]] = total[:, d + 2 :]
        square[:, upper[1], upper[0]] = total[:, d + 2 :]
        loss = total[:, 0] + 0.5 * (half * w * w).sum(1)
        slope = np.einsum("kij,kj->ki", to_scaled, total[:, 1 : d + 2]) + half * w
        return loss, slope, to_scaled @ square @ to_scaled.transpose(0, 2, 1) + np.diag(half) + 1e-12 * np.eye(d + 1)

    w, before, step = np.zeros((count, d + 1)), np.full(count, np.inf), np.zeros((count, d + 1))
    if start is not None:
        # a model that is not fitted stays at zero
        raw, base = (np.tile(x.reshape(kinds, -1), (folds, 1)) for x in (start.weights, start.intercepts))
        w = np.where(fitted.ravel()[:, None], np.concatenate([raw * scale, base + (raw * (shift + centre)).sum(1)[:, None]], 1), 0.0)
    passes = 0
    while passes < PASSES:
        passes += 1
        loss, slope, square = sums(w)
        worse = loss > before + 1e-9 * np.abs(before)
        step = np.where(worse[:, None], step / 2, -np.linalg.solve(square, slope[:, :, None])[:, :, 0])
        # a model whose last step went too far goes back by half of it; the others go on
        w = np.where(worse[:, None], w - step, w + step)
        before = np.where(worse, before, loss)
        if not worse.any() and np.abs(step).max(initial=0.0) < CLOSE:
            break
    weights = w[:, :d] / scale
    intercepts = w[:, d] - (weights * (shift + centre)).sum(1)
    return Models(weights.reshape(folds, kinds, d), intercepts.reshape(folds, kinds), fitted, labels, passes)


class _Expansion:
    """Sums over all rows about the models of all rows: derivatives of the loss up to the fourth, for each label's positive and negative rows.

    Features are scaled by the means and deviations of all rows, and a 1 is added.  A tensor is kept by pairs of places
    in order, as it is the same for all orders of its places.
    """

    def __init__(self, rows: DataFrame, every: Models, total: np.ndarray, centre: np.ndarray, penalty: float):
        self.labels, self.total, self.centre, self.penalty = every.labels, total, centre, penalty
        self.d, kinds = len(centre), len(every.labels)
        mean, spread, heavy, light, self.fitted = (x[0] for x in _scales(total[None], total, centre, kinds))
        self.mean, self.spread = mean, spread
        raw = every.weights[0]
        self.base = np.concatenate([raw * spread, (every.intercepts[0] + raw @ (mean + centre))[:, None]], 1)
        self.upper = np.triu_indices(self.d + 1)
        wide = self.d + 1
        pairs = len(self.upper[0])
        sizes = np.cumsum([wide, pairs, pairs * wide, pairs * pairs])
        width = -(-int(sizes[-1]) // 16)

        def per_batch(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((kinds, 2, 16 * width))
            for _, x, y in _batches([batch], self.labels):
                for k in range(0, len(x), 2048):
                    z = self.scaled(x[k : k + 2048])
                    both = z[:, self.upper[0]] * z[:, self.upper[1]]
                    p = _chance(z @ self.base.T)
                    for j in range(kinds):
                        for c in (0, 1):
                            some = y[k : k + 2048, j] == c
                            own, pair, s = z[some], both[some], p[some, j]
                            q = s * (1 - s)
                            parts = ((s - c) @ own, q @ pair, ((pair.T * (q * (1 - 2 * s))) @ own).ravel(), ((pair.T * (q * (1 - 6 * q))) @ pair).ravel())
                            out[j, c, : sizes[-1]] += np.concatenate(parts)
            return out.reshape(kinds * 2 * 16, width)

        sums = _summed(rows, per_batch, kinds * 2 * 16, width).reshape(kinds, 2, 16 * width)[:, :, : sizes[-1]]
        first, second, third, fourth = np.split(sums, sizes[:-1], axis=2)
        self.tensors = first, second, third.reshape(kinds, 2, pairs, wide), fourth.reshape(kinds, 2, pairs, pairs)
        weights = np.stack([light, heavy], 1)
        self.metric = np.stack([self.square(weights[j] @ second[j]) + np.diag(np.append(np.full(self.d, penalty), 0.0)) + 1e-12 * np.eye(wide) for j in range(kinds)])
        self.furthest = np.sqrt(self._greatest(rows, np.linalg.inv(self.metric)))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.centre - self.mean) / self.spread, np.ones((len(x), 1))], 1)

    def square(self, flat: np.ndarray) -> np.ndarray:
        out = np.zeros((self.d + 1, self.d + 1))
        out[self.upper] = flat
        out.T[self.upper] = flat
        return out

    def _greatest(self, rows: DataFrame, inverse: np.ndarray) -> np.ndarray:
        """For each label the greatest square of a row's length by ``inverse``."""

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(len(inverse))
            for _, x, _ in _batches(batches, self.labels):
                for k in range(0, len(x), 2048):
                    z = self.scaled(x[k : k + 2048])
                    most = np.maximum(most, np.stack([np.einsum("ri,ij,rj->r", z, m, z, optimize=True) for m in inverse]).max(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most)), pa.int32()), pa.array(most)], names=["k", "v"])

        found = {r.k: r.v for r in rows.mapInArrow(lengths, "k int, v double").groupBy("k").agg(F.max("v").alias("v")).collect()}
        return np.array([found.get(k, 0.0) for k in range(len(inverse))])

    def raw(self, j: int, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients on raw features, and the intercept."""
        weights = w[:-1] / self.spread
        return weights, float(w[-1] - weights @ (self.mean + self.centre))

    def reach(self, j: int, w: np.ndarray) -> float:
        """How far a model's logit can be from that of the model of all rows, on any row."""
        off = w - self.base[j]
        return float(np.sqrt(max(off @ self.metric[j] @ off, 0.0)) * self.furthest[j])

    def without(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, float, bool]], float]:
        """(moments, (coefficients on scaled features, reach, whether fitted) of each label, greatest error) of the models that leave out rows.

        The error is a bound: with u the reach, the loss's fifth derivative is at most its second one, which changes by
        a factor of e^u at most, so what is left out of the slope is a sum of the rows by their second derivative times
        e^u v^4 / 24 at most, where v, a row's own share of the way, is at most u and its squares add up by the metric.
        """
        moved = x - self.centre
        own = np.concatenate([[len(x)], y.sum(0), moved.sum(0), (moved * moved).sum(0)])
        _, spread, heavy, light, fitted = (v[0] for v in _scales((self.total - own)[None], self.total, self.centre, len(self.labels)))
        z, wide = self.scaled(x), self.d + 1
        half = np.append(self.penalty * (spread / self.spread) ** 2, 0.0)
        twice = np.where(self.upper[0] == self.upper[1], 1.0, 2.0)
        out, error = [], 0.0
        for j in range(len(self.labels)):
            if not fitted[j]:
                out.append((np.zeros(wide), 0.0, False))
                continue
            weights = np.array([light[j], heavy[j]])
            first, second, third, fourth = (np.tensordot(weights, t[j], 1) for t in self.tensors)
            row_weight = np.where(y[:, j], heavy[j], light[j])
            off, flat = np.zeros(wide), self.square(second)
            for _ in range(20):
                w = self.base[j] + off
                m3, m4 = self.square(third @ off), self.square(fourth @ (twice * off[self.upper[0]] * off[self.upper[1]]))
                whole = flat + m3 + m4 / 2 + np.diag(half) + 1e-12 * np.eye(wide)
                p = _chance(z @ w)
                slope = first + flat @ off + m3 @ off / 2 + m4 @ off / 6 + half * w - z.T @ (row_weight * (p - y[:, j]))
                rest = whole - (z.T * (row_weight * p * (1 - p))) @ z
                step = -np.linalg.solve(rest, slope)
                off = off + step
                if not np.isfinite(off).all() or np.abs(step).max() < CLOSE:
                    break
            u = self.reach(j, self.base[j] + off)
            if not np.isfinite(off).all() or np.abs(step).max() >= CLOSE or u > 1:
                error = np.inf
            else:
                inverse = np.linalg.inv(rest)
                spread_of = np.einsum("ij,jk,ki->i", inverse, whole, inverse).max()
                bound = np.exp(3 * u) * u**3 / 24 * np.sqrt(max(off @ flat @ off, 0.0) * max(spread_of, 0.0))
                error = max(error, bound if np.isfinite(bound) else np.inf)
            out.append((self.base[j] + off, u, True))
        return own, out, float(error)


def _chance(logit: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(logit))
    return np.where(logit >= 0, 1.0, small) / (1 + small)


def fit_each(rows: DataFrame, labels: tuple[str, ...] = LABELS, penalty: float = PENALTY, *, certain: float = CERTAIN) -> tuple[DataFrame, Models]:
    """((fold, label, weights, intercept, fitted, reach) of the models that leave out each book, fold being its id; the models of all rows).

    ``reach`` bounds how far a model's logit is from that of the model of all rows.  Nothing that grows with the books
    is held by the driver but ``AT_ONCE`` of them.
    """
    rows = rows.select("book_id", "label", "features")
    spark, kinds, d = rows.sparkSession, len(labels), len(rows.select("features").first()[0])
    one = rows.select(F.lit(0).alias("fold"), "label", "features")
    rough = _moments(one, 1, labels, np.zeros(d))[0]
    centre = rough[1 + kinds : 1 + kinds + d] / max(rough[0], 1)
    total = _moments(one, 1, labels, centre)
    every = _newton(one, np.array([-1]), total, total, centre, labels, penalty)
    about = _Expansion(one, every, total[0], centre, penalty)

    def solve(book: pa.Table) -> pa.Table:
        batch = book.select(["label", "features"]).append_column("fold", pa.array(np.zeros(book.num_rows, np.int32))).combine_chunks().to_batches()
        _, x, y = zip(*_batches(batch, labels), strict=True)
        own, models, error = about.without(np.concatenate(x), np.concatenate(y))
        raw = [about.raw(j, w) for j, (w, _, _) in enumerate(models)]
        fitted = [m[2] for m in models]
        return pa.table({
            "fold": pa.array([book["book_id"][0].as_py()] * kinds, pa.int64()), "label": pa.array(labels), "weights": pa.array([(r[0] if f else 0 * r[0]).tolist() for r, f in zip(raw, fitted, strict=True)], pa.list_(pa.float64())),
            "intercept": pa.array([r[1] if f else 0.0 for r, f in zip(raw, fitted, strict=True)]), "fitted": pa.array(fitted), "reach": pa.array([m[1] for m in models]),
            "error": pa.array([error] * kinds), "moments": pa.array([own.tolist()] * kinds, pa.list_(pa.float64())),
        })

    schema = "fold long, label string, weights array<double>, intercept double, fitted boolean, reach double"
    columns = ["fold", "label", "weights", "intercept", "fitted", "reach"]
    # a stated number of parts: the rows are few beside the work on them
    by_book = rows.withColumn("book_id", F.col("book_id").cast("long")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "book_id")
    solved = stored(by_book.groupBy("book_id").applyInArrow(solve, f"{schema}, error double, moments array<double>"))
    found = solved.filter(F.col("error") <= certain).select(columns)
    rest, last = solved.filter((F.col("error") > certain) & (F.col("label") == labels[0])).select("fold", "moments"), None
    while block := (rest if last is None else rest.filter(F.col("fold") > last)).orderBy("fold").limit(AT_ONCE).collect():
        books, last = [r.fold for r in block], block[-1].fold
        numbers = spark.createDataFrame([(b, k) for k, b in enumerate(books)], "book_id long, fold int")
        numbered = rows.join(F.broadcast(numbers), "book_id", "left").select(F.coalesce("fold", F.lit(-1)).alias("fold"), "label", "features")
        models = _newton(numbered, np.arange(len(books)), total - np.array([r.moments for r in block]), total, centre, labels, penalty, every)
        scaled = np.concatenate([models.weights * about.spread, (models.intercepts + models.weights @ (about.mean + centre))[:, :, None]], 2)
        fitted = [
            (b, name, models.weights[k, j].tolist(), float(models.intercepts[k, j]), bool(models.fitted[k, j]), about.reach(j, scaled[k, j]) if models.fitted[k, j] else 0.0)
            for k, b in enumerate(books) for j, name in enumerate(labels)
        ]
        found = found.unionByName(stored(spark.createDataFrame(fitted, schema)))
    return found, every


def _logit() -> Column:
    return F.aggregate(F.zip_with("features", "weights", lambda a, b: a * b), F.col("intercept"), lambda s, x: s + x)


def scored(rows: DataFrame, models: Models | DataFrame) -> DataFrame:
    """(book_id, page_index, fold, label, toc, chapter_first): what the model of a row's own fold says; 0 of a label it never saw.

    Models of a few folds are sent to all tasks; those of each book (``fit_each``) are joined to its rows.
    """
    few = isinstance(models, Models)
    table, labels = (models.table(rows.sparkSession), models.labels) if few else (models, LABELS)
    out = rows
    for name in labels:
        own = table.filter(F.col("label") == name).select("fold", "weights", "intercept", "fitted")
        p = F.when(F.col("fitted"), F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit()))).otherwise(0.0)
        out = out.join(F.broadcast(own) if few else own.hint("merge"), "fold").withColumn(name, p).drop("weights", "intercept", "fitted")
    return out


def thresholds(rows: DataFrame, models: Models, recall: float) -> DataFrame:
    """(fold, label, threshold): the greatest probability that reaches a recall among the positives a model was fitted on; 1 without any."""
    table = models.table(rows.sparkSession).filter("fitted").withColumnRenamed("fold", "model")
    logit = _logit()
    met = rows.select("fold", "label", "features").join(F.broadcast(table), "label").filter(F.col("fold") != F.col("model"))
    values = met.select(F.col("model").alias("fold"), "label", (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("p"))
    wanted = values.groupBy("fold", "label").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(recall))).cast("long").alias("k"))
    found = ranks.kth_greatest(values, wanted, "fold", "label").select("fold", "label", F.col("value").alias("threshold"))
    every = models.table(rows.sparkSession).select("fold", "label")
    return every.join(found, ["fold", "label"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))


def thresholds_each(rows: DataFrame, models: DataFrame, every: Models, recall: float) -> DataFrame:
    """(fold, label, threshold) as of ``thresholds`` for the models of each book, from rows whose fold is their book.

    By the model of all rows, a book's threshold is no further from the ranks that it can have than its model's reach,
    so rows well above are counted and only rows near to it are scored.  Books of like reach share a level, so that one
    book whose rows weigh much does not widen what is near for the others.
    """
    spark = rows.sparkSession
    models = models.withColumn("level", F.greatest(F.lit(-30), F.ceil(F.log2(F.col("reach") + 1e-12))).cast("int"))
    base = every.table(spark).select("label", "weights", "intercept")
    positive = stored(rows.select("fold", "label", "features").join(F.broadcast(base), "label").withColumn("p", _logit()).select("fold", "label", "features", "p"))
    n = F.broadcast(positive.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    own = positive.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("own")).hint("merge")
    wanted = models.filter("fitted").select("fold", "label", "level", "reach").join(own, ["fold", "label"], "left").join(n, "label").withColumn("own", F.coalesce("own", F.lit(0)))
    wanted = stored(wanted.filter("n > own").withColumn("k", F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("own")) * F.lit(recall))).cast("long")))
    span = stored(wanted.groupBy("label", "level").agg(F.min("k").alias("first"), F.max(F.col("k") + F.col("own")).alias("last"), F.max("reach").alias("reach")))
    asked = span.select("label", F.explode(F.array("first", "last")).alias("k")).distinct()
    ranked = stored(ranks.kth_greatest(positive.select("label", "p"), asked, "label"))
    at = lambda name: ranked.select("label", F.col("k").alias(name), F.col("value").alias(f"{name}_at"))
    slack = 2 * F.col("reach") + 1e-9 * (1 + F.abs("first_at") + F.abs("last_at"))
    ends = span.join(at("first"), ["label", "first"]).join(at("last"), ["label", "last"])
    ends = F.broadcast(stored(ends.select("label", "level", (F.col("last_at") - slack).alias("low"), (F.col("first_at") + slack).alias("high"))))
    above = positive.select("fold", "label", "p").join(ends, "label").filter("p > high")
    counts = F.broadcast(above.groupBy("label", "level").agg(F.count(F.lit(1)).alias("above")))
    own_above = above.groupBy("fold", "label", "level").agg(F.count(F.lit(1)).alias("own_above")).hint("merge")
    wanted = wanted.join(counts, ["label", "level"], "left").join(own_above, ["fold", "label", "level"], "left")
    wanted = wanted.select("fold", "label", (F.col("k") - F.coalesce("above", F.lit(0)) + F.coalesce("own_above", F.lit(0))).alias("k"))
    near = positive.join(ends, "label").filter("p between low and high").select(F.col("fold").alias("of"), "label", "level", "features")
    table = models.filter("fitted").select("fold", "label", "level", "weights", "intercept").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fold", "label")
    met = table.join(near, ["label", "level"]).filter(F.col("fold") != F.col("of")).select("fold", "label", (F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit()))).alias("p"))
    place = met.withColumn("at", F.row_number().over(Window.partitionBy("fold", "label").orderBy(F.desc("p"))))
    found = place.join(wanted.hint("merge"), ["fold", "label"]).filter(F.col("at") == F.col("k")).select("fold", "label", F.col("p").alias("threshold"))
    return models.select("fold", "label").join(found.hint("merge"), ["fold", "label"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))


def _judged(pages: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """A row for each book from its pages (book_id, label, chosen) and its true labels (book_id, label).

    Recall counts against all true pages of a label, those whose layout was lost as well; a book without any passes.
    """
    hits = lambda name: F.count_if(F.col("chosen") & (F.col("label") == name)).alias(f"{name}_hits")
    found = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("chosen").alias("candidates"), *map(hits, LABELS))
    true = truth.groupBy("book_id").agg(*(F.count_if(F.col("label") == name).alias(f"{name}_true") for name in LABELS))
    rows = found.join(true, "book_id")
    recall = {name: F.when(F.col(f"{name}_true") > 0, F.col(f"{name}_hits") / F.col(f"{name}_true")) for name in LABELS}
    passed = (recall["toc"].isNull() | (F.col("toc_hits") > 0)) & (recall["chapter_first"].isNull() | (recall["chapter_first"] >= tolerance))
    return rows.select("book_id", "total_pages", *(recall[name].alias(f"{name}_recall") for name in LABELS), (F.col("candidates") / F.col("total_pages")).alias("candidate_share"), passed.alias("full_recall"))


def lobo_budget(rows: DataFrame, truth: DataFrame, cap: float = 0.15, *, folds: int | None = None, tolerance: float = RECALL_TOLERANCE) -> DataFrame:
    """A row for each book: what a budget of a share of its pages, the likeliest of either label, recalls."""
    from folio.operators import curate

    if folds is None:
        rows = rows.withColumn("fold", F.col("book_id").cast("long"))
        models = fit_each(rows)[0]
    else:
        rows, count = with_folds(rows, folds)
        models = fit(rows, count)
    pages = scored(rows, models).filter("not augmented")
    pages = pages.select("book_id", "page_index", "label", F.greatest(*LABELS).alias("p"))
    chosen = curate.candidate_budget(pages.select("book_id", "page_index", "p"), cap).withColumn("chosen", F.lit(True))
    marked = pages.join(chosen, ["book_id", "page_index"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return _judged(marked, truth, tolerance)


def lobo_threshold(rows: DataFrame, truth: DataFrame, recall: float = 0.9, *, folds: int | None = None, tolerance: float = RECALL_TOLERANCE) -> DataFrame:
    """A row for each book: what thresholds that reach a recall on all other books recall on it."""
    if folds is None:
        rows = rows.withColumn("fold", F.col("book_id").cast("long"))
        models, every = fit_each(rows)
        bars = thresholds_each(rows, models, every, recall)
    else:
        rows, count = with_folds(rows, folds)
        models = fit(rows, count)
        bars = thresholds(rows, models, recall)
    bars = bars.groupBy("fold").agg(*(F.max(F.when(F.col("label") == name, F.col("threshold"))).alias(f"{name}_bar") for name in LABELS))
    pages = scored(rows, models).filter("not augmented").join(bars.hint("merge") if folds is None else F.broadcast(bars), "fold")
    # a label's hits are those of its own classifier; the candidates are those of either
    reached = {name: F.col(name) >= F.col(f"{name}_bar") for name in LABELS}
    own = F.when(F.col("label") == "toc", reached["toc"]).when(F.col("label") == "chapter_first", reached["chapter_first"]).otherwise(False)
    either = reached["toc"] | reached["chapter_first"]
    share = pages.groupBy("book_id").agg((F.count_if(either) / F.count(F.lit(1))).alias("candidate_share"))
    return _judged(pages.withColumn("chosen", own), truth, tolerance).drop("candidate_share").join(share, "book_id").select("book_id", "total_pages", "toc_recall", "chapter_first_recall", "candidate_share", "full_recall")
