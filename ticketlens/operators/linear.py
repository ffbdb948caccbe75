"""Linear one-against-rest classifiers of many classes and folds, fitted together.

One pass over the rows an iteration serves all classes and folds: every task adds up the losses
and gradients of its rows for all models as one matrix, blocks of it are summed over the tasks,
and only the sums reach the driver.  There a limited-memory quasi-Newton step is taken for every
model; a step that does not lower its loss, or leaves the finite numbers, is halved, model by
model, in the next pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.plans.scale import cut_lineage

BLOCK = 8_192  # coefficients of all models that are summed in one group
ENTRIES = 1 << 15  # feature entries of a block of rows, which a task holds at once
BLOCK_COLUMNS = ["y", "fold", "weight", "sizes", "feature", "value", "by_feature"]
MEMORY = 8  # pairs of steps and gradient changes that a model remembers


def sparse_vectors(counts: list[dict[int, float]]) -> pa.RecordBatch:
    """(idx, val) of rows of {feature: value} as binary columns."""
    return pa.RecordBatch.from_arrays(
        [pa.array([np.array(list(c), np.int32).tobytes() for c in counts], pa.binary()),
         pa.array([np.array(list(c.values()), np.float32).tobytes() for c in counts], pa.binary())], names=["idx", "val"])


def _entries(idx: list[bytes], val: list[bytes]):
    """Feature, value and row of all entries of some rows."""
    sizes = np.array([len(i) // 4 for i in idx], np.int64)
    return (np.frombuffer(b"".join(idx), np.int32), np.frombuffer(b"".join(val), np.float32).astype(float),
            np.repeat(np.arange(len(idx)), sizes))


def margins(idx: list[bytes], val: list[bytes], weights: np.ndarray) -> np.ndarray:
    """rows x models: products with the weights (features + 1 x models); the last row is the intercept."""
    feature, value, row = _entries(idx, val)
    out = np.tile(weights[-1], (len(idx), 1))
    for m in range(weights.shape[1]):
        out[:, m] += np.bincount(row, value * np.ascontiguousarray(weights[:, m]).take(feature), len(idx))
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (y, fold, weight, idx, val) gathered into blocks of about ENTRIES entries, as binary columns.

    A block has its entries by row and the order that sorts them by feature, so that a pass over
    the rows adds up runs of entries, for margins and for gradients alike.
    """
    def run(batches):
        held, size = [], 0
        for y, fold, weight, idx, val in _rows(batches, ["y", "fold", "weight", "idx", "val"]):
            held.append((y, fold, weight, idx, val))
            size += sum(len(i) for i in idx) // 4
            if size >= ENTRIES:
                yield _block(held)
                held, size = [], 0
        if held:
            yield _block(held)

    return rows.select("y", "fold", "weight", "idx", "val").mapInArrow(run, ", ".join(f"{n} binary" for n in BLOCK_COLUMNS))


def _rows(batches, columns: list[str]):
    """Lists of the columns of up to a thousand rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1_000):
            yield [batch.column(c).slice(a, 1_000).to_pylist() for c in columns]


def _block(parts: list) -> pa.RecordBatch:
    y, fold, weight, idx, val = ([x for part in parts for x in part[c]] for c in range(5))
    sizes = np.array([len(i) // 4 for i in idx], np.int32)
    feature = np.frombuffer(b"".join(idx), np.int32)
    arrays = [np.array(y, np.int32), np.array(fold, np.int32), np.array(weight, float), sizes, feature,
              np.frombuffer(b"".join(val), np.float32), np.argsort(feature, kind="stable").astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=BLOCK_COLUMNS)


class _Block:
    """The arrays of a block; entries of a row, or of a feature, are summed as runs."""

    def __init__(self, cells: list[bytes]):
        kinds = [np.int32, np.int32, float, np.int32, np.int32, np.float32, np.int32]
        self.y, self.fold, self.weight, self.sizes, self.feature, value, self.order = (
            np.frombuffer(c, k) for c, k in zip(cells, kinds))
        self.feature, self.value = self.feature.astype(np.int64), value.astype(float)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """models x rows: products with weights (models x features + 1); the last one is the intercept."""
        filled = np.flatnonzero(self.sizes)
        start = np.concatenate([[0], np.cumsum(self.sizes[filled], dtype=np.int64)[:-1]])
        out = np.repeat(weights[:, -1:], len(self.sizes), axis=1)
        if len(filled):
            part = np.empty(len(self.feature))  # one buffer for all models: fresh ones cost more than the sums
            for m in range(len(weights)):
                weights[m].take(self.feature, out=part, mode="clip")
                part *= self.value
                out[m, filled] += np.add.reduceat(part, start)
        return out

    def add_gradient(self, slope: np.ndarray, grad: np.ndarray) -> None:
        """Adds the products of the slopes (models x rows) with the entries to grad (models x features + 1)."""
        grad[:, -1] += slope.sum(axis=1)
        if not len(self.feature):
            return
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.order]
        value, feature = self.value[self.order], self.feature[self.order]
        start = np.flatnonzero(np.diff(feature, prepend=-1))
        found, part = feature[start], np.empty(len(feature))
        for m in np.flatnonzero(slope.any(axis=1)):
            slope[m].take(row, out=part, mode="clip")
            part *= value
            grad[m, found] += np.add.reduceat(part, start)


def _blocks_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block([batch.column(c)[i].as_py() for c in BLOCK_COLUMNS])


def _summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum over all tasks of the vectors that run makes of the batches of a task."""
    def parts(batches):
        total = run(batches)
        if total is None:
            return
        blocks = range(0, width, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(len(blocks))), pa.int32()), pa.array([total[b:b + BLOCK].tobytes() for b in blocks], pa.binary())],
            names=["block", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), float) for p in group.column("part"))
        return pa.table({"block": group.column("block").slice(0, 1), "part": pa.array([np.asarray(total).tobytes()], pa.binary())})

    found = rows.mapInArrow(parts, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").toArrow()
    out = np.zeros(width)
    for block, part in zip(found.column("block").to_pylist(), found.column("part").to_pylist()):
        out[block * BLOCK:block * BLOCK + len(part) // 8] = np.frombuffer(part, float)
    return out


def _squared_hinge(rows: DataFrame, weights: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Losses and gradients of all models; model fold * n_classes + class leaves out the rows of its fold.

    Rows are blocks.  The last fold leaves out none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))
    width, models = weights.shape
    held_out = np.repeat(np.arange(models // n_classes), n_classes)[:, None]
    wanted = np.tile(np.arange(n_classes), models // n_classes)[:, None]

    def run(batches):
        w = shared.value
        loss, grad = np.zeros(models), np.zeros((models, width))
        seen = False
        for block in _blocks_of(batches):
            seen = True
            sign = np.where(block.y == wanted, 1.0, -1.0)
            short = np.maximum(0.0, 1.0 - sign * block.margins(w))
            used = np.where(block.fold == held_out, 0.0, block.weight)
            loss += (used * short * short).sum(axis=1)
            block.add_gradient(-2.0 * used * sign * short, grad)
        return np.concatenate([loss, grad.ravel()]) if seen else None

    total = _summed(rows, run, models + weights.size)
    shared.destroy()
    return total[:models], total[models:].reshape(models, width).T


class _Descent:
    """Steps of one model: limited-memory quasi-Newton with halving, one evaluation at a time."""

    def __init__(self, size: int, tol: float):
        self.point, self.loss, self.grad = np.zeros(size), np.inf, None
        self.trial, self.direction, self.step = self.point, None, 1.0
        self.pairs: list = []
        self.tol, self.done = tol, False

    def _ahead(self) -> np.ndarray:
        q, kept = self.grad.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, r), a in zip(self.pairs, reversed(kept)):
            q += s * (a - r * (y @ q))
        return -q

    def tell(self, loss: float, grad: np.ndarray) -> None:
        """The loss and gradient at the trial point; sets the next one."""
        if self.done:
            return
        finite = np.isfinite(loss) and np.isfinite(grad).all()
        if self.grad is not None and not (finite and loss <= self.loss + 1e-4 * self.step * (self.grad @ self.direction)):
            self.step /= 2
            if self.step < 1e-6:
                if self.pairs:  # begin again from the gradient alone
                    self.pairs, self.step = [], 1.0
                    self.direction = self._ahead()
                else:
                    self.done = True
                    return
            self.trial = self.point + self.step * self.direction
            return
        if not finite:
            raise ValueError("the loss of the first point is not finite")
        if self.grad is not None:
            s, y = self.trial - self.point, grad - self.grad
            if s @ y > 1e-12:
                self.pairs = [*self.pairs, (s, y, 1.0 / (s @ y))][-MEMORY:]
        self.point, gain, self.loss, self.grad = self.trial, self.loss - loss, loss, grad
        if np.abs(grad).max() <= self.tol or gain <= self.tol * max(1.0, abs(loss)):
            self.done = True
            return
        self.step, self.direction = 1.0, self._ahead()
        self.trial = self.point + self.direction


def _descend(size: int, models: int, evaluate, passes: int, tol: float) -> tuple[np.ndarray, int]:
    """Points of all models, one column each, and the passes made; evaluate gives losses and gradients."""
    steps = [_Descent(size, tol) for _ in range(models)]
    for made in range(1, passes + 1):
        at = np.column_stack([s.trial for s in steps])
        losses, grads = evaluate(at)
        for m, s in enumerate(steps):
            s.tell(losses[m], grads[:, m])
        if all(s.done for s in steps):
            break
    return np.column_stack([s.point for s in steps]), made


def fit_margins(rows: DataFrame, n_features: int, n_classes: int, folds: int, c: float, passes: int,
                tol: float) -> tuple[np.ndarray, int]:
    """Weights (n_features + 1) x ((folds + 1) * n_classes) and the passes made over the blocks or rows.

    Minimises half the squared norm plus c times the weighted squared hinge losses, the intercept
    being a weight of a constant feature.
    """
    models = (folds + 1) * n_classes
    if rows.columns != BLOCK_COLUMNS:
        rows = cut_lineage(blocks(rows))

    def evaluate(weights):
        loss, grad = _squared_hinge(rows, weights, n_classes)
        return 0.5 * (weights * weights).sum(axis=0) + c * loss, weights + c * grad

    return _descend(n_features + 1, models, evaluate, passes, tol)


def out_of_fold_margins(rows: DataFrame, weights: np.ndarray, n_classes: int, folds: int) -> DataFrame:
    """(y, m array<double>) of every row of the blocks by the models that did not see its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights[:, :folds * n_classes].T))

    def run(batches):
        for block in _blocks_of(batches):
            every = block.margins(shared.value).reshape(folds, n_classes, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.y), pa.array(list(every[block.fold, :, np.arange(len(block.y))]), pa.list_(pa.float64()))],
                names=["y", "m"])

    return rows.mapInArrow(run, "y int, m array<double>")


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def fit_calibration(held: DataFrame, n_classes: int, passes: int, tol: float, ridge: float = 1e-3) -> np.ndarray:
    """(n_classes + 1) x n_classes: probabilities are the softmax of the margins, with a one behind, times it.

    held has y and m; it is read once a pass, so give a saved one.
    """
    shape = (n_classes + 1, n_classes)
    size = shape[0] * shape[1]

    def evaluate(points):
        matrix = points[:, 0].reshape(shape)

        def run(batches):
            loss, grad, seen = 0.0, np.zeros(shape), False
            for batch in batches:
                for a in range(0, batch.num_rows, 100_000):
                    part = batch.slice(a, 100_000)
                    seen = True
                    y = part.column("y").to_numpy()
                    x = np.column_stack([np.array(part.column("m").to_pylist(), float), np.ones(len(y))])
                    p = softmax(x @ matrix)
                    loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
                    p[np.arange(len(y)), y] -= 1.0
                    grad += x.T @ p
            return np.concatenate([[loss], grad.ravel()]) if seen else None

        total = _summed(held, run, 1 + size)
        return (np.array([total[0] + 0.5 * ridge * (points[:, 0] ** 2).sum()]),
                (total[1:] + ridge * points[:, 0])[:, None])

    return _descend(size, 1, evaluate, passes, tol)[0][:, 0].reshape(shape)


def probabilities(shared):
    """Pandas UDF (idx, val) -> array<double>; shared holds weights of the classes and the calibration."""
    @F.pandas_udf("array<double>")
    def probability(idx: pd.Series, val: pd.Series) -> pd.Series:
        weights, matrix = shared.value
        if not len(idx):
            return pd.Series([], dtype=object)
        m = margins(idx.tolist(), val.tolist(), weights)
        return pd.Series(list(softmax(np.column_stack([m, np.ones(len(m))]) @ matrix)))

    return probability
