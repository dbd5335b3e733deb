"""Logistic regression on sparse rows of a bounded sample, and on a table of any size with few columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


class Rows:
    """Sparse rows: (row, column, value) entries."""

    def __init__(self, row, column, value, n_rows, n_columns):
        self.row, self.column, self.value = row, column, value
        self.shape = (n_rows, n_columns)

    def dot(self, weights):
        return np.bincount(self.row, weights=self.value * weights[self.column], minlength=self.shape[0])

    def back(self, values):
        return np.bincount(self.column, weights=self.value * values[self.row], minlength=self.shape[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows, labels, penalty=1e-3, intercept=True, equal=None, equal_penalty=0.0, balanced=False, rounds=300, rate=0.05):
    """(weights, intercept) by Adam on the mean logistic loss plus `penalty` * |w|^2 / 2.

    `equal` holds differences between rows that should score alike; the mean square of their scores
    is added, times `equal_penalty`. `balanced` gives both labels the same total weight.
    """
    n, d = rows.shape
    w, b = np.zeros(d), 0.0
    if n == 0:
        return w, b
    share = np.mean(labels)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) if balanced and 0 < share < 1 else np.ones(n)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        error = weight * (sigmoid(rows.dot(w) + b) - labels)
        grad = rows.back(error) / n + penalty * w
        if equal is not None and equal.shape[0]:
            grad += equal_penalty * 2 * equal.back(equal.dot(w)) / equal.shape[0]
        both = np.append(grad, error.mean() if intercept else 0.0)
        m = 0.9 * m + 0.1 * both
        v = 0.999 * v + 0.001 * both * both
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:d]
        b -= move[d]
    return w, b


def fit_table(table, design, n, width, penalty, free=0, rounds=50):
    """Weights by Newton's method on the mean logistic loss of all `n` rows plus `penalty` * |w|^2 / 2.

    `design` gives (matrix of rows x width, labels) pieces of a record batch of `table`. Each round reads the table once; a task sums loss,
    slopes and curvatures of its rows, and only their sums over all tasks come to the driver. The last `free` weights
    are not penalised.
    """
    ridge = np.full(width, penalty)
    ridge[width - free:] = 0

    def moments(weights):
        def run(batches):
            loss, slopes, curves = 0.0, np.zeros(width), np.zeros((width, width))
            for batch in batches:
                for x, y in design(batch):
                    z = x @ weights
                    p = sigmoid(z)
                    loss += (np.logaddexp(0, z) - y * z).sum()
                    slopes += x.T @ (p - y)
                    curves += (x * (p * (1 - p))[:, None]).T @ x
            values = np.concatenate([[loss], slopes, curves.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

        found = table.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        values = np.zeros(1 + width + width * width)
        values[found["at"].to_numpy()] = found["value"].to_numpy()
        values /= n
        slopes, curves = values[1:1 + width], values[1 + width:].reshape(width, width)
        return values[0] + (ridge * weights**2).sum() / 2, slopes + ridge * weights, curves + np.diag(ridge)

    w = np.zeros(width)
    loss, slopes, curves = moments(w)
    size = 1.0
    for _ in range(rounds):
        step = np.linalg.lstsq(curves, slopes, rcond=1e-12)[0]
        gain = slopes @ step
        if gain < 1e-12 or size < 1e-6:
            break
        tried = w - size * step
        found = moments(tried)
        if found[0] <= loss - 1e-4 * size * gain:
            w, (loss, slopes, curves), size = tried, found, 1.0
        else:
            size /= 2
    return w
