"""Sparse 0/1 features and the fitting of shared weights with ordered thresholds."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sets of feature numbers, one for each row."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.n, self.width = len(sets), width
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.col = np.concatenate(sets) if sets else np.zeros(0, np.int64)

    def frequent(self, least: int) -> np.ndarray:
        """Which features at least so many rows hold; the others are dropped."""
        keep = np.bincount(self.col, minlength=self.width) >= least
        hold = keep[self.col]
        self.row, self.col = self.row[hold], self.col[hold]
        return keep

    def telling(self, values: np.ndarray, least: float) -> np.ndarray:
        """Which features' rows differ in mean value by ``least`` standard errors from all; the others are dropped."""
        n = np.maximum(np.bincount(self.col, minlength=self.width), 1)
        spread = values.std() if self.n else 0.0
        z = np.abs(self.gather(values - values.mean())) / np.sqrt(n) / spread if spread > 0 else np.zeros(self.width)
        keep = z >= least
        hold = keep[self.col]
        self.row, self.col = self.row[hold], self.col[hold]
        return keep

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], minlength=self.n)

    def gather(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, by_row[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: Rows, grades: np.ndarray, top: int, l2: float = 1e-5, steps: int = 600, rate: float = 0.1
) -> tuple[np.ndarray, np.ndarray]:
    """Weights w and ordered thresholds t of P(grade > j) = sigmoid(w x - t[j]), for grades 0 to ``top``.

    Full-batch gradient descent with per-weight step sizes (Adam) on the log likelihood of the grades, so the result
    is the same in every run. Thresholds stay in order, as all but the first are steps upwards. With ``top`` 1 this
    is logistic regression. Without rows the weights are 0 and every threshold but for the steps too.
    """
    params = np.zeros(rows.width + top)
    m, v = np.zeros_like(params), np.zeros_like(params)

    def thresholds() -> np.ndarray:
        raw = params[rows.width :]
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    for step in range(1, steps + 1) if rows.n else ():
        t = thresholds()
        score = rows.scores(params[: rows.width])
        above = sigmoid(score[:, None] - t)  # P(grade > j)
        edges = np.concatenate([np.ones((rows.n, 1)), above, np.zeros((rows.n, 1))], axis=1)
        at = np.arange(rows.n)
        p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        slope = edges * (1 - edges)
        # of minus the mean log likelihood by the score, and by each threshold
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / p / rows.n
        by_t = np.zeros(top)
        for j in range(top):
            lower, upper = grades == j + 1, grades == j
            by_t[j] = (np.sum((slope[at, grades] / p)[lower]) - np.sum((slope[at, grades + 1] / p)[upper])) / rows.n
        raw = params[rows.width :]
        tail = np.cumsum(by_t[::-1])[::-1]
        by_raw = np.concatenate([[tail[0]], tail[1:] * np.exp(raw[1:])])
        g = np.concatenate([rows.gather(by_score) + l2 * params[: rows.width], by_raw])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[: rows.width].copy(), thresholds()
