"""A binary tree-structured graphical model: a label for each node of a forest,
node potentials linear in sparse features, and parent-child potentials.
Marginals come by sum-product message passing, from the leaves up and from the
roots down, over all trees of the forest at once, a depth at a time."""

from __future__ import annotations

import numpy as np


class Forest:
    """Parents, depths and sparse features of the nodes of many trees."""

    def __init__(self, parents: np.ndarray, features: list[list[int]]):
        self.parents = parents
        self.size = len(parents)
        depth = np.zeros(self.size, np.int64)
        for k, p in enumerate(parents.tolist()):  # a parent comes before its children
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]
        lengths = np.fromiter(map(len, features), np.int64, len(features))
        self.rows = np.repeat(np.arange(self.size), lengths)
        self.columns = np.fromiter((c for f in features for c in f), np.int64, int(lengths.sum()))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.size)


def marginals(forest: Forest, scores: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(label 1) of each node, the expected parent-child label pairs (2 x 2,
    parent first) and the log partition function."""
    belief = np.stack([np.zeros_like(scores), scores], axis=1)
    up = np.zeros_like(belief)
    parents = forest.parents
    for level in reversed(forest.levels):
        joint = belief[level][:, None, :] + edge[None]
        up[level] = np.logaddexp(joint[..., 0], joint[..., 1])
        np.add.at(belief, parents[level], up[level])
    roots = parents < 0
    log_z = float(np.logaddexp(belief[roots, 0], belief[roots, 1]).sum())
    pairs = np.zeros((2, 2))
    for level in forest.levels:
        outside = belief[parents[level]] - up[level]
        joint = outside[:, :, None] + edge[None] + belief[level][:, None, :]
        down = outside[:, :, None] + edge[None]
        belief[level] += np.logaddexp(down[:, 0], down[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    one = 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return one, pairs, log_z


def train(forest: Forest, labels: np.ndarray, n_features: int, steps: int = 200, rate: float = 0.1,
          penalty: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials of largest penalised likelihood, by Adam on
    the exact gradient (observed less expected feature and pair counts)."""
    y = labels.astype(np.float64)
    children = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[forest.parents[children]], labels[children]), 1.0)
    parameters = np.zeros(n_features + 4)
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        weights, edge = parameters[:n_features], parameters[n_features:].reshape(2, 2)
        one, pairs, _ = marginals(forest, forest.scores(weights), edge)
        gradient = np.concatenate([
            np.bincount(forest.columns, weights=(y - one)[forest.rows], minlength=n_features),
            (seen - pairs).ravel()]) - penalty * parameters
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        parameters = parameters + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return parameters[:n_features], parameters[n_features:].reshape(2, 2)
