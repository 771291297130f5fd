"""No-U-turn sampling (Hoffman and Gelman 2014) with step sizes by dual averaging, chains as Spark tasks, and the split R-hat of their draws."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from tessella.operators.replicates import broadcast_samples, replicate_vectors

Density = Callable[[np.ndarray], tuple[float, np.ndarray]]

#: Fixed values of dual averaging: shrinkage, early stabilisation, decay; and the loss of energy at which a trajectory counts as divergent.
GAMMA, EARLY, DECAY, DIVERGENT = 0.05, 10.0, 0.75, 1000.0


@dataclass
class Tree:
    """A piece of a trajectory: its ends (position, momentum, slope), a drawn position and the number of points it stands for, whether to go on,
    and the acceptance of its points with their number."""

    left: tuple
    right: tuple
    drawn: np.ndarray
    size: int
    open: bool
    accept: float
    points: int

    def turns(self) -> bool:
        span = self.right[0] - self.left[0]
        return span @ self.left[1] < 0 or span @ self.right[1] < 0


def leapfrog(density: Density, state: tuple, step: float) -> tuple[tuple, float]:
    """The next (position, momentum, slope), and its joint log density."""
    q, r, slope = state
    r = r + step / 2 * slope
    q = q + step * r
    value, slope = density(q)
    r = r + step / 2 * slope
    joint = value - r @ r / 2
    return (q, r, slope), joint if math.isfinite(joint) else -math.inf


def grow(density: Density, state: tuple, height: float, way: int, depth: int, step: float, start: float, rng: np.random.Generator) -> Tree:
    """A tree of 2^depth points from a state in one direction; height is the slice, start the joint log density at the trajectory's beginning."""
    if depth == 0:
        new, joint = leapfrog(density, state, way * step)
        return Tree(new, new, new[0], int(joint >= height), joint > height - DIVERGENT, math.exp(min(0.0, joint - start)), 1)
    tree = grow(density, state, height, way, depth - 1, step, start, rng)
    return extend(density, tree, height, way, depth - 1, step, start, rng, lambda old, new: new / max(old + new, 1)) if tree.open else tree


def extend(density: Density, tree: Tree, height: float, way: int, depth: int, step: float, start: float, rng: np.random.Generator, share: Callable[[int, int], float]) -> Tree:
    """The tree with 2^depth points more; share(points before, new points) is the chance that the drawn position is a new one."""
    more = grow(density, tree.right if way > 0 else tree.left, height, way, depth, step, start, rng)
    drawn = more.drawn if more.open and rng.random() < share(tree.size, more.size) else tree.drawn
    left, right = (tree.left, more.right) if way > 0 else (more.left, tree.right)
    out = Tree(left, right, drawn, tree.size + more.size, more.open, tree.accept + more.accept, tree.points + more.points)
    out.open = more.open and not out.turns()
    return out


def sample(density: Density, start: np.ndarray, samples: int, warmup: int, rng: np.random.Generator, target: float = 0.8, depth: int = 10) -> np.ndarray:
    """samples draws (rows) from a log density with its slope, after warmup ones that set the step; coordinates should be of like scales."""
    q, step, centre, lag, mean_log = np.asarray(start, dtype=float), 0.1, math.log(1.0), 0.0, 0.0
    out = np.empty((samples, len(q)))
    for k in range(warmup + samples):
        value, slope = density(q)
        r = rng.standard_normal(len(q))
        begin = value - r @ r / 2
        height = begin - rng.exponential()
        tree = Tree((q, r, slope), (q, r, slope), q, 1, True, 0.0, 0)
        for level in range(depth):
            way = 1 if rng.random() < 0.5 else -1
            tree = extend(density, tree, height, way, level, step, begin, rng, lambda old, new: new / old)
            if not tree.open:
                break
        q = tree.drawn
        if k < warmup:
            t = k + 1
            lag += (target - tree.accept / tree.points - lag) / (t + EARLY)
            log_step = centre - math.sqrt(t) / GAMMA * lag
            mean_log += t**-DECAY * (log_step - mean_log)
            step = math.exp(log_step if t < warmup else mean_log)
        else:
            out[k - warmup] = q
    return out


def split_r_hat(chains: np.ndarray) -> np.ndarray:
    """Of draws (chains x draws x coordinates): each chain in halves, the spread of all against that within them; 1 where they agree."""
    half = chains.shape[1] // 2
    parts = np.concatenate([chains[:, :half], chains[:, half : 2 * half]])
    within, between = parts.var(axis=1, ddof=1).mean(axis=0), parts.mean(axis=1).var(axis=0, ddof=1)
    return np.sqrt((half - 1) / half + between / np.maximum(within, 1e-300))


def batch_density(m: np.ndarray, n: np.ndarray, v: np.ndarray, prior: float = 1e-3) -> Density:
    """Log density of (mean, log batch variance, log error variance) given each batch's mean, number and variance of controls, the batches' own effects
    integrated out; both variances have inverse gamma priors of shape 1 and this scale."""

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        mu, (theta, error) = x[0], np.exp(np.clip(x[1:], -200, 200))
        total, gap, inner = theta + error / n, m - mu, np.sum(n * v)
        value = -0.5 * np.sum(np.log(total) + gap**2 / total) - 0.5 * (np.sum(n - 1) * x[2] + inner / error) - x[1] - x[2] - prior / theta - prior / error
        pull = 0.5 * (gap**2 / total - 1) / total
        slopes = [np.sum(gap / total), theta * np.sum(pull) - 1 + prior / theta, error * np.sum(pull / n) - 0.5 * (np.sum(n - 1) - inner / error) - 1 + prior / error]
        return float(value), np.array(slopes)

    return f


def batch_posterior(spark: SparkSession, m: np.ndarray, n: np.ndarray, v: np.ndarray, chains: int = 4, samples: int = 500, warmup: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of each batch (share of the batch variance in that of its mean control), and the split R-hat of mean and log variances. Each chain is a task,
    which gets the batches' three numbers; a draw's work grows with batches, not rows."""
    centre = np.array([m.mean(), math.log(max(m.var(), 1e-6)), math.log(max(np.average(v, weights=n), 1e-6))])
    scale = np.array([max(m.std(), 1e-3) / math.sqrt(len(m)), math.sqrt(2 / len(m)), math.sqrt(2 / max(np.sum(n - 1), 1))])
    shared = broadcast_samples(spark, m, n, v)

    def chain(k: int) -> np.ndarray:
        density, rng = batch_density(*shared.value), np.random.default_rng([seed, k])

        def scaled(z: np.ndarray) -> tuple[float, np.ndarray]:
            value, slope = density(centre + scale * z)
            return value, slope * scale

        x = centre + scale * sample(scaled, rng.standard_normal(3), samples, warmup, rng)
        weights = np.mean([t / (t + e / shared.value[1]) for t, e in np.exp(x[:, 1:])], axis=0)
        return np.concatenate([x.ravel(), weights])

    got = np.array([r["value"] for r in replicate_vectors(spark, chains, chain).orderBy("replicate").collect()])
    return got[:, 3 * samples :].mean(axis=0), split_r_hat(got[:, : 3 * samples].reshape(chains, samples, 3))
