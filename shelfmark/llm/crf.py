"""A linear-chain conditional random field over tags 0 (outside) to n; the outside tag scores 0 everywhere."""

from __future__ import annotations

import numpy as np


def _with_outside(scores: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((*scores.shape[:2], 1), np.float32), scores], axis=2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def negative_log_likelihood(model, scores: np.ndarray, tags: np.ndarray):
    """Mean over rows, with gradients by the forward-backward recursion.  scores (time, rows, n), tags (time, rows)."""
    e, moves = _with_outside(scores), model.p["transitions"]
    steps, rows, k = e.shape
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + moves, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = _log_sum(moves + (e[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    d = np.exp(ahead + behind - total[:, None])
    d_moves = np.zeros_like(moves)
    for t in range(1, steps):
        d_moves += np.exp(ahead[t - 1][:, :, None] + moves + (e[t] + behind[t])[:, None, :] - total[:, None, None]).sum(0)
    own = np.take_along_axis(e, tags[..., None], 2)[..., 0].sum(0) + moves[tags[:-1], tags[1:]].sum(0)
    np.put_along_axis(d, tags[..., None], np.take_along_axis(d, tags[..., None], 2) - 1, 2)
    np.add.at(d_moves, (tags[:-1], tags[1:]), -1)
    return float((total - own).mean()), d[..., 1:] / rows, {"transitions": d_moves / rows}


def all_outside(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Rows whose best path is surely outside all along.

    A stretch of n positions off the outside tag gains at most n * (score + d) + d, where d bounds the gain of one move; below
    -2 d no stretch can gain.
    """
    gain = moves - moves[0, 0]
    gain[0, 0] = -np.inf
    return scores.max((0, 2)) < -2 * max(float(gain.max()), 0.0)


def best_path(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi tags (time, rows); equal scores go to the lower tag."""
    e = _with_outside(scores)
    best, back = e[0], np.zeros(e.shape, np.int8)
    for t in range(1, len(e)):
        step = best[:, :, None] + moves
        back[t] = step.argmax(1)
        best = step.max(1) + e[t]
    out = np.empty(e.shape[:2], np.int8)
    out[-1] = best.argmax(1)
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = np.take_along_axis(back[t], out[t][:, None].astype(np.intp), 1)[:, 0]
    return out
