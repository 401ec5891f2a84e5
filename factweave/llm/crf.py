"""A small linear-chain conditional random field: training by gradient on the exact log-likelihood, Viterbi decoding.

A place of a sequence has features of its own and a set of features that it shares with its neighbours (those of the zone it lies in);
a shared set is scored once. Training is vectorised over sequences of about the same length; decoding is plain Python over a dictionary
of weights, since the sequences of one line are short.
"""

from __future__ import annotations

import numpy as np


def train(data: list[tuple[list[list[str]], list[tuple[str, ...]], list[int]]], labels: int, rounds: int = 60, rate: float = 0.15, l2: float = 1e-3) -> dict:
    """Weights {"emit": feature -> [label weights], "move": [[...]], "start": [...]} that maximise the likelihood of ``data``.

    A sequence is (own features of each place, shared features of each place, labels).
    """
    names = {f: i for i, f in enumerate(sorted({f for own, shared, _ in data for fs in (*own, *shared) for f in fs}), 1)}
    sets = {fs: i for i, fs in enumerate(dict.fromkeys(fs for _, shared, _ in data for fs in shared))}

    def matrix(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int32)
        for i, r in enumerate(rows):
            out[i, : len(r)] = [names[f] for f in r]
        return out

    mine, common = matrix([fs for own, _, _ in data for fs in own]), matrix(list(sets))
    of = np.array([sets[fs] for _, shared, _ in data for fs in shared])
    gold = np.eye(labels)[[y for _, _, ys in data for y in ys]]
    size = np.array([len(ys) for _, _, ys in data])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    # Sequences by length: a batch is as wide as its longest.
    order = np.argsort(size, kind="stable")
    batches = []
    for part in np.array_split(order, min(24, len(order))):
        width = np.arange(size[part].max())
        mask = width[None, :] < size[part][:, None]
        batches.append((np.where(mask, first[part][:, None] + width, 0), mask))
    emit, move, start = np.zeros((len(names) + 1, labels)), np.zeros((labels, labels)), np.zeros(labels)
    state = [np.zeros_like(p) for p in (emit, move, start)], [np.zeros_like(p) for p in (emit, move, start)]
    n = len(data)
    for step in range(1, rounds + 1):
        score = emit[mine].sum(1) + emit[common].sum(1)[of]
        off = np.zeros_like(score)
        g_move, g_start = np.zeros_like(move), np.zeros_like(start)
        for at, mask in batches:
            e, g = score[at] * mask[:, :, None], gold[at] * mask[:, :, None]
            t = e.shape[1]
            alpha, beta = np.full_like(e, -1e9), np.zeros_like(e)
            alpha[:, 0] = start + e[:, 0]
            for j in range(1, t):
                a = _lse(alpha[:, j - 1, :, None] + move[None], 1) + e[:, j]
                alpha[:, j] = np.where(mask[:, j, None], a, alpha[:, j - 1])
            z = _lse(alpha[:, -1], 1)
            for j in range(t - 2, -1, -1):
                b = _lse(move[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where(mask[:, j + 1, None], b, 0)
            node = np.exp(np.clip(alpha + beta - z[:, None, None], -60, 0)) * mask[:, :, None]
            pair = np.exp(np.clip(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -60, 0)) * mask[:, 1:, None, None]
            off[at[mask]] = (g - node)[mask]
            g_move += np.einsum("nta,ntb->ab", g[:, :-1], g[:, 1:]) - pair.sum((0, 1))
            g_start += (g[:, 0] - node[:, 0]).sum(0)
        of_set = np.stack([np.bincount(of, off[:, k], len(common)) for k in range(labels)], axis=1)
        g_emit = np.stack([np.bincount(mine.ravel(), np.repeat(off[:, k], mine.shape[1]), len(emit)) + np.bincount(common.ravel(), np.repeat(of_set[:, k], common.shape[1]), len(emit)) for k in range(labels)], axis=1)
        g_emit[0] = 0
        for k, (p, g) in enumerate(((emit, g_emit), (move, g_move), (start, g_start))):
            g = g / n - l2 * p
            state[0][k][...] = 0.9 * state[0][k] + 0.1 * g
            state[1][k][...] = 0.99 * state[1][k] + 0.01 * g * g
            p += rate * (state[0][k] / (1 - 0.9**step)) / (np.sqrt(state[1][k] / (1 - 0.99**step)) + 1e-8)
    return {"emit": {f: emit[i].tolist() for f, i in names.items()}, "move": move.tolist(), "start": start.tolist()}


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def viterbi(model: dict, seq: list[list[str]], given: list[list[float] | None] | None = None) -> list[int]:
    """The likeliest labels of one sequence; ``given`` are scores that come on top of the features' at each place."""
    emit, move, score = model["emit"], model["move"], None
    labels = range(len(model["start"]))
    back = []
    for place, fs in enumerate(seq):
        e = list(given[place]) if given and given[place] is not None else [0.0] * len(labels)
        for f in fs:
            w = emit.get(f)
            if w is not None:
                for k in labels:
                    e[k] += w[k]
        if score is None:
            score = [model["start"][k] + e[k] for k in labels]
            continue
        ptr, new = [], []
        for k in labels:
            best = max(labels, key=lambda j, k=k, score=score: score[j] + move[j][k])
            ptr.append(best)
            new.append(score[best] + move[best][k] + e[k])
        back.append(ptr)
        score = new
    if score is None:
        return []
    out = [max(labels, key=lambda k: score[k])]
    for ptr in reversed(back):
        out.append(ptr[out[-1]])
    return out[::-1]
