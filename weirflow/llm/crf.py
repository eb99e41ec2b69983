"""Linear-chain conditional random field over binary features, in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # features x states
    step: np.ndarray  # from state x to state
    start: np.ndarray
    end: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores of tokens given as rows of feature ids; the id past the last feature is padding."""
        padded = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]))])
        out = np.zeros((len(features), self.weights.shape[1]))
        for k in range(features.shape[1]):
            out += padded[features[:, k]]
        return out

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of sequences of tokens laid end to end."""
        return self.viterbi(self.emissions(features), lengths) if len(features) else np.zeros(0, np.int64)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Labels for emission scores of sequences laid end to end; sequences are decoded together, longest first."""
        labels = np.zeros(len(scores), np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        begin, lengths = begin[order], lengths[order]
        if not len(lengths):
            return labels
        best, back = self.start + scores[begin], []
        together = int(lengths[1]) if len(lengths) > 1 else 1  # from here on the longest sequence is alone
        for t in range(1, together):
            live = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
            options = best[:live, :, None] + self.step
            back.append(options.argmax(axis=1))
            best = np.concatenate([options.max(axis=1) + scores[begin[:live] + t], best[live:]])
        alone, lone = [], best[0].tolist()
        states, moves = range(len(lone)), self.step.T.tolist()
        for row in scores[begin[0] + together:begin[0] + lengths[0]].tolist():  # plain numbers: arrays of one are slower
            options = [[lone[a] + m[a] for a in states] for m in moves]
            lone = [max(o) for o in options]
            alone.append([o.index(x) for o, x in zip(options, lone)])
            lone = [x + y for x, y in zip(lone, row)]
        best[0] = lone
        state = (best + self.end).argmax(axis=1)
        own = int(state[0])
        for t in range(int(lengths[0]) - 1, together - 1, -1):
            labels[begin[0] + t] = own
            own = alone[t - together][own]
        state[0] = own
        for t in range(together - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            labels[begin[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return labels


def fit(features: list[np.ndarray], labels: list[np.ndarray], n_features: int, n_states: int, epochs: int = 120, decay: float = 1e-3) -> Chain:
    """Maximise the penalised log-likelihood by Adam over full batches, with forward-backward expectations."""
    n, length = len(features), max(map(len, features))
    sizes = np.array([len(f) for f in features])
    mask = np.arange(length) < sizes[:, None]
    ids, gold = np.concatenate(features), np.zeros((n, length), np.int64)
    gold[mask] = np.concatenate(labels)
    flat = np.zeros((len(ids), n_features + 1), np.float32)  # only real tokens; padding has no row
    np.put_along_axis(flat, ids, 1.0, axis=1)
    flat = np.ascontiguousarray(flat[:, :n_features])
    last, rows = mask.sum(axis=1) - 1, np.arange(n)
    want = np.eye(n_states)[gold] * mask[:, :, None]
    want_step = np.einsum("nta,ntb->ab", want[:, :-1], want[:, 1:])
    p = [np.zeros((n_features, n_states)), np.zeros((n_states, n_states)), np.zeros(n_states), np.zeros(n_states)]
    m1, m2 = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for epoch in range(1, epochs + 1):
        w, step, start, end = p
        score = flat @ w.astype(np.float32)
        e = np.ones((n, length, n_states))
        e[mask] = np.exp(score - score.max(axis=1, keepdims=True))
        move, finish = np.exp(step), np.exp(end)
        forward, backward, scale = np.zeros_like(e), np.zeros_like(e), np.ones((n, length))
        forward[:, 0] = np.exp(start) * e[:, 0]
        for t in range(length):
            if t:
                forward[:, t] = (forward[:, t - 1] @ move) * e[:, t]
            scale[:, t] = forward[:, t].sum(axis=1)
            forward[:, t] /= scale[:, t, None]
        backward[rows, last] = finish / (forward[rows, last] @ finish)[:, None]
        for t in range(length - 2, -1, -1):
            behind = (e[:, t + 1] * backward[:, t + 1]) @ move.T / scale[:, t + 1, None]
            backward[:, t] = np.where(mask[:, t + 1, None], behind, backward[:, t])
        have = forward * backward * mask[:, :, None]
        later = e[:, 1:] * backward[:, 1:] / scale[:, 1:, None] * mask[:, 1:, None]
        have_step = move * np.tensordot(forward[:, :-1], later, axes=((0, 1), (0, 1)))
        slack = (have - want)[mask]
        grads = [
            flat.T @ slack.astype(np.float32) / n + decay * w,
            (have_step - want_step) / n + decay * step,
            (have[:, 0] - want[:, 0]).sum(axis=0) / n + decay * start,
            (have[rows, last] - want[rows, last]).sum(axis=0) / n + decay * end,
        ]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            p[i] = p[i] - 0.1 * (m1[i] / (1 - 0.9**epoch)) / (np.sqrt(m2[i] / (1 - 0.99**epoch)) + 1e-8)
    return Chain(*p)
