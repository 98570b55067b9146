"""A linear-chain conditional random field over token classes, in numpy, with exact Viterbi decoding.

A token's score for a label is the sum of a weight of its own class, of the coarse kind of that class, of
the classes of the two tokens before it and of the one after it, of the last word before it and the word after it
(by a hash of the word), and of a class of its file. In training a token's own class is hidden now and then, so that its
kind and its neighbours must tell as well; a class that never occurred there counts as hidden. Labels are outside,
begin and inside.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
LABELS = 3
#: Places whose class bears on a token: itself, one and two before it, one after it.
OFFSETS = (0, -1, -2, 1)


@dataclass(frozen=True)
class Weights:
    """near: (offsets, classes, labels); kind: (classes, labels); file: (file classes, labels); move: (from, to); word:
    (before and after, hashes of words, labels)."""

    near: np.ndarray
    kind: np.ndarray
    file: np.ndarray
    move: np.ndarray
    word: np.ndarray

    @cached_property
    def own(self) -> np.ndarray:
        return self.near[0] + self.kind

    @cached_property
    def made_up(self) -> list[float]:
        """The most that moves to and from begin and inside can make up for, against those of outside."""
        move, ends = self.move, (None, *range(LABELS))
        return [
            max(
                (0 if i is None else move[i, y] - move[i, OUTSIDE]) + (0 if k is None else move[y, k] - move[OUTSIDE, k])
                for i in ends for k in ends
            )
            for y in (BEGIN, INSIDE)
        ]

    def emissions(self, classes: np.ndarray, words: np.ndarray, file_class: int) -> np.ndarray:
        """Of one document: (tokens, labels). words: (before and after, tokens). Class 0 stands beyond both ends."""
        padded = np.concatenate([[0, 0], classes, [0]])
        n = len(classes)
        out = self.own[classes]
        for k, offset in enumerate(OFFSETS[1:], 1):
            out += self.near[k][padded[2 + offset : 2 + offset + n]]
        out += self.word[0][words[0]]
        out += self.word[1][words[1]]
        out += self.file[file_class]
        return out


def train(
    classes: np.ndarray, words: np.ndarray, files: np.ndarray, labels: np.ndarray, kinds: np.ndarray, n_files: int, n_words: int,
    steps: int = 200, batch: int = 1024, rate: float = 0.2, decay: float = 5e-6, hidden: float = 0.6, seed: int = 3,
) -> Weights:
    """Maximises the likelihood of labels by Adam on batches of sequences, at least so many steps and as many more as it
    takes to go over all of them twice. classes: (rows, steps + 3), with two more before and one after each sequence;
    words: (2, rows, steps), hashes of the words before and after; labels: (rows, steps), -1 past the end of a sequence;
    kinds: the coarse kind of each class."""
    (every, length), n_classes, n_kinds, rng = labels.shape, len(kinds), int(kinds.max()) + 1, np.random.default_rng(seed)
    near, file, move = np.zeros((len(OFFSETS), n_classes + 1, LABELS)), np.zeros((n_files, LABELS)), np.zeros((LABELS, LABELS))
    kind, word = np.zeros((n_kinds, LABELS)), np.zeros((2, n_words, LABELS))
    all_classes, all_words, all_files, all_labels = classes, words, files, labels
    steps = max(steps, -(-2 * every // batch))
    order = np.arange(every) if every <= batch else np.concatenate([rng.permutation(every) for _ in range(-(-steps * batch // every))])
    params = [near, kind, file, move, word]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        some = order if every <= batch else order[(step - 1) * batch : step * batch]
        classes, words, files, labels = all_classes[some].astype(np.int64), all_words[:, some].astype(np.int64), all_files[some], all_labels[some].astype(np.int64)
        valid = labels >= 0
        own = [classes[:, 2 + o : 2 + o + length] for o in OFFSETS]
        of_kind = kinds[own[0]]
        truth = np.zeros((len(some), length, LABELS))
        np.put_along_axis(truth, np.maximum(labels, 0)[..., None], 1, axis=2)
        truth *= valid[..., None]
        moved = np.zeros((LABELS, LABELS))
        pairs = valid[:, 1:] & valid[:, :-1]
        going = valid.T[..., None]
        np.add.at(moved, (labels[:, :-1][pairs], labels[:, 1:][pairs]), 1)
        views = [np.where(rng.random(own[0].shape) < hidden, n_classes, own[0]), *own[1:]]
        e = sum(near[k][views[k]] for k in range(len(OFFSETS))) + kind[of_kind] + file[files][:, None, :] + word[0][words[0]] + word[1][words[1]]
        # forward and backward in probabilities, scaled at each step; past its end a sequence stays as it is
        lift = np.exp(e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
        through = np.exp(move)
        forward, backward = np.empty_like(lift), np.ones_like(lift)
        forward[0] = lift[0] / lift[0].sum(1, keepdims=True)
        for t in range(1, length):
            ahead = forward[t - 1] @ through * lift[t]
            ahead /= ahead.sum(1, keepdims=True)
            forward[t] = np.where(going[t], ahead, forward[t - 1])
        for t in range(length - 2, -1, -1):
            behind = (backward[t + 1] * lift[t + 1]) @ through.T
            behind /= behind.sum(1, keepdims=True)
            backward[t] = np.where(going[t + 1], behind, 1)
        marginal = forward * backward
        marginal /= marginal.sum(2, keepdims=True)
        d = marginal.transpose(1, 0, 2) * valid[..., None] - truth
        met = lift[1:] * backward[1:]
        weight = going[1:] / ((forward[:-1] @ through) * met).sum(2, keepdims=True)
        joint = through * np.einsum("tni,tnj->ij", forward[:-1], met * weight, optimize=True)
        grads = [
            np.stack([np.stack([np.bincount(views[k].ravel(), d[..., y].ravel(), n_classes + 1) for y in range(LABELS)], 1) for k in range(len(OFFSETS))]),
            np.stack([np.bincount(of_kind.ravel(), d[..., y].ravel(), n_kinds) for y in range(LABELS)], 1),
            np.stack([np.bincount(files, d[..., y].sum(1), n_files) for y in range(LABELS)], 1),
            joint - moved,
            np.stack([np.stack([np.bincount(words[k].ravel(), d[..., y].ravel(), n_words) for y in range(LABELS)], 1) for k in range(2)]),
        ]
        for i, g in enumerate(grads):
            g = g / max(valid.sum(), 1) + decay * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    own = all_classes[:, 2 : 2 + length][all_labels >= 0]
    unseen = np.bincount(own, minlength=n_classes)[:n_classes] == 0
    near[0][:n_classes][unseen] = near[0][n_classes]
    return Weights(near[:, :n_classes], kind[kinds], file, move, word)


def _best_paths(e: np.ndarray, move: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, opens: np.ndarray, closes: np.ndarray, labels: np.ndarray) -> None:
    """Sets the best labels of runs of tokens whose neighbours are outside; none come before runs that open a text and
    after those that close one. All runs take each step together,
    the longest first, so that those that go on are the first ones."""
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths, opens, closes = firsts[order], lengths[order], opens[order], closes[order]
    best = e[firsts] + np.where(opens[:, None], 0, move[OUTSIDE])
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0]), side="left").tolist()  # runs longer than 1, 2, ...
    back = []
    for t, n in enumerate(going, 1):
        through = best[:n, :, None] + move
        back.append(through.argmax(1).astype(np.int8))
        best[:n] = through.max(1) + e[firsts[:n] + t]
    at = (best + np.where(closes[:, None], 0, move[:, OUTSIDE])).argmax(1)
    for t, n in zip(range(len(going), 0, -1), reversed(going), strict=True):
        labels[firsts[:n] + t] = at[:n]
        at[:n] = back[t - 1][np.arange(n), at[:n]]
    labels[firsts] = at


def decode(w: Weights, e: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The labels of the best path over emissions (tokens, labels), of each of several texts one after the other where
    the places are given at which they start.

    Where outside leads by more than any moves can make up for, every best path is outside, whatever its
    neighbours; so only the runs between such tokens need the dynamic programme, and the result is exact.
    """
    move = w.move
    labels = np.zeros(len(e), np.int8)
    possible = np.zeros(len(e), bool)
    for y, most in zip((BEGIN, INSIDE), w.made_up, strict=True):
        possible |= e[:, OUTSIDE] - e[:, y] <= most
    places = np.flatnonzero(possible)
    if not len(places):
        return labels
    opening = np.zeros(len(e) + 1, bool)
    opening[[0, len(e)]] = True
    if starts is not None:
        opening[starts] = True
    breaks = np.flatnonzero((np.diff(places) > 1) | opening[places[1:]]) + 1
    firsts, lasts = places[np.concatenate([[0], breaks])], places[np.concatenate([breaks - 1, [len(places) - 1]])]
    # most runs are single tokens between two that are outside: those are all decided at once
    opens, closes = opening[firsts], opening[lasts + 1]
    longer = (firsts < lasts) | opens | closes
    single = firsts[~longer]
    labels[single] = (e[single] + (move[OUTSIDE] + move[:, OUTSIDE])).argmax(1)
    if longer.any():
        _best_paths(e, move, firsts[longer], (lasts - firsts + 1)[longer], opens[longer], closes[longer], labels)
    return labels
