"""A bidirectional gated recurrent network over bytes that labels every position, in numpy.

Long texts run as chunks side by side. Each direction comes to a chunk through the RUN_UP bytes before it (for
the backward direction, those after it), so that states don't start anew at its ends; only the true ends of a
text do. Rows shorter than others of their pass are aligned at the start of each direction, so that what they are
filled up with lies behind all that counts. Outside training, states and weights are rounded to multiples of
2^-10 and 2^-8 before they are multiplied, so that their sums are exact in float32 whatever their order: a text's
probabilities are the same bit for bit whatever else is in its batch.
"""

from __future__ import annotations

import numpy as np

UNITS, CHUNK, RUN_UP = 8, 256, 64
#: Rows of each pass; their states are all that is held at once.
PASS_ROWS = 1024
#: Numbers near this one have no bits below 2^-10: added and taken away again, it rounds to multiples of that.
ROUNDS = np.float32(12288)
#: Bytes of a training window.
WINDOW = 128


def init(n_labels: int, units: int = UNITS, seed: int = 7) -> dict[str, np.ndarray]:
    """x: inputs of the gates z, r and the candidate n by direction and byte (biases included); u: recurrent
    weights; v, c: output weights and biases."""
    rng = np.random.default_rng(seed)
    return {
        "x": rng.normal(0, 0.3, (2, 256, 3 * units)).astype(np.float32),
        "u": rng.normal(0, 1 / np.sqrt(units), (2, units, 3 * units)).astype(np.float32),
        "v": rng.normal(0, 0.3, (2, units, n_labels)).astype(np.float32),
        "c": np.zeros(n_labels, np.float32),
    }


def rounded(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """w with those weights that states are multiplied by as multiples of 2^-8 of less than 8. With states in multiples of
    2^-10, of at most 1, the sums of up to 8 products are multiples of 2^-18 that fill no more than the 24 bits of a float."""
    return w | {k: np.clip(np.rint(w[k] * 256), -2047, 2047).astype(np.float32) / np.float32(256) for k in ("u", "v")}


def _forward(w: dict[str, np.ndarray], both: np.ndarray) -> tuple[np.ndarray, list]:
    """both: bytes by time, direction and row, the second direction in reverse order. States by time, direction and row,
    and what backpropagation needs of each step."""
    steps, _, rows = both.shape
    units = w["u"].shape[1]
    h, sides = np.zeros((2, rows, units), np.float32), np.arange(2)[:, None]
    states, trace = np.empty((steps, 2, rows, units), np.float32), []
    for t in range(steps):
        inputs, g = w["x"][sides, both[t]], h @ w["u"]
        gates = 0.5 + 0.5 * np.tanh(0.5 * (inputs[..., : 2 * units] + g[..., : 2 * units]))  # the logistic function
        z, r = gates[..., :units], gates[..., units:]
        n = np.tanh(inputs[..., 2 * units :] + r * g[..., 2 * units :])
        before, h = h, n + z * (h - n)
        states[t] = h
        trace.append((before, z, r, n, g[..., 2 * units :]))
    return states, trace


class Rounded:
    """The states of a network whose sums are exact, for labelling: the same equations with states and weights rounded, and
    with the parts of the two gates and of the candidate each in an array of its own, scaled so that exp gives both
    functions: 1 / (1 + exp(-v)), and tanh(v) as 2 / (1 + exp(-2 v)) - 1."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.units = rounded(w), w["u"].shape[1]
        scale = np.array([-1, -1, -2], np.float32)[:, None, None, None]
        part = lambda v: np.stack(np.split(v, 3, axis=-1)) * scale
        self.x, self.u = np.ascontiguousarray(part(w["x"]).reshape(3, 512, self.units)), np.ascontiguousarray(part(self.w["u"]))

    def states(self, both: np.ndarray) -> np.ndarray:
        steps, _, rows = both.shape
        h = np.zeros((2, rows, self.units), np.float32)
        states = np.empty((steps, 2, rows, self.units), np.float32)
        inputs = np.empty((3, 2, rows, self.units), np.float32)
        g = np.empty_like(inputs)
        index = both.astype(np.int64)
        index[:, 1] += 256
        with np.errstate(over="ignore"):
            for t in range(steps):
                for k in range(3):
                    np.take(self.x[k], index[t], axis=0, out=inputs[k], mode="clip")
                np.matmul(h, self.u, out=g)
                gates = np.add(inputs[:2], g[:2], out=inputs[:2])
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                n = g[2]
                n *= gates[1]
                n += inputs[2]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                h = np.subtract(h, n, out=states[t])
                h *= gates[0]
                h += n
                h += ROUNDS
                h -= ROUNDS
        return states

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """By label, time and row, of the states of both directions at each place."""
        out = forward @ self.w["v"][0]
        out += backward @ self.w["v"][1]
        out += self.w["c"]
        out = np.ascontiguousarray(out.transpose(2, 0, 1))
        out -= out.max(axis=0)
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out


def _backwards(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(steps, rows): the place that step t of a row of so many places, read backwards, stands at; 0 behind its end."""
    return np.maximum(lengths - 1 - np.arange(steps)[:, None], 0)


def _in_step(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """rows: (rows, steps), of which the first lengths bytes of each count. Both directions start with the first of theirs."""
    back = rows[np.arange(len(rows)), _backwards(lengths, rows.shape[1])]
    return np.ascontiguousarray(np.stack([rows.T, back], axis=1))


def _probabilities(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """By time, row and label, of the states of both directions at each place."""
    out = forward @ w["v"][0]
    out += backward @ w["v"][1]
    out += w["c"]
    out -= out.max(axis=-1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=-1, keepdims=True)
    return out


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss over positions of windows (rows, steps), whose first lengths bytes count, with a label for
    each row, and its gradients by backpropagation through time. weights: of each row."""
    both = _in_step(windows, lengths)
    steps, _, rows = both.shape
    units = w["u"].shape[1]
    states, trace = _forward(w, both)
    each, turned = np.arange(rows), _backwards(lengths, steps)
    valid = (np.arange(steps)[:, None] < lengths).astype(np.float32)
    backward = states[turned, 1, each]
    p = _probabilities(w, states[:, 0], backward)
    share = (weights / (weights * lengths).sum()).astype(np.float32) * valid
    loss = float(-(np.log(np.maximum(p[:, each, labels], 1e-12)) * share).sum())
    d = p
    d[:, each, labels] -= 1
    d *= share[..., None]
    flat = d.reshape(-1, d.shape[-1])
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["c"] = flat.sum(axis=0)
    grads["v"][0] = states[:, 0].reshape(-1, units).T @ flat
    grads["v"][1] = backward.reshape(-1, units).T @ flat
    from_right = d[turned, each] * valid[..., None]  # by step of the backward direction
    dh = np.zeros((2, rows, units), np.float32)
    dx = np.empty((2, rows, 3 * units), np.float32)
    for t in reversed(range(steps)):
        before, z, r, n, gn = trace[t]
        dh[0] += d[t] @ w["v"][0].T
        dh[1] += from_right[t] @ w["v"][1].T
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[..., :units], dx[..., units : 2 * units], dx[..., 2 * units :] = dz, dr, dn
        dg = dx.copy()
        dg[..., 2 * units :] *= r
        grads["u"] += before.transpose(0, 2, 1) @ dg
        for side in range(2):
            np.add.at(grads["x"][side], both[t, side], dx[side])
        dh = dh * z + dg @ w["u"].transpose(0, 2, 1)
    return loss, grads


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of the texts in windows (rows, window), the bytes that count of each, and the number of its text."""
    rows, lengths, owners = [], [], []
    for i, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        padded = np.full(-(-len(data) // window) * window, 32, np.uint8)
        padded[: len(data)] = data
        rows.append(padded.reshape(-1, window))
        lengths += [min(window, len(data) - at) for at in range(0, len(data), window)]
        owners += [i] * len(rows[-1])
    return np.concatenate(rows) if rows else np.zeros((0, window), np.uint8), np.array(lengths, np.int64), np.array(owners, np.int64)


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches of windows, at least so many steps and as many more as it takes to go over all windows
    once; labels weigh alike however often they occur."""
    w, rng = init(n_labels, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    per_label = 1 / np.maximum(np.bincount(labels, lengths, minlength=n_labels), 1)
    steps = max(steps, -(-len(windows) // batch))
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * batch // len(windows)))])
    for step in range(1, steps + 1):
        rows = order[(step - 1) * batch : step * batch]
        long = int(lengths[rows].max())
        _, grads = gradients(w, windows[rows, :long], lengths[rows], labels[rows], per_label[labels[rows]])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def pooled(w: dict[str, np.ndarray], texts: list[bytes], chunk: int = CHUNK, run_up: int = RUN_UP) -> np.ndarray:
    """The mean over all positions of each whole text of the probabilities of the labels; zeros for an empty text."""
    sums = np.zeros((len(texts), len(w["c"])))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)) * chunk
    lengths = np.minimum(chunk, sizes[owner] - place)
    before, after = np.minimum(run_up, place), np.minimum(run_up, sizes[owner] - place - lengths)
    steps = lengths + np.maximum(before, after)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.repeat(sizes.cumsum() - sizes, counts) + place
    order, network = np.lexsort((after, before, lengths, steps)), Rounded(w)
    for at in range(0, len(order), PASS_ROWS):
        some = order[at : at + PASS_ROWS]
        each = np.arange(len(some))
        step = np.arange(int(steps[some].max()))[:, None]
        ahead = np.minimum(starts[some] - before[some] + step, len(data) - 1)
        back = np.maximum(starts[some] + lengths[some] + after[some] - 1 - step, 0)
        states = network.states(np.stack([data[ahead], data[back]], axis=1))
        n, b, a = int(lengths[some].max()), before[some], after[some]
        if (lengths[some] == n).all() and (b == b[0]).all() and (a == a[0]).all():  # as most are
            p = network.probabilities(states[b[0] : b[0] + n, 0], states[a[0] : a[0] + n, 1][::-1])
        else:
            place_in = np.arange(n)[:, None]
            from_left = np.minimum(b + place_in, len(step) - 1)
            from_right = np.maximum(a + lengths[some] - 1 - place_in, 0)
            p = network.probabilities(states[from_left, 0, each], states[from_right, 1, each])
            p *= place_in < lengths[some]
        np.add.at(sums, owner[some], p.sum(axis=1, dtype=np.float64).T)
    return sums / np.maximum(sizes, 1)[:, None]
