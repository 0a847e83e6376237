"""A small convolutional network over bytes: filters of several widths, max pooling, softmax; trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a window, numbers per byte, filter widths, filters of each width.
WINDOW, EMBEDDED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: The symbol behind the end of a text.
PAD = 256
_AT_ONCE = 2048
# letters are read in lower case, A to Z at least
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@dataclass
class Network:
    """`table` (257, EMBEDDED); per width `filters` (width * EMBEDDED, FILTERS) and `offsets`; `out` and `out_offset`."""

    table: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    out: np.ndarray
    out_offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.offsets, self.out, self.out_offset]


def new_network(classes: int, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    return Network(
        rng.normal(0, 0.5, (PAD + 1, EMBEDDED)), [rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, total**-0.5, (total, classes)), np.zeros(classes),
    )


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def loss_and_slopes(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of windows (n, WINDOW) of symbols, and its slope in every parameter."""
    n, rows = len(windows), np.arange(len(windows))[:, None]
    embedded = net.table[windows].reshape(n, -1)
    pooled, places = [], []
    for width, weights, offset in zip(WIDTHS, net.filters, net.offsets, strict=True):
        patches = np.lib.stride_tricks.sliding_window_view(embedded, width * EMBEDDED, axis=1)[:, ::EMBEDDED]
        sums = patches @ weights
        place = sums.argmax(1)
        places.append(place)
        pooled.append(np.take_along_axis(sums, place[:, None], 1)[:, 0] + offset)
    raw = np.concatenate(pooled, 1)
    features = np.maximum(raw, 0)
    logs = log_softmax(features @ net.out + net.out_offset)
    loss = -logs[np.arange(n), labels].mean()
    error = np.exp(logs)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ net.out.T) * (raw > 0)
    table, filters, offsets = np.zeros_like(net.table), [], []
    for i, (width, weights, place) in enumerate(zip(WIDTHS, net.filters, places, strict=True)):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        # only the place of the maximum counts
        symbols = windows[rows[..., None], place[..., None] + np.arange(width)]
        patches = net.table[symbols].reshape(n, FILTERS, width * EMBEDDED)
        filters.append(np.einsum("nf,nfk->kf", own, patches))
        offsets.append(own.sum(0))
        np.add.at(table, symbols, (own[..., None] * weights.T[None]).reshape(n, FILTERS, width, EMBEDDED))
    return float(loss), [table, *filters, *offsets, features.T @ error, error.sum(0)]


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, steps: int = 400, batch: int = 256, rate: float = 4e-3, seed: int = 0) -> Network:
    """Adam over shuffled batches, `epochs` times all windows or `steps` batches at least; the same input gives the same network."""
    net, rng = new_network(classes, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(max(epochs, -(-steps // -(-len(windows) // batch)))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, slopes = loss_and_slopes(net, windows[own], labels[own])
            step += 1
            for p, (mean, square), slope in zip(net.parameters(), moments, slopes, strict=True):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope**2 - square)
                p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Symbols (WINDOW, windows) of the bytes from `starts`, behind `sizes` bytes the pad."""
    at = np.arange(WINDOW)[:, None]
    symbols = _LOWER[data[np.minimum(starts + at, len(data) - 1)]]
    symbols[at >= sizes] = PAD
    return symbols


class Reader:
    """The network for many windows: what each pair of symbols adds to the filters is looked up in tables."""

    def __init__(self, net: Network):
        one = [[net.table @ w[j * EMBEDDED : (j + 1) * EMBEDDED] for j in range(width)] for width, w in zip(WIDTHS, net.filters, strict=True)]
        size = PAD + 1

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None] + b[None]).reshape(size * size, FILTERS)

        self.first = np.concatenate([pair(one[0][0], one[0][1]), pair(one[1][0], one[1][1]), pair(one[2][0], one[2][1])], 1).astype(np.float32)
        self.third, self.second = one[1][2].astype(np.float32), pair(one[2][2], one[2][3]).astype(np.float32)
        self.offset = np.concatenate(net.offsets).astype(np.float32)
        self.out, self.out_offset = net.out.astype(np.float32), net.out_offset.astype(np.float32)

    def log_probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """(windows, classes) for symbols (WINDOW, windows)."""
        f = FILTERS
        pairs = symbols[:-1] * (PAD + 1) + symbols[1:]
        best = np.full((symbols.shape[1], 3 * f), -np.inf, np.float32)
        for t in range(WINDOW - 1):
            sums = self.first.take(pairs[t], 0)
            if t + 2 < WINDOW:
                sums[:, f : 2 * f] += self.third.take(symbols[t + 2], 0)
            else:
                sums[:, f : 2 * f] = -np.inf
            if t + 3 < WINDOW:
                sums[:, 2 * f :] += self.second.take(pairs[t + 2], 0)
            else:
                sums[:, 2 * f :] = -np.inf
            np.maximum(best, sums, out=best)
        return log_softmax((np.maximum(best + self.offset, 0) @ self.out + self.out_offset).astype(np.float64))

    def read(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log probabilities (texts, classes), by bytes, for texts that end at `ends` in `data`; 0 for empty ones."""
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // WINDOW)
        of = np.repeat(np.arange(len(ends)), counts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[of] + WINDOW * number
        sizes = np.minimum(WINDOW, ends[of] - starts)
        sums = np.zeros((len(ends), len(self.out_offset)))
        for at in range(0, len(of), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            logs = self.log_probabilities(windows_of(data, starts[part], sizes[part]))
            np.add.at(sums, of[part], logs * sizes[part, None])
        return sums / np.maximum(ends - begins, 1)[:, None]
