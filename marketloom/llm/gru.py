"""A small gated recurrent network over token numbers with a class-factored softmax, in numpy.

Tokens are numbered 0 .. n_words + n_shapes - 1: single words first, in classes of `size` words each,
then classes of rare words that the network predicts as a whole. The output is a softmax over all
classes times, for a single word, a softmax over the words of its class. Documents are laid side by
side in lanes; a window of a few steps of all lanes is one step of training (truncated
backpropagation), and the state is carried from window to window until the document ends.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

f32 = np.float32
#: Rows of scores at once.
ROWS = 2048
#: States that wait until their outputs are told at once.
WAITING = 32_768


@dataclass(frozen=True)
class Shape:
    """Sizes of a network: words, words of a class, classes of rare words, hidden units."""

    n_words: int
    size: int
    n_shapes: int
    hidden: int

    @property
    def word_classes(self) -> int:
        return -(-self.n_words // self.size)

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, c = self.hidden, self.word_classes
        return {"E": (self.n_words + self.n_shapes, h), "W": (h, 3 * h), "b": (3 * h,), "U": (h, 3 * h), "C": (h, c + self.n_shapes),
                "cb": (c + self.n_shapes,), "O": (c, h, self.size), "ob": (c, self.size)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the parameters inside one flat vector."""
        out, at = {}, 0
        for name, dims in self.parts().items():
            n = int(np.prod(dims))
            out[name], at = flat[at:at + n].reshape(dims), at + n
        return out

    def length(self) -> int:
        return sum(int(np.prod(d)) for d in self.parts().values())


def initial(shape: Shape, counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters that predict the frequencies of the tokens, whatever came before."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.length(), f32)
    p = shape.split(flat)
    p["E"][:] = rng.normal(0, 0.3, p["E"].shape)
    p["W"][:] = rng.normal(0, shape.hidden ** -0.5, p["W"].shape)
    p["U"][:] = rng.normal(0, shape.hidden ** -0.5, p["U"].shape)
    words = np.zeros(shape.word_classes * shape.size)
    words[:shape.n_words] = counts[:shape.n_words] + 0.1
    words = words.reshape(shape.word_classes, shape.size)
    classes = np.r_[words.sum(1), counts[shape.n_words:] + 0.1]
    with np.errstate(divide="ignore"):
        p["cb"][:] = np.log(classes / classes.sum())
        p["ob"][:] = np.maximum(np.log(words / words.sum(1, keepdims=True)), -50.0)  # places without a word
    return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The sigmoid of -x, in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, pick: np.ndarray, buffer: np.ndarray | None = None):
    """(log-probability of the picked output, probabilities before division, their sum) of each row of scores."""
    x = np.matmul(states, weights, out=buffer)
    x += bias
    return picked(x, pick)


def picked(x: np.ndarray, pick: np.ndarray):
    """softmax of scores, which are overwritten."""
    rows = np.arange(len(x))
    own = x[rows, pick].astype(np.float64)
    if not np.abs(x[:, :8]).max(initial=0) < 60 or x.max(initial=0) > 60:  # else no row can overflow
        shift = x.max(1)
        x -= shift[:, None]
        own -= shift
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return own - np.log(total.astype(np.float64)), x, total


class Lanes:
    """Documents side by side: every lane is a row of whole documents, the longest lanes first.

    With cut, a longer document is laid out in parts of that many tokens. Every part but the first follows the
    token before it, with a fresh state."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, n_lanes: int, end: int, cut: int | None = None):
        before = np.r_[end, ids[:-1]][:len(ids)]
        before[first[:-1]] = end
        if cut:
            parts = -(-np.diff(first) // cut)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.r_[np.repeat(first[:-1], parts) + nth * cut, first[-1]]
        lengths = np.diff(first)
        heap = [(0, lane) for lane in range(max(1, min(n_lanes, len(lengths))))]
        lanes: list[list[int]] = [[] for _ in heap]
        for doc in np.argsort(-lengths, kind="stable").tolist():
            total, lane = heap[0]
            lanes[lane].append(doc)
            heapq.heapreplace(heap, (total + int(lengths[doc]), lane))
        lanes.sort(key=lambda docs: -int(lengths[docs].sum()))
        order = np.array([d for docs in lanes for d in docs], dtype=np.int64)
        size = lengths[order]
        starts = np.cumsum(size) - size
        self.doc = np.repeat(order, size)
        source = np.arange(len(ids)) - np.repeat(starts, size) + np.repeat(first[order], size)
        self.target, self.given = ids[source], before[source]
        self.begin = np.zeros(len(ids), bool)
        self.begin[starts] = True
        self.length = np.array([int(lengths[docs].sum()) for docs in lanes], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def windows(self, steps: int):
        """(positions, which of them exist), both steps by lanes; lanes that have ended leave."""
        for at in range(0, int(self.length[0]) if len(self.length) else 0, steps):
            active = int(np.searchsorted(-self.length, -at, "left"))
            t = at + np.arange(min(steps, int(self.length[0]) - at))[:, None]
            exists = t < self.length[:active]
            yield self.offset[:active] + np.minimum(t, self.length[:active] - 1), exists


class Network:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.p = shape, flat, shape.split(flat)

    def run(self, given: np.ndarray, begin: np.ndarray, h: np.ndarray, table: np.ndarray, keep: bool = False):
        """States after every step of a window, and what backpropagation needs."""
        H = self.shape.hidden
        U = self.turned(self.p["U"])
        size, kind = given.shape, self.flat.dtype
        states, x, r = np.empty((*size, H), kind), np.empty((size[1], 3 * H), table.dtype), np.empty((size[1], 3 * H), kind)
        kept = tuple(np.empty((*size, n), kind) for n in (H, 2 * H, H, H)) if keep else ()
        fresh = begin.any(1)
        for t in range(len(given)):
            prev = np.where(begin[t][:, None], f32(0), h) if fresh[t] else h
            np.take(table, given[t], axis=0, out=x, mode="clip")
            np.matmul(prev, U, out=r)
            zr = x[:, :2 * H]
            zr += r[:, :2 * H]
            sigmoid(zr)
            z, gate, inner = zr[:, :H], zr[:, H:], r[:, 2 * H:]
            g = gate * inner
            g += x[:, 2 * H:]
            sigmoid(g)  # tanh by one exponential
            g *= 2
            g -= 1
            h = states[t]
            np.subtract(prev, g, out=h)
            h *= z
            h += g
            for whole, part in zip(kept, (prev, zr, inner, g)):
                whole[t] = part
        return states, h, kept

    def turned(self, x: np.ndarray) -> np.ndarray:
        """What is added to the gates with the sign, and for tanh the factor, that their exponentials need; both are exact."""
        H = self.shape.hidden
        return x * np.repeat(np.array([-1, -2], x.dtype), [2 * H, H])

    def table(self, tokens=slice(None)) -> np.ndarray:
        """What every token adds to the gates, turned."""
        return self.turned(self.p["E"][tokens] @ self.p["W"] + self.p["b"])

    def output(self, states: np.ndarray, target: np.ndarray, grad: dict | None = None):
        """Natural log-probability of each target after its state; with grad, also the gradient to the states (of the negative sum)."""
        p, s = self.p, self.shape
        rows = np.arange(len(target))
        single = target < s.n_words
        cls = np.where(single, target // s.size, s.word_classes + target - s.n_words)
        back = None
        if grad is None:  # a few rows at a time, so that the scores stay in the cache
            logp, buffer = np.empty(len(target)), np.empty((min(ROWS, len(target)), p["C"].shape[1]), states.dtype)
            for at in range(0, len(target), ROWS):
                part = states[at:at + ROWS]
                logp[at:at + ROWS] = softmax(part, p["C"], p["cb"], cls[at:at + ROWS], buffer[:len(part)])[0]
        else:
            logp, e, total = softmax(states, p["C"], p["cb"], cls)
            e /= total[:, None]
            e[rows, cls] -= 1
            grad["C"] += states.T @ e
            grad["cb"] += e.sum(0)
            back = e @ p["C"].T
        order = np.flatnonzero(single)
        order = order[np.argsort(cls[order].astype(np.min_scalar_type(s.word_classes)), kind="stable")]
        edges = np.searchsorted(cls[order], np.arange(s.word_classes + 1)).tolist()
        classes = [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        own, place = states[order], target[order] % s.size
        if grad is None:
            for c, a, b in classes:
                logp[order[a:b]] += softmax(own[a:b], p["O"][c], p["ob"][c], place[a:b])[0]
            return logp, back
        scores, more = np.empty((len(order), s.size), states.dtype), np.empty_like(own)
        for c, a, b in classes:
            np.matmul(own[a:b], p["O"][c], out=scores[a:b])
            scores[a:b] += p["ob"][c]
        found, e, total = picked(scores, place)
        logp[order] += found
        e /= total[:, None]
        e[np.arange(len(order)), place] -= 1
        for c, a, b in classes:
            grad["O"][c] += own[a:b].T @ e[a:b]
            grad["ob"][c] += e[a:b].sum(0)
            np.matmul(e[a:b], p["O"][c].T, out=more[a:b])
        back[order] += more
        return logp, back

    def backward(self, tokens: np.ndarray, given: np.ndarray, begin: np.ndarray, kept: tuple, back: np.ndarray, grad: dict) -> None:
        """Truncated backpropagation through one window; given: places in tokens, back: gradient to each state."""
        H, turned = self.shape.hidden, np.ascontiguousarray(self.p["U"].T)
        prev, zr, inner, g = kept
        z, gate = np.ascontiguousarray(zr[..., :H]), np.ascontiguousarray(zr[..., H:])
        # what each step multiplies, for all steps at once
        rest = 1 - z
        update = (prev - g) * z * rest
        toward = rest * (1 - g * g)
        reset = f32(-0.5) * inner * gate * (1 - gate)  # inner is turned
        dtable, dr = (np.empty((*given.shape, 3 * H), f32) for _ in range(2))
        dh = np.zeros_like(back[0])
        fresh = begin.any(1)
        for t in range(len(given) - 1, -1, -1):
            dh += back[t]
            d, e = dtable[t], dr[t]
            dg = dh * toward[t]
            np.multiply(dh, update[t], out=d[:, :H])
            np.multiply(dg, reset[t], out=d[:, H:2 * H])
            d[:, 2 * H:] = dg
            e[:, :2 * H] = d[:, :2 * H]
            np.multiply(dg, gate[t], out=e[:, 2 * H:])
            dh *= z[t]
            dh += e @ turned
            if fresh[t]:
                dh[begin[t]] = 0
        grad["U"] += prev.reshape(-1, H).T @ dr.reshape(-1, 3 * H)
        flat = given.ravel()
        order = np.argsort(flat.astype(np.min_scalar_type(len(tokens))), kind="stable")
        counts = np.bincount(flat, minlength=len(tokens))
        used = np.flatnonzero(counts)
        sums = np.add.reduceat(dtable.reshape(-1, 3 * H)[order], (np.cumsum(counts) - counts)[used])
        grad["b"] += sums.sum(0)
        grad["W"] += self.p["E"][tokens[used]].T @ sums
        grad["E"][tokens[used]] += sums @ self.p["W"].T


class Trainer:
    """Adam steps, one for each window of the lanes."""

    def __init__(self, shape: Shape, flat: np.ndarray, rate: float, clip: float = 1.0):
        self.net, self.rate, self.clip = Network(shape, flat.astype(f32, copy=True)), f32(rate), clip
        self.grad_flat = np.zeros_like(self.net.flat)
        self.grad = shape.split(self.grad_flat)
        self.first, self.second, self.spare = (np.zeros_like(self.net.flat) for _ in range(3))
        self.turn = self.tokens = 0

    def learn(self, lanes: Lanes, steps: int) -> None:
        h = np.zeros((len(lanes.length), self.net.shape.hidden), f32)
        for at, exists in lanes.windows(steps):
            h = self.window(lanes.given[at], lanes.target[at], lanes.begin[at], exists, h[:at.shape[1]])

    def window(self, given, target, begin, exists, h):
        net, n = self.net, int(exists.sum())
        seen = np.zeros(len(net.p["E"]), bool)
        seen[given] = True
        tokens, given = np.flatnonzero(seen), (np.cumsum(seen) - 1)[given]
        states, h, kept = net.run(given, begin, h, net.table(tokens), keep=True)
        self.grad_flat[:] = 0
        _, out = net.output(states[exists], target[exists], self.grad)
        back = np.zeros_like(states)
        back[exists] = out
        net.backward(tokens, given, begin, kept, back, self.grad)
        self.turn, self.tokens = self.turn + 1, self.tokens + n
        self.step(1 / n)
        return h

    def step(self, scale: float) -> None:
        """One Adam step along the scaled and clipped gradient, without new arrays."""
        g, x = self.grad_flat, self.spare
        norm = float(np.sqrt(np.dot(g, g))) * scale
        g *= f32(scale * min(1.0, self.clip / max(norm, 1e-30)))
        self.first *= f32(0.9)
        self.first += np.multiply(g, f32(0.1), out=x)
        self.second *= f32(0.99)
        g *= g
        self.second += np.multiply(g, f32(0.01), out=x)
        np.sqrt(self.second, out=x)
        x += f32(1e-6)
        np.divide(self.first, x, out=x)
        x *= self.rate * f32(np.sqrt(1 - 0.99 ** self.turn) / (1 - 0.9 ** self.turn))
        self.net.flat -= x


def log_likelihood(net: Network, table: np.ndarray, ids: np.ndarray, first: np.ndarray, end: int, n_lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log-probability of every document; ids of document i are first[i]..first[i + 1], its end included."""
    lanes, out = Lanes(ids, first, n_lanes, end), np.zeros(len(first) - 1)
    h = np.zeros((len(lanes.length), net.shape.hidden), f32)
    held, waiting = [], 0

    def add():
        here = np.concatenate([x for x, _ in held])
        logp, _ = net.output(np.concatenate([x for _, x in held]), lanes.target[here])
        return np.bincount(lanes.doc[here], logp, len(out))

    for at, exists in lanes.windows(steps):
        states, h, _ = net.run(lanes.given[at], lanes.begin[at], h[:at.shape[1]], table)
        held.append((at[exists], states[exists]))
        waiting += len(held[-1][0])
        if waiting >= WAITING:  # the windows of long documents hold few lanes, so their outputs are told together
            out += add()
            held, waiting = [], 0
    return out + add() if held else out
