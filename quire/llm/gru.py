"""A gated recurrent language model in numpy, with class-factored output softmax.

Word numbers below ``words`` are output words, class number // members; numbers from there on
are open classes, which end with the class. Callers give states with one column a document; inside,
states, gates and logits have one row a word or document, and gates stand in blocks of their own, so
that every elementwise step runs over whole blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Logits whose largest is within this are exponentiated as they are; others are shifted first.
SAFE = 60.0
#: Documents and words that a step handles at once, and weights: so many stay in a core's cache.
BLOCK, PIECE = 1024, 32768


def _softmax(logits: np.ndarray, own: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns rows of logits into probabilities times their sums, in place: (sums, log probabilities of own, their flat places).

    safe tells that the largest logit of each row is known to be within SAFE.
    """
    at = own + np.arange(0, logits.size, logits.shape[1])
    picked = logits.reshape(-1).take(at)
    if not safe:
        top = logits.max(1, initial=-np.inf)
        if top.max(initial=0) > SAFE or top.min(initial=0) < -SAFE:
            logits -= top[:, None]
            picked -= top
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return sums, picked - np.log(sums), at


def _safe(weights: np.ndarray, reach: float) -> bool:
    """Whether for all states within +-reach the largest logit of each row is within SAFE; the biases are the last row."""
    swing, bias = np.abs(weights[..., :-1, :]).sum(-2) * reach, weights[..., -1, :]
    return bool((bias + swing).max() <= SAFE and (bias - swing).max(-1).min() >= -SAFE)


class Room(dict):
    """Arrays that one window after another is computed in: fresh ones cost more than the arithmetic on them."""

    def __init__(self, kind: np.dtype):
        super().__init__()
        self.kind = kind

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, self.kind)
        return self[name][:size].reshape(shape)


@dataclass
class Gru:
    """words output words in classes of members, then open classes; hidden units."""

    words: int
    members: int
    open_classes: int
    hidden: int
    weights: dict[str, np.ndarray]

    @property
    def classes(self) -> int:
        return -(-self.words // self.members)

    @classmethod
    def fresh(cls, words: int, members: int, open_classes: int, hidden: int, seed: int = 0) -> Gru:
        r = np.random.default_rng(seed)
        classes = -(-words // members)
        init = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        weights = {
            "embed": init(words + open_classes + 1, hidden) * np.float32(5), "input": init(hidden, 3 * hidden), "gate_bias": np.zeros(3 * hidden, np.float32), "state": init(hidden, 3 * hidden),
            "class": init(hidden, classes + open_classes), "class_bias": np.zeros(classes + open_classes, np.float32),
            "word": init(max(classes, 1), hidden, members), "word_bias": np.zeros((max(classes, 1), members), np.float32),
        }
        short = classes * members - words
        if short:
            weights["word_bias"][classes - 1, members - short :] = -1e9  # places without a word
        return cls(words, members, open_classes, hidden, weights)

    def copy(self) -> Gru:
        return Gru(self.words, self.members, self.open_classes, self.hidden, {k: v.copy() for k, v in self.weights.items()})

    @property
    def start(self) -> int:
        """Number that stands before the first word of a document."""
        return self.words + self.open_classes

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Class of each word, the order that sorts them by class, and where each class of output words ends."""
        own = np.where(ids < self.words, ids // self.members, self.classes + ids - self.words)
        narrow = own.astype(np.int16 if self.classes + self.open_classes < 1 << 15 else np.int64)
        order = np.argsort(narrow, kind="stable")
        return own, order, np.searchsorted(narrow[order], np.arange(self.classes + 1)).tolist()

    def _recurrent(self, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of every word (gate, word, hidden) and state weights (gate, hidden, hidden). Gates come as
        tanh of a half, so those of the update and reset gates are halved."""
        w, n = self.weights, self.hidden
        inputs, bias, state = (w[k].reshape(-1, 3, n).swapaxes(0, 1).copy() for k in ("input", "gate_bias", "state"))
        for x in (inputs, bias, state):
            x[:2] *= 0.5
        table = np.matmul(w["embed"], inputs, out=None if room is None else room("table", 3, len(w["embed"]), n))
        table += bias
        return table, state

    def _outputs(self, reach: float) -> tuple[np.ndarray, bool, np.ndarray, bool]:
        """Class and word weights with their biases as the last row, and whether their logits are safe for states within +-reach."""
        w = self.weights
        kinds, words = np.concatenate([w["class"], w["class_bias"][None]]), np.concatenate([w["word"], w["word_bias"][:, None]], 1)
        return kinds, _safe(kinds, reach), words, _safe(words, reach)

    def _advance(self, h: np.ndarray, g: np.ndarray, state: np.ndarray, u: np.ndarray | None = None, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step from states h with gate inputs g: the next states, and what backpropagation needs."""
        u = np.matmul(h, state, out=u)
        gates = u[:2]
        gates += g[:2]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new = np.multiply(u[1], u[2], out=new)
        new += g[2]
        np.tanh(new, out=new)
        out = h - new
        out *= u[0]
        out += new
        return out, u, new

    def step(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """States (hidden, document) after each document's next word."""
        inputs, state = self._recurrent()
        return self._advance(np.ascontiguousarray(h.T), inputs.take(ids, 1), state)[0].T

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logarithms for the words that follow states (hidden, word): of word, or of open class."""
        return self._log_probabilities(self._with_one(h.T), ids, self._outputs(max(1.0, np.abs(h).max(initial=0))))

    def _with_one(self, h: np.ndarray) -> np.ndarray:
        """States with a one behind them, which stands for the bias."""
        return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)

    def _log_probabilities(self, h: np.ndarray, ids: np.ndarray, outputs: tuple[np.ndarray, bool, np.ndarray, bool]) -> np.ndarray:
        kinds, safe_kinds, words, safe_words = outputs
        own, order, cuts = self._by_class(ids)
        h, kind, k = h.take(order, 0), own[order], (ids - own * self.members)[order]
        got = np.empty(len(ids), h.dtype)
        for a in range(0, len(ids), BLOCK):
            got[a : a + BLOCK] = _softmax(h[a : a + BLOCK] @ kinds, kind[a : a + BLOCK], safe_kinds)[1]
        for c in range(self.classes):
            for a in range(cuts[c], cuts[c + 1], BLOCK):
                b = min(a + BLOCK, cuts[c + 1])
                got[a:b] += _softmax(h[a:b] @ words[c], k[a:b], safe_words)[1]
        out = np.empty_like(got)
        out[order] = got
        return out

    def score(self, documents: list[np.ndarray], window: int = 64, width: int = 32768) -> np.ndarray:
        """Natural log-likelihood of each whole document: state is carried from window to window.

        Documents run side by side, the longest first; those that have ended leave the end. A
        window holds at most about ``width`` words, so memory doesn't depend on the lengths.
        """
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        sizes = np.array([len(documents[i]) for i in order])
        flat = np.concatenate([documents[i] for i in order]) if order else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
        total = np.zeros(len(order))
        h = np.zeros((len(order), self.hidden), self.weights["state"].dtype)
        (inputs, state), outputs = self._recurrent(), self._outputs(1.0)
        last = np.full(len(order), self.start)
        at, states, targets, owners, held = 0, [], [], [], 0
        longest = int(sizes[0]) if len(sizes) else 0
        alive = len(order)
        while at < longest:
            while alive and sizes[alive - 1] <= at:
                alive -= 1
            parts = [self._advance(h[a : min(a + BLOCK, alive)], inputs.take(last[a : min(a + BLOCK, alive)], 1), state)[0] for a in range(0, alive, BLOCK)]
            h = parts[0] if len(parts) == 1 else np.concatenate(parts)
            ids = flat[starts[:alive] + at]
            states.append(h)
            targets.append(ids)
            owners.append(alive)
            held += alive
            last = ids
            at += 1
            if held >= width or len(states) >= 16 * window or at == longest:
                got = self._log_probabilities(self._with_one(np.concatenate(states)), np.concatenate(targets), outputs)
                who = np.concatenate([np.arange(n) for n in owners])
                total[: len(order)] += np.bincount(who, got, len(order))
                states, targets, owners, held = [], [], [], 0
        out = np.zeros(len(order))
        out[order] = total
        return out

    def loss(self, ids: np.ndarray, before: np.ndarray, h: np.ndarray, fresh: np.ndarray, room: Room | None = None) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean loss of one window, its last state, and gradients by truncated backpropagation.

        All of (time, lane): the words, those before them, and where a document begins, at which
        the state (hidden, lane) is reset. The gradients may lie in room, until its next use.
        """
        w, n = self.weights, self.hidden
        kind = w["state"].dtype
        room = Room(kind) if room is None else room
        steps, lanes = ids.shape
        flat, previous, count = ids.reshape(-1), before.reshape(-1).astype(np.intp), ids.size
        kinds, safe_kinds, words, safe_words = self._outputs(max(1.0, np.abs(h).max(initial=0)))
        inputs, state = self._recurrent(room)
        g = inputs.take(previous, 1, out=room("g", 3, count, n), mode="clip").reshape(3, steps, lanes, n)
        h = np.ascontiguousarray(h.T)
        keep, resets = (~fresh).astype(kind)[:, :, None], fresh.any(1).tolist()
        olds, news, saved, every = room("olds", steps, lanes, n), room("news", steps, lanes, n), room("saved", steps, 3, lanes, n), room("every", steps, lanes, n + 1)
        every[:, :, n] = 1  # for the biases
        for t in range(steps):
            if resets[t]:
                np.multiply(h, keep[t], out=olds[t])
            else:
                olds[t] = h
            h = self._advance(olds[t], g[:, t], state, saved[t], news[t])[0]
            every[t, :, :n] = h
        # words in the order of their classes; probabilities aren't divided by their sums, the states and gradients beside them are
        own, order, cuts = self._by_class(flat)
        sorted_h = every.reshape(count, n + 1).take(order, 0, out=room("sorted", count, n + 1), mode="clip")
        k, own, inside = (flat - own * self.members)[order], own[order], cuts[-1]
        dsorted, found, loss, across = room("dsorted", count, n), np.zeros_like(kinds), 0.0, w["class"].T
        for a in range(0, count, BLOCK):
            part = slice(a, min(a + BLOCK, count))
            p = np.matmul(sorted_h[part], kinds, out=room("p", part.stop - a, kinds.shape[1]))
            sums, got, at = _softmax(p, own[part], safe_kinds)
            loss -= float(got.sum())
            p.reshape(-1)[at] -= sums
            share = np.reciprocal(sums * count)[:, None]
            np.matmul(p, across, out=dsorted[part])
            dsorted[part] *= share
            found += (p.T @ (sorted_h[part] * share)).T
        grads = {"class": found[:n], "class_bias": found[n]}
        p, dword, found = room("p", inside, self.members), room("dword", inside, n), room("words", *words.shape)
        for c in range(self.classes):
            if cuts[c + 1] > cuts[c]:
                np.matmul(sorted_h[cuts[c] : cuts[c + 1]], words[c], out=p[cuts[c] : cuts[c + 1]])
        sums, got, at = _softmax(p, k[:inside], safe_words)
        loss -= float(got.sum())
        p.reshape(-1)[at] -= sums
        share = np.reciprocal(sums * count)[:, None]
        sorted_h[:inside] *= share
        for c in range(self.classes):
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                np.matmul(sorted_h[a:b].T, p[a:b], out=found[c])
                np.matmul(p[a:b], w["word"][c].T, out=dword[a:b])
            else:
                found[c] = 0
        dword *= share
        dsorted[:inside] += dword
        grads["word"], grads["word_bias"] = found[:, :n], found[:, n]
        places = np.empty(count, order.dtype)
        places[order] = np.arange(count)
        dh = dsorted.take(places, 0, out=room("dh", count, n), mode="clip").reshape(steps, lanes, n)
        # gradients before the gates: the candidate's by the state, those of update, reset and the candidate by the input
        d, part = room("d", 4, steps, lanes, n), room("part", 3, lanes, n)
        by_state, by_input = (np.ascontiguousarray(w[k].reshape(n, 3, n).transpose(1, 2, 0)) for k in ("state", "input"))
        by_state = by_state[[2, 0, 1]]
        back = np.zeros((lanes, n), kind)
        for t in range(steps - 1, -1, -1):
            (z, r, u), own, slope = saved[t], d[:, t], 1 - saved[t, :2]
            back += dh[t]
            dnew = np.multiply(news[t], news[t], out=own[3])
            np.subtract(1, dnew, out=dnew)
            dnew *= slope[0]
            dnew *= back
            np.multiply(dnew, r, out=own[0])
            slope *= saved[t, :2]
            np.subtract(olds[t], news[t], out=own[1])
            own[1] *= back
            np.multiply(dnew, u, out=own[2])
            own[1:3] *= slope
            back *= z
            for x in np.matmul(own[:3], by_state, out=part):
                back += x
            if resets[t]:
                back *= keep[t]
        d = d.reshape(4, count, n)
        found = np.matmul(d[:3].swapaxes(1, 2), olds.reshape(count, n))
        grads["state"] = np.concatenate([found[1], found[2], found[0]]).T
        x = room("sorted", count, n + 1)
        x[:, :n], x[:, n] = w["embed"].take(previous, 0, out=room("dsorted", count, n), mode="clip"), 1
        found = np.matmul(d[1:].swapaxes(1, 2), x).reshape(3 * n, n + 1).T
        grads["input"], grads["gate_bias"] = found[:n], found[n]
        de = np.add.reduce(np.matmul(d[1:], by_input, out=room("g", 3, count, n)), 0, out=room("dsorted", count, n))
        x = room("columns", n, count)
        x[:] = de.T
        found = room("embed", n, len(w["embed"]))
        for i in range(n):
            found[i] = np.bincount(previous, x[i], len(w["embed"]))
        grads["embed"] = found.T
        return loss / count, h.T, grads


class Trainer:
    """Adam on a network, whose moments last from one lot of documents to the next."""

    def __init__(self, model: Gru, lanes: int = 256, window: int = 32):
        self.model, self.lanes, self.window, self.updates = model, lanes, window, 0
        # one row of all weights, of which the model's are parts
        self.flat = np.concatenate([w.ravel() for w in model.weights.values()])
        ends = np.cumsum([w.size for w in model.weights.values()])
        model.weights = {k: self.flat[end - w.size : end].reshape(w.shape) for end, (k, w) in zip(ends.tolist(), model.weights.items(), strict=True)}
        self.moments = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room = Room(self.flat.dtype)

    def update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.updates += 1
        every, at = self.room("grads", self.flat.size), 0
        for k, w in self.model.weights.items():
            every[at : at + w.size].reshape(w.shape)[...] = grads[k]
            at += w.size
        scale = min(1.0, 1.0 / (float(np.sqrt(np.dot(every, every))) + 1e-9))
        first, second = 1 - 0.9**self.updates, 1 - 0.99**self.updates
        for a in range(0, len(every), PIECE):
            g, m, v, w = (x[a : a + PIECE] for x in (every, *self.moments, self.flat))
            m *= 0.9
            v *= 0.99
            m += g * (0.1 * scale)
            g *= g
            g *= 0.01 * scale * scale
            v += g
            np.multiply(v, 1 / second, out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate / first
            w -= g

    def learn(self, documents: list[np.ndarray], least_updates: int = 1, rate: float = 0.01, last: float = 1.0) -> list[float]:
        """Windows of all documents, each lane running through documents one after another: all of
        them once or, if they are few, as often as least_updates takes. The rate falls to its share last;
        the words that fill up the lanes are the first ones again. Returns the losses."""
        documents = [d for d in documents if len(d)]
        if not documents:
            return []
        model = self.model
        flat = np.concatenate(documents)
        fresh = np.zeros(len(flat), bool)
        fresh[np.cumsum([0, *map(len, documents)])[:-1]] = True
        before = np.concatenate([[model.start], flat[:-1]])
        before[fresh] = model.start
        lanes = max(1, min(self.lanes, len(flat) // (4 * self.window)))
        length = -(-len(flat) // lanes)
        flat, before, fresh = (np.concatenate([x, x[: lanes * length - len(x)]]) for x in (flat, before, fresh))
        window = min(self.window, length)
        grid = [np.ascontiguousarray(x.reshape(lanes, length).T) for x in (flat, before, fresh)]
        losses: list[float] = []
        once = range(0, length, window)
        plan = [a for _ in range(-(-least_updates // len(once))) for a in once]
        h = np.zeros((model.hidden, lanes), model.weights["state"].dtype)
        for i, a in enumerate(plan, 1):
            if a == 0:
                h = np.zeros_like(h)
            ids, prev, first = (x[a : a + window] for x in grid)
            loss, h, grads = model.loss(ids, prev, h, first, self.room)
            losses.append(loss)
            self.update(grads, rate * (1 - (1 - last) * i / len(plan)))
        return losses


def train(model: Gru, documents: list[np.ndarray], lanes: int = 96, window: int = 32, least_updates: int = 150, rate: float = 0.01, last: float = 0.1) -> list[float]:
    """Fit a model to a few documents, as Trainer does."""
    return Trainer(model, lanes, window).learn(documents, least_updates, rate, last)
