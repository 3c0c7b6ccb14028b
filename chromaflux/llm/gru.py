"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Output 0 ends a text; outputs up to ``words`` are the most frequent tokens; the last ``PER_CLASS`` are buckets of all
other tokens by their first two bytes. A class has ``PER_CLASS`` outputs: a token's probability is that of its class times
its own within the class, so a step costs one class, not the vocabulary.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

PER_CLASS, HIDDEN, LANES, WINDOW, RATE = 64, 16, 256, 16, 0.1
#: Rows of ``PER_CLASS`` numbers that are worked out together: some of them stay near the processor core.
BLOCK = 4096


def initial(unigram: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters that predict the unigram frequencies of the outputs; ``unigram`` holds their probabilities."""
    size, random = len(unigram), np.random.default_rng(seed)
    classes = unigram.reshape(-1, PER_CLASS)
    of_class = classes.sum(1, keepdims=True)
    normal = lambda *shape, s: (random.standard_normal(shape) * s).astype(np.float32)
    return {
        "enter": normal(size + 1, 3 * HIDDEN, s=0.3),  # what a token adds to the gates; the last row begins a text
        "gates": normal(HIDDEN, 2 * HIDDEN, s=0.2),
        "state": normal(HIDDEN, HIDDEN, s=0.2),
        "class_w": normal(HIDDEN, len(classes), s=0.05),
        "class_b": np.log(np.maximum(of_class[:, 0], 1e-12)).astype(np.float32),
        "word_w": normal(len(classes), HIDDEN, PER_CLASS, s=0.05),
        "word_b": np.log(np.maximum(classes, 1e-12) / np.maximum(of_class, 1e-12)).astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


class Lanes:
    """Whole texts laid end to end in lanes of like length, longest lanes first; windows over them are cut as they are needed.

    Memory follows the tokens: a long text beside short ones makes its own lane long, not the others.
    """

    def __init__(self, many: list[np.ndarray], most: int = LANES):
        self.count = count = max(1, min(most, len(many)))
        heap = [(0, i) for i in range(count)]
        lane: list[list[int]] = [[] for _ in range(count)]
        for i in sorted(range(len(many)), key=lambda i: -len(many[i])):
            n, at = heapq.heappop(heap)
            lane[at].append(i)
            heapq.heappush(heap, (n + len(many[i]), at))
        lane.sort(key=lambda texts: -sum(len(many[i]) for i in texts))
        order = [i for texts in lane for i in texts]
        sizes = np.array([len(many[i]) for i in order], np.int64)
        self.tokens = np.concatenate([many[i] for i in order])
        self.owner = np.repeat(np.array(order, np.int32), sizes)
        self.begin = np.zeros(len(self.tokens), bool)
        self.begin[np.cumsum(sizes) - sizes] = True
        self.length = np.array([sum(len(many[i]) for i in texts) for texts in lane], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.steps = int(self.length[0])

    def active(self, at: int) -> int:
        """Lanes that still have tokens at a step."""
        return int(np.searchsorted(-self.length, -at, side="left"))

    def window(self, at: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``targets``, ``begins`` (a text starts here) and ``owner`` (its number, -1 beyond the lane) of [step, lane], for the lanes that are active."""
        n = self.active(at)
        steps = np.arange(at, min(at + size, self.steps))[:, None]
        place = self.first[:n] + steps
        if steps[-1, 0] < self.length[n - 1]:  # no lane ends here
            return self.tokens.take(place), self.begin.take(place), self.owner.take(place)
        real = steps < self.length[:n]
        place *= real
        return self.tokens[place] * real, self.begin[place] & real, np.where(real, self.owner[place], -1)


def by_gate(x: np.ndarray) -> np.ndarray:
    """The gates' columns, side by side in ``x``, as blocks of their own: a step then works on whole blocks of memory."""
    return np.ascontiguousarray(x.reshape(len(x), -1, HIDDEN).swapaxes(0, 1))


class Space:
    """Arrays that are used again window after window, as pages of memory that are touched for the first time are dear."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        """The array of that name, as it was left or with anything in it."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, dtype)
        return self.held[name][:size].reshape(shape)


class Run:
    """One pass over lanes; ``h`` is the state that windows hand on."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.space, self.kind = p, Space(), p["word_w"].dtype
        self.start = len(p["enter"]) - 1
        self.prepare()

    def prepare(self) -> None:
        """The parameters in the forms that the passes need: gates negated, for 1 / (1 + exp(-x)), and biases as a row of the weights."""
        p = self.p
        self.enter, self.gates = by_gate(p["enter"]), by_gate(p["gates"])
        np.negative(self.enter[:2], out=self.enter[:2])
        np.negative(self.gates, out=self.gates)
        self.classes = np.concatenate([p["class_w"], p["class_b"][None]])
        self.words = np.concatenate([p["word_w"], p["word_b"][:, None]], 1)

    def window(self, target, begin, before, h, learn: bool):
        """States after each step of a window and, if ``learn``, what backpropagation needs. ``before``: the tokens ahead of the window.

        All of it is overwritten by the next window.
        """
        space, kind, (steps, n) = self.space, self.kind, target.shape
        inputs = space("inputs", steps, n, dtype=np.intp)
        inputs[0], inputs[1:] = before, target[:-1]
        fresh = begin.any(1).tolist()
        if any(fresh):
            np.copyto(inputs, self.start, where=begin)
        keep = (~begin).astype(np.float32)[..., None]
        hs, into, state = space("hs", steps, n, HIDDEN), space("into", 3, n, HIDDEN, dtype=kind), self.p["state"]
        kept = steps if learn else 1
        old, cs, gs = space("old", kept, n, HIDDEN, dtype=kind), space("cs", kept, n, HIDDEN, dtype=kind), space("gs", kept, 2, n, HIDDEN, dtype=kind)
        step = space("step", n, HIDDEN, dtype=kind)
        for t in range(steps):
            at = t if learn else 0
            if fresh[t]:
                h = h * keep[t]
            if learn:
                old[t] = h
            self.enter.take(inputs[t], axis=1, out=into, mode="clip")
            g = np.matmul(h, self.gates, out=gs[at])
            g += into[:2]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c = np.matmul(np.multiply(g[1], h, out=step), state, out=cs[at])
            c += into[2]
            np.tanh(c, out=c)
            np.subtract(c, h, out=step)
            step *= g[0]
            h = np.add(h, step, out=hs[t])
        return hs, h.copy(), (inputs, keep, fresh, old, gs, cs)

    def heads(self, hs: np.ndarray, y: np.ndarray, real: np.ndarray, learn: bool):
        """Natural-log probability of each real target, in the order that comes first; or, if ``learn``, the gradients (of their negative sum)."""
        space, kind, classes = self.space, self.kind, self.classes.shape[1]
        of_class = (y // PER_CLASS).astype(np.int16)
        if real.all():
            order = np.argsort(of_class, kind="stable")
        else:
            order = np.nonzero(real)[0]
            order = order.take(np.argsort(of_class.take(order), kind="stable"))
        n, row = len(order), np.arange(len(order))
        y, of_class = y.take(order).astype(np.intp), of_class.take(order)
        cuts = np.searchsorted(of_class, np.arange(classes + 1)).tolist()
        sorted_ = hs.take(order, axis=0, out=space("sorted", n, HIDDEN), mode="clip")
        h_all = space("h_all", n, HIDDEN + 1)
        h_all[:, :HIDDEN], h_all[:, HIDDEN] = sorted_, 1
        exp = np.matmul(h_all, self.classes, out=space("exp", n, classes, dtype=kind))
        flat_, at = exp.reshape(-1), row * classes + of_class
        log = None if learn else flat_.take(at)
        np.exp(exp, out=exp)  # states lie within 1 and weights are small: no overflow
        total = exp @ np.ones(classes, np.float32)
        if learn:  # (exp / total - target): the narrow side is divided, not the wide one
            flat_[at] -= total
            share = np.reciprocal(total)[:, None]
            narrow = np.multiply(h_all, share, out=space("narrow", n, HIDDEN + 1))
            of_classes, of_words = exp.T @ narrow, np.zeros((classes, PER_CLASS, HIDDEN + 1), np.float32)
            dh = space("dh", len(hs) + 1, HIDDEN)  # of the sorted targets; a row of zeros stands for those that are none
            dh[n] = 0
            np.matmul(exp, self.p["class_w"].T, out=dh[:n])
            dh[:n] *= share
        ones, wide, own = np.ones(PER_CLASS, np.float32), space("wide", BLOCK, PER_CLASS, dtype=kind), y - of_class * PER_CLASS
        for begin in range(0, n, BLOCK):
            end = min(begin + BLOCK, n)
            cut = [(k, max(a, begin), min(b, end)) for k, a, b in zip(range(classes), cuts, cuts[1:], strict=False) if a < end and b > begin]
            for k, a, b in cut:
                np.matmul(h_all[a:b], self.words[k], out=wide[a - begin : b - begin])
            e = wide[: end - begin]
            flat_, at = e.reshape(-1), row[: end - begin] * PER_CLASS + own[begin:end]
            if not learn:
                log[begin:end] += flat_.take(at)
            np.exp(e, out=e)
            s = e @ ones
            if not learn:
                log[begin:end] -= np.log(s)
                continue
            flat_[at] -= s
            share = np.reciprocal(s)[:, None]
            np.multiply(h_all[begin:end], share, out=narrow[begin:end])
            within = space("within", end - begin, HIDDEN)
            for k, a, b in cut:
                mine = e[a - begin : b - begin]
                of_words[k] += mine.T @ narrow[a:b]
                np.matmul(mine, self.p["word_w"][k].T, out=within[a - begin : b - begin])
            within *= share
            dh[begin:end] += within
        if not learn:
            log -= np.log(total)
            return order, log
        grad = {"class_w": of_classes[:, :HIDDEN].T, "class_b": of_classes[:, HIDDEN], "word_w": of_words[..., :HIDDEN].swapaxes(1, 2), "word_b": of_words[..., HIDDEN]}
        back = np.full(len(hs), n)
        back[order] = row
        return grad, dh.take(back, axis=0, out=space("back", len(hs), HIDDEN), mode="clip")


def summed(rows: np.ndarray, ids: np.ndarray, space: Space, together: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``ids`` and the sums of their ``rows``.

    Up to ``together`` rows of an id are a chunk, and chunks are summed side by side, longest first: the rows that are
    second in a chunk are added to the first ones as one block of memory, and so on. Then the sums are the rows.
    """
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids.take(order)
    first = np.concatenate([[0], np.nonzero(ids[1:] != ids[:-1])[0] + 1])
    ids, count, level = ids.take(first), np.append(first[1:], len(ids)) - first, 0
    while True:
        chunks = (count + together - 1) // together
        ends = np.cumsum(chunks)
        start = (first - (ends - chunks) * together).repeat(chunks) + np.arange(ends[-1]) * together
        size = np.minimum((first + count).repeat(chunks) - start, together).astype(np.int8)
        by = np.argsort(-size, kind="stable")
        start, longer = start.take(by), np.cumsum(np.bincount(size, minlength=together + 1)[::-1])[::-1]
        sums = rows.take(order.take(start), axis=0, out=space(f"sums {level}", len(start), rows.shape[1]), mode="clip")
        for i in range(1, together):
            if n := int(longer[i + 1]):
                sums[:n] += rows.take(order.take(start[:n] + i), axis=0, out=space("more rows", n, rows.shape[1]), mode="clip")
        if len(by) == len(ids):
            return ids.take(by), sums
        order = np.empty_like(by)
        order[by] = np.arange(len(by))
        rows, first, count, level = sums, ends - chunks, chunks, level + 1


def score(p: dict[str, np.ndarray], many: list[np.ndarray], most: int = LANES) -> np.ndarray:
    """log10 probability of each text, over all of its tokens, with the state carried from window to window."""
    out = np.zeros(len(many))
    if not many:
        return out
    every = Lanes(many, most)
    run, h, before = Run(p), np.zeros((every.count, HIDDEN), np.float32), np.zeros(every.count, np.int32)
    at = 0
    while at < every.steps:
        t, b, owner = every.window(at, max(64, min(512, 64 * most // max(every.active(at), 1))))
        n = t.shape[1]
        hs, h, _ = run.window(t, b, before[:n], h[:n], False)
        of = owner.ravel()
        order, log = run.heads(hs.reshape(-1, HIDDEN), t.ravel(), of >= 0, False)
        out += np.bincount(of.take(order), log, len(many))
        before, at = t[-1], at + len(t)
    return out / np.log(10)


class Learner:
    """Truncated backpropagation with per-coordinate step sizes."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = RATE):
        self.p = {k: x.copy() for k, x in p.items()}
        self.square = {k: np.full_like(x, 1e-3) for k, x in p.items()}
        self.rate, self.tokens = rate, 0

    def _step(self, name: str, grad: np.ndarray, at=...) -> None:
        grad = np.minimum(np.maximum(grad, -1), 1)
        square = self.square[name][at]  # a copy, if only some rows are taken
        square += grad * grad
        grad *= self.rate
        grad /= np.sqrt(square)
        if at is not ...:
            self.square[name][at] = square
        self.p[name][at] -= grad

    def learn(self, many: list[np.ndarray], most: int = LANES) -> None:
        if not many:
            return
        every = Lanes(many, most)
        run, h, before = Run(self.p), np.zeros((every.count, HIDDEN), np.float32), np.zeros(every.count, np.int32)
        for at in range(0, every.steps, WINDOW):
            t, b, owner = every.window(at, WINDOW)
            n = t.shape[1]
            hs, h, kept = run.window(t, b, before[:n], h[:n], True)
            real = (owner >= 0).ravel()
            grad, dh = run.heads(hs.reshape(-1, HIDDEN), t.ravel(), real, True)
            count = int(real.sum())
            self._back(dh.reshape(hs.shape), kept, grad, 1 / max(count, 1) * 8, run.space)
            run.prepare()
            self.tokens += count
            before = t[-1]

    def _back(self, dhs, kept, grad, scale: float, space: Space) -> None:
        p = self.p
        inputs, keep, fresh, old, gs, cs = kept
        steps, n = inputs.shape
        z, r = gs[:, 0], gs[:, 1]
        hold = np.subtract(1, z, out=space("hold", *old.shape))
        reset = np.multiply(r, old, out=space("reset", *old.shape))
        of_z = np.subtract(cs, old, out=space("of_z", *old.shape))
        of_z *= z
        of_z *= hold
        of_r = np.subtract(1, r, out=space("of_r", *old.shape))
        of_r *= reset
        of_c = np.multiply(cs, cs, out=space("of_c", *old.shape))
        np.subtract(1, of_c, out=of_c)
        of_c *= z
        d_in = space("d_in", steps * n, 3 * HIDDEN)
        each = d_in.reshape(steps, n, -1)
        d_z, d_r, d_c, d_zr = each[..., :HIDDEN], each[..., HIDDEN : 2 * HIDDEN], each[..., 2 * HIDDEN :], each[..., : 2 * HIDDEN]
        back_state, back_gates = p["state"].T.copy(), p["gates"].T.copy()
        d, d_rh, more = np.zeros((n, HIDDEN), np.float32), space("d_rh", n, HIDDEN), space("more", n, HIDDEN)
        for t in range(steps - 1, -1, -1):
            d += dhs[t]
            np.matmul(np.multiply(d, of_c[t], out=d_c[t]), back_state, out=d_rh)
            np.multiply(d, of_z[t], out=d_z[t])
            np.multiply(d_rh, of_r[t], out=d_r[t])
            d *= hold[t]
            d_rh *= r[t]
            d += d_rh
            d += np.matmul(d_zr[t], back_gates, out=more)
            if fresh[t]:
                d *= keep[t]
        d_gates = old.reshape(-1, HIDDEN).T @ d_in[:, : 2 * HIDDEN]
        d_state = reset.reshape(-1, HIDDEN).T @ d_in[:, 2 * HIDDEN :]
        rows, sums = summed(d_in, inputs.ravel(), space)
        self._step("enter", sums * scale, rows)
        self._step("gates", d_gates * scale)
        self._step("state", d_state * scale)
        for name, g in grad.items():
            self._step(name, g * scale)
