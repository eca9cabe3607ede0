"""A small causal self-attention language model over subword ids, in numpy.

The next subword is drawn in two steps: its class from a softmax over classes, whose logits are corpus-wide class counts after the last
subword plus what attention over the window adds; then the subword within its class from corpus-wide counts after the last subword. The
counts come from the whole training corpus; attention is trained by gradient descent. A class holds either subwords that begin a word (they
start with a space; the document mark is one of them) or others, so the model also says how likely a word ends after a subword.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids of the vocabulary, and the id that begins and ends a document.
VOCABULARY, DOCUMENT = 50_257, 50_256


@dataclass(frozen=True)
class Shape:
    """Sizes: subwords with rows of their own (two more rows are for all others), classes of either kind, single ones among them, model and head width, window and step."""

    rows: int = 1280
    classes: int = 64
    singles: int = 40
    dim: int = 24
    head: int = 12
    window: int = 32
    step: int = 28


#: Weights are made of x * STEPS + ZERO: the lowest 22 bits of that number, moved to the top, are a float near e^x.
STEPS, ZERO = np.float32((1 << 14) / np.log(2)), np.float32((1 << 23) + (127 << 14))
_LEAST, _MOST = ZERO - 80 * STEPS, ZERO + 80 * STEPS


def weights(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """`positive` of values that are given times STEPS plus ZERO already. x may be overwritten; the result is in room (float32, as large) if given."""
    if len(x) and (x.max() > _MOST or x.min() < _LEAST):
        np.clip(x, _LEAST, _MOST, out=x)
    if room is None:
        room = np.empty(x.shape, np.float32)
    np.multiply(x.view(np.int32), np.int32(512), out=room.view(np.int32))  # a product in whole numbers wraps, as a shift does, and is faster
    return room


def positive(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """e^x but for up to 6%: exact at powers of two and linear between them (in steps of 2^-14), so positive and rising, at a fraction of the cost. Overwrites x; the result is in room (float32, as large) if given.

    Wherever weights are made of it, it stands above and below the line, so they still add up to 1.
    """
    x *= STEPS
    x += ZERO
    return weights(x, room)


def _classes(mass: np.ndarray, shape: Shape) -> np.ndarray:
    """Class of each of some rows, the most frequent first: one a class for `singles`, then classes of about equal mass."""
    one, many = min(shape.singles, len(mass)), shape.classes - shape.singles
    rest = np.cumsum(mass[one:]) - mass[one:]
    return np.r_[np.arange(one), one + np.minimum(many - 1, rest * many / max(mass[one:].sum(), 1e-9)).astype(int)]


@dataclass
class Counts:
    """Corpus tables: row of each id; class of each row; class logits and within-class log probabilities by last row; share of ids in their shared row; which classes begin words."""

    row: np.ndarray
    kind: np.ndarray
    prior: np.ndarray
    within: np.ndarray
    rest: np.ndarray
    opens: np.ndarray

    @staticmethod
    def rows_of(unigram: np.ndarray, begins: np.ndarray, shape: Shape) -> np.ndarray:
        """Row of each id: the most frequent have their own (the document mark the first), others that begin words share the last but one, others the last."""
        weight = unigram.astype(float)
        weight[DOCUMENT] = np.inf
        order = np.argsort(-weight, kind="stable")
        row = np.where(begins, shape.rows - 2, shape.rows - 1).astype(np.int32)
        row[order[: shape.rows - 2]] = np.arange(shape.rows - 2)
        return row

    @classmethod
    def of(cls, unigram: np.ndarray, begins: np.ndarray, inside: np.ndarray, ends: np.ndarray, starts: np.ndarray, shape: Shape) -> Counts:
        """unigram, begins: by id. By row: pairs inside words, words that end with it, and words (or document ends) that begin with it."""
        m = shape.rows
        row = cls.rows_of(unigram, begins, shape)
        by_row = np.bincount(row, unigram, m) + 0.5
        opens = np.zeros(m, bool)
        opens[row] = begins
        opens[m - 2] = True
        kind, k = np.zeros(m, np.int64), 0
        for which in (opens, ~opens):
            at = np.flatnonzero(which)
            kind[at] = k + _classes(by_row[at], shape)
            k = int(kind[at].max()) + 1 if len(at) else k
        total = inside + np.outer(ends, starts / max(starts.sum(), 1))
        member = np.zeros((m, k))
        member[np.arange(m), kind] = 1
        of_class, in_class = total @ member, by_row / (by_row @ member)[kind]
        prior = np.log((of_class + 4 * np.maximum(by_row @ member, 1e-12) / by_row.sum()) / (of_class.sum(axis=1, keepdims=True) + 4))
        within = np.log((total + 4 * in_class) / (of_class[:, kind] + 4))
        rest, shared = np.zeros(VOCABULARY), np.flatnonzero(row >= m - 2)
        mass = np.bincount(row[shared], unigram[shared] + 0.1, m)
        rest[shared] = np.log((unigram[shared] + 0.1) / mass[row[shared]])
        class_opens = np.zeros(k, np.float32)
        class_opens[kind[opens]] = 1
        return cls(row, kind.astype(np.int32), prior.astype(np.float32), within.astype(np.float32), rest.astype(np.float32), class_opens)


def windows(sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with `sizes` ids laid end to end: the first place of each window, and which places of it are scored (a row a window).

    Place t predicts id t + 1. Windows overlap by window - step places; each place but the last of a document is scored once, in the
    first window that holds it.
    """
    t, s = shape.window, shape.step
    targets = np.maximum(sizes - 1, 0)
    count = np.where(targets > 0, 1 + np.maximum(0, -(-(targets - t) // s)), 0)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(sizes) - sizes, count) + nth * s
    left = np.repeat(targets, count) - nth * s
    place = np.arange(t)
    return begin, (place < left[:, None]) & ((place >= t - s) | (nth == 0)[:, None])


class Attention:
    """The network; float32 weights in `p`."""

    def __init__(self, counts: Counts, shape: Shape, seed: int = 11):
        r, s = np.random.default_rng(seed), shape
        g = lambda *n, scale: (r.standard_normal(n) * scale).astype(np.float32)
        self.counts, self.shape = counts, s
        self.p = {
            "embed": g(s.rows, s.dim, scale=0.3), "place": g(s.window, s.dim, scale=0.1), "query": g(s.dim, s.head, scale=s.dim**-0.5), "key": g(s.dim, s.head, scale=s.dim**-0.5), "value": g(s.dim, s.head, scale=s.dim**-0.5),
            "merge": g(s.head, s.dim, scale=s.head**-0.5), "out": np.zeros((s.dim, len(counts.opens)), np.float32),
        }
        self.past = np.tri(s.window, dtype=np.float32)

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Masked self-attention over windows of rows (n x window)."""
        p = self.p
        x = p["embed"][rows]
        x += p["place"]
        q, k, v = x @ (p["query"] * np.float32(self.shape.head**-0.5)), x @ p["key"], x @ p["value"]
        a = positive(np.matmul(q, k.transpose(0, 2, 1))) * self.past
        a /= a.sum(axis=2, keepdims=True)
        o = np.matmul(a, v)
        return x, q, k, v, a, o, x + o @ p["merge"]

    def class_probs(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probabilities of the next subword's class from hidden states and last rows."""
        d = positive(h @ self.p["out"] + self.counts.prior[last])
        return d / d.sum(axis=1, keepdims=True)

    def log_probs(self, ids: np.ndarray, sizes: np.ndarray, batch: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every id of documents laid end to end, but the first of each (zero there), and of any id that begins a word in its place.

        The same sums as `hidden` and `class_probs`, laid out for speed: one product for queries, keys and values, weights that are divided once
        they are summed up, and row sums as products.
        """
        p, c, s = self.p, self.counts, self.shape
        out, opening = np.zeros(len(ids)), np.zeros(len(ids))
        begin, scored = windows(sizes, s)
        rows = np.append(c.row[ids], np.zeros(s.window, np.int32))
        place = np.arange(s.window)
        into = np.concatenate([p["query"] * (STEPS * np.float32(s.head**-0.5)), p["key"], p["value"]], axis=1)
        to_class, prior = p["out"] * STEPS, c.prior * STEPS + ZERO
        sums = np.stack([np.ones(len(c.opens), np.float32), c.opens], axis=1)
        # written over by every batch: new memory for each costs more than the sums
        most, k = min(batch, len(begin)) * s.window, len(c.opens)
        by_class, of_class = np.empty((2, most, k), np.float32)
        by_place, of_place = np.empty((2, most // s.window, s.window, s.window), np.float32)
        valued = np.ones((most // s.window, s.window, s.head + 1), np.float32)
        embedded, into_room = np.empty((most, s.dim), np.float32), np.empty((most, 3 * s.head), np.float32)
        for i in range(0, len(begin), batch):
            at = begin[i : i + batch, None] + place
            w, keep = len(at), np.flatnonzero(scored[i : i + batch])
            x = p["embed"].take(rows[at].ravel(), axis=0, out=embedded[: w * s.window], mode="clip").reshape(w, s.window, s.dim)
            x += p["place"]
            qkv = np.matmul(embedded[: w * s.window], into, out=into_room[: w * s.window]).reshape(w, s.window, 3 * s.head)
            v = valued[:w]
            v[:, :, :-1] = qkv[:, :, 2 * s.head :]
            a = np.matmul(qkv[:, :, : s.head], qkv[:, :, s.head : 2 * s.head].transpose(0, 2, 1), out=by_place[:w])
            a += ZERO
            a = weights(a, of_place[:w])
            a *= self.past
            o = np.matmul(a, v).reshape(-1, s.head + 1).take(keep, axis=0)
            h = (o[:, :-1] / o[:, -1:]) @ p["merge"]
            h += embedded.take(keep, axis=0)
            at = at.ravel()[keep]
            last, goal = rows[at], rows[at + 1]
            logits = np.matmul(h, to_class, out=by_class[: len(at)])
            logits += prior.take(last, axis=0, out=of_class[: len(at)], mode="clip")
            logits = weights(logits, of_class[: len(at)])
            both = np.log(logits @ sums)
            picked = np.log(logits[np.arange(len(at)), c.kind[goal]])
            out[at + 1] = picked - both[:, 0] + c.within[last, goal]
            opening[at + 1] = both[:, 1] - both[:, 0]
        out += c.rest[ids]
        out[np.cumsum(sizes) - sizes] = 0
        return out, opening

    def train(self, ids: np.ndarray, scored: np.ndarray, epochs: int = 1, rate: float = 3e-3, batch: int = 48, seed: int = 5) -> None:
        """Adam on the class losses of windows in a fixed random order. ids: a row a window, of one place more than it; scored: which places count."""
        c, order = self.counts, np.random.default_rng(seed)
        rows = c.row.astype(np.uint16)[ids]
        m, v2 = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        t, total, prior = 0, max(1, epochs * -(-len(rows) // batch)), c.prior * STEPS + ZERO
        for _ in range(epochs):
            todo = order.permutation(len(rows))
            for i in range(0, len(todo), batch):
                w = todo[i : i + batch]
                grads, used = self.gradients(rows[w], np.flatnonzero(scored[w]), prior)
                t += 1
                step = np.float32(rate * min(1.0, t / 50) * (1.0 - 0.9 * t / total) / (1 - 0.9**t))
                two = np.float32(1 / (1 - 0.99**t))
                for name, grad in grads.items():
                    own, first, second = (x[used] if name == "embed" else x for x in (self.p[name], m[name], v2[name]))
                    first += np.float32(0.1) * (grad - first)
                    second += np.float32(0.01) * (grad * grad - second)
                    own -= step * first / (np.sqrt(second * two) + np.float32(1e-8))
                    if name == "embed":
                        self.p[name][used], m[name][used], v2[name][used] = own, first, second

    def gradients(self, rows: np.ndarray, keep: np.ndarray, prior: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean class loss over the places `keep` (of all windows, end to end) of windows of rows, a place more in each; and the rows that those of "embed" belong to.

        prior: the counts' own, as `weights` takes it. The same sums as `hidden` and `class_probs`, laid out for speed as in `log_probs`: weights
        are divided once they are summed up, also on the way back.
        """
        p, c, s = self.p, self.counts, self.shape
        n, t, h = len(rows), s.window, s.head
        seen = rows[:, :-1].ravel()
        scale = np.float32(h**-0.5)
        into = np.concatenate([p["query"] * scale, p["key"], p["value"]], axis=1)
        x = p["embed"].take(seen, axis=0)
        x.reshape(n, t, -1)[:] += p["place"]
        qkv = (x @ into).reshape(n, t, 3 * h)
        q, k = qkv[:, :, :h], qkv[:, :, h : 2 * h]
        v = np.ones((n, t, h + 1), np.float32)
        v[:, :, :h] = qkv[:, :, 2 * h :]
        a = np.matmul(q * STEPS, k.transpose(0, 2, 1))
        a += ZERO
        a = weights(a)
        a *= self.past
        o = np.matmul(a, v).reshape(-1, h + 1)
        share = 1 / o[:, h:]
        o = o[:, :h] * share
        found = (x + o @ p["merge"]).take(keep, axis=0)
        d = found @ (p["out"] * STEPS)
        d += prior.take(seen[keep], axis=0)
        d = weights(d)
        d *= 1 / (len(keep) * (d @ np.ones((d.shape[1], 1), np.float32)))
        d[np.arange(len(keep)), c.kind[rows[:, 1:].ravel()[keep]]] -= np.float32(1 / max(len(keep), 1))
        back = np.zeros_like(x)
        back[keep] = d @ p["out"].T
        down = np.empty((n, t, h + 1), np.float32)
        flat = down.reshape(-1, h + 1)
        np.multiply(back @ p["merge"].T, share, out=flat[:, :h])
        np.einsum("ij,ij->i", flat[:, :h], o, out=flat[:, h])
        np.negative(flat[:, h], out=flat[:, h])
        da = np.matmul(down, v.transpose(0, 2, 1))
        da *= a
        up = np.empty((n, t, 3 * h), np.float32)
        up[:, :, :h], up[:, :, h : 2 * h] = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q)
        up[:, :, 2 * h :] = np.matmul(a.transpose(0, 2, 1), down[:, :, :h])
        up = up.reshape(-1, 3 * h)
        g_in = x.T @ up
        dx = back + up @ into.T
        line = np.argsort(seen, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(seen[line]) != 0))
        grads = {"out": found.T @ d, "merge": o.T @ back, "query": g_in[:, :h] * scale, "key": g_in[:, h : 2 * h], "value": g_in[:, 2 * h :], "place": dx.reshape(n, t, -1).sum(axis=0), "embed": np.add.reduceat(dx.take(line, axis=0), first, axis=0)}
        return grads, seen[line[first]]
