"""LM scoring with a gated recurrent language model in numpy.

Tokens are lower-cased words and an end. The head words (at most head_size, the most
frequent of those above 1 / 2**20 of all tokens, which bounds what reaches the driver)
have an embedding each; all other words share tail classes by their last two bytes.
The output softmax is factored: first the class (head words are binned by frequency,
each tail class and the end are classes too), then the word in its class, by a softmax
over the class's words for the head, by smoothed corpus counts for a tail class. So
every word, known or not, has a probability and they sum to 1.

* Counts: every training token of the corpus, by packed hash exchange, kept as a table.
* Training: the training documents are dealt by a hash of id and text, each as a whole, to
  streams of about part_bytes, and the streams to the rounds, which together learn from
  every token once. A stream has its documents in the order of their hashes. In a round
  truncated backpropagation (bptt steps, the state carried from window to window, Adam)
  runs over each of its streams, over short ones again until there were that many updates;
  the parameters are averaged by token count, piece by piece, in the order of the streams.
  So the model depends on the rows alone, not on their order or partitions.
* Scoring: whole documents run side by side in lanes, the state carried across windows
  to a document's end; counts of tail words come from the table, once per chunk.

Defined cases: null and empty texts are one end token; a null doc_id counts as the empty
text for the fold; without training documents the model is uniform over classes; equal
rows get equal scores; other columns are ignored. Words are told apart by 58 bits of a
hash and their tail class.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _frame, _text
from .langid import held_out

TAILS = 64
#: Token numbers have 16 bits; the last can't be a head word's.
NONE = (1 << 16) - 1
LANES, WINDOW = 512, 32
#: An update goes over the parameters in blocks of so many, which stay in a core's cache.
BLOCK = 1 << 15
#: Texts are scored beside others of their length: up to these bytes, and longer ones.
LENGTHS = (1 << 13, 1 << 15)
LOG10 = float(np.log(10.0))


def tails(w: _text.Words) -> np.ndarray:
    """The tail class of each word, from its last two bytes."""
    last = w.data[w.ends - 1].astype(np.uint32)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint32)
    return (((last * 256 + before) * np.uint32(0x9E3779B1)) >> np.uint32(20)) % TAILS


def keys(w: _text.Words) -> np.ndarray:
    """Words as numbers: 58 bits of the hash, and below them the tail class."""
    return w.hashes() & ~np.uint64(TAILS - 1) | tails(w).astype(np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


@dataclass
class Vocabulary:
    """Token numbers: head words 0 to H - 1 (class by class), the end H, tail classes from H + 1."""

    hashes: np.ndarray  # of head words, by number
    counts: np.ndarray
    cuts: np.ndarray  # head class k has the words cuts[k] to cuts[k + 1] - 1
    ends: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int = 0
    words: int = 0
    order: np.ndarray = field(init=False)
    sorted: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)  # the number of a head word by 18 bits of its key; NONE if there is none
    of_class: np.ndarray = field(init=False)  # of each token number

    def __post_init__(self):
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.slots = np.full(1 << 18, NONE, np.uint16)
        self.slots[self._low(self.hashes)] = np.arange(self.head)
        k = len(self.cuts) - 1
        self.of_class = np.concatenate([np.repeat(np.arange(k), np.diff(self.cuts)), [k], k + 1 + np.arange(TAILS)])
        self.tokens = int(self.counts.sum() + self.tail_tokens.sum()) + self.ends
        self.words = int(len(self.hashes) + self.tail_words.sum()) + (self.ends > 0)

    @property
    def head(self) -> int:
        return len(self.hashes)

    @property
    def classes(self) -> int:
        return len(self.cuts) - 1 + 1 + TAILS

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(6)) & np.uint64(0x3FFFF)).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = (h & np.uint64(TAILS - 1)).astype(np.int64) + self.head + 1
        number = self.slots.take(self._low(h))
        at = np.flatnonzero(number != NONE)
        if len(at):
            number = number.take(at)
            same = self.hashes.take(number) == h.take(at)
            out[at[same]] = number[same]
            at = at[~same]  # words of the tail, and the head words that share a slot with another
            found = np.minimum(np.searchsorted(self.sorted, h.take(at)), self.head - 1)
            same = self.sorted.take(found) == h.take(at)
            out[at[same]] = self.order[found[same]]
        return out

    def class_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.of_class.take(numbers)

    def class_counts(self) -> np.ndarray:
        own = np.add.reduceat(self.counts, self.cuts[:-1]) if self.head else np.zeros(0)
        return np.concatenate([own, [self.ends], self.tail_tokens]) + 0.5


def vocabulary(hashes: np.ndarray, counts: np.ndarray, classes: int, ends: int, tail_tokens: np.ndarray, tail_words: np.ndarray) -> Vocabulary:
    """Head words in falling frequency, binned into classes of equal root mass."""
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    mass = np.cumsum(np.sqrt(counts / max(1, counts.sum())))
    bins = np.minimum((mass / (mass[-1] if len(mass) else 1) * classes).astype(np.int64), classes - 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(hashes)]]) if len(hashes) else np.zeros(1, np.int64)
    return Vocabulary(hashes, counts, cuts, ends, tail_tokens, tail_words)


def _sigmoid_of_twice(x: np.ndarray) -> np.ndarray:
    """In place: the sigmoid of 2 x."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _totals(of: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """For each row of rows, and each number below n, the sum where of has that number."""
    out = np.empty((len(rows), n), rows.dtype)
    for own, row in zip(out, rows, strict=True):
        own[:] = np.bincount(of, row, n)
    return out


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in sorted_keys (not empty), and whether it is there; keys are sought in rising order, which is kind to caches."""
    order = np.argsort(keys)
    keys = keys.take(order)
    at, same = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    near = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    at[order], same[order] = near, sorted_keys.take(near) == keys
    return at, same


class Model:
    """A GRU and the factored softmax over a vocabulary's classes and head words."""

    def __init__(self, vocab: Vocabulary, embed: int = 24, hidden: int = 32, seed: int = 7):
        self.vocab = vocab
        rng, f = np.random.default_rng(seed), np.float32
        n = vocab.head + 1 + TAILS
        init = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(f)
        words = np.log(vocab.counts / np.repeat(np.add.reduceat(vocab.counts, vocab.cuts[:-1]), np.diff(vocab.cuts))) if vocab.head else np.zeros(0)
        mass = vocab.class_counts()
        self.p = {"E": init(n, embed), "W": init(embed, 3 * hidden), "U": init(hidden, 3 * hidden), "b": np.zeros(3 * hidden, f), "Wc": init(hidden, vocab.classes) * f(0.1), "bc": np.log(mass / mass.sum()).astype(f), "Wo": init(vocab.head, hidden) * f(0.1), "bo": words.astype(f)}
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def states(self, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, hidden, lanes) after each token of x (steps, lanes), from h (hidden, lanes); keep collects what backpropagation needs.

        Lanes are the last axis throughout, so that gates are blocks of rows."""
        n, u, w = self.hidden, self.p["U"].T.copy(), np.concatenate([self.p["W"], self.p["b"][None]]).T.copy()
        e = np.concatenate([self.p["E"], np.ones_like(self.p["E"][:, :1])], axis=1)  # a one for the bias
        for half in (u, w):  # of a gate's input: its sigmoid is taken by way of tanh
            half[: 2 * n] *= 0.5
        out = np.empty((len(x), n, x.shape[1]), h.dtype)
        for t in range(len(x)):
            if start[t].any():
                h = h * ~start[t]
            into = e.take(x[t], axis=0)
            g, hu = w @ into.T, u @ h
            g[: 2 * n] += hu[: 2 * n]
            _sigmoid_of_twice(g[: 2 * n])
            z, r, c, hu = g[:n], g[n : 2 * n], g[2 * n :], hu[2 * n :]
            c += r * hu
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((into[:, :-1], h, z, r, c, hu))
            np.subtract(h, c, out=out[t])
            out[t] *= z
            out[t] += c
            h = out[t]
        return out

    def bounds(self) -> tuple[float, float]:
        """The largest size that a logit of a class, and of a word in its class, can have: states are within -1 and 1."""
        one = lambda w, b: float(np.abs(w).sum(axis=0).max(initial=0) + np.abs(b).max(initial=0))
        return one(self.p["Wc"], self.p["bc"]), one(self.p["Wo"].T, self.p["bo"])

    def log_probs(self, hs: np.ndarray, y: np.ndarray, grads: dict | None = None, bounds: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of class times word in class for states (steps, hidden, lanes) and tokens y (steps, lanes) (words of the tail: the class alone).

        With grads, also adds the gradients of the mean loss and returns that of hs."""
        p, cuts, n = self.p, self.vocab.cuts, y.size
        cls, (class_bound, word_bound) = self.vocab.class_of(y), bounds or self.bounds()
        out, dh = np.empty(y.shape), None if grads is None else np.empty_like(hs)
        lanes, ones = np.arange(y.shape[1]), np.ones(max(n, int(np.diff(cuts).max(initial=0))), hs.dtype)
        # exp(a + b) is exp(a) exp(b): biases come in by factors of sums, not of every element, unless they could overflow
        wc, bc, large = p["Wc"].T.copy(), p["bc"], class_bound > 40
        factor = np.ones_like(bc) if large else np.exp(bc)
        back, own_wc, own_bc = p["Wc"] * factor, np.zeros_like(wc), np.zeros_like(bc)
        for t, h in enumerate(hs):
            e = wc @ h
            if large:
                e += bc[:, None]
                e -= e.max(axis=0)
            out[t] = e[cls[t], lanes]
            np.exp(e, out=e)
            total = factor @ e
            out[t] -= np.log(total)
            if grads is not None:
                e[cls[t], lanes] -= total / factor.take(cls[t])
                part = 1 / (total * n)
                own_wc += e @ (h * part).T
                own_bc += e @ part
                np.matmul(back, e, out=dh[t])
                dh[t] *= part
        if not large:
            out += bc.take(cls)
        if grads is not None:
            grads["Wc"] += (own_wc * factor[:, None]).T
            grads["bc"] += own_bc * factor
        alone = np.diff(cuts) == 1  # the only word of its class has probability 1
        among = np.append(~alone, np.zeros(1 + TAILS, bool))
        at = np.flatnonzero(among.take(cls.ravel()))
        if not len(at):
            return out, dh
        at = at[np.argsort(y.ravel().take(at).astype(np.uint16), kind="stable")]  # words of a class have consecutive numbers
        word = y.ravel().take(at)
        h = np.ascontiguousarray(hs.transpose(0, 2, 1)).reshape(n, -1).take(at, axis=0)
        logs, back = np.empty(len(at), hs.dtype), np.empty((len(at) + 1, h.shape[1]), hs.dtype)
        ends = np.searchsorted(word, cuts)
        for k in np.flatnonzero(np.diff(ends)):
            part, own = slice(ends[k], ends[k + 1]), slice(cuts[k], cuts[k + 1])
            w, hk, mine = p["Wo"][own], h[part], (word[part] - cuts[k], np.arange(ends[k + 1] - ends[k]))
            e = w @ hk.T
            e += p["bo"][own, None]
            if word_bound > 60:
                e -= e.max(axis=0)
            logs[part] = e[mine]
            np.exp(e, out=e)
            total = ones[: len(w)] @ e
            logs[part] -= np.log(total)
            if grads is not None:
                e *= 1 / (total * n)
                e[mine] -= 1 / n
                grads["Wo"][own] += e @ hk
                grads["bo"][own] += e @ ones[: len(hk)]
                np.matmul(e.T, w, out=back[part])
        out.ravel()[at] += logs
        if grads is not None:
            back[-1], row = 0, np.full(n, len(at))
            row[at] = np.arange(len(at))
            dh += back.take(row, axis=0).reshape(*y.shape, -1).transpose(0, 2, 1)
        return out, dh

    def gradients(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, h: np.ndarray, grads: dict | None = None) -> tuple[float, dict, np.ndarray]:
        """Mean loss, gradients (added to grads) and last state of one window (steps, lanes): backpropagation ends at its first step."""
        p, n, keep = self.p, self.hidden, []
        grads = {k: np.zeros_like(v) for k, v in p.items()} if grads is None else grads
        hs = self.states(x, start, h, keep)
        logs, dh = self.log_probs(hs, y, grads)
        after, du, de = np.zeros_like(h), np.empty((3 * n, x.shape[1]), hs.dtype), np.empty((p["E"].shape[1], *x.shape), hs.dtype)
        own_w, own_u, ones = np.zeros_like(p["W"].T), np.zeros_like(p["U"].T), np.ones(x.shape[1], hs.dtype)
        for t in range(len(x) - 1, -1, -1):
            into, before, z, r, c, hu = keep[t]
            d, rest = dh[t] + after, 1 - z
            dc = d * rest
            dc *= 1 - c * c
            np.multiply(d, before - c, out=du[:n])
            rest *= z
            du[:n] *= rest
            np.multiply(dc, hu, out=du[n : 2 * n])
            du[n : 2 * n] *= r * (1 - r)
            du[2 * n :] = dc
            own_w += du @ into
            grads["b"] += du @ ones
            de[:, t] = p["W"] @ du
            du[2 * n :] *= r
            own_u += du @ before.T
            after = p["U"] @ du
            d *= z
            after += d
            if start[t].any():
                after *= ~start[t]
        grads["W"] += own_w.T
        grads["U"] += own_u.T
        grads["E"] += _totals(x.ravel(), len(p["E"]), de.reshape(len(de), -1)).T
        return -float(logs.mean()), grads, hs[-1]

    def fit(self, stream: np.ndarray, updates: int, bptt: int = 16, lanes: int = 512, rate: float = 0.01) -> float:
        """Passes over a stream of tokens (documents, each with its end): one over all of it at least, and until there were that many updates; returns the last losses' mean."""
        if not len(stream):
            return 0.0
        lanes = max(1, min(lanes, len(stream) // bptt))
        steps = -(-len(stream) // lanes)
        y = np.resize(stream, steps * lanes)  # the last lane is filled up from the stream's begin
        x = np.roll(y, 1)  # a document starts after the end before it
        x[0] = self.vocab.head
        x, y = (a.reshape(lanes, steps).T for a in (x, y))
        updates = max(updates, -(-steps // bptt))
        # all parameters are views of one array, so an update is a few passes over it
        flat = self.flat()
        g, m, v, room = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty(min(len(flat), BLOCK), flat.dtype)
        grads, at = {}, 0
        for k, w in self.p.items():
            self.p[k], grads[k] = flat[at : at + w.size].reshape(w.shape), g[at : at + w.size].reshape(w.shape)
            at += w.size
        done, losses = 0, []
        while done < updates:
            h = np.zeros((self.hidden, lanes), np.float32)
            for lo in range(0, steps, bptt):
                window = x[lo : lo + bptt].astype(np.int64, order="C")
                g[:] = 0
                loss, _, h = self.gradients(window, y[lo : lo + bptt].astype(np.int64, order="C"), window == self.vocab.head, h, grads)
                losses.append(loss)
                done += 1
                norm, lr = float(np.sqrt(g @ g)), rate * max(0.1, 1 - done / updates)
                shrink, lr = np.float32(min(1.0, 2.0 / (norm + 1e-12))), np.float32(lr * (1 - 0.99**done) ** 0.5 / (1 - 0.9**done))
                for cut in range(0, len(flat), BLOCK):
                    own = slice(cut, cut + BLOCK)
                    now, step = g[own], room[: len(flat[own])]
                    now *= shrink
                    for mean, part in ((m[own], 0.1), (v[own], 0.01)):
                        if part == 0.01:
                            now *= now
                        np.subtract(now, mean, out=step)
                        step *= np.float32(part)
                        mean += step
                    np.sqrt(v[own], out=step)
                    step += np.float32(1e-7)
                    np.divide(m[own], step, out=step)
                    step *= lr
                    flat[own] -= step
                if done >= updates:
                    break
        return float(np.mean(losses[-20:]))

    def score(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each document tokens[first[d]:first[d + 1]]: in lanes, the state carried to its end."""
        length = np.diff(first)
        lanes = min(LANES, len(length))
        heap, of = [(0, i) for i in range(lanes)], np.zeros(len(length), np.int64)
        for d in np.argsort(-length, kind="stable"):
            n, i = heapq.heappop(heap)
            of[d] = i
            heapq.heappush(heap, (n + int(length[d]), i))
        total = np.bincount(of, weights=length, minlength=lanes).astype(np.int64)
        rename = np.argsort(-total, kind="stable")  # the longest lanes first
        rank = np.empty(lanes, np.int64)
        rank[rename] = np.arange(lanes)
        docs = np.argsort(rank[of], kind="stable")
        at = np.repeat(first[docs] - np.cumsum(length[docs]) + length[docs], length[docs]) + np.arange(int(length.sum()))
        y, doc = tokens[at], np.repeat(docs, length[docs])
        start = np.zeros(len(y), bool)
        start[np.cumsum(length[docs]) - length[docs]] = True
        x = np.concatenate([[self.vocab.head], y[:-1]])
        x[start] = self.vocab.head
        total = total[rename]
        begin = np.cumsum(total) - total
        out, bounds, h = np.zeros(len(length)), self.bounds(), np.zeros((self.hidden, lanes), np.float32)
        for lo in range(0, int(total[0]) if len(total) else 0, WINDOW):
            live = int(np.searchsorted(-total, -lo, "left"))
            steps = np.arange(lo, min(lo + WINDOW, int(total[0])))
            there = steps[:, None] < total[None, :live]
            place = np.minimum(begin[None, :live] + steps[:, None], len(y) - 1)
            hs = self.states(x[place], start[place], h[:, :live])
            h = hs[-1]
            logs = self.log_probs(hs, y[place], bounds=bounds)[0][there]
            out += np.bincount(doc[place[there]], weights=logs, minlength=len(length))
        return out


def _counted(buckets: int):
    """Training tokens by key: rows (bucket, keys, counts); the ends are a row with bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for b in batches:
            ends += b.num_rows
            found = [distinct(keys(w)) for _, _, w in _text.read(b.column("text"), lower=True)]
            if not found or not any(len(h) for h, _ in found):
                continue
            h, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
            n, h = np.add.reduceat(n[order], at), h[order][at]
            rows = {"bucket": [], "h": [], "n": []}
            for bucket, (x, y) in _frame.split_by(((h >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64), h, n):
                for k, v in zip(rows, (bucket, x.tobytes(), y.tobytes()), strict=True):
                    rows[k].append(v)
            yield pa.record_batch({"bucket": pa.array(rows["bucket"], pa.int32()), **{k: pa.array(rows[k], pa.binary()) for k in "hn"}})
        yield pa.record_batch({"bucket": pa.array([-1], pa.int32()), "h": [b""], "n": [np.int64(ends).tobytes()]})

    return run


_ROW = "bucket int, h binary, n binary"


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    h, n = join("h", np.uint64), join("n", np.int64)
    if key[0].as_py() < 0:
        n = n.sum(keepdims=True)
    else:
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        h, n = h[order][at], np.add.reduceat(n[order], at)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "h": [h.tobytes()], "n": [n.tobytes()]})


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, words, ends = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64), 0
    for b in batches:
        for bucket, h, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "h", "n")), strict=True):
            n, t = np.frombuffer(n, np.int64), (np.frombuffer(h, np.uint64) & np.uint64(TAILS - 1)).astype(np.int64)
            if bucket < 0:
                ends += int(n.sum())
            else:
                tokens += np.bincount(t, weights=n, minlength=TAILS).astype(np.int64)
                words += np.bincount(t, minlength=TAILS)
    yield pa.record_batch({"tail": pa.array(np.arange(-1, TAILS), pa.int32()), "tokens": np.concatenate([[ends], tokens]), "words": np.concatenate([[0], words])})


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "h", "n")), strict=True):
                h, n = (np.frombuffer(x, np.int64) for x in row)
                if bucket >= 0 and (keep := n >= least).any():
                    yield pa.record_batch({"h": h[keep], "n": n[keep]})

    return run


def _numbered(vocab: Vocabulary):
    """The token numbers of each text, an end after it: rows (part, key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.read(b.column("text"), lower=True):
                tokens = np.full(len(w) + hi - lo, vocab.head, np.uint16)
                tokens[np.arange(len(w)) + w.docs] = vocab.numbers(keys(w))
                ends = 2 * (w.first + np.arange(hi - lo + 1)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
                yield pa.record_batch({"part": b.column("part")[lo:hi], "key": b.column("key")[lo:hi], "tokens": packed})

    return run


def _trained(model: Model, updates: int, piece: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _frame.one_blas_thread()
        _frame.keep_freed_memory()
        own = copy.copy(model)  # a worker may get several streams
        own.p = {k: v.copy() for k, v in model.p.items()}
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        stream = np.frombuffer(b"".join(table.column("tokens").take(pa.array(order)).to_pylist()), np.uint16)
        own.fit(stream, updates)
        flat = own.flat()
        cuts = range(0, len(flat), piece)
        return pa.table({"part": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "piece": pa.array(range(len(cuts)), pa.int32()), "weight": pa.array([float(len(stream))] * len(cuts)), "data": pa.array([flat[c : c + piece].tobytes() for c in cuts], pa.binary())})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by piece and part, the mean of each piece by weight."""
    sums: dict[int, list] = {}
    for b in batches:
        for piece, weight, data in zip(b.column("piece").to_pylist(), b.column("weight").to_pylist(), b.column("data").to_pylist(), strict=True):
            own = sums.setdefault(piece, [0.0, 0.0])
            own[0] += weight
            own[1] = own[1] + weight * np.frombuffer(data, np.float32).astype(np.float64)
    if sums:
        yield pa.record_batch({"piece": pa.array(list(sums), pa.int32()), "data": pa.array([(s[1] / s[0]).astype(np.float32).tobytes() for s in sums.values()], pa.binary())})


def train(docs: DataFrame, total_bytes: int, head_size: int = 4096, classes: int = 48, updates: int = 100, rounds: int = 2, part_bytes: int = 16 << 20, piece: int = 4096) -> tuple[Model, DataFrame]:
    """Learn from all of docs (key, a hash, and text as binary); returns the model and the table of word counts, packed by bucket."""
    if head_size + TAILS > 1 << 16:
        raise ValueError("token numbers have 16 bits")
    buckets = 1 + total_bytes // (16 << 20)
    counts = _frame.stored(docs.select("text").mapInArrow(_counted(buckets), _ROW).groupBy("bucket").applyInArrow(_summed, _ROW))
    sums = {r.tail: r for r in counts.mapInArrow(_classed, "tail int, tokens long, words long").groupBy("tail").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()}
    ends = int(sums[-1].tokens) if sums else 0
    tokens, words = (np.array([int(sums[i][c]) if i in sums else 0 for i in range(TAILS)]) for c in ("tokens", "words"))
    least = 1 + (int(tokens.sum()) + ends >> 20)
    top = counts.mapInArrow(_frequent(least), "h long, n long").orderBy(F.desc("n"), "h").limit(head_size).collect()
    n, h = np.array([r.n for r in top], np.int64), np.array([r.h for r in top], np.int64).view(np.uint64)
    t = (h & np.uint64(TAILS - 1)).astype(np.int64)
    tokens, words = tokens - np.bincount(t, weights=n, minlength=TAILS).astype(np.int64), words - np.bincount(t, minlength=TAILS)
    model = Model(vocabulary(h, n, classes, ends, tokens, words))
    parts = rounds * (1 + total_bytes // (rounds * part_bytes))
    streams = docs.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "text").mapInArrow(_numbered(model.vocab), "part int, key long, tokens binary")
    streams = _frame.stored(streams)
    for turn in range(rounds):
        own = streams.where(F.col("part") % rounds == turn).withColumn("turn", (F.col("part") / rounds).cast("int"))
        done = _frame.numbered(own, "turn", parts // rounds).groupBy("turn").applyInArrow(_trained(model, updates, piece), "part int, piece int, weight double, data binary")
        found = done.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(_averaged, "piece int, data binary")
        found = sorted(found.collect(), key=lambda r: r.piece)  # the model: its size is a parameter
        if found:
            model.load(np.concatenate([np.frombuffer(r.data, np.float32) for r in found]))
    return model, counts


def score(docs: DataFrame, fold: int = 5, chunk_bytes: int = 8 << 20, **kwargs) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    size = F.octet_length("text")
    length = sum((F.when(size > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    held = [x or 0 for x in docs.agg(*[F.sum(F.when(length == i, size)) for i in range(len(LENGTHS) + 1)]).first()]
    total, chunks = sum(held), [1 + n // chunk_bytes for n in held]
    buckets = 1 + total // (16 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(fold).alias("held_out"), F.coalesce(_frame.as_binary("text"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    model, counts = train(rows.where("not held_out").select("key", "text"), total, **kwargs)
    v = model.vocab
    base = float(v.tokens + 0.5 * (v.words + 1))
    tail_base = v.tail_tokens + 0.5 * (v.tail_words + 1)

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        found = [distinct(keys(w))[0] for _, _, w in _text.read(table.column("text"), lower=True)]
        h, _ = distinct(np.concatenate([np.zeros(0, np.uint64), *found]))
        h = h[v.numbers(h) > v.head]
        parts = [(b, x.tobytes()) for b, (x,) in _frame.split_by(((h >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64), h)]
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "h": pa.array([x for _, x in parts], pa.binary())})

    def told(key: tuple, wanted: pa.Table, table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "h": [], "n": []}
        own = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int64)
        for chunk, h in zip(wanted.column("chunk").to_pylist(), wanted.column("h").to_pylist(), strict=True) if len(own) else ():
            h = np.frombuffer(h, np.uint64)
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            same = own[at] == h
            for k, x in zip(out, (chunk, h[same].tobytes(), n[at[same]].tobytes()), strict=True):
                out[k].append(x)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int32()), "h": pa.array(out["h"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    def scored(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _frame.one_blas_thread()
        _frame.keep_freed_memory()
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        known = np.frombuffer(b"".join(answers.column("h").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(answers.column("n").to_pylist()), np.int64)
        order = np.argsort(known)
        known, n = known[order], n[order]
        tokens, counts_of, extra, sizes = [], [], [], []
        for lo, hi, w in _text.read(table.column("text"), lower=True):
            h = keys(w)
            number = v.numbers(h)
            c = np.zeros(len(w), np.int64)
            head = number < v.head
            c[head] = v.counts[number[head]]
            if len(known):
                at, same = _found(known, h[~head])
                c[~head] = np.where(same, n.take(at), 0)
            within = np.where(head, 0.0, np.log((c + 0.5) / tail_base[(h & np.uint64(TAILS - 1)).astype(np.int64)]))
            place = np.arange(len(w)) + w.docs
            for out, fill, value in ((tokens, v.head, number), (counts_of, v.ends, c), (extra, 0.0, within)):
                x = np.full(len(w) + hi - lo, fill, value.dtype)
                x[place] = value
                out.append(x)
            sizes.append(w.counts + 1)
        tokens, counts_of, extra, sizes = (np.concatenate(x) for x in (tokens, counts_of, extra, sizes))
        first = np.concatenate([[0], np.cumsum(sizes)])
        per = lambda x: np.add.reduceat(x, first[:-1])
        logs = model.score(tokens, first) + per(extra)
        values = (table.column("doc_id"), table.column("held_out"), sizes, per((counts_of > 0).astype(np.int64)), np.full(table.num_rows, v.tokens), per(np.log10((counts_of + 0.5) / base)), logs / LOG10)
        return pa.table(dict(zip(kinds, values, strict=True)))

    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    # a chunk takes as many steps as its longest document has tokens, so long documents have chunks of their own
    of_length = [sum(chunks[:i]) + F.pmod("key", F.lit(n)) for i, n in enumerate(chunks)]
    chunk = F.element_at(F.array(*of_length), length + 1)
    dealt = rows.withColumn("chunk", chunk.cast("int")).drop("key")
    by_chunk = lambda df: _frame.numbered(df, "chunk", sum(chunks)).groupBy("chunk")
    by_bucket = lambda df: _frame.numbered(df, "bucket", buckets).groupBy("bucket")
    texts = by_chunk(dealt)
    wanted = texts.applyInArrow(asked, "bucket int, chunk int, h binary")
    answers = by_bucket(wanted).cogroup(by_bucket(counts.where("bucket >= 0"))).applyInArrow(told, "chunk int, h binary, n binary")
    return texts.cogroup(by_chunk(answers)).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
