"""Language-model scores by a gated recurrent network with a class-factored output, in numpy.

Words that make up more than one token in ``OWN_SHARE`` have vectors of their own (there can be no more of them
than that, however large the corpus is); all other words are in tail classes by the magnitude of their count, and
their share of the class comes from exact counts over the whole corpus.  The probability of a token is that of
its class given the state, times that of the word within its class.  One pass over all training documents, in
rounds: tasks train copies by truncated backpropagation on their own documents, copies are averaged.  State is
carried from window to window within a document, in training and in scoring, and begins at zero with each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.llm.dictionary import HOT_BYTES, from_planes, matched, planes, vocabulary
from worktrail.llm.store import discard, in_arrow, written
from worktrail.llm.words import SPACE, words

OWN_SHARE = 16_384
STATE, VECTOR = 12, 12
WINDOW = 32
RATE = 0.01
# Tokens of a gradient step at least, and of a sequence in training at most.
STEP_TOKENS = 2048
SEGMENT = 1024
# Shares (of 16) of the training documents for each round.
ROUNDS = (1, 3, 12)
# Tokens that a task trains on or scores at a time (one block at least).
GROUP_TOKENS = 1 << 21
END = 0  # the symbol after the last word of each text
_CHUNK = 1 << 14
_F = np.float32


@dataclass
class Sizes:
    """Numbers of symbols, and where the classes of words with own vectors begin; each tail symbol is a class of its own."""

    own: int
    tails: int
    begin: list[int]  # of each own class, and the end of the last

    @property
    def classes(self) -> int:
        return len(self.begin) - 1 + self.tails

    def class_of(self) -> np.ndarray:
        """The class of each symbol."""
        own = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        return np.concatenate([own, len(self.begin) - 1 + np.arange(self.tails)]).astype(np.int64)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {
            "vector": (self.own + self.tails, VECTOR), "wx": (VECTOR, 3 * STATE), "wh": (STATE, 3 * STATE), "b": (3 * STATE,),
            "wc": (STATE, self.classes), "bc": (self.classes,), "ww": (self.own, STATE), "bw": (self.own,),
        }


def class_borders(counts: np.ndarray) -> list[int]:
    """Classes of words in falling order of count, with about equal sums of the roots of the counts."""
    k = max(1, round(len(counts) ** 0.5))
    share = np.cumsum(np.sqrt(counts))
    of = np.minimum((share - np.sqrt(counts) / 2) / max(share[-1], 1e-9) * k, k - 1).astype(int)
    return [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(counts)]


class Network:
    """Parameters as views of one flat array, with loss, gradient and log10 probabilities."""

    def __init__(self, sizes: Sizes, flat: np.ndarray) -> None:
        self.sizes, self.flat = sizes, flat
        self.p = self._views(flat)
        self.of = sizes.class_of()

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.sizes.shapes().items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @staticmethod
    def fresh(sizes: Sizes, own: np.ndarray, tails: np.ndarray, seed: int = 7) -> Network:
        """A network that gives each symbol its share of the counts, whatever the state."""
        rng = np.random.default_rng(seed)
        net = Network(sizes, np.zeros(sum(int(np.prod(s)) for s in sizes.shapes().values()), _F))
        net.p["vector"][:] = rng.normal(0, 0.3, net.p["vector"].shape)
        for name in ("wx", "wh"):
            net.p[name][:] = rng.normal(0, 0.2, net.p[name].shape)
        net.p["wc"][:] = rng.normal(0, 0.02, net.p["wc"].shape)
        net.p["ww"][:] = rng.normal(0, 0.02, net.p["ww"].shape)
        mass = np.bincount(net.of, weights=np.concatenate([own, tails]) + 0.5, minlength=sizes.classes)
        net.p["bc"][:] = np.log(mass / mass.sum())
        net.p["bw"][:] = np.log(own + 0.5)
        return net

    def forward(self, given: np.ndarray, reset: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """States (steps, lanes, ``STATE``) of a window of (steps, lanes), the last one, and what the gradient needs.

        Inside, a step is (units, lanes), so that each gate is one stretch of memory.
        """
        p, k = self.p, STATE
        x = p["vector"][given]
        half = np.repeat(np.array([0.5, 1], _F), [2 * k, k])  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        gx = np.ascontiguousarray(((x @ p["wx"] + p["b"]) * half).transpose(0, 2, 1))
        wh = np.ascontiguousarray((p["wh"] * half).T)
        steps, n_lanes = given.shape
        out, before, inner, n = (np.empty((steps, k, n_lanes), _F) for _ in range(4))
        zr = np.empty((steps, 2 * k, n_lanes), _F)
        again = reset.any(axis=1).tolist()
        h = np.ascontiguousarray(state.T)
        for t in range(steps):
            if again[t]:
                h = np.where(reset[t], _F(0), h)
            before[t] = h
            a = wh @ h
            gate, new = zr[t], n[t]
            np.add(gx[t, : 2 * k], a[: 2 * k], out=gate)
            np.tanh(gate, out=gate)
            gate *= _F(0.5)
            gate += _F(0.5)
            inner[t] = a[2 * k :]
            np.multiply(gate[k:], a[2 * k :], out=new)
            new += gx[t, 2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=out[t])
            h *= gate[:k]
            h += new
        return out.transpose(0, 2, 1), h.T, (x, before, zr, inner, n, again)

    def _within(self, klass: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Rows of each class that has several own words, and its words."""
        order = np.argsort(klass, kind="stable")
        edge = np.searchsorted(klass[order], np.arange(len(self.sizes.begin)))
        for c, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            low, high = self.sizes.begin[c], self.sizes.begin[c + 1]
            if b > a and high - low > 1:
                yield order[a:b], low, high

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability (of its class, for tail symbols) in each state."""
        p, klass = self.p, self.of[target]
        out = _log_share(h @ p["wc"] + p["bc"], klass)[0]
        for some, low, high in self._within(klass):
            out[some] += _log_share(h[some] @ p["ww"][low:high].T + p["bw"][low:high], target[some] - low)[0]
        return out

    def gradient(self, given: np.ndarray, reset: np.ndarray, state: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the summed loss of a window (targets below zero count nothing), the last state, and the loss."""
        p, k = self.p, STATE
        out, last, (x, before, zr, inner, n, again) = self.forward(given, reset, state)
        flat = np.zeros_like(self.flat)
        g = self._views(flat)
        at = np.flatnonzero(target.ravel() >= 0)
        h, goal = out.reshape(-1, k)[at], target.ravel()[at]
        klass = self.of[goal]
        logs, d = _log_share(h @ p["wc"] + p["bc"], klass)
        loss = -float(logs.sum())
        g["wc"][:], g["bc"][:] = h.T @ d, d.sum(axis=0)
        dh = d @ p["wc"].T
        for some, low, high in self._within(klass):
            one = h[some]
            logs, d = _log_share(one @ p["ww"][low:high].T + p["bw"][low:high], goal[some] - low)
            loss -= float(logs.sum())
            g["ww"][low:high], g["bw"][low:high] = d.T @ one, d.sum(axis=0)
            dh[some] += d @ p["ww"][low:high]
        steps, n_lanes = given.shape
        dout = np.zeros((steps * n_lanes, k), _F)
        dout[at] = dh
        dout = np.ascontiguousarray(dout.reshape(steps, n_lanes, k).transpose(0, 2, 1))
        z, r = zr[:, :k], zr[:, k:]
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), inner * r * (1 - r)
        dn, da = np.empty_like(n), np.empty((steps, 3 * k, n_lanes), _F)
        wh, carried = np.ascontiguousarray(p["wh"]), np.zeros((k, n_lanes), _F)
        for t in range(steps - 1, -1, -1):
            carried += dout[t]
            np.multiply(carried, by_n[t], out=dn[t])
            np.multiply(carried, by_z[t], out=da[t, :k])
            np.multiply(dn[t], by_r[t], out=da[t, k : 2 * k])
            np.multiply(dn[t], r[t], out=da[t, 2 * k :])
            carried *= z[t]
            carried += wh @ da[t]
            if again[t]:
                carried[:, reset[t]] = 0
        two = lambda y: y.transpose(0, 2, 1).reshape(-1, y.shape[1])
        flat_a = two(da)
        flat_g = np.concatenate([flat_a[:, : 2 * k], two(dn)], axis=1)
        g["wh"][:], g["wx"][:], g["b"][:] = two(before).T @ flat_a, x.reshape(-1, VECTOR).T @ flat_g, flat_g.sum(axis=0)
        dx, order = flat_g @ p["wx"].T, np.argsort(given.ravel(), kind="stable")
        seen = given.ravel()[order]
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        g["vector"][seen[first]] = np.add.reduceat(dx[order], first, axis=0)
        return flat, last, loss


def _log_share(x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of each row at its goal, and the gradient of the loss by the row."""
    if np.abs(x).max(initial=0) > 60:  # out of the range where exp is safe in 32 bits
        x = x - x.max(axis=1, keepdims=True)
    rows = np.arange(len(x))
    share = np.exp(x)
    total = share @ np.ones(x.shape[1], _F)
    logs = x[rows, goal] - np.log(total)
    share /= total[:, None]
    share[rows, goal] -= 1
    return logs, share


def lanes(lengths: np.ndarray, n: int, seed: int | None = None) -> np.ndarray:
    """Texts one after the other in ``n`` lanes of nearly equal length, longest lane first: (steps, lanes) of token places, -1 where a lane is over.

    With a seed, the texts of a lane are in random order.
    """
    begin = np.cumsum(lengths) - lengths
    ends = [(0, i) for i in range(n)]
    held: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(ends)
        held[i].append(d)
        heapq.heappush(ends, (size + int(lengths[d]), i))
    if seed is not None:
        rng = np.random.default_rng(seed)
        held = [rng.permutation(x).tolist() for x in held]
    order = [i for _, i in sorted(ends, key=lambda x: (-x[0], x[1])) if held[i]]
    sizes = [int(lengths[held[i]].sum()) for i in order]
    out = np.full((max(sizes, default=0), len(order)), -1, np.int64)
    for j, i in enumerate(order):
        out[: sizes[j], j] = np.concatenate([np.arange(begin[d], begin[d] + lengths[d]) for d in held[i]])
    return out


def _windows(symbols: np.ndarray, lengths: np.ndarray, n: int, window: int, seed: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(given, reset, target, place) of each window of the lanes that are not over."""
    place = lanes(lengths, n, seed)
    starts = np.zeros(len(symbols) + 1, bool)
    starts[(np.cumsum(lengths) - lengths)] = True
    before = np.append(np.append(END, symbols[:-1]), END)
    before[starts] = END
    padded = np.append(symbols, -1)
    for t in range(0, len(place), window):
        at = place[t : t + window]
        at = at[:, : int((at[0] >= 0).sum())]
        yield before[at], starts[at], padded[at], at


def segments(lengths: np.ndarray, longest: int = SEGMENT) -> np.ndarray:
    """Lengths with longer ones cut into several."""
    k = np.maximum(1, -(-lengths // longest))
    out = np.full(int(k.sum()), longest, np.int64)
    out[np.cumsum(k) - 1] = lengths - (k - 1) * longest
    return out


class Adam:
    """Running averages of gradients and their squares; a step is taken when so many tokens have come together."""

    def __init__(self, net: Network, rate: float, tokens: int = STEP_TOKENS) -> None:
        self.net, self.rate, self.tokens = net, rate, tokens
        self.m, self.v, self.sum = (np.zeros_like(net.flat) for _ in range(3))
        self.steps = self.n = 0

    def add(self, gradient: np.ndarray, n: int) -> None:
        self.sum += gradient
        self.n += n
        if self.n >= self.tokens:
            self.step()

    def step(self) -> None:
        if not self.n:
            return
        g = self.sum / _F(self.n)
        g *= _F(min(1.0, 1 / max(float(np.sqrt((g * g).sum())), 1e-9)))
        self.steps += 1
        self.m += _F(0.1) * (g - self.m)
        self.v += _F(0.01) * (g * g - self.v)
        rate = self.rate * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        self.net.flat -= _F(rate) * self.m / (np.sqrt(self.v) + _F(1e-6))
        self.sum[:] = 0
        self.n = 0


def trained(net: Network, symbols: np.ndarray, lengths: np.ndarray, adam: Adam, window: int = WINDOW) -> None:
    """Train in place on all tokens of some texts, window after window; texts longer than ``SEGMENT`` are several sequences."""
    n = int(np.clip(len(symbols) // SEGMENT, 8, 256))
    state = np.zeros((n, STATE), _F)
    for given, reset, target, _ in _windows(symbols, segments(lengths), n, window, seed=adam.steps):
        g, state, _ = net.gradient(given, reset, state[: given.shape[1]], target)
        adam.add(g, int((target >= 0).sum()))
    adam.step()


def scored(net: Network, symbols: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Natural log of the model's probability of each text's symbols."""
    out = np.zeros(len(symbols))
    n = int(np.clip(len(symbols) // 2048, 16, 512))
    state = np.zeros((n, STATE), _F)
    for given, reset, target, place in _windows(symbols, lengths, n, window):
        h, state, _ = net.forward(given, reset, state[: given.shape[1]])
        some = place >= 0
        out[place[some]] = net.log_probability(h[some], target[some])
    return np.add.reduceat(out, np.cumsum(lengths) - lengths) if len(lengths) else out


@dataclass
class LanguageModel:
    """A trained network and the counts behind it."""

    net: Network
    tokens: int  # all training tokens, ends included
    distinct: int


def _blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """``block``, per text ``id``, ``train``, ``round`` and ``size`` (words), ``codes`` into ``words``, and ``n``, their training occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            w = words(batch.column(1), SPACE, lower=True)
            train = batch.column(2).to_numpy(zero_copy_only=False)
            # Frequent words get small codes.
            order = np.argsort(-np.bincount(w.code, minlength=len(w.distinct)), kind="stable")
            renamed = np.empty(len(order), np.int32)
            renamed[order] = np.arange(len(order), dtype=np.int32)
            code = renamed[w.code]
            n = np.bincount(code[train[w.doc()]], minlength=len(order))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            strings = pa.array([w.distinct[i].decode() for i in order.tolist()], pa.string())
            sizes = pa.array(np.diff(w.first), pa.int32())
            yield pa.RecordBatch.from_arrays([listed(batch.column(0)), listed(batch.column(2)), listed(batch.column(3)), listed(sizes), pa.array([planes(code)], pa.binary()), listed(strings), listed(pa.array(n, pa.int64()))], ["ids", "train", "round", "sizes", "codes", "words", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"), F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(sum(ROUNDS))).cast("int").alias("round"))
    done = in_arrow(rows, run, f"ids array<{kind}>, train array<boolean>, round array<int>, sizes array<int>, codes binary, words array<string>, n array<bigint>")
    return done.withColumn("block", F.monotonically_increasing_id())


def _streams(blocks: DataFrame, kind: str, tokens: int, distinct: int, own: np.ndarray, tail_logs: np.ndarray, unknown: float, single: float) -> DataFrame:
    """Per block: texts with their base and tail sums, and ``symbols`` (16 bits each), the end of each text included."""
    floor = np.log10(tokens + 0.1 * (distinct + 1))
    counts, tails_from, ends = own.astype(np.int64), len(own), int(own[END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, train, round_, sizes = (batch.column(j)[i].values for j in range(4))
                code = from_planes(batch.column(4)[i].as_buffer(), np.int32)
                size = sizes.to_numpy().astype(np.int64)
                count = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
                if batch.column(5)[i].is_valid:
                    count[batch.column(5)[i].values.to_numpy()] = batch.column(6)[i].values.to_numpy()
                symbol = np.where(count < 0, -count, tails_from + np.frexp(np.maximum(count, 1))[1] - 1)  # 2 ** n to 2 ** (n + 1) - 1
                count = np.where(count < 0, counts[np.maximum(-count, 0)], count)
                base = np.log10(count + 0.1) - floor
                tail = np.where(symbol >= tails_from, np.log10(np.maximum(count, 1)) + tail_logs[np.maximum(symbol - tails_from, 0)], 0.0)
                tail[(symbol == tails_from) & (count == 0)], tail[(symbol == tails_from) & (count == 1)] = unknown, single
                border = np.concatenate([[0], np.cumsum(size)])
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[code])])[border])
                end = np.log10(ends + 0.1) - floor
                stream = np.insert(symbol[code], border[1:], END).astype(np.uint16)
                listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), x)
                columns = [ids, train, round_, pa.array(size + 1), pa.array(sums((count > 0).astype(np.int64)) + (ends > 0)), pa.array(sums(base) + end), pa.array(sums(tail))]
                yield pa.RecordBatch.from_arrays([*map(listed, columns), pa.array([planes(stream)], pa.binary())], ["ids", "train", "round", "sizes", "known", "base", "tail", "symbols"])

    schema = f"ids array<{kind}>, train array<boolean>, round array<int>, sizes array<bigint>, known array<bigint>, base array<double>, tail array<double>, symbols binary"
    return in_arrow(blocks.select("ids", "train", "round", "sizes", "codes", "at", "v"), run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows (blocks) until they have ``GROUP_TOKENS`` together."""
    held, n = [], 0
    for batch in batches:
        for i in range(len(batch)):
            held.append(batch.slice(i, 1))
            n += len(batch.column("symbols")[i].as_buffer()) // 2
            if n >= GROUP_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _joined(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([r.column(name)[0].values.to_numpy(zero_copy_only=False) for r in rows])


def _symbols(rows: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([from_planes(r.column("symbols")[0].as_buffer(), np.uint16) for r in rows]).astype(np.int64)


def _chosen(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lengths of the training texts of a round, until they have ``GROUP_TOKENS`` together."""
    held, sizes, n = [], [], 0
    for batch in batches:
        for i in range(len(batch)):
            rows = [batch.slice(i, 1)]
            size, round_ = _joined(rows, "sizes"), _joined(rows, "round")
            chosen = _joined(rows, "train").astype(bool) & (round_ >= low) & (round_ < high)
            held.append(_symbols(rows)[np.repeat(chosen, size)])
            sizes.append(size[chosen])
            n += len(held[-1])
            if n >= GROUP_TOKENS:
                yield np.concatenate(held), np.concatenate(sizes)
                held, sizes, n = [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(sizes)


def _trained_round(streams: DataFrame, net: Network, low: int, high: int, rate: float) -> np.ndarray:
    """The average of the copies that tasks have trained on the documents of a round, weighted by tokens.

    Copies travel in chunks; a chunk's sum is kept while its rows stream by, so a task holds one model at most.
    """
    sizes, start = net.sizes, streams.sparkSession.sparkContext.broadcast(net.flat)  # bounded by OWN_SHARE

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(sizes, start.value.copy())
        adam, tokens = Adam(own, rate), 0
        for symbols, size in _chosen(batches, low, high):
            trained(own, symbols, size, adam)
            tokens += len(symbols)
        if tokens:
            parts = [own.flat[a : a + _CHUNK] for a in range(0, len(own.flat), _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), float(tokens))), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "weight", "part"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for c, w, part in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                one = total.setdefault(c, [0.0, 0.0])
                one[0], one[1] = one[0] + w, one[1] + w * np.frombuffer(part, _F).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([(s / w).astype(_F).tobytes() for w, s in total.values()], pa.binary())], ["chunk", "part"])

    copies = in_arrow(streams.select("train", "round", "sizes", "symbols"), train, "chunk bigint, weight double, part binary")
    rows = {r.chunk: r.part for r in in_arrow(copies.repartition("chunk"), average, "chunk bigint, part binary").collect()}
    start.unpersist()
    return np.concatenate([np.frombuffer(rows[c], _F) for c in range(len(rows))]) if rows else net.flat


def language_scores(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Scores of all whole texts by a model that learns from those for which ``train`` holds (null: does not).

    Returns ``id_col``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-0.1 unigrams) and ``score``
    (the network), log10.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with one end token.
    The network's probabilities of all known words and one unknown word add up to one in every state.
    A null or empty text is its end token; null ids and repeated rows are texts like others; without training
    documents all words are unknown; an empty table gives no rows; other columns are not carried.
    All training documents are counted and trained on, once.  A very long text runs through its lane step by step.
    """
    spark = docs.sparkSession
    chosen = F.coalesce(train if train is not None else F.lit(True), F.lit(False))
    blocks = written(_blocks(docs, id_col, text_col, chosen), "blocks")
    counted = written(vocabulary(blocks, [], ["n"]).withColumnRenamed("n", "c"), "vocabulary")
    of = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    n_words, distinct, n1, n2 = counted.agg(of(F.lit(True), F.col("c")), of(F.col("c") > 0, F.lit(1)), of(F.col("c") == 1, F.lit(1)), of(F.col("c") == 2, F.lit(1))).first()
    ends = blocks.select(F.size(F.filter("train", lambda t: t)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = n_words + ends, distinct + (ends > 0)
    frequent = counted.where((F.col("c") * OWN_SHARE > tokens) & (F.octet_length("word") <= HOT_BYTES)).orderBy(F.col("c").desc(), "word").select("word", "c").collect()  # fewer than OWN_SHARE
    own = np.array([ends, *[r.c for r in frequent]], np.float64)
    # Symbols: 0 is the end; classes are cut in falling order of count, and the end is a class of its own in front.
    borders = [0, *[1 + b for b in class_borders(own[1:])]] if frequent else [0, 1]
    named = spark.createDataFrame([(r.word, i) for i, r in enumerate(frequent, 1)], "word string, own long")
    # A word's value: its count, or its symbol below zero if it has one of its own.
    table = counted.join(F.broadcast(named), "word", "left").select("word", "n_blocks", F.coalesce(-F.col("own"), F.col("c")).alias("v"))
    table = written(table, "values")
    magnitude = (F.length(F.bin(F.col("v"))) - 1).alias("magnitude")
    mass = {r.magnitude: r.c for r in table.where("v > 0").groupBy(magnitude).agg(F.sum("v").alias("c")).collect()}  # 64 at most
    tails = np.zeros(max([1, *[t + 1 for t in mass]]))
    for t, c in mass.items():
        tails[t] = c
    unknown = (n1 + 0.5) / (n1 + 2 * n2 + 1) if n1 else 1.0
    logs = -np.log10(np.maximum(tails, 1))
    single = float(np.log10((1 - unknown) / n1)) if n1 else 0.0
    lists = matched(blocks, table, [], F.col("v")).groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v"))  # one order, no nulls
    lists = blocks.select("block", "ids", "train", "round", "sizes", "codes").join(lists, "block", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    streams = written(_streams(lists, kind, tokens, distinct, own, logs, float(np.log10(unknown)), single), "streams")
    discard(blocks, counted, table)
    net = Network.fresh(Sizes(len(own), len(tails), borders), own, tails)
    low = 0
    for i, share in enumerate(ROUNDS if ends else ()):
        net = Network(net.sizes, _trained_round(streams, net, low, low + share, rate / (i + 1) ** 0.5))
        low += share
    sizes, weights = net.sizes, spark.sparkContext.broadcast(net.flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Network(sizes, weights.value)
        for rows in _groups(batches):
            size, symbols = _joined(rows, "sizes"), _symbols(rows)
            logs = scored(whole, symbols, size) / np.log(10) + _joined(rows, "tail")
            flat = lambda c: pa.concat_arrays([r.column(c)[0].values for r in rows])
            yield pa.RecordBatch.from_arrays([flat("ids"), flat("train"), flat("sizes"), flat("known"), flat("base"), pa.array(logs)], ["id", "train", "n_tokens", "n_known", "base_score", "score"])

    done = in_arrow(streams.drop("round"), score, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumnRenamed("id", id_col)


def op12_recurrent_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, scored by a model of those whose crc32 of the id is not divisible by 10."""
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0
    done = language_scores(spark.read.parquet(f"{sf}/documents.parquet"), ~F.coalesce(held_out, F.lit(False)))
    return done.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
