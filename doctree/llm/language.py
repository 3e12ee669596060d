"""Language identification by a bidirectional gated recurrent network over bytes.

A network of one layer reads windows of a text's UTF-8 bytes forwards and backwards and labels every position with
probabilities of the languages; a document's probabilities are the mean over all its positions. It is trained here, in
numpy, by backpropagation through time on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, release_memory, text_of
from .textwords import chunks

#: Labelled documents that are learned from, at most, for each language, and windows of each.
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 3
WINDOW = 64
HIDDEN = 12
EPOCHS = 3
BATCH = 256
RATE = 0.01
SEED = 13
UNKNOWN = "und"
#: The symbol after a text's end.
END = 256
#: Windows that a task reads at once.
AT_ONCE = 1024


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


class Network:
    """Gates z (keep) and r (reset) and the candidate c, in that order, for both directions: weights of the input (3, 2, 257, H),
    of the state (3, 2, H, H) and of the output (2H, C). Gates are (1 + softsign) / 2, candidates softsign."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "x": f(0.3, 3, 2, END + 1, hidden), "u": f(1 / np.sqrt(hidden), 3, 2, hidden, hidden), "d": np.zeros((2, 1, hidden), np.float32),
            "v": f(1 / np.sqrt(hidden), 2 * hidden, len(classes)), "b": np.zeros(len(classes), np.float32),
        }

    def states(self, symbols: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(T + 1, 2, n, H) from symbols (T, n): after t steps forwards [t, 0] and backwards [t, 1]; what the way back needs."""
        w, hidden = self.weights, self.hidden
        steps, n = symbols.shape
        out, memory = np.zeros((steps + 1, 2, n, hidden), w["x"].dtype), []
        table = w["x"].reshape(-1, hidden)
        offset = np.arange(6).reshape(3, 2, 1) * (END + 1)
        of = np.empty((3, 2, n, hidden), w["x"].dtype)
        for t in range(steps):
            h = out[t]
            given = table.take(offset + np.stack([symbols[t], symbols[steps - 1 - t]]), 0)
            np.matmul(h, w["u"], out=of)
            gates = given[:2]
            gates += of[:2]
            _softsign(gates)
            gates += 1
            gates *= 0.5
            inner = of[2]
            inner += w["d"]
            c = given[2]
            c += gates[1] * inner
            _softsign(c)
            np.subtract(h, c, out=out[t + 1])
            out[t + 1] *= gates[0]
            out[t + 1] += c
            if keep:
                memory.append((gates[0], gates[1], c, inner.copy()))
        return out, memory

    def positions(self, states: np.ndarray) -> np.ndarray:
        """(C, T, n): probabilities of every position, from both states that have read its byte."""
        w, hidden = self.weights, self.hidden
        steps, n = states.shape[0] - 1, states.shape[2]
        p = w["v"][:hidden].T @ states[1:, 0].reshape(-1, hidden).T
        p += w["v"][hidden:].T @ states[:0:-1, 1].reshape(-1, hidden).T
        p += w["b"][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, steps, n)

    def gradients(self, symbols: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions before a text's end, and its gradients through all steps."""
        w, hidden = self.weights, self.hidden
        steps, n = symbols.shape
        states, memory = self.states(symbols, keep=True)
        delta = np.ascontiguousarray(self.positions(states).transpose(1, 2, 0))
        real = (symbols != END)[:, :, None].astype(delta.dtype) / max(1, int((symbols != END).sum()))
        loss = -float((np.log(delta[:, np.arange(n), label] + 1e-9) * real[:, :, 0]).sum())
        delta[:, np.arange(n), label] -= 1
        delta *= real
        both = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=2).reshape(steps * n, -1)
        g = {k: np.zeros_like(x) for k, x in w.items()}
        g["v"], g["b"] = both.T @ delta.reshape(steps * n, -1), delta.sum(axis=(0, 1))
        above = np.stack([delta @ w["v"][:hidden].T, delta[::-1] @ w["v"][hidden:].T], axis=1)
        back = np.zeros((2, n, hidden), delta.dtype)
        arrived = np.empty((steps, 3, 2, n, hidden), delta.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, c, inner = memory[t]
            h, dh = states[t], above[t] + back
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * (1 - np.abs(2 * z - 1)) ** 2 * 0.5
            dr = dc * inner * (1 - np.abs(2 * r - 1)) ** 2 * 0.5
            arrived[t] = dz, dr, dc
            into = np.stack([dz, dr, dc * r])
            g["u"] += h.transpose(0, 2, 1) @ into
            g["d"] += into[2].sum(axis=1, keepdims=True)
            back = dh * z + (into @ w["u"].transpose(0, 1, 3, 2)).sum(axis=0)
        for d, read in enumerate((symbols, symbols[::-1])):  # by one sorted sum a direction
            order = np.argsort(read, axis=None, kind="stable")
            at = read.ravel()[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for k in range(3):
                g["x"][k, d, at[first]] = np.add.reduceat(arrived[:, k, d].reshape(steps * n, -1)[order], first, axis=0)
        return loss, g


def train(windows: np.ndarray, label: np.ndarray, classes: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network after Adam over windows (n, T) in a seeded order."""
    net, r = Network(classes, hidden, seed), np.random.default_rng(seed)
    one, two = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    step = 0
    total = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, g = net.gradients(np.ascontiguousarray(windows[pick].T), label[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            rate = RATE * (1 - step / (total + 1)) / max(size, 1.0)
            for k, x in net.weights.items():
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.99 * two[k] + 0.01 * g[k] * g[k]
                x -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _symbols(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """(width, n): the bytes from each start; END from ``end`` on."""
    at = start + np.arange(width)[:, None]
    inside = at < end
    out = np.full(at.shape, END, np.int64)
    out[inside] = raw[at[inside]]
    return out


def document_probabilities(net: Network, texts: pa.Array, width: int = WINDOW) -> np.ndarray:
    """texts (no nulls) x classes: means over all bytes of each text; zeros for empty texts."""
    raw, bounds = _bytes(texts)
    size = np.diff(bounds)
    count = -(-size // width)
    doc = np.repeat(np.arange(len(size)), count)
    start = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width
    total = np.zeros((len(size), len(net.classes)))
    for at in range(0, len(doc), AT_ONCE):
        own, first = doc[at : at + AT_ONCE], start[at : at + AT_ONCE]
        symbols = _symbols(raw, first, bounds[own + 1], width)
        p = net.positions(net.states(symbols)[0])
        p *= symbols != END
        for c, summed in enumerate(p.sum(axis=1)):
            total[:, c] += np.bincount(own, weights=summed, minlength=len(size))
    return total / np.maximum(size, 1)[:, None]


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2


def sample_windows(df: DataFrame, id_col: str, text_col: str, label_col: str, docs: int = SAMPLE_DOCS, each: int = SAMPLE_WINDOWS, width: int = WINDOW) -> tuple[np.ndarray, list[str]]:
    """(windows, labels) of ``docs`` documents of each language at most, the first by a hash; where each window begins is drawn
    by that hash over the whole text. Languages are counted over all rows; frequent ones are thinned before they are ranked."""
    rows = df.where(df[label_col].isNotNull() & df[text_col].isNotNull() & ~held_out(df[id_col]))
    rows = rows.select(df[label_col].cast("string").alias("label"), df[text_col].cast("string").alias("text"), F.xxhash64(df[id_col], F.lit(SEED)).alias("h"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), (docs + 6 * F.sqrt(F.lit(float(docs)))) / F.col("n"))
    # One row a language: as many as the network has outputs. Rows are thinned where they are read.
    likely = rows.join(F.broadcast(counts), "label").where(F.pmod("h", F.lit(1 << 40)) / F.lit(1 << 40) <= share)
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    picked = likely.withColumn("nth", first).where(F.col("nth") <= docs).select("label", "text", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = _bytes(batch.column(1))
            h = batch.column(2).to_numpy()
            for k in range(each):
                room = np.maximum(np.diff(bounds) - width + 1, 1)
                start = bounds[:-1] + ((h.view(np.uint64) >> np.uint64(7 * k)) % room.astype(np.uint64)).astype(np.int64)
                symbols = _symbols(raw, start, bounds[1:], width).T.astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in symbols], pa.binary())], ["label", "h", "window"])

    found = picked.mapInArrow(cut, "label string, h long, window binary").orderBy("label", "h", "window").toArrow()
    windows = [np.frombuffer(x, "<u2") for x in found.column("window").to_pylist()]
    return np.array(windows, np.int64).reshape(len(windows), width), found.column("label").to_pylist()


def predict_language(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, over all bytes of its text.

    A null text, one without a letter, and any text where nothing could be learned is ``und`` with score 0. Of equally
    likely languages the first by name is taken. Repeated rows are told alike; an empty table gives no rows.
    """
    letter = F.coalesce(df[text_col].cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.when(letter, text_of(df, text_col)).otherwise("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                size = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False)
                name, score = np.full(len(size), UNKNOWN, object), np.zeros(len(size))
                if net is not None:
                    p = document_probabilities(net, part.column(1)).round(5)  # sums in another order differ beyond
                    name = np.where(size > 0, np.array(net.classes, object)[p.argmax(axis=1)], name)
                    score = np.minimum(p.max(axis=1), 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        release_memory()

    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def fit_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs: int = SAMPLE_DOCS) -> Network | None:
    """A network from the rows that are not held out; None where none has text and language."""
    windows, labels = sample_windows(df, id_col, text_col, label_col, docs)
    if not labels:
        return None
    classes = sorted(set(labels))
    number = {c: k for k, c in enumerate(classes)}
    return train(windows, np.array([number[x] for x in labels]), classes)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with a network learned from those that are not held out. Nulls, empty texts and tables: see
    predict_language and fit_language."""
    docs = read_table(spark, sf_dir, "documents")
    return predict_language(docs, fit_language(docs))
