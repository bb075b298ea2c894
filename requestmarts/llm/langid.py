"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in windows of ``WINDOW`` bytes, each with a state of its
own, so a text of any length takes bounded memory. A gated recurrent layer runs over
each window in both directions; at every byte a softmax over both states labels that
position, and a document's probabilities are the means over all its positions.

The network is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled rows: for each language the ``SAMPLE`` documents with the
smallest hash of their id, and of each text up to ``TRAIN_WINDOWS`` windows spread
evenly over it. Rows whose CRC-32 of the id leaves 1 by 3 are held out and never
learned from. Prediction reads whole texts and nothing but the text.

The network's scores only compare the languages it knows, so it can be sure of any
bytes. Whether a text is in one of them at all is told by ``familiarity``: the mean log
probability of each byte after the one before it, in the predicted language, in lower
case and over letters and the gaps between them only. Its least
value is learned from the same windows, against the same windows shuffled, and does not
depend on how many languages there are.

Null texts and texts without a letter are ``und`` with score 0. Empty tables give no
row; without a labelled row there is no language to learn and all rows are ``und``.
Repeated rows each get their row. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNKNOWN = "und"
WINDOW = 128
HIDDEN = 8
EMBEDDING = 6
#: Bounds of the training sample: documents for each language, windows for each document.
SAMPLE = 150
TRAIN_WINDOWS = 3
EPOCHS = 14
BATCH = 192
RATE = 0.03
#: Windows that run through the network together.
TOGETHER = 4096
#: Count given to each pair of bytes that the sample could hold.
UNSEEN = 0.02
#: ASCII in lower case, with a blank for all that is no letter; other bytes as they are.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes whose familiarity is looked up together.
PIECE = 1 << 20

LETTER = regex.compile(r"\p{L}")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def squash(x: np.ndarray) -> np.ndarray:
    """In place: the rational stand-in for tanh, exact at 0 and flat at -1 and 1 from 3 on."""
    np.clip(x, -3, 3, out=x)
    square = x * x
    x *= square + 27
    square += 3
    square *= 9
    x /= square
    return x


def slope(x: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` at the input ``x``."""
    square = np.minimum(x * x, 9)
    return (9 - square) ** 2 / (9 * (3 + square) ** 2)


@dataclass
class Direction:
    """Gated recurrent layer. Columns of the weights: the byte's embedding, then the state."""

    gates: np.ndarray  # 2H x (E + H): update and reset
    candidate: np.ndarray  # H x (E + H)

    def step(self, e: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
        """New state (H x rows); with ``keep`` also what backpropagation needs."""
        n = len(h)
        joined = np.concatenate((e, h))
        raw_gates = self.gates @ joined
        raw_gates *= 0.5
        before = raw_gates.copy() if keep else raw_gates
        gates = squash(raw_gates)
        gates += 1
        gates *= 0.5
        joined[-n:] *= gates[n:]
        raw = self.candidate @ joined
        raw_before = raw.copy() if keep else raw
        new = squash(raw)
        change = (new - h) if keep else np.subtract(new, h, out=new)
        after = h + gates[:n] * change
        return (after, before, gates, joined, raw_before, change) if keep else (after,)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # E x 256
    forward: Direction
    backward: Direction
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1
    pairs: np.ndarray | None = None  # L x 256 x 256: log probability of a byte after another
    least: np.ndarray | None = None  # L: least familiarity of a text in the language

    def arrays(self) -> list[np.ndarray]:
        layers = (self.forward.gates, self.forward.candidate, self.backward.gates, self.backward.candidate)
        return [self.embedding, *layers, self.out, self.bias]

    @staticmethod
    def random(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        width = EMBEDDING + hidden
        layer = lambda: Direction(draw(2 * hidden, width) * 0.4, draw(hidden, width) * 0.4)
        embedding = draw(EMBEDDING, 256)
        embedding[0] = 1  # serves as the bias of both layers
        k = len(languages)
        return Network(languages, embedding, layer(), layer(), draw(k, 2 * hidden) * 0.3, np.zeros((k, 1), np.float32))

    def label(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the positions of each window of the label probabilities (rows x L)."""
        rows, n = data.shape
        hidden = len(self.forward.candidate)
        columns = np.ascontiguousarray(data.T).astype(np.intp)
        embedded = [np.take(self.embedding, c, axis=1, mode="clip") for c in columns]
        whole = bool((lengths == n).all())
        ahead: list = [None] * n
        h = np.zeros((hidden, rows), np.float32)
        for t in range(n):
            new = self.forward.step(embedded[t], h)[0]
            h = new if whole else np.where(t < lengths, new, h)
            ahead[t] = self.out[:, :hidden] @ h
        total = np.zeros((len(self.languages), rows), np.float32)
        h = np.zeros((hidden, rows), np.float32)
        for t in range(n - 1, -1, -1):
            new = self.backward.step(embedded[t], h)[0]
            h = new if whole else np.where(t < lengths, new, h)
            p = self.out[:, hidden:] @ h
            p += ahead[t]
            p += self.bias
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total += p if whole else p * (t < lengths)
        return total.T


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of ``size``; the last row is padded with zeros."""
    rows = -(-len(text) // size)
    return np.frombuffer(text.ljust(rows * size, b"\0"), np.uint8).reshape(rows, size)


def gradients(net: Network, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the positions and its gradients, by backpropagation through time."""
    rows, n = data.shape
    hidden, width = len(net.forward.candidate), len(net.embedding)
    layers = (net.forward, net.backward)
    orders = (range(n), range(n - 1, -1, -1))
    kept: list[list] = [[None] * n, [None] * n]
    on = (np.arange(n)[:, None] < lengths).astype(net.out.dtype)
    for d in (0, 1):
        h = np.zeros((hidden, rows), net.out.dtype)
        for t in orders[d]:
            new, *rest = layers[d].step(net.embedding[:, data[:, t]], h, keep=True)
            after = h + on[t] * (new - h)
            kept[d][t] = (h, after, *rest)
            h = after
    count, loss = float(lengths.sum()), 0.0
    d_out, d_bias, d_embedding = np.zeros_like(net.out), np.zeros_like(net.bias), np.zeros_like(net.embedding)
    down: list = [None] * n
    one = np.eye(len(net.languages), dtype=net.out.dtype)[:, labels]
    for t in range(n):
        both = np.concatenate((kept[0][t][1], kept[1][t][1]))
        z = net.out @ both + net.bias
        p = np.exp(z - z.max(axis=0))
        p /= p.sum(axis=0)
        loss -= float((np.log(np.maximum((p * one).sum(axis=0), 1e-9)) * on[t]).sum()) / count
        dz = (p - one) * on[t] / count
        d_out += dz @ both.T
        d_bias += dz.sum(axis=1, keepdims=True)
        down[t] = net.out.T @ dz
    grads = []
    for d in (0, 1):
        layer = layers[d]
        d_gates, d_cand = np.zeros_like(layer.gates), np.zeros_like(layer.candidate)
        carry = np.zeros((hidden, rows), net.out.dtype)
        for t in reversed(orders[d]):
            h, _, before, gates, joined, raw, change = kept[d][t]
            update, reset = gates[:hidden], gates[hidden:]
            total = carry + down[t][d * hidden : (d + 1) * hidden]
            dh = total * on[t]
            da = dh * update * slope(raw)
            d_cand += da @ joined.T
            back = layer.candidate.T @ da
            dg = np.concatenate((dh * change, back[width:] * h)) * slope(before) * 0.25
            own = joined.copy()
            own[width:] = h
            d_gates += dg @ own.T
            through = layer.gates.T @ dg
            np.add.at(d_embedding.T, data[:, t], (back[:width] + through[:width]).T)
            carry = total - dh * update + back[width:] * reset + through[width:]
        grads += [d_gates, d_cand]
    return loss, [d_embedding, *grads, d_out, d_bias]


def pair_table(texts: list[bytes]) -> np.ndarray:
    """Log probability of each byte (column) after each byte (row)."""
    counts = np.full((256, 256), UNSEEN)
    for text in texts:
        raw = np.frombuffer(text.translate(FOLDED), np.uint8)
        np.add.at(counts, (raw[:-1], raw[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def familiarity(text: bytes, table: np.ndarray) -> float:
    """Mean log probability of the bytes of a text, each after the one before it."""
    raw, total, n = np.frombuffer(text.translate(FOLDED), np.uint8), 0.0, 0
    for at in range(0, len(raw) - 1, PIECE):
        part = raw[at : at + PIECE + 1]
        on = (part[:-1] != 32) | (part[1:] != 32)
        total += float(table[part[:-1][on], part[1:][on]].sum(dtype=np.float64))
        n += int(on.sum())
    return total / max(1, n)


def least_familiarity(texts: list[bytes], rng: np.random.Generator) -> float:
    """Midway between the language's windows and the same windows shuffled.

    Windows are judged by a table learned from the other half of them.
    """
    halves = [texts[::2], texts[1::2]] if len(texts) > 1 else [texts, texts]
    clean, mixed = [], []
    for own, other in (halves, halves[::-1]):
        table = pair_table(other)
        clean += [familiarity(text, table) for text in own]
        mixed += [familiarity(rng.permutation(np.frombuffer(text, np.uint8)).tobytes(), table) for text in own]
    return float(np.median(clean) + np.median(mixed)) / 2


def train(rows: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """A network from (language, window) rows; None without rows. Adam, with clipped gradients."""
    languages = sorted({lang for lang, text in rows if text})
    if not languages:
        return None
    rows = sorted((lang, text[:WINDOW]) for lang, text in rows if text)
    data = np.concatenate([windows(text) for _, text in rows])
    lengths = np.array([len(text) for _, text in rows])
    labels = np.array([languages.index(lang) for lang, _ in rows])
    net, rng = Network.random(languages, seed=seed), np.random.default_rng(seed)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    step, steps = 0, max(1, epochs * -(-len(data) // BATCH))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), max(1, -(-len(data) // BATCH))):
            step += 1
            _, grads = gradients(net, data[part], lengths[part], labels[part])
            size = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            rate = RATE * (1 - step / (steps + 1))
            for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    own = [[text for lang, text in rows if lang == language] for language in languages]
    net.pairs = np.stack([pair_table(texts) for texts in own])
    net.least = np.array([least_familiarity(texts, rng) for texts in own])
    return net


def recognised(net: Network | None, texts: list[str | None]) -> list[bool]:
    """Whether each text is in the language that the network finds best."""
    found = predictions(net, texts)
    out = []
    for text, (lang, _) in zip(texts, found, strict=True):
        known = lang != UNKNOWN
        if known and net.pairs is not None:
            i = net.languages.index(lang)
            known = familiarity(text.encode(), net.pairs[i]) >= net.least[i]
        out.append(bool(known))
    return out


def predictions(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Best language and its mean probability over all bytes of each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    total = np.zeros((len(texts), len(net.languages)), np.float64)
    size = np.zeros(len(texts), np.int64)
    whole, whole_of, tails = [], [], []

    def run_whole() -> None:
        data = np.concatenate(whole)
        sums = net.label(data, np.full(len(data), WINDOW))
        np.add.at(total, np.concatenate(whole_of), sums)
        whole.clear()
        whole_of.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if text is None or not LETTER.search(text):
            continue
        raw = text.encode()
        size[i] = len(raw)
        full = len(raw) // WINDOW * WINDOW
        for at in range(0, full, TOGETHER * WINDOW):
            part = windows(raw[at : min(full, at + TOGETHER * WINDOW)])
            whole.append(part)
            whole_of.append(np.full(len(part), i))
            waiting += len(part)
            if waiting >= TOGETHER:
                run_whole()
                waiting = 0
        if full < len(raw):
            tails.append((len(raw) - full, i, raw[full:]))
    if whole:
        run_whole()
    # Tails of similar length run together, so little of a batch is padding.
    tails.sort(key=lambda x: x[:2])
    for at in range(0, len(tails), TOGETHER):
        part = tails[at : at + TOGETHER]
        longest = part[-1][0]
        data = np.concatenate([windows(raw.ljust(longest, b"\0"), longest) for _, _, raw in part])
        np.add.at(total, [i for _, i, _ in part], net.label(data, np.array([n for n, _, _ in part])))
    for i in np.flatnonzero(size):
        mean = total[i] / size[i]
        best = int(mean.argmax())
        out[i] = (net.languages[best], float(min(1.0, mean[best])))
    return out


def held_out(id_column: str) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 by 3; null ids count as empty."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, id_column: str = "doc_id", sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """The bounded sample, in a fixed order: at most ``sample`` documents for each language.

    Ids and languages are ranked first, without reading texts.
    """
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(id_column)
    labelled = docs.where(known).select(F.col(id_column).alias("id"), "lang", "text")
    order = F.xxhash64("id")
    cut = labelled.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), order.alias("_h"))
    # The best of each of 64 slices first, so that no task ranks a whole language.
    slices = Window.partitionBy("_lang", F.pmod("_h", F.lit(64))).orderBy("_h", "_id")
    ranks = Window.partitionBy("_lang").orderBy("_h", "_id")
    best = cut.withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= sample)
    best = best.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= sample)
    chosen = best.select("_id", "_lang").distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))
    found = labelled.join(F.broadcast(chosen), same, "left_semi")
    # What is learned from a text is a few windows, so only those leave the executors.
    picked = found.select("lang", F.explode(training_windows("text")).alias("w"))
    return sorted((r.lang, bytes(r.w)) for r in picked.collect())


@F.arrow_udf(returnType=T.ArrayType(T.BinaryType()))
def training_windows(texts: pa.Array) -> pa.Array:
    """Up to ``TRAIN_WINDOWS`` windows of each text, spread evenly over it."""
    out = []
    for text in texts.cast(pa.binary()):
        raw = text.as_py()
        rows = -(-len(raw) // WINDOW)
        picked = np.unique(np.linspace(0, max(0, rows - 1), TRAIN_WINDOWS).astype(int)) if rows else []
        out.append([raw[WINDOW * int(i) : WINDOW * (int(i) + 1)] for i in picked])
    return pa.array(out, pa.list_(pa.binary()))


def identify(docs: DataFrame, net: Network | None, text_column: str = "text") -> Column:
    """Struct (lang_pred, score) for a text column."""

    @F.arrow_udf(returnType=RESULT)
    def predicted(texts: pa.Array) -> pa.Array:
        found = predictions(net, texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], RESULT.names
        )

    return predicted(docs[text_column])


def identify_languages(docs: DataFrame, net: Network | None = None, id_column: str = "doc_id") -> DataFrame:
    """Id, whether the row was held out, predicted language and score, for every row."""
    net = net or train(training_rows(docs, id_column))
    rows = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), identify(docs, net).alias("_p"))
    return rows.select(id_column, "held_out", "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame, net: Network | None = None, id_column: str = "doc_id") -> DataFrame:
    """The documents, all columns, that are in a language of the table."""
    net = net or train(training_rows(docs, id_column))

    @F.arrow_udf(returnType=T.BooleanType())
    def known(texts: pa.Array) -> pa.Array:
        return pa.array(recognised(net, texts.to_pylist()), pa.bool_())

    return docs.where(known(docs["text"]))
