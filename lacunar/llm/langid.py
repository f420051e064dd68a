"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes, all of them, whatever the length. Filters of two, three and four
bytes slide over a window; each keeps its largest response (max pooling), a linear layer and softmax follow. The
network is written and trained in numpy on the driver, from a bounded sample of windows. As a filter over one-hot bytes
is a sum of table entries, two gathers by byte pair give every filter's response at a position.

A document's probabilities are its windows' mean, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

WINDOW = 256
WIDTHS = {2: 8, 3: 12, 4: 12}


def byte_classes() -> np.ndarray:
    """256 bytes folded to classes: a-z without case, digits, white space and other ASCII together, each byte above alone."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b) if b < 128 else ""
        out[b] = 0 if c.isspace() or b < 32 else 1 if c.isdigit() else 2 + ord(c.lower()) - 97 if c.isalpha() else 28 if c else 29 + b - 128
    return out


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the windows that begin at `starts` in a buffer, blank from `ends` on."""
    at = starts[:, None] + np.arange(WINDOW)
    out = CLASSES[data[np.minimum(at, len(data) - 1)]]
    out[at >= ends[:, None]] = 0
    return out


class Network:
    """Filters (one table per width and offset), linear layer, and the names of its classes."""

    def __init__(self, names: list[str], seed: int):
        rng = np.random.default_rng(seed)
        self.names = names
        self.p = {f"u{w}": rng.normal(0, 0.5, (w, N_CLASSES, n)).astype(np.float32) for w, n in WIDTHS.items()}
        total = sum(WIDTHS.values())
        self.p |= {"b": np.zeros(total, np.float32), "v": rng.normal(0, 0.3, (total, len(names))).astype(np.float32), "c": np.zeros(len(names), np.float32)}

    def compile(self) -> None:
        """Tables by byte pair: of the first two bytes of each filter, and of the two after."""
        u2, u3, u4 = (self.p[f"u{w}"] for w in (2, 3, 4))
        pair = lambda a, b: (a[:, None] + b[None]).reshape(N_CLASSES**2, -1)
        self.first = np.hstack([pair(u2[0], u2[1]), pair(u3[0], u3[1]), pair(u4[0], u4[1])])
        self.second = np.hstack([np.zeros((N_CLASSES**2, WIDTHS[2]), np.float32), pair(u3[2], np.zeros_like(u3[2])), pair(u4[2], u4[3])])

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(window, position, filter)"""
        two = x[:, :-1].astype(np.int32) * N_CLASSES + x[:, 1:]
        out = self.first[two[:, :-2]]
        out += self.second[two[:, 2:]]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(x).max(1) + self.p["b"], 0)
        z = pooled @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        r = self.responses(x)
        at = r.argmax(1)
        top = np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p["b"]
        pooled = np.maximum(top, 0)
        z = pooled @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.p["v"].T) * (top > 0)
        g = {"v": pooled.T @ d, "c": d.sum(0), "b": back.sum(0)}
        begin, rows = 0, np.arange(len(x))[:, None]
        for w, n in WIDTHS.items():
            part, where = back[:, begin : begin + n], at[:, begin : begin + n]
            grad = np.zeros_like(self.p[f"u{w}"])
            for k in range(w):
                np.add.at(grad[k], (x[rows, where + k], np.arange(n)[None]), part)
            g[f"u{w}"] = grad
            begin += n
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, batch: int = 128, rate: float = 0.02) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        steps = max(1, -(-len(x) // batch)) * epochs
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                self.compile()
                i, t = order[s : s + batch], t + 1
                for k, g in self.gradient(x[i], y[i]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    step = rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        self.compile()


def _sample_windows(per_doc: int):
    """(h, lang, window, ends) of windows at places drawn from the row's hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, rng = text.encode(), np.random.default_rng(h & (1 << 63) - 1)
                for _ in range(per_doc):
                    at = int(rng.integers(0, max(1, len(data) - WINDOW // 2)))
                    size = WINDOW if rng.random() < 0.6 else int(rng.integers(8, WINDOW))
                    out.append((h, lang, data[at : at + size]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())], ["h", "lang", "window"])

    return each


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000, per_doc: int = 3, epochs: int = 5, seed: int = 11) -> Network | None:
    """A network from at most `per_lang` documents of each language that are not held out, chosen by hash, `per_doc`
    windows each. None if there is no such document."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) > 0) & ~held_out(F.col(id_col)))
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    scale = 1 << 30
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(scale, scale * per_lang // n)))])
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    some = rows.withColumn("_h", h).where(F.pmod("_h", F.lit(scale)) < share[F.col(lang_col)]).select("_h", F.col(lang_col), F.col(text_col))
    got = some.mapInArrow(_sample_windows(per_doc), "h long, lang string, window binary").toPandas().sort_values(["h", "lang", "window"])
    names = sorted(counts)
    got = got.groupby("lang").head(per_lang * per_doc)  # the hash bounds the rows on average, this for certain
    size = got["window"].map(len).to_numpy()
    data = np.frombuffer(b"".join(got["window"]), np.uint8)
    starts = np.r_[0, np.cumsum(size)[:-1]]
    net = Network(names, seed)
    net.train(windows_of(data, starts, starts + size), got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), epochs, seed)
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", step: int = 128) -> DataFrame:
    """(id_col, lang_pred, score) of every whole text; `und` and 0 for null, for texts without a letter, and without a
    network. Repeated rows and null ids come back as they are; extra columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    letter = r"\p{L}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(letter).search
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).to_pylist()
            raw = [t.encode() if t and net and found(t) else b"" for t in texts]
            size = np.array([len(r) for r in raw])
            ends = np.cumsum(size)
            data = np.frombuffer(b"".join(raw), np.uint8)
            n = -(-size // WINDOW)
            doc = np.repeat(np.arange(len(raw)), n)
            starts = (ends - size)[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
            total = np.zeros((len(raw), len(net.names) if net else 1))
            for s in range(0, len(doc), step):
                d, at = doc[s : s + step], starts[s : s + step]
                p = net.probabilities(windows_of(data, at, ends[d]))
                np.add.at(total, d, p * np.minimum(ends[d] - at, WINDOW)[:, None])
            best = total.argmax(1)
            score = np.where(size > 0, total.max(1) / np.maximum(size, 1), 0.0)
            pred = [net.names[k] if s else "und" for k, s in zip(best, size, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], [id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(each, f"`{id_col}` {kind}, lang_pred string, score double")
