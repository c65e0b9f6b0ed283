"""Language identification by a byte-level convolutional network, in numpy.

The network reads windows of ``WINDOW`` bytes.  A filter of width w has one
weight for every byte at each of its w places, which is a table of 256 rows a
place; its response is a sum of table rows, so a pair of places is one row of a
65,536-row table.  The largest response of each filter over the window (max
pooling), rectified, feeds a softmax.  Training is by Adam with the gradient of
a pooled response going to the place where it was largest.

A text is cut into windows of WINDOW bytes, without overlap and to its end (the
last one is moved back to be full where the text is longer than a window); its
class scores are the mean of its windows' log-probabilities, weighted by their
bytes.  All bytes of all texts are read.

Training takes at most ``max_train`` labelled texts, evenly per language, and
``windows_per_text`` windows spread over each.  Only rows that the caller
offers for training are looked at.

Nulls and edges: a null text, or one without a letter (Unicode category L),
gets ``und`` with score 0.0; texts shorter than a filter are padded with zero
bytes; without any labelled row every prediction is ``und``; with one language
it is always that one; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import slices
from .shared import map_arrow

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"


@dataclass
class ByteNet:
    """tables[w]: (w, 256, FILTERS); bias: all filters; out: (filters, classes)."""

    classes: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, classes: list[str], seed: int = 7) -> "ByteNet":
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(classes, {w: r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(n, np.float32), r.normal(0, 0.2, (n, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))

    def packed(self) -> dict[int, tuple[float, list[np.ndarray]]]:
        """For prediction: each width's tables in 8 bits with their unit, places two by two.

        The unit keeps every sum of rows within 8 bits; one row, the responses
        of all filters of the width, is one 16-byte item.
        """
        out = {}
        for w, t in self.tables.items():
            unit = float(np.abs(t).max((1, 2)).sum()) / 120 or 1.0
            parts = [t[k][:, None, :] + t[k + 1][None, :, :] if k + 1 < w else t[k] for k in range(0, w, 2)]
            rows = [np.ascontiguousarray(np.rint(x.reshape(-1, FILTERS) / unit).astype(np.int8)) for x in parts]
            out[w] = unit, [x.view(f"V{FILTERS}")[:, 0] for x in rows]
        return out

    def pooled(self, windows: np.ndarray, packed: dict[int, tuple[float, list[np.ndarray]]]) -> np.ndarray:
        """Largest response of every filter in each window, before bias: (n, filters)."""
        x = np.ascontiguousarray(windows.T).astype(np.int32)  # places first: the pooling runs along whole rows
        two = (x[:-1] << 8) | x[1:]
        found = []
        for w, (unit, parts) in packed.items():
            m = len(x) - w + 1
            total = None
            for k, table in zip(range(0, w, 2), parts):
                r = table.take((two if k + 1 < w else x)[k : k + m], mode="clip").view(np.int8).reshape(m, -1, FILTERS)
                total = r if total is None else np.add(total, r, out=total)
            found.append(total.max(0) * np.float32(unit))
        return np.concatenate(found, 1)

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut_windows(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes that each adds; short texts are padded with zeros."""
    n = len(data)
    if n <= window:
        return np.frombuffer(data.ljust(window, b"\0"), np.uint8)[None], np.array([max(n, 1)])
    full, rest = divmod(n, window)
    a = np.frombuffer(data, np.uint8)
    rows = a[: full * window].reshape(full, window)
    if not rest:
        return rows, np.full(full, window)
    return np.concatenate([rows, a[None, n - window :]]), np.r_[np.full(full, window), rest]


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], *, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit a network; windows (n, WINDOW) bytes, labels (n) indices into classes."""
    net, r = ByteNet.fresh(classes, seed), np.random.default_rng(seed)
    params = [*net.tables.values(), net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(labels, minlength=len(classes)).clip(1)
    weight = (len(labels) / (len(classes) * share)).astype(np.float32)
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            x, y = windows[own], labels[own]
            pooled, at = _responses(net, x)
            hidden = np.maximum(pooled + net.bias, 0)
            p = np.exp(net.log_probs(pooled))
            p[np.arange(len(y)), y] -= 1
            d = p * (weight[y] / len(y))[:, None]
            back = (d @ net.out.T) * (hidden > 0)
            grads, c = [], 0
            for w in WIDTHS:
                g = np.zeros_like(net.tables[w])
                for f in range(FILTERS):
                    pos = at[:, c + f]
                    for q in range(w):
                        np.add.at(g[q, :, f], x[np.arange(len(y)), pos + q], back[:, c + f])
                grads.append(g)
                c += FILTERS
            grads += [back.sum(0), hidden.T @ d, d.sum(0)]
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for q, (param, g) in enumerate(zip(params, grads)):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                param -= lr * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return net


def _responses(net: ByteNet, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = [], []
    for w, t in net.tables.items():
        n = x.shape[1] - w + 1
        total = t[0].take(x[:, :n], axis=0)
        for k in range(1, w):
            total += t[k].take(x[:, k : k + n], axis=0)
        at.append(total.argmax(1))
        found.append(np.take_along_axis(total, at[-1][:, None], 1)[:, 0])
    return np.concatenate(found, 1), np.concatenate(at, 1)


def training_set(rows: DataFrame, *, max_train: int, windows_per_text: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of rows (key, text, lang), even over the languages.

    The sample takes the rows with the smallest hashes of the key below a
    threshold set from each language's count; only the bytes of the chosen
    windows leave the executors.
    """
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    share = max_train / len(sizes)
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, int(min(1.0, share / n) * (1 << 30)))]), F.col("lang"))
    data = F.encode(F.col("text"), "UTF-8")
    size = F.length(data)
    spots = F.transform(F.sequence(F.lit(0), F.lit(windows_per_text - 1)), lambda k: F.substring(data, (1 + F.floor(F.greatest(size - WINDOW, F.lit(0)) * k / max(1, windows_per_text - 1))).cast("int"), F.lit(WINDOW)))
    found = rows.where(draw < limit).select("lang", draw.alias("draw"), F.array_distinct(spots).alias("spots")).collect()
    found.sort(key=lambda r: (r["draw"], r["lang"]))
    classes = sorted(sizes)
    of = {c: i for i, c in enumerate(classes)}
    x = [(bytes(s).ljust(WINDOW, b"\0"), of[r["lang"]]) for r in found for s in r["spots"]]
    return np.frombuffer(b"".join(b for b, _ in x), np.uint8).reshape(-1, WINDOW), np.array([y for _, y in x], np.int64), classes


def _predict(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = net.packed() if net else {}
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = part.column(1).to_pylist()
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
                # windows of several texts go through the network together, so many bytes at a time
                held, rows, bytes_of, totals = [], [], [], np.zeros((len(texts), len(net.classes) if net else 0))

                def flush() -> None:
                    x, owner = np.concatenate(held), np.concatenate(rows)
                    lp = np.concatenate([net.log_probs(net.pooled(x[k : k + 512], packed)) for k in range(0, len(x), 512)])
                    np.add.at(totals, owner, lp * np.concatenate(bytes_of)[:, None])
                    held.clear(), rows.clear(), bytes_of.clear()

                waiting = 0
                for i in known:
                    w, n = cut_windows(texts[i].encode("utf-8", "replace"))
                    held.append(w)
                    rows.append(np.full(len(w), i))
                    bytes_of.append(n)
                    waiting += len(w)
                    if waiting > 4096:
                        flush()
                        waiting = 0
                if held:
                    flush()
                for i in known:
                    mean = totals[i] / max(1, len(texts[i].encode("utf-8", "replace")))
                    p = np.exp(mean - mean.max())
                    p /= p.sum()
                    lang[i], score[i] = net.classes[int(p.argmax())], float(min(1.0, p.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 4000, windows_per_text: int = 3, epochs: int = 8) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Rows whose crc32(id as text) mod 3 is 1 are held out of training.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"), F.col(lang_col).cast("string").alias("lang"))
    x, y, classes = training_set(rows.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"), max_train=max_train, windows_per_text=windows_per_text)
    net = train(x, y, classes, epochs=epochs) if classes else None
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "text", "held_out"), _predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
