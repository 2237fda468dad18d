"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows.

A window of ``WINDOW`` bytes goes through filters of several widths over its one-hot bytes, max pooling over the
window, a rectifier and a softmax. A text's probabilities are the mean over all its windows, weighted by their bytes.

Trained filters are applied as table lookups: two neighbouring bytes index a table of their summed responses, so a
filter of width w costs w / 2 gathers at a place. The model is a few MB and goes to the workers by broadcast.

The network is fitted on a bounded sample of labelled documents: at most ``per_language`` of each language, chosen
by the hash of their id, and ``windows_each`` windows from within each. ``score`` is a mean probability, from 0 to 1.

Cases: ``und`` with score 0 for null texts and those without a letter; texts of any length are read whole; repeated
rows get equal results; with no labelled document to learn from, every text is ``und``; null ids are never held
out and never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
CHUNK = 256
"""Windows that are scored at once."""


@dataclass
class Network:
    """``filters[w][k, byte, f]`` responses, ``bias`` of each filter, ``dense`` and ``dense_bias`` of the softmax."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width the lookup tables of pairs of bytes, and of the last byte alone where the width is odd."""
        made = {}
        for w, one in self.filters.items():
            made[w] = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else one[k] for k in range(0, w, 2)]
        return made


def pooled(windows: np.ndarray, tables: dict[int, list[np.ndarray]], bias: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each window (bytes [n, WINDOW])."""
    n, size = windows.shape
    pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
    out = []
    for w, parts in tables.items():
        places = size - w + 1
        total = None
        for j, table in enumerate(parts):
            index = pairs[:, 2 * j : 2 * j + places] if len(table) == 65536 else windows[:, 2 * j : 2 * j + places]
            got = table.take(index, axis=0)
            total = got if total is None else np.add(total, got, out=total)
        out.append(total.max(axis=1))
    return np.concatenate(out, axis=1) + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(raw: bytes) -> np.ndarray:
    """Bytes as windows [n, WINDOW], the last one padded with zeros."""
    held = np.zeros(-(-max(1, len(raw)) // WINDOW) * WINDOW, dtype=np.uint8)
    held[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return held.reshape(-1, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy; the gradient of a filter reaches only the place where it was largest."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    named = {**{f"f{w}": net.filters[w] for w in WIDTHS}, "bias": net.bias, "dense": net.dense, "dense_bias": net.dense_bias}
    first, second, step = {k: np.zeros_like(v) for k, v in named.items()}, {k: np.zeros_like(v) for k, v in named.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], labels[rows]
            best, peak = [], {}
            for w in WIDTHS:
                places = WINDOW - w + 1
                total = sum(net.filters[w][k][x[:, k : k + places]] for k in range(w))
                peak[w] = total.argmax(axis=1)
                best.append(np.take_along_axis(total, peak[w][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(best, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ net.dense + net.dense_bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.dense.T) * (raw > 0)
            grads = {"dense": hidden.T @ error, "dense_bias": error.sum(0), "bias": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    at_peak = np.take_along_axis(x, peak[w] + k, axis=1)
                    np.add.at(g[k], (at_peak, np.arange(FILTERS)[None, :]), part)
                grads[f"f{w}"] = g
            step += 1
            for k, value in named.items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                value -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, windows_each: int = 4, max_languages: int = 256, seed: int = 7) -> Network | None:
    """A network learned from documents that are not held out; None where there is nothing to learn from.

    At most ``per_language`` documents of each of the ``max_languages`` most frequent languages reach the driver,
    of each ``windows_each`` windows from places that the hash of its id chooses.
    """
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    dice = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = None
    for r in counts:
        case = F.col(lang) == r["lang"], F.lit(min(1.0, 1.2 * per_language / r["n"]))
        share = F.when(*case) if share is None else share.when(*case)
    length = F.length(text)
    starts = [1 + F.floor(F.pmod(F.xxhash64(F.lit(seed + 1 + k), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.greatest(length - WINDOW, F.lit(0))).cast("int") for k in range(windows_each)]
    pieces = F.array_distinct(F.array(*[F.substring(F.col(text), s, F.lit(WINDOW)) for s in starts]))
    own = F.crc32(F.col(id_col).cast("string")).alias("dice")
    likely = usable.where(dice < share).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), own, pieces.alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "id", "pieces"))  # an id may be that of many rows
    chosen = likely.withColumn("n", rank).where(F.col("n") <= per_language).drop("n").collect()
    languages = sorted(r["lang"] for r in counts)
    windows, labels = [], []
    for r in sorted(chosen, key=lambda r: (r["dice"], r["id"], r["pieces"])):
        for piece in r["pieces"]:
            windows.append(cut(piece.encode())[0])
            labels.append(languages.index(r["lang"]))
    return train(np.array(windows), np.array(labels), languages, seed=seed)


def scorer(net: Network | None):
    """texts -> (language, score) frames; made once in a worker for each model."""
    tables = net.tables() if net else {}

    def scored(texts: pd.Series) -> pd.DataFrame:
        language, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        if net is None:
            return pd.DataFrame({"lang_pred": language, "score": score})
        rows = [i for i, t in enumerate(texts) if t and (t[0].isalpha() or any(map(str.isalpha, t)))]

        def flush(held: list[int], parts: list[np.ndarray], sizes: list[int]):
            windows = np.concatenate(parts)
            each = np.array([len(p) for p in parts])
            probabilities = np.empty((len(windows), len(net.languages)))
            for at in range(0, len(windows), CHUNK):
                hidden = np.maximum(pooled(windows[at : at + CHUNK], tables, net.bias), 0)
                probabilities[at : at + CHUNK] = softmax((hidden @ net.dense + net.dense_bias).astype(np.float64))
            weight = np.full(len(windows), float(WINDOW))
            ends = np.cumsum(each)
            weight[ends - 1] = np.array(sizes) - WINDOW * (each - 1)
            mean = np.add.reduceat(probabilities * weight[:, None], ends - each, axis=0) / np.array(sizes)[:, None]
            top = mean.argmax(axis=1)
            for i, k, p in zip(held, top, mean, strict=True):
                language[i], score[i] = net.languages[k], min(1.0, float(p[k]))

        held, parts, sizes, total = [], [], [], 0
        for i in rows:
            raw = texts.iat[i].encode()
            held.append(i)
            parts.append(cut(raw))
            sizes.append(len(raw))
            total += len(raw)
            if total > 1 << 22:
                flush(held, parts, sizes)
                held, parts, sizes, total = [], [], [], 0
        if held:
            flush(held, parts, sizes)
        return pd.DataFrame({"lang_pred": language, "score": score})

    return scored


_scorers: dict = {}


def predicted(df: DataFrame, net: Network | None, text: str = "text") -> F.Column:
    """A column (lang_pred, score) for the whole texts of ``df``."""
    model = df.sparkSession.sparkContext.broadcast(net)

    def predict(texts: pd.Series) -> pd.DataFrame:
        key = id(model.value)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = scorer(model.value), model.value
        return _scorers[key][0](texts)

    return F.pandas_udf(predict, "lang_pred string, score double")(F.col(text))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("__p", predicted(rows, net)).select("doc_id", held_out("doc_id").alias("held_out"), "__p.lang_pred", "__p.score")


def accepted(docs: DataFrame, net: Network | None, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The documents that have a language: not ``und``, and a score of ``min_score`` at least."""
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    told = own.withColumn("p", predicted(own, net, f"c{names.index(text)}"))
    return told.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score)).select(*own.columns).toDF(*names)
