"""Language ID by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, the largest answer of each filter over
a window is kept, and a softmax layer gives the window's language. A text is cut into windows from start to end
(the last one padded with zero bytes); its score for a language is the mean over its windows, weighted by their
bytes. Training reads the whole texts of at most `SAMPLE_ROWS` labelled rows, those of smallest id hash (a bounded
sample, stated here), and takes `STEPS` steps of `BATCH` rows, each with a window drawn from anywhere in its text.

Defined results: a null text or one without a letter is `und` with score 0; a tie goes to the language that sorts
first; without any labelled row every text is `und`; repeated rows get equal results; an empty table gives an empty
table; input columns named like the added ones are replaced; ids may be of any type that casts to text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime, textkit

WINDOW = 128
DIM = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_ROWS = 2000
STEPS = 900
BATCH = 128
#: Windows with fewer bytes are not learned from.
LEAST_BYTES = 8


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


class Network:
    def __init__(self, labels: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        n, taps = FILTERS * len(WIDTHS), max(WIDTHS)
        self.labels = labels
        #: Filters narrower than the widest have zero weights at their last taps.
        self.mask = np.repeat(np.array([[t < w for w in WIDTHS] for t in range(taps)]), FILTERS, axis=1).repeat(DIM, axis=0).astype(np.float32)
        self.p = {
            "emb": r.normal(0, 1, (256, DIM)), "w": r.normal(0, 0.25, (taps * DIM, n)) * self.mask, "b": np.zeros(n),
            "out": r.normal(0, 0.1, (n, len(labels))), "c": np.zeros(len(labels)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, taps * DIM): what the filters see at each place."""
        taps = max(WIDTHS)
        e = self.p["emb"][np.pad(x, ((0, 0), (0, taps - 1)))]
        view = np.lib.stride_tricks.sliding_window_view(e, taps, axis=1)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), x.shape[1], taps * DIM)

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = self.patches(x)
        a = (seen.reshape(-1, seen.shape[2]) @ self.p["w"]).reshape(len(x), x.shape[1], -1)
        return seen, a, a.max(axis=1)

    def head(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(top + self.p["b"], 0)
        z = h @ self.p["out"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return h, z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        out = [self.head(self.pool(x[i : i + step])[2])[1] for i in range(0, len(x), step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        seen, a, top = self.pool(x)
        h, prob = self.head(top)
        dz = prob
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.p["out"].T) * (h > 0)
        at = a.argmax(axis=1)  # only the place of each filter's largest answer learns
        own = seen[np.arange(len(x))[:, None], at]
        demb = np.zeros_like(self.p["emb"])
        back = (dh[:, :, None] * self.p["w"].T[None]).reshape(len(x), at.shape[1], max(WIDTHS), DIM)
        wide = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        byte = wide[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))].ravel()
        for d in range(DIM):
            demb[:, d] = np.bincount(byte, back[..., d].ravel(), 256)
        return {"emb": demb, "w": np.einsum("bfk,bf->kf", own, dh) * self.mask, "b": dh.sum(0), "out": h.T @ dz, "c": dz.sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, *, steps: int = STEPS, rate: float = 4e-3, seed: int = 5) -> Network:
        """Learns from windows x of the rows `of` (in order), whose labels are y[of]; all rows count alike."""
        r, m, v = np.random.default_rng(seed), {}, {}
        rows, first, count = np.unique(of, return_index=True, return_counts=True)
        if not len(rows):
            return self
        queue = np.zeros(0, np.int64)
        for t in range(1, steps + 1):
            while len(queue) < BATCH:
                queue = np.append(queue, r.permutation(len(rows)))
            some, queue = queue[:BATCH], queue[BATCH:]
            at = first[some] + r.integers(0, count[some])
            for k, g in self.grads(x[at], y[rows[some]]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                step = rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
                self.p[k] = (self.p[k] - step).astype(np.float32)
        return self


def cut(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts of a column, the text of each and its bytes."""
    data, off = textkit.flat(column)
    count = -(-np.diff(off) // WINDOW)
    of = np.repeat(np.arange(len(count)), count)
    out, at = np.zeros(int(count.sum()) * WINDOW, np.uint8), 0
    size = np.full(len(of), WINDOW, np.int64)
    last = np.cumsum(count)[count > 0] - 1
    size[last] = (np.diff(off) - (count - 1) * WINDOW)[count > 0]
    for a, b, n in zip(off[:-1].tolist(), off[1:].tolist(), count.tolist(), strict=True):
        out[at : at + b - a] = data[a:b]
        at += n * WINDOW
    return out.reshape(-1, WINDOW), of, size


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    sample_rows: int = SAMPLE_ROWS,
) -> Network | None:
    """A network fitted on the labelled rows that are not held out."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(True)))
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # Only hashes pass the top-k sort; the texts of the chosen follow.
    chosen = runtime.sample(rows.select("i"), F.col("i"), sample_rows)
    if not chosen:
        return None
    got = rows.where(F.xxhash64("i") <= chosen[-1]["h"]).orderBy(F.xxhash64("i"), "l", "t").limit(sample_rows).collect()
    labels = sorted({r["l"] for r in got})
    x, of, size = cut(pa.array([r["t"] for r in got], pa.string()))
    y = np.array([labels.index(r["l"]) for r in got], np.int64)
    full = size >= LEAST_BYTES
    return Network(labels).fit(x[full], y, of[full])


def _predict(model_bc, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network | None = model_bc.value
        for batch in textkit.chunks(batches, text_col, textkit.CHUNK // 2):
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            text = batch.column(text_col)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            if model:
                x, of, size = cut(text)
                prob = model.predict(x)
                total = np.stack([np.bincount(of, prob[:, k] * size, n) for k in range(prob.shape[1])], axis=1).astype(np.float64)
                total /= np.maximum(np.bincount(of, size, n), 1)[:, None]
                best = total.argmax(axis=1)
                lang[letters] = np.array(model.labels, object)[best[letters]]
                score[letters] = np.clip(total[np.arange(n), best], 0, 1)[letters]
            new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}
            yield pa.record_batch([new[c] if c in new else batch.column(c) for c in names], names)

    return run


def identify(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", *, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """docs with lang_pred and score, by a network fitted on `labelled` (by default docs itself)."""
    model = train(docs if labelled is None else labelled, id_col, text_col, lang_col, sample_rows=sample_rows)
    docs = runtime.without(docs, "lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), text_col, [*docs.columns, "lang_pred", "score"]), schema)
