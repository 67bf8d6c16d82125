"""Quality classifier: a convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned filters
look at WIDTH bytes at a time, every STRIDE bytes; each filter's largest response in a chunk is the chunk's feature. The mean
and the largest of each feature over the chunks give, through one layer, the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import table

WIDTH, STRIDE, VECTOR, FILTERS = 8, 2, 8, 32
#: Places at which filters look in a chunk, and how far the next chunk begins: chunks overlap by the difference.
CHUNK, STEP = 128, 120
CHUNK_BYTES = STRIDE * (CHUNK - 1) + WIDTH
#: Bounds of training: texts of each label (all chunks of each), passes, texts to a step.
TRAIN_TEXTS, EPOCHS, BATCH = 2000, 12, 32
#: Chunks whose responses are held at once in training.
TRAIN_PIECE = 512
PIECE = 1 << 16


def byte_array(text: str | None) -> np.ndarray:
    """The bytes of a text, with zeros up to the least that the filters need and to a whole number of strides."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    short = max(WIDTH - len(b), 0) or -(len(b) - WIDTH) % STRIDE
    return np.concatenate([b, np.zeros(short, np.uint8)]) if short else b


def chunk_starts(n_places: int) -> np.ndarray:
    return np.arange(0, max(n_places - (CHUNK - STEP), 1), STEP)


def features(b: np.ndarray, vectors: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean and largest over all chunks of each filter's largest response, negative ones as zero. b from byte_array."""
    n = (len(b) - WIDTH) // STRIDE + 1
    starts = chunk_starts(n)
    total, most, count = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
    per_piece = PIECE // STEP
    for k in range(0, len(starts), per_piece):
        part = starts[k : k + per_piece]
        first, last = part[0], min(part[-1] + CHUNK, n)
        v = vectors[b[first * STRIDE : (last - 1) * STRIDE + WIDTH]]
        windows = sliding_window_view(v.reshape(-1), WIDTH * VECTOR)[:: STRIDE * VECTOR]
        out = np.ascontiguousarray(windows) @ filters  # BLAS takes no overlapping rows
        edges = np.stack([part - first, np.minimum(part + CHUNK, n) - first], axis=1).reshape(-1)
        tops = np.maximum.reduceat(out, np.minimum(edges, len(out) - 1), axis=0)[::2]
        if edges[-1] == len(out):  # reduceat leaves the last place out of a range that ends there
            tops[-1] = out[edges[-2] :].max(axis=0)
        tops = np.maximum(tops + bias, 0)
        total += tops.sum(axis=0)
        most = np.maximum(most, tops.max(axis=0))
        count += len(tops)
    return np.concatenate([(total / count).astype(np.float32), most])


def chunks_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a text's bytes as rows of CHUNK_BYTES, and at how many places of each the filters look."""
    n = (len(b) - WIDTH) // STRIDE + 1
    starts = chunk_starts(n)
    padded = np.concatenate([b, np.zeros(CHUNK_BYTES, np.uint8)])
    return padded[starts[:, None] * STRIDE + np.arange(CHUNK_BYTES)], np.minimum(n - starts, CHUNK)


def _tops(chunks: np.ndarray, places: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter the place of the largest response, and that response."""
    where, top = [], []
    for k in range(0, len(chunks), TRAIN_PIECE):
        part = chunks[k : k + TRAIN_PIECE]
        windows = sliding_window_view(w["vectors"][part].reshape(len(part), -1), WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]
        response = np.ascontiguousarray(windows) @ w["filters"]
        short = np.flatnonzero(places[k : k + TRAIN_PIECE] < CHUNK)
        for i in short:
            response[i, places[k + i] :] = -np.inf
        where.append(response.argmax(axis=1))
        top.append(np.take_along_axis(response, where[-1][:, None], axis=1)[:, 0])
    return np.concatenate(where), np.concatenate(top)


def gradients(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: dict[str, np.ndarray], decay: float = 1e-4) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss over texts (chunks and places of each) plus weight decay of the last layer, and its gradient."""
    chunks, places = (np.concatenate(x) for x in zip(*texts, strict=True))
    owner = np.repeat(np.arange(len(texts)), [len(p) for _, p in texts])
    place, top = _tops(chunks, places, w)
    top = top + w["bias"]
    h = np.maximum(top, 0)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[begin, len(owner)])[:, None]
    mean, most = np.add.reduceat(h, begin) / count, np.maximum.reduceat(h, begin)
    x = np.concatenate([mean, most], axis=1).astype(h.dtype)
    odds = x @ w["out"] + w["last"]
    p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    loss = float(np.mean(np.logaddexp(0, odds) - y * odds) + decay / 2 * (w["out"] @ w["out"]))
    d = (p - y) / len(y)
    dx = d[:, None] * w["out"]
    # the largest of a text's chunks gets the gradient, the first of several
    best = np.zeros(h.shape, bool)
    for i, (a, n) in enumerate(zip(begin, count[:, 0], strict=True)):
        best[a + h[a : a + n].argmax(axis=0), np.arange(FILTERS)] = True
    dh = ((dx[:, :FILTERS] / count)[owner] + dx[:, FILTERS:][owner] * best) * (top > 0)
    g = {"out": x.T @ d + decay * w["out"], "last": d.sum(keepdims=True), "bias": dh.sum(axis=0), "filters": np.zeros_like(w["filters"]), "vectors": np.zeros_like(w["vectors"])}
    for k in range(0, len(chunks), TRAIN_PIECE):
        own, part = dh[k : k + TRAIN_PIECE], chunks[k : k + TRAIN_PIECE]
        letters = part[np.arange(len(part))[:, None, None], place[k : k + TRAIN_PIECE][:, :, None] * STRIDE + np.arange(WIDTH)]
        at_top = w["vectors"][letters].reshape(len(part), FILTERS, WIDTH * VECTOR)  # chunk, filter, window
        g["filters"] += np.einsum("cfk,cf->kf", at_top, own, optimize=True)
        dv = (own[:, :, None] * w["filters"].T[None]).reshape(-1, VECTOR)
        g["vectors"] += np.stack([np.bincount(letters.reshape(-1), dv[:, v], 256) for v in range(VECTOR)], axis=1)
    return loss, g


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network by Adam on the log loss. texts: the bytes of each, of which all chunks count."""
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"vectors": scale(256, VECTOR) * 8, "filters": scale(WIDTH * VECTOR, FILTERS), "bias": np.zeros(FILTERS, np.float32), "out": scale(2 * FILTERS, 1)[:, 0], "last": np.zeros(1, np.float32)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            _, g = gradients([chunks_of(texts[i]) for i in chosen], labels[chosen].astype(np.float32), w)
            step += 1
            for k in w:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                w[k] = (w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def score(b: np.ndarray, w: dict[str, np.ndarray]) -> float:
    odds = float(features(b, w["vectors"], w["filters"], w["bias"]) @ w["out"] + w["last"][0])
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_TEXTS) -> dict[str, np.ndarray] | None:
    """The network, fitted on whole texts of at most `most` ids of each label, by hash of the id, that are not held out.

    Ids with both labels are left out; of ids with several texts each counts, up to 4 * most texts by hash of id and text.
    None if there is no text of one of the labels. The driver holds the chosen texts, one batch's chunks at a time.
    """
    told = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("doc_id", "label")
    sizes = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        some = told.filter(F.col("label") == label).orderBy(order, "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = picked.orderBy(order, "doc_id", F.md5("text"), "text").limit(4 * most).select("label", "text").toPandas()
    y = rows["label"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        return None
    w = train([byte_array(t) for t in rows["text"]], y)
    # labels were drawn evenly: put their proportions back
    w["last"] = w["last"] + np.float32(np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (1 - y).sum()))
    return w


def classify(docs: DataFrame, weights: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and score, the probability that its whole text is of quality 1.

    Null and empty texts are scored as a text of zeros. Without weights (no labels to learn from) every score is 0.5.
    Repeated rows have equal scores; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = [0.5 if w is None else score(byte_array(t.as_py()), w) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
