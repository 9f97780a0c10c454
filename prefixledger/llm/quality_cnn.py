"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes, moved by four, run over the whole text. Activations are
max-pooled over chunks of 512 bytes that overlap by half, a small layer scores each chunk, and
the mean and the maximum over all chunks give one probability. The network is trained on the driver from a bounded
sample of labelled rows; scoring runs in tasks over Arrow batches, a few hundred kilobytes of text
at a time, so that one very long text costs no more memory than many short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED, FILTERS, HIDDEN = 8, 24, 12
STEP, SEGMENT = 4, 256
PAD = 256
#: Bound of the sample: labelled rows, and bytes of a sampled text (longer ones are scored, but not learned from).
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 16_384
EPOCHS, BATCH, RATE = 8, 48, 0.01
SLICE_BYTES = 512 << 10


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    block = STEP * EMBED
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = {
        "embed": draw(PAD + 1, EMBED, scale=0.5),
        "near": draw(block, FILTERS, scale=(2 / (2 * block)) ** 0.5),
        "far": draw(block, FILTERS, scale=(2 / (2 * block)) ** 0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "chunk": draw(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        "chunk_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(2 * HIDDEN, scale=(1 / HIDDEN) ** 0.5),
        "out_bias": np.zeros(1, np.float32),
    }
    weights["embed"][PAD] = 0
    return weights


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole segments (an empty one to one segment) behind each other, and segments of each."""
    segments = np.array([max(1, -(-len(t) // SEGMENT)) for t in texts])
    out = np.full(int(segments.sum()) * SEGMENT, PAD, dtype=np.int16)
    at = 0
    for text, k in zip(texts, segments.tolist(), strict=True):
        out[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += k * SEGMENT
    return out, segments


def _forward(w: dict[str, np.ndarray], laid: np.ndarray, segments: np.ndarray, train: bool = False) -> dict[str, np.ndarray]:
    per = SEGMENT // STEP
    blocks = w["embed"][laid].reshape(-1, STEP * EMBED)
    far = blocks @ w["far"]
    ends = np.cumsum(segments) * per
    active = blocks @ w["near"] + w["bias"]
    active[:-1] += far[1:]
    inner = ends[:-1]
    active[inner - 1] -= far[inner]  # a filter never reaches into the next text
    active = active.reshape(-1, per, FILTERS)
    pooled = active.max(axis=1)
    np.maximum(pooled, 0, out=pooled)
    # chunks: neighbouring segments of a text; a text of one segment is one chunk
    first_segment = np.cumsum(segments) - segments
    chunks = np.maximum(segments - 1, 1)
    first_chunk = np.cumsum(chunks) - chunks
    left = np.arange(int(chunks.sum())) + np.repeat(first_segment - first_chunk, chunks)
    right = left + np.repeat((segments > 1).astype(int), chunks)
    features = np.maximum(pooled[left], pooled[right])
    raw = features @ w["chunk"] + w["chunk_bias"]
    hidden = np.maximum(raw, 0)
    mean = np.add.reduceat(hidden, first_chunk) / chunks[:, None]
    most = np.maximum.reduceat(hidden, first_chunk)
    logit = np.concatenate([mean, most], axis=1) @ w["out"] + w["out_bias"][0]
    probability = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))
    if not train:
        return {"p": probability}
    return {"p": probability, "blocks": blocks, "active": active, "pooled": pooled, "left": left, "right": right, "features": features, "raw": raw, "hidden": hidden, "mean": mean, "most": most, "chunks": chunks, "laid": laid, "per": per, "ends": ends}


def _gradients(w: dict[str, np.ndarray], c: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss; maxima pass theirs to the place they came from."""
    off = ((c["p"] - labels) / len(labels)).astype(np.float32)
    g = {"out": np.concatenate([c["mean"], c["most"]], axis=1).T @ off, "out_bias": off.sum(keepdims=True)}
    by_mean, by_most = off[:, None] * w["out"][:HIDDEN], off[:, None] * w["out"][HIDDEN:]
    text = np.repeat(np.arange(len(labels)), c["chunks"])
    hidden = by_mean[text] / c["chunks"][text, None] + by_most[text] * (c["hidden"] == c["most"][text])
    hidden *= c["raw"] > 0
    g["chunk"], g["chunk_bias"] = c["features"].T @ hidden, hidden.sum(axis=0)
    features = hidden @ w["chunk"].T
    pooled = np.zeros_like(c["pooled"])
    from_left = c["pooled"][c["left"]] >= c["pooled"][c["right"]]
    np.add.at(pooled, c["left"], features * from_left)
    np.add.at(pooled, c["right"], features * ~from_left)
    pooled *= c["pooled"] > 0
    g["bias"] = pooled.sum(axis=0)
    place = c["active"].argmax(axis=1) + (np.arange(len(pooled)) * c["per"])[:, None]
    here = c["blocks"][place]
    following = np.minimum(place + 1, len(c["blocks"]) - 1)
    within = (~np.isin(place + 1, c["ends"]))[..., None].astype(np.float32)
    there = c["blocks"][following] * within
    g["near"], g["far"] = np.einsum("sf,sfk->kf", pooled, here), np.einsum("sf,sfk->kf", pooled, there)
    g["embed"] = np.zeros_like(w["embed"])
    symbols = c["laid"].reshape(-1, STEP)
    for part, rows, mask in (("near", place, 1.0), ("far", following, within)):
        flow = (pooled[..., None] * w[part].T[None] * mask).reshape(*place.shape, STEP, EMBED)
        np.add.at(g["embed"], symbols[rows], flow)
    g["embed"][PAD] = 0
    return g


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` passes of Adam over the sample in a seeded order; without rows, the start weights with output 0."""
    w = start_weights(seed)
    if not texts:
        w["out"][:] = 0
        return w
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            laid, segments = _laid([texts[i] for i in rows])
            g = _gradients(w, _forward(w, laid, segments, train=True), labels[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, x in g.items():
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.001 * (x * x - second[k])
                w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def score_texts(w: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; slices of about SLICE_BYTES, one long text in parts."""
    out, held, size = [], [], 0
    for text in texts:
        if len(text) > SLICE_BYTES:
            if held:
                out.append(_forward(w, *_laid(held))["p"])
                held, size = [], 0
            out.append(_score_long(w, text))
            continue
        if size + len(text) > SLICE_BYTES and held:
            out.append(_forward(w, *_laid(held))["p"])
            held, size = [], 0
        held.append(text)
        size += max(len(text), SEGMENT)
    if held:
        out.append(_forward(w, *_laid(held))["p"])
    return np.concatenate(out) if out else np.zeros(0)


def _score_long(w: dict[str, np.ndarray], text: bytes) -> np.ndarray:
    """The same network over one long text in parts that overlap by a segment, so that every chunk is seen once."""
    total, most, chunks = np.zeros(HIDDEN), np.zeros(HIDDEN), 0
    step = SLICE_BYTES // SEGMENT * SEGMENT
    for begin in range(0, max(1, len(text) - SEGMENT), step):
        # one more segment for the last chunk, and one block for the last filter
        part = text[begin : begin + step + SEGMENT + STEP]
        last = begin + step + SEGMENT >= len(text)
        laid, segments = _laid([part])
        c = _forward(w, laid, segments, train=True)
        k = len(c["hidden"]) if last else step // SEGMENT
        total += c["hidden"][:k].sum(axis=0)
        most = np.maximum(most, c["hidden"][:k].max(axis=0))
        chunks += k
        if last:
            break
    logit = float(np.concatenate([total / chunks, most]) @ w["out"] + w["out_bias"][0])
    return np.array([1 / (1 + np.exp(-np.clip(logit, -30, 30)))])


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Weights learned from at most ``sample_rows`` labelled rows outside the held-out fold, chosen by a hash of the key.

    Only texts of at most ``sample_bytes`` bytes are sampled. Null labels, keys and texts are left out; a key with several
    labels counts as the smallest. The sample's size bounds the broadcast and what the driver collects.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    chosen = usable.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_label")).orderBy(F.xxhash64("_k"), "_k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.octet_length("_text") <= sample_bytes).join(F.broadcast(chosen), F.col("_key") == F.col("_k"))
    sample = rows.select("_key", "_text", "_label").dropDuplicates(["_key"]).toPandas().sort_values("_key")
    return train([t.encode() for t in sample["_text"]], sample["_label"].to_numpy(dtype=np.float32))


def score(docs: DataFrame, weights: dict[str, np.ndarray], *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` for every row. Null and empty texts get the score of a text of padding alone.

    Repeated rows score alike; a null key is not held out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(key).alias(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    schema = T.StructType([rows.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                scores = score_texts(shared.value, [t.as_py() for t in part.column("_text")])
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("held_out"), pa.array(scores, pa.float64())], names=[key, "held_out", "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
