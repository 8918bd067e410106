"""Document quality by a small convolutional network over bytes, in numpy.

Each byte has a learned vector; filters run over windows of 16 bytes that start every 8 bytes. 32 windows make a chunk
(chunks share the bytes of their bordering windows) and cover the whole document. A filter's answer is its largest one in
the chunk; the largest and the mean over all chunks go through one hidden layer into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import crc_mod, map_rows, table

WIDTH, STRIDE, CHUNK, PAD = 16, 8, 32, 256
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: A bounded sample of labelled rows to learn from.
TRAIN_ROWS, EPOCHS, UPDATES, RATE = 3_000, 8, 900, 3e-3
THRESHOLD = 0.3


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each filled up to whole chunks with PAD, and the number of chunks of each."""
    span = STRIDE * CHUNK
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    chunks = np.array([max(1, -(-len(r) // span)) for r in raws])
    out = np.full(int(chunks.sum()) * span, PAD, np.int16)
    at = 0
    for r, n in zip(raws, chunks, strict=True):
        out[at:at + len(r)] = np.frombuffer(r, np.uint8)
        at += int(n) * span
    return out, chunks


def windows(codes: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Codes under each window; the windows that would run into the next text see PAD."""
    rows = codes.reshape(-1, STRIDE)
    after = np.concatenate([rows[1:], np.full((1, STRIDE), PAD, codes.dtype)])
    after[np.cumsum(chunks * CHUNK) - 1] = PAD
    return np.concatenate([rows, after], axis=1)


@dataclass
class ByteNet:
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7, bias: float = 0.0) -> ByteNet:
        r = np.random.default_rng(seed)
        n = lambda *shape: r.standard_normal(shape).astype(np.float32)
        return cls({
            "e": 0.5 * n(257, EMBED), "w": n(WIDTH * EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED / 2)),
            "b": np.zeros(FILTERS, np.float32), "u": n(2 * FILTERS, HIDDEN) / np.float32(np.sqrt(FILTERS)),
            "c": np.zeros(HIDDEN, np.float32), "v": n(HIDDEN, 1) / np.float32(np.sqrt(HIDDEN)),
            "d": np.full(1, bias, np.float32),
        })

    def chunk_peaks(self, seen: np.ndarray, keep: bool = False):
        x = self.p["e"][seen].reshape(len(seen), -1)
        a = np.maximum(x @ self.p["w"] + self.p["b"], 0)
        peaks = a.reshape(-1, CHUNK, FILTERS).max(1)
        return (peaks, x, a) if keep else peaks

    def head(self, peaks: np.ndarray, chunks: np.ndarray):
        start = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        top = np.maximum.reduceat(peaks, start, axis=0)
        mean = np.add.reduceat(peaks, start, axis=0) / chunks[:, None].astype(np.float32)
        z = np.concatenate([top, mean], axis=1)
        h = np.maximum(z @ self.p["u"] + self.p["c"], 0)
        return top, z, h, 1 / (1 + np.exp(-(h @ self.p["v"] + self.p["d"])[:, 0].astype(np.float64)))

    def score(self, texts: list[str | None], step: int = 512) -> np.ndarray:
        """Probability of label 1 for each text; memory is bounded by ``step`` chunks at a time besides the bytes."""
        if not texts:
            return np.zeros(0)
        codes, chunks = padded(texts)
        seen = windows(codes, chunks)
        peaks = [self.chunk_peaks(seen[i:i + step * CHUNK]) for i in range(0, len(seen), step * CHUNK)]
        return self.head(np.concatenate(peaks), chunks)[-1]

    def gradients(self, texts: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
        codes, chunks = padded(texts)
        seen = windows(codes, chunks)
        peaks, x, a = self.chunk_peaks(seen, keep=True)
        top, z, h, s = self.head(peaks, chunks)
        g = ((s - y) / len(y)).astype(np.float32)[:, None]
        gh = (g @ self.p["v"].T) * (h > 0)
        gz = gh @ self.p["u"].T
        doc = np.repeat(np.arange(len(chunks)), chunks)
        gp = gz[:, :FILTERS][doc] * (peaks == top[doc]) + gz[:, FILTERS:][doc] / chunks[doc][:, None].astype(np.float32)
        ga = (np.repeat(gp, CHUNK, axis=0) * (a == np.repeat(peaks, CHUNK, axis=0)) * (a > 0)).astype(np.float32)
        gx = (ga @ self.p["w"].T).reshape(-1, EMBED)
        flat = seen.ravel()
        ge = np.stack([np.bincount(flat, gx[:, i], 257) for i in range(EMBED)], axis=1).astype(np.float32)
        return {"e": ge, "w": x.T @ ga, "b": ga.sum(0), "u": z.T @ gh, "c": gh.sum(0), "v": h.T @ g, "d": g.sum(0)}


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Adam on batches of about 64 kB, UPDATES steps and ``epochs`` passes at least; the same rows give the same network. No rows: probability one half."""
    y = np.asarray(labels, np.float64)
    share = np.clip(y.mean(), 0.05, 0.95) if len(y) else 0.5
    net = ByteNet.fresh(seed, float(np.log(share / (1 - share))))
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    s = {k: np.zeros_like(x) for k, x in net.p.items()}
    order, t, epoch = np.random.default_rng(seed), 0, 0
    while len(y) and (t < UPDATES or epoch < epochs):
        epoch += 1
        batch, size = [], 0
        for i in [*order.permutation(len(y)), -1]:
            if i >= 0:
                batch.append(i)
                size += len(texts[i])
            if batch and (size > 65_536 or len(batch) >= 32 or i < 0):
                t += 1
                for k, g in net.gradients([texts[j] for j in batch], y[batch]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    net.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                batch, size = [], 0
    return net


def train(labelled: DataFrame, text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> ByteNet:
    """Fit on about ``rows`` rows chosen by a hash of their text; null texts and labels are not used."""
    df = labelled.select(F.col(text).alias("t"), F.col(label).alias("y")).where("t IS NOT NULL AND y IS NOT NULL")
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    got = sorted((r["t"], r["y"]) for r in df.collect())
    return fit([t for t, _ in got], np.array([y for _, y in got]))


def score(df: DataFrame, net: ByteNet, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` of every row from its whole text; null and empty texts are scored as empty."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    def work(rows: dict):
        ids, texts, at = rows[key], rows["t"], 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(texts[end] or "") < 400_000):
                size += len(texts[end] or "")
                end += 1
            yield {key: ids[at:end], "score": sent.value.score(texts[at:end])}
            at = end

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(F.col(key), F.col(text).alias("t")), work, f"`{key}` {kind}, score double")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality")
    n = known.count()
    if n > 2 * TRAIN_ROWS:  # fewer texts to join; ``train`` sees twice its rows at most
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(2e6 * TRAIN_ROWS / n))
    few = F.broadcast(known) if n <= 2 * TRAIN_ROWS or known.count() <= 4 * TRAIN_ROWS else known
    net = train(docs.select("doc_id", "text").join(few, "doc_id"))
    return score(docs, net).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
