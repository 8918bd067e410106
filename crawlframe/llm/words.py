"""Word hashes and shingles in numpy, and a batch form of grouped work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """64-bit hash of each word met; keeps the first 100,000."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


HASHES = WordHashes()


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def raw_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    words = raw_words(text)
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = hashes[:n].copy()
    for i in range(1, k):
        x = x * MIX + hashes[i:i + n]
    return scramble(x)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words as one if there are fewer, empty without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    x = np.sort(runs(h, min(k, len(h))))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def grouped(df: DataFrame, keys: list[str], work: Callable[[dict], Iterator[dict] | None], schema: str) -> DataFrame:
    """Rows of equal keys meet in one call of ``work`` as {column: list}; many small groups cost one Arrow batch.

    For groups of bounded size only: a group is held in memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held: pa.Table | None = None

        def flush(rows: pa.Table):
            out: dict[str, list] = {f.name: [] for f in target}
            cols = rows.to_pydict()
            which = list(zip(*[cols[k] for k in keys], strict=True))
            at = 0
            for end in range(1, len(which) + 1):
                if end == len(which) or which[end] != which[at]:
                    made = work({c: v[at:end] for c, v in cols.items()})
                    if made:
                        for c in out:
                            out[c] += made[c]
                    at = end
            if out[target[0].name]:
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in target}, schema=target)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = tuple(held[k][len(held) - 1].as_py() for k in keys)
            end = len(held)
            lows = [held[k] for k in keys]
            while end > 0 and tuple(c[end - 1].as_py() for c in lows) == last:
                end -= 1
            if end:
                yield from flush(held.slice(0, end))
                held = held.slice(end)
        if held is not None and len(held):
            yield from flush(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
