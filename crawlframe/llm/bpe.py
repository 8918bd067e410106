"""BPE encoding and decoding with an index of pair occurrences.

The new words of an Arrow batch are laid out in one array of symbols. A map leads from each merge rank to all positions
of its pair; a heap gives the active ranks in ascending order, and each applied merge only touches the lists of the
pairs it makes. Since words never share symbols, this equals merging every word by itself.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import map_rows, table

#: White space as Unicode has it, unlike Python's ``\s``, which adds four control characters.
SPACE = "\t-\r \x85\xa0  -     　"


def load_vocabulary(path: str) -> str:
    """Content of a tokenizer file, to be sent to the executors (a vocabulary is of fixed size)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary; keeps the codes of the words it has met, up to ``keep`` of them."""

    content: str
    keep: int = 250_000

    def __post_init__(self):
        spec = json.loads(self.content)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in merges]
        self.pair = [(vocab[a], vocab[b]) for a, b in merges]
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(self.pair)}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.first = np.array(self.inner + self.last)  # of a byte inside a word and of the last one
        self.ranks = np.array([self.rank.get(a << 32 | b, -1) for a in self.inner for b in self.first.tolist()], np.int32).reshape(256, 512)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.blank = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for the pattern
        self.known: dict[str, bytes] = {" " + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.words: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Codes of distinct words, all merged together."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = size.cumsum() - 1
        letter = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        right = letter.copy()
        right[ends] += 256
        nxt, prv = np.arange(1, len(letter) + 1), np.arange(-1, len(letter) - 1)
        nxt[ends] = -1
        prv[ends - size + 1] = -1
        ranks = self.ranks[letter[:-1], right[1:]]
        ranks[ends[:-1]] = -1
        at = np.argsort(ranks, kind="stable")
        at = at[np.searchsorted(ranks[at], 0):]
        active, cuts = np.unique(ranks[at], return_index=True)
        places = dict(zip(active.tolist(), (x.tolist() for x in np.split(at, cuts[1:])), strict=False))
        get = self.rank.get
        sym, nxt, prv, start = self.first[right].tolist(), nxt.tolist(), prv.tolist(), (ends - size + 1).tolist()
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (a, b), new = self.pair[r], self.made[r]
            for i in sorted(places.pop(r)):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                h = prv[i]
                if k >= 0:
                    prv[k] = i
                    if (q := get(new << 32 | sym[k])) is not None:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            heapq.heappush(active, q)
                if h >= 0 and (q := get(sym[h] << 32 | new)) is not None:
                    if q in places:
                        places[q].append(h)
                    else:
                        places[q] = [h]
                        heapq.heappush(active, q)
        out = []
        for at in start:
            codes = []
            while at >= 0:
                codes.append(sym[at])
                at = nxt[at]
            out.append(array("I", codes).tobytes())
        return out

    def chunks(self, text: str) -> list[str]:
        """Normalised stretches without white space; a special token between them is led by a space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(" " + part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                out += [c for c in self.blank.split(part) if c] if self.odd.search(part) else part.split()
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not known yet, all words of them at once."""
        fresh = [c for c in chunks if c not in self.known]
        parts = [[c] if c.isascii() and c.isalpha() else self.pieces.findall(c) for c in fresh]
        words = self.words
        new = list({w for p in parts for w in p if w not in words})
        gc.disable()  # only lists of numbers are made here
        words.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        gc.enable()
        for c, p in zip(fresh, parts, strict=True):
            self.known[c] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.words) > self.keep:
            self.words.clear()
        if len(self.known) > self.keep:
            self.known = {" " + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        split = [self.chunks(t or "") for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, codes: bytes) -> str:
        """Tokens of the ids, joined by single spaces (the vocabulary file names no decoder)."""
        return " ".join(map(self.token.__getitem__, memoryview(codes).cast("I").tolist()))


@functools.lru_cache(2)
def codec(content: str) -> Codec:
    return Codec(content)


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` of every whole text.

    ``vocabulary`` is the content of a tokenizer file. Null and empty texts have no ids; repeated rows and null keys
    give one row each. Other columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(rows: dict):
        ids = codec(sent.value).encode(rows["t"])
        return {key: rows[key], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(F.col(key), F.col(text).alias("t")), work, f"`{key}` {kind}, ids binary, n_tokens long", 400)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids, to the frame; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "decoded") + ", decoded string"

    def work(rows: dict):
        c = codec(sent.value)
        rows["decoded"] = [None if x is None else c.decode(x) for x in rows[ids]]
        return rows

    return map_rows(df, work, schema, 400)


def op10_bpe(spark: SparkSession, folder: str, vocabulary_path: str | None = None) -> DataFrame:
    """Digests of ids and of the decoded text of every document."""
    import public_tokenizers

    content = load_vocabulary(vocabulary_path or public_tokenizers.path("word_bpe_49k.json"))
    coded = decode(encode(table(spark, folder, "documents"), content), content)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
