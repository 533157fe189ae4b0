"""Problem 6: encoding of a whole corpus with a public byte-level BPE vocabulary.

The encoder works on many words at once. All words that a batch needs and that are not known yet are laid out in one
row of symbols. A pair occurrence index maps the rank of each mergeable pair to all its positions in that row; ranks
that have positions are active and are applied in ascending order, each to all its positions at once from left to
right; a merge links its neighbours anew and adds the pairs it makes to the lists of their ranks, which are always
higher, since a pair with a new symbol was learned after that symbol. Positions gone stale are told by their symbols.

The vocabulary is read on the driver and broadcast (its size is fixed); workers index it once a process.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_WORDS = 200_000  # words a worker remembers; beyond it starts anew
BATCH_CHARS = 4_000_000  # characters encoded together, about


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class PairIndexEncoder:
    """Byte-level BPE by a pair occurrence index over a row of words."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.pair: dict[int, tuple[int, int]] = {}  # left id << 20 | right id -> rank, merged id
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pair.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.by_rank = {r: (k >> 20, k & 0xFFFFF, new) for k, (r, new) in self.pair.items()}
        self.words = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, list[int]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        n = int(sizes.sum())
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = np.cumsum(sizes)
        for e in ends.tolist():
            if e:
                nxt[e - 1] = -1
            if e < n:
                prv[e] = -1
        index: dict[int, list[int]] = {}
        pair, by_rank = self.pair, self.by_rank
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                hit = pair.get(ids[i] << 20 | ids[j])
                if hit:
                    index.setdefault(hit[0], []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = by_rank[rank]
            at = index.pop(rank)
            at.sort()
            for i in at:
                j = nxt[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue
                k, p = nxt[j], prv[i]
                ids[i], ids[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    hit = pair.get(new << 20 | ids[k])
                    if hit:
                        if hit[0] not in index:
                            index[hit[0]] = []
                            heapq.heappush(active, hit[0])
                        index[hit[0]].append(i)
                if p >= 0:
                    hit = pair.get(ids[p] << 20 | new)
                    if hit:
                        if hit[0] not in index:
                            index[hit[0]] = []
                            heapq.heappush(active, hit[0])
                        index[hit[0]].append(p)
        out, start = [], 0
        for e in ends.tolist():
            out.append([x for x in ids[start:e] if x >= 0])
            start = e
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; a null or empty text gives the empty list."""
        split = [self.words.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        fresh = list({w for ws in split for w in ws if w not in known})
        for w, ids in zip(fresh, self.encode_words(fresh), strict=True):
            known[w] = ids
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out


_ENCODERS: dict[int, PairIndexEncoder] = {}


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of whole texts of about BATCH_CHARS characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _run(df: DataFrame, key: str, column: str, vocabulary: str, lengths: bool) -> DataFrame:
    spark: SparkSession = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    key_type = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = hash(shared.value)
        if tag not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[tag] = PairIndexEncoder(shared.value)
        enc = _ENCODERS[tag]
        for batch in batches:
            done = 0
            for run in _pieces(batch.column(1).to_pylist()):
                ids = enc.encode(run)
                keys = batch.column(0).slice(done, len(run))
                done += len(run)
                sizes = np.fromiter((len(x) for x in ids), np.int32, len(ids))
                if lengths:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(sizes)], ["k", "n"])
                    continue
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["k", "ids"])

    schema = f"k {key_type}, n int" if lengths else f"k {key_type}, ids array<int>"
    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInArrow(encode, schema).withColumnRenamed("k", key)


def token_ids(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ids of every row's text as stored, without special tokens; strings of special tokens are text.

    Null and empty texts give the empty list; repeated keys a row each; an empty table an empty result.
    """
    return _run(df, key, column, vocabulary, lengths=False)


def token_counts(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and n, the number of ids of every row's text."""
    return _run(df, key, column, vocabulary, lengths=True)
