"""Byte-level BPE encoding and decoding with a pair occurrence index.

Encoding works on all distinct pre-tokens of a batch of a partition at once. Their byte
symbols lie in one array, linked to their neighbours. An index maps each mergeable pair to
all its positions; the active ranks are taken in ascending order, each pair merged at all
its positions together, and the position lists of the pairs that this makes are extended.
A merge makes only pairs that hold the new symbol; the heap of active ranks brings them up
in their turn, so every word gets the merges that merging it alone would make.

Decoding looks up each id's bytes. Special tokens are found in the raw text first.

Scale: a map over the scan, no shuffle. The memory of a worker is bounded by the batch and
by a cache of pre-token ids, emptied when full.

Cases: a null or empty text has no tokens; repeated rows are encoded each; an empty table
gives no rows; further columns are not carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common
from corpusmith.llm.encoding import PIECE, WS, byte_chars, tokenizer_path

MAX_ENTRIES = 1_000_000
OUT = "doc_id long, n_tokens long, ids binary, decoded binary"


class PairIndexBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        to_byte = {c: b for b, c in byte_chars().items()}
        self.table: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_chars().items())], np.int64)
        self.pair = [(vocab[a], vocab[b]) for a, b in merges]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = np.array([a << 32 | b for a, b in self.pair], np.int64)
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        s = WS
        self.pre = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.max_entries = max_entries
        self.cache: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of each word, all words merged together over one pair index."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(flat)
        if not n:
            return [np.empty(0, np.int64) for _ in words]
        ends = np.cumsum(sizes)
        sym = np.append(flat, -1)  # the last place is a wall
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n
        starts = (ends - sizes)[sizes > 0]
        before[starts] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[(at < n) & (after[np.minimum(at, n)] < n)] if len(at) else at
            if not len(at):
                return
            r = self.ranks(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for k, places in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if k in index:
                    index[k].append(places)
                else:
                    index[k] = [places]
                    heapq.heappush(heap, k)

        add(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            a, b = self.pair[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[at]
            live = (sym[at] == a) & (nxt < n)
            at, nxt = at[live], nxt[live]
            live = sym[nxt] == b
            at, nxt = at[live], nxt[live]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol, every other place from the left
                at = np.sort(at)
                nxt = after[at]
                breaks = np.append(True, at[1:] != nxt[:-1])
                first = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
                take = (np.arange(len(at)) - first) % 2 == 0
                at, nxt = at[take], nxt[take]
            beyond = after[nxt]
            sym[at], sym[nxt] = self.made[rank], -1
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            prev = before[at]
            add(np.unique(np.concatenate([at, prev[prev < n]])))
        word = np.repeat(np.arange(len(words)), sizes)
        alive = sym[:n] >= 0
        return np.split(sym[:n][alive], np.cumsum(np.bincount(word[alive], minlength=len(words)))[:-1])

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > self.max_entries:
            self.cache.clear()
            new = list(pieces)
        parts = [self.pre.findall(p) for p in new]
        words = list({w for p in parts for w in p})
        ids = {w: x.astype("<u4").tobytes() for w, x in zip(words, self.encode_words([w.encode() for w in words]), strict=True)}
        for p, ws in zip(new, parts, strict=True):
            self.cache[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at odd places."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return self.split_special.split(text)

    def encode_batch(self, texts: list[str], piece_limit: int = 400_000) -> list[bytes]:
        """ids of each text as little-endian uint32 bytes."""
        out: list[bytes] = []
        held: list[list[list[str]]] = []
        unknown: set[str] = set()

        def flush() -> None:
            self.learn(unknown)
            get = self.cache
            for doc in held:
                blobs = []
                for k, pieces in enumerate(doc):
                    blobs += [self.special[pieces[0]].to_bytes(4, "little")] if k % 2 else [get[p] for p in pieces]
                out.append(b"".join(blobs))
            held.clear()
            unknown.clear()

        for text in texts:
            doc = [[s] if k % 2 else cut_pieces(s) for k, s in enumerate(self.segments(text))]
            held.append(doc)
            unknown.update(*doc[::2])
            if len(unknown) >= piece_limit:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        joined = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return joined.decode("utf-8", "replace").encode()


def cut_pieces(text: str) -> list[str]:
    """The text cut before each space that stands between two other characters, and at line ends."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or not text.isprintable() and any(c in text for c in ODD):
        return PIECE.findall(text)
    if not text or text[0] in " \n" or text[-1] in " \n":
        return PIECE.findall(text)
    out = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        words = line.split(" ")
        out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


#: White space besides the space and the line feed.
ODD = "\t\v\f\r\x85\xa0                　"
_CODERS: dict[str, PairIndexBPE] = {}


def coder(name: str, folder: str | None = None) -> PairIndexBPE:
    path = tokenizer_path(name, folder)
    if path not in _CODERS:
        _CODERS[path] = PairIndexBPE(path)
    return _CODERS[path]


def _round_trip(tokenizer: str, folder: str | None, digest: bool):
    def run(batches):
        bpe = coder(tokenizer, folder)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            head = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if digest:
                sha = lambda data: hashlib.sha256(data).hexdigest()
                yield pa.record_batch(
                    [*head, pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.record_batch(
                    [*head, pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the decoded text (UTF-8) of each document."""
    return _rows(docs).mapInArrow(_round_trip(tokenizer, folder, False), OUT)


def round_trip_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """As encode_decode, with SHA-256 digests taken where the ids are, so that they needn't travel."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(docs).mapInArrow(_round_trip(tokenizer, folder, True), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(common.table(spark, sf_dir, "documents"))
