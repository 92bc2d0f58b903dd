"""Best-fit packing: vector best-fit of token pieces into training sequences.

Each document's ids (library encoding, end id appended) are cut into pieces of at most
``capacity`` tokens; only longer documents are cut. Pieces are packed into sequences under
three capacities at once: tokens, documents and attention cost (sum of squared lengths).
Pieces are taken longest first; of the open sequences where a piece fits under every
constraint, the one with the least weighted residual norm takes it.

The query's document capacity of 128 binds (short pieces would fill a sequence with more) and
costs no sequence on the test tables. Its attention capacity is the cost of one full piece,
the least that lets every piece be placed: lengths that sum to the token capacity cannot
exceed it, so it binds only where a caller sets it lower.

Scale: encoding is a map over the scan and yields one small row a piece. The pieces are
dealt evenly into groups of about ``group_rows``, each packed in one task's memory, so
waste is at most a few sequences a group at every input size and no key can be hot.

Cases: a null or empty text is one piece with the end id alone; repeated rows are packed
each; an empty table gives no rows; further columns of the input are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common
from corpusmith.llm.encoding import crc, encoder

CAPACITY = 2048
MAX_DOCS = 128
GROUP_ROWS = 16_000
SLICE_ROWS = 2048
WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def vector_best_fit(
    lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: float | None = None, weights: tuple = WEIGHTS
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. lengths are from 1 to capacity."""
    max_cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    n = len(lengths)
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.empty((3, max(n, 1)))  # residual capacities of the open sequences
    ids = np.empty(max(n, 1), np.int64)
    n_open = n_all = 0
    scale = np.array(weights) / np.array([capacity, max_docs, max_cost]) ** 2
    for k, i in enumerate(order):
        size = float(lengths[i])
        if size * size > max_cost:
            raise ValueError("a piece exceeds the attention capacity")
        best = -1
        if n_open and size * 2 <= capacity:
            if k % 256 == 0:  # close what not even the smallest piece fits
                least = float(lengths[order[-1]])
                keep = np.flatnonzero((left[0, :n_open] >= least) & (left[1, :n_open] >= 1) & (left[2, :n_open] >= least * least))
                left[:, : len(keep)], ids[: len(keep)], n_open = left[:, keep], ids[keep], len(keep)
            a = left[:, :n_open]
            fit = np.flatnonzero((a[0] >= size) & (a[1] >= 1) & (a[2] >= size * size))
            if len(fit):
                r = a[:, fit]
                norm = scale[0] * (r[0] - size) ** 2 + scale[1] * (r[1] - 1) ** 2 + scale[2] * (r[2] - size * size) ** 2
                best = int(fit[np.argmin(norm)])
        if best < 0:
            best, n_open = n_open, n_open + 1
            left[:, best], ids[best], n_all = (capacity, max_docs, max_cost), n_all, n_all + 1
        seq[i], offset[i] = ids[best], capacity - left[0, best]
        left[0, best] -= size
        left[1, best] -= 1
        left[2, best] -= size * size
    return seq, offset


def _cut(tokenizer: str, folder: str | None, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(tokenizer, folder)
        for batch in common.slices(batches, SLICE_ROWS):
            flat, n = enc.encode(batch.column(1))
            ids = memoryview(np.ascontiguousarray(np.insert(flat, np.cumsum(n), end_id), "<u4")).cast("B")
            n = n + 1
            parts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            at = 4 * ((np.cumsum(n) - n)[doc] + start)
            sums = [crc(ids[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return common.tidied(run)


def _pack(capacity: int, max_docs: int, max_cost: float | None, weights: tuple):
    def run(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        seq, offset = vector_best_fit(t.column("length").to_numpy(), capacity, max_docs, max_cost, weights)
        base = TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))
        yield from t.to_batches()

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_cut(tokenizer, folder, end_id, capacity), PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 0,
    capacity: int = CAPACITY,
    max_docs: int = MAX_DOCS,
    max_cost: float | None = None,
    weights: tuple = WEIGHTS,
    group_rows: int = GROUP_ROWS,
    folder: str | None = None,
) -> DataFrame:
    """One row a piece with its sequence and offset; see the module's docstring."""
    pieces, _ = common.materialize(cut_pieces(docs, tokenizer, end_id, capacity, folder), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    return pieces.repartition(groups).mapInArrow(_pack(capacity, max_docs, max_cost, weights), PACKED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
