"""Token-id files: range asymmetric numeral system blocks with a shared table, in ascending doc_id order.

A dataset is a folder with `blocks` (first_token, n_tokens, payload: see `rans_format`) and `table` (token, n). Blocks
are independent: any executor reads any of them; a whole document's ids come back with its place in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayprint.llm.rans_format import Table, decode, encode
from dayprint.llm.store import dropped, sized, stored
from dayprint.llm.words import chunks, tokenizer, with_end
from dayprint.sources.workdir import new_folder

#: A block ends with the document that reaches this many ids.
BLOCK_TOKENS = 32_768
#: Blocks coded side by side by a task: enough to keep numpy busy, little memory.
BLOCKS_AT_ONCE = 96


def _tokenised(path: str, end: int):
    def run(batches):
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in chunks(batch, "text"):
                ids, n = with_end(*tokenizer(path).encode(piece.column("text")), end)
                upto = np.cumsum(n)
                local = pa.array(first + upto - n, pa.int64())
                first += int(upto[-1])
                edges = pa.array(np.concatenate([[0], upto * 4]), pa.int64())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, edges.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), piece.column("doc_id").cast(pa.int64()), local, pa.array(n, pa.int64()), raw.cast(pa.binary())],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )

    return run


def _counted(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        _, offsets, values = batch.column("ids").buffers()
        place = np.frombuffer(offsets, np.int32)[batch.column("ids").offset :][: batch.num_rows + 1]
        if batch.num_rows:
            n = np.bincount(np.frombuffer(values, "<u4", (place[-1] - place[0]) // 4, place[0]), minlength=len(total))
            n[: len(total)] += total
            total = n
    tokens = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(total[tokens], pa.int64())], ["token", "n"])


def _blocks(shared):
    def cut(batches):
        """Runs of consecutive whole documents of about BLOCK_TOKENS ids."""
        parts, docs, size, upto = [], [], 0, None
        for batch in batches:
            for doc, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids"))):
                if size >= BLOCK_TOKENS or size and start != upto:
                    yield np.concatenate(parts), docs
                    parts, docs, size = [], [], 0
                ids = np.frombuffer(raw, "<u4")
                parts.append(ids)
                docs.append((doc, start, len(ids)))
                size, upto = size + len(ids), start + len(ids)
        if size:
            yield np.concatenate(parts), docs

    def emit(table, group):
        columns = [[docs[0][1] for _, docs in group], [len(ids) for ids, _ in group]]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array(encode(table, group), pa.binary())], ["first_token", "n_tokens", "payload"]
        )

    def run(batches):
        table = Table(*shared.value)
        yield from map(lambda g: emit(table, g), grouped(cut(batches), lambda block: len(block[0])))

    return run


def grouped(items, size):
    """Lists of items that fill at most BLOCKS_AT_ONCE usual blocks when all are as long as their longest."""
    group, longest = [], 0
    for item in items:
        longest = max(longest, size(item))
        if group and (len(group) + 1) * longest > BLOCKS_AT_ONCE * 2 * BLOCK_TOKENS or len(group) == BLOCKS_AT_ONCE:
            yield group
            group, longest = [], size(item)
        group.append(item)
    if group:
        yield group


def _documents(shared):
    def run(batches):
        table = Table(*shared.value)
        blocks = (x for batch in batches for x in zip(batch.column("n_tokens").to_pylist(), batch.column("payload")))
        for group in grouped(blocks, lambda block: block[0]):
            rows, raws = [], []
            for ids, docs in decode(table, [raw.as_py() for _, raw in group]):
                at = 0
                for doc, start, n in docs:
                    rows.append((doc, start, n))
                    raws.append(ids[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(raws, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
            )

    return run


def _shared_table(spark: SparkSession, folder: str):
    # As many rows as the vocabulary has tokens at most.
    rows = spark.read.parquet(f"{folder}/table").toPandas()
    return spark.sparkContext.broadcast((rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Write the ids of all documents (doc_id, text; further columns are ignored), `end_id` after each.

    A null text is empty (its only id is end_id); null doc_ids come first; rows with the same doc_id are ordered by a
    hash of their text, repeated rows are written as often as they occur. An empty table gives an empty dataset.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part int, doc_id long, local_start long, n_tokens long, ids binary"
    tokens = stored(rows.mapInArrow(_tokenised(tokenizer_path, end_id), schema), "ids")
    counts = tokens.select("ids").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{folder}/table")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    bases = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = sized(stored(bases, "bases"), 16)
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")
    placed.mapInArrow(_blocks(_shared_table(spark, folder)), "first_token long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    dropped(spark, tokens)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("n_tokens", "payload")
    return blocks.mapInArrow(_documents(_shared_table(spark, folder)), "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' ids into a new folder and read them back."""
    folder = new_folder(docs.sparkSession, "rans")
    write_ids(docs, folder, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, folder)
