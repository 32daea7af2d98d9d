"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, then tries with counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.canonical import kind
from tideline.session import materialize

#: Bytes of canonical texts and ids that a task holds before it emits its groups.
BLOCK_BYTES = 16 << 20
#: Rows a bucket may have, at every size of the input.
BUCKET_ROWS = 20_000


class Trie:
    """A radix trie over byte strings with a counter at each terminal.

    Children are keyed by chunks of STRIDE bytes; a lone suffix stays a leaf until another key shares its path.
    ``add`` returns the terminal's number; ``first`` and ``count`` are lists by that number.
    """

    STRIDE = 8

    def __init__(self) -> None:
        self.root: dict = {}
        self.first: list[int] = []
        self.count: list[int] = []

    def add(self, key: bytes, seq: int, n: int = 1) -> int:
        node, at, step = self.root, 0, self.STRIDE
        while True:
            chunk = key[at : at + step]
            child = node.get(chunk)
            rest = key[at + step :]
            if child is None:
                node[chunk] = (rest, len(self.first))
                self.first.append(seq)
                self.count.append(n)
                return len(self.first) - 1
            if type(child) is tuple:
                if child[0] == rest:
                    self.first[child[1]] = min(seq, self.first[child[1]])
                    self.count[child[1]] += n
                    return child[1]
                other, number = child
                child = node[chunk] = {other[:step]: (other[step:], number)}
            node, at = child, at + step


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal kinds within a block of the partition: canonical bytes, first seq, all seqs."""
    held: dict[bytes, list[int]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.binary()),
                pa.array([min(x) for x in held.values()], pa.int64()),
                pa.array(list(held.values()), pa.list_(pa.int64())),
            ],
            ["key", "rep", "members"],
        )

    for batch in batches:
        for seq, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = kind(text).encode("utf-8", "surrogatepass")
            if key in held:
                held[key].append(seq)
            else:
                held[key] = [seq]
                size += len(key) + 64
            size += 8
            if size > BLOCK_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def blocks(rows: DataFrame, id_col: str = "seq", text_col: str = "original_text") -> DataFrame:
    """key binary, rep bigint, members array<bigint>: the kinds of each block, equal texts already together."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_groups, "key binary, rep bigint, members array<bigint>")


def buckets(reps: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, bool]:
    """reps with columns bucket, a prefix of key that is long enough for the bucket to fit, and part; whether any has parts.

    Level by level the oversized prefixes are split by further bytes; they stay a table, which Spark broadcasts only
    below its threshold.  A bucket in which no key is longer than the prefix holds one key only: its rows, one for
    each block, are dealt into parts that fit.
    """
    depth, left, bucket, hot = 4, reps.select("key"), None, None
    reps = reps.withColumn("part", F.lit(0))
    while True:
        prefix = F.substring("key", 1, depth)
        sizes = left.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.max(F.length("key")).alias("longest")).where(F.col("n") > bucket_rows)
        over = materialize(sizes, "over")
        found = over.agg(F.count_if(F.col("longest") > depth).alias("wide"), F.count_if(F.col("longest") <= depth).alias("hot")).first()
        if found.hot:
            one = over.where(F.col("longest") <= depth).select(F.col("p").alias("_hot"), F.ceil(F.col("n") / max(2, bucket_rows)).alias("_parts"))
            hot = one if hot is None else hot.union(one)
        if not found.wide:
            break
        name = f"_over{depth}"
        large = over.where(F.col("longest") > depth).select(F.col("p").alias(f"_p{depth}"), F.lit(True).alias(name))
        reps = reps.join(large, prefix == F.col(f"_p{depth}"), "left").drop(f"_p{depth}")
        fits = F.when(F.col(name).isNull(), prefix)
        bucket = fits if bucket is None else F.coalesce(bucket, fits)
        left = left.join(large, prefix == F.col(f"_p{depth}"), "left_semi")
        depth *= 2
    reps = reps.withColumn("bucket", prefix if bucket is None else F.coalesce(bucket, prefix))
    if hot is not None:
        reps = reps.join(hot, (F.col("key") == F.col("_hot")) & (F.col("bucket") == F.col("_hot")), "left")
        reps = reps.withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"), F.lit(0)))
    return reps.select("bucket", "part", "key", "rep", "n"), hot is not None


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    at = [trie.add(k, s, n) for k, s, n in zip(pdf["key"], pdf["rep"], pdf["n"], strict=True)]
    return pd.DataFrame({"rep": pdf["rep"], "first_seq": [trie.first[i] for i in at], "copies": [trie.count[i] for i in at]})


def _tried(reps: DataFrame, bucket_rows: int) -> DataFrame:
    """rep, first_seq, copies of reps (key, rep, n), by tries over buckets that fit."""
    placed, parted = buckets(reps, bucket_rows=bucket_rows)
    counted = placed.groupBy("bucket", "part").applyInPandas(_count, "rep bigint, first_seq bigint, copies bigint")
    if not parted:
        return counted
    # one row for each part and key goes through tries again, a bucket_rows-th of the rows before
    counted = materialize(counted, "parts")
    firsts = counted.where("rep = first_seq").select("rep", F.col("copies").alias("n")).join(reps.select("rep", "key"), "rep")
    whole = _tried(firsts.select("key", "rep", "n"), bucket_rows).select(F.col("rep").alias("_r"), F.col("first_seq").alias("_f"), F.col("copies").alias("_c"))
    return counted.join(whole, F.col("first_seq") == F.col("_r")).select("rep", F.col("_f").alias("first_seq"), F.col("_c").alias("copies"))


def _counted(rows: DataFrame, id_col: str, text_col: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    held = materialize(blocks(rows, id_col, text_col), "kinds")
    return held, _tried(held.select("key", "rep", F.size("members").alias("n")), bucket_rows)


def copies(rows: DataFrame, *, id_col: str = "seq", text_col: str = "original_text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """first_seq, copy_seq: each row that is not the first (smallest id) of its kind, with that first row.

    Equal kinds are joined within each block before anything is shuffled; what goes through the tries is one row for
    each kind and block, so a text that holds a third of all rows has one row per block there, dealt into parts that
    fit, and its members are joined back by their block's representative, never by the text.  Rows with a null id or text are left out;
    texts without a letter or digit (the empty text among them) are of one kind.  Extra columns are ignored.
    """
    held, counted = _counted(rows, id_col, text_col, bucket_rows)
    firsts = counted.select("rep", "first_seq")
    members = held.select("rep", F.explode("members").alias("copy_seq"))
    return members.join(firsts, "rep").where("copy_seq <> first_seq").select("first_seq", "copy_seq")


def records(rows: DataFrame, *, id_col: str = "seq", text_col: str = "original_text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """first_seq, copies: one row for each kind with the number of its rows; nulls as in copies()."""
    _, counted = _counted(rows, id_col, text_col, bucket_rows)
    return counted.where("rep = first_seq").select("first_seq", "copies")
