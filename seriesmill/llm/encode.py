"""Encoding of the whole corpus with a public byte-level tokenizer (problem 8), by merge replay.

1. Every task cuts its texts into words and counts the distinct ones; the counts are summed over the corpus.
2. The words that recur most (the head: at most HEAD_WORDS, whatever the corpus) are spread by hash, and each shard
   replays the merges over its words through an inverted index from token pair to word positions.
3. Every task turns its texts into ids: head words by looking them up, the words left by a replay over the distinct
   ones among them. No text is shuffled, and the result doesn't depend on what is in the head.

Defined results: a null text and an empty text both give an empty list. Special tokens are ordinary text. Texts of any
length are encoded whole. The vocabulary's folder is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.merges import TOKENIZERS, load, replay
from seriesmill.llm.pretokens import pieces, words

#: Most words in the head that every task gets: some 10 MB.
HEAD_WORDS = 1 << 17
#: Longest word in the head, in bytes; longer ones are replayed where they stand.
HEAD_BYTES = 64
#: Words outside the head, and ids of them, that a task remembers.
MEMO_WORDS, MEMO_IDS = 1 << 16, 1 << 22


def _texts(b: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(b.column(column).cast(pa.string()), "")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the distinct words of the corpus and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, "text")
            counted = [words(texts.slice(a, z - a))[0].value_counts() for a, z in pieces(texts)]
            if counted:
                both = pa.table({"word": pa.concat_arrays([c.field(0) for c in counted]), "n": pa.concat_arrays([c.field(1) for c in counted])})
                yield from both.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    return df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The words that occur at least so often that no more than `most` do; most of the words of any corpus are rarer.

    The limit comes from counting the words by the size of their count, in quarters of a power of two.
    """
    size = F.floor(F.log2("n") * 4).cast("int")
    by_size = counts.where(F.octet_length("word") <= HEAD_BYTES).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()
    taken, least = 0, 1 << 30
    for r in sorted(by_size, key=lambda r: -r["size"]):
        taken += r["words"]
        if taken > most or r["size"] < 4:  # a word seen once or twice isn't worth a place
            break
        least = r["size"]
    return counts.where((F.octet_length("word") <= HEAD_BYTES) & (size >= least))


def word_ids(words_: DataFrame, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """word, ids: the merges replayed over the distinct words, each shard with its own inverted index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            w = pa.concat_arrays([c.cast(pa.string()) for c in table["word"].chunks])
            ids, offsets = replay(w, load(tokenizer, folder))
            yield pa.RecordBatch.from_arrays([w, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], names=["word", "ids"])

    return words_.select("word").mapInArrow(run, "word string, ids array<int>")


class Encoder:
    """Looks words up in the head and replays the others. One for each task."""

    def __init__(self, head_words: pa.Array, ids: np.ndarray, offsets: np.ndarray, tokenizer: str, folder: str) -> None:
        self.head, self.ids, self.offsets = head_words, ids, offsets
        self.merges = load(tokenizer, folder)
        self._forget()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)"""
        all_words, per_text = words(texts)
        coded = all_words.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at = pc.index_in(distinct, self.head) if len(self.head) else pa.nulls(len(distinct), pa.int32())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False)
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        pool = self.ids
        begin[known], size[known] = self.offsets[at[known]], self.offsets[at[known] + 1] - self.offsets[at[known]]
        if not known.all():
            ids, start, n = self._tail(distinct.filter(pa.array(~known)))
            begin[~known], size[~known] = start + len(pool), n
            pool = np.concatenate([pool, ids])
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = pool[np.repeat(begin[which] - (ends - n), n) + np.arange(total)]
        upto = np.concatenate(([0], ends))[np.cumsum(per_text)] if len(per_text) else np.zeros(0, np.int64)
        return flat, np.diff(np.concatenate(([0], upto)))


    def _tail(self, rest: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many) of words outside the head; what the task replayed before is remembered."""
        if len(self.memo) > MEMO_WORDS or len(self.memo_ids) > MEMO_IDS:
            self._forget()
        at = pc.index_in(rest, self.memo) if len(self.memo) else pa.nulls(len(rest), pa.int32())
        fresh = rest.filter(at.is_null())
        if len(fresh):
            ids, offsets = replay(fresh, self.merges)
            self.memo_ends = np.concatenate([self.memo_ends, self.memo_ends[-1] + offsets[1:]])
            self.memo_ids = np.concatenate([self.memo_ids, ids])
            self.memo = pa.concat_arrays([self.memo, fresh])
            at = pc.index_in(rest, self.memo)
        where = at.to_numpy(zero_copy_only=False)
        return self.memo_ids, self.memo_ends[where], self.memo_ends[where + 1] - self.memo_ends[where]

    def _forget(self) -> None:
        self.memo, self.memo_ids, self.memo_ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)


def shared_head(df: DataFrame, text: str, tokenizer: str, folder: str, most: int = HEAD_WORDS):
    """Broadcast of the head's words with their ids: at most `most` words of at most HEAD_BYTES bytes."""
    spark = df.sparkSession
    counts = word_counts(df, text).persist()
    try:
        got = word_ids(head(counts, most), tokenizer, folder).toArrow().combine_chunks()
    finally:
        counts.unpersist()
    ids = got["ids"].combine_chunks() if got.num_rows else None
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0)
    if ids is None:
        return spark.sparkContext.broadcast((pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)))
    w = pa.concat_arrays([c.cast(pa.string()) for c in got["word"].chunks])
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return spark.sparkContext.broadcast((w, flat, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)))


def _encoded(df: DataFrame, key: str, text: str, tokenizer: str, folder: str, most: int, counts_only: bool) -> DataFrame:
    shared = shared_head(df, text, tokenizer, folder, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, tokenizer, folder)
        for b in batches:
            texts = _texts(b, "text")
            for a, z in pieces(texts):
                ids, n = encoder(texts.slice(a, z - a))
                if counts_only:
                    out = pa.array(n)
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(a, z - a), out], names=["key", "out"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, out {'bigint' if counts_only else 'array<int>'}")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, most: int = HEAD_WORDS) -> DataFrame:
    """key and ids (array<int>) of each row, in any order; keys may repeat."""
    return _encoded(df, key, text, tokenizer, folder, most, False).select(F.col("key").alias(key), F.col("out").alias("ids"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, most: int = HEAD_WORDS) -> DataFrame:
    """key and tokens (bigint) of each row: the length of its ids."""
    return _encoded(df, key, text, tokenizer, folder, most, True).select(F.col("key").alias(key), F.col("out").alias("tokens"))
