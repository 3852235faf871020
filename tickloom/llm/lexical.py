"""Ranked lexical search by NRA: no random access, only reads of impact-sorted lists.

Texts become an index of the query terms they hold, one row a document, written once; its counts give N, L and the
document frequencies, so that the impact of a term in a document is an integer known before any list is read. Shards
of documents are then searched one after the other in every task. In a shard each term has its documents sorted by
falling impact. An item's lists are read in step, each read twice as deep as all before it. Every document has a lower
bound, the impacts read, and an upper bound, which adds the next unread impact of each list that has not yet shown it. Reading ends when no
document outside the first k can reach them, ties by id included, and the scores of those inside are known exactly. What is already
known of other shards raises the bar from the start. Nothing but k rows for each item leaves a task.

Items are taken in blocks of bounded number and size, whose terms are sent to all tasks; any number of blocks gives the same rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.textio import pieces

#: items and bytes of their text for one pass over the index
BLOCK_ITEMS, BLOCK_TEXT = 4096, 16 << 20
#: documents and postings searched at once; a single document may have more of them
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
FIRST_READ = 64
SLICE = 1 << 20

# What ends a term, and the letters that are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text with repeats, in lists of about SLICE bytes; a term is never cut."""
    data, begin = (text or b"").translate(_TABLE), 0
    while begin < len(data):
        end = begin + SLICE
        end = len(data) if end >= len(data) else data.find(b" ", end)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), term and tf (arrays over the vocabulary's terms that the text holds); rows without any term are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        wanted = known.__contains__
        for batch, texts in pieces(batches):
            rows, number, term, tf = [], [], [], []
            for i, text in enumerate(texts):
                found, n = Counter(), 0
                for part in terms(text):
                    n += len(part)
                    found.update(filter(wanted, part))
                if n:
                    rows.append(i)
                    number.append(n)
                    term.append([known[t] for t in found])
                    tf.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                names=["doc_id", "n", "term", "tf"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


class Statistics(NamedTuple):
    documents: int  # with at least one term
    terms: int  # all of theirs, with repeats
    weight: np.ndarray  # of every term of the vocabulary


def statistics(indexed: DataFrame, size: int) -> Statistics:
    """Of the whole index; the document frequencies of a block's terms are what comes to the driver."""
    n, total = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(size, np.int64)
    for term, df in indexed.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Statistics(n, total, weight)


class Best(NamedTuple):
    """Documents of an item in the order of rank: score falls, then ids rise, those without an id last."""

    score: np.ndarray
    missing: np.ndarray
    doc: np.ndarray

    def merged(self, other: Best, k: int) -> Best:
        both = [np.concatenate(x) for x in zip(self, other)]
        first = np.lexsort((both[2], both[1], -both[0]))[:k]
        return Best(*[x[first] for x in both])


NOTHING = Best(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


class Shard:
    """The impact-sorted lists of some documents, which are numbered in the order of their ids."""

    def __init__(self, doc: np.ndarray, missing: np.ndarray, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: Statistics):
        order = np.lexsort((doc, missing))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        self.doc, self.missing = doc[order], missing[order]
        length = 100 - 25 + (25 * n * stats.documents) // stats.terms
        impact = stats.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(length, size)))
        row = np.repeat(place, size)
        order = np.lexsort((row, -impact, term))
        self.row, self.impact, term = row[order], impact[order], term[order]
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.lists = dict(zip(term[begin].tolist(), zip(begin.tolist(), np.append(begin[1:], len(term)).tolist())))

    def search(self, item: dict[int, int], best: Best, k: int) -> Best:
        """The first k of ``best`` and of this shard's documents for an item of terms and their repeats."""
        lists = [(self.row[b:e], self.impact[b:e] * times) for t, times in item.items() if t in self.lists for b, e in [self.lists[t]]]
        if not lists:
            return best
        lower, deep, step = np.zeros(len(self.doc), np.int64), 0, FIRST_READ
        while True:
            for row, impact in lists:
                lower[row[deep : deep + step]] += impact[deep : deep + step]
            deep, step = deep + step, deep + step
            # the next unread impact of every list, and for each document the sum of those that have shown it
            heads = [int(impact[deep]) if deep < len(impact) else 0 for _, impact in lists]
            unread = sum(heads)
            if not unread:
                break
            shown = np.zeros(len(lower), np.int64)
            for head, (row, _) in zip(heads, lists):
                if head:
                    shown[row[:deep]] += head
            open_ = unread - shown  # upper bound minus lower bound
            first = self._first(lower, k)
            now = best.merged(Best(lower[first], self.missing[first], self.doc[first]), k)
            if len(now.score) < k or (bar := int(now.score[-1])) <= 0:
                continue
            # whoever could still reach the bar: above it, or at it with an id not behind that of the last
            upper = lower + open_
            rivals = (upper > bar) | ((upper == bar) & self._not_behind(now))
            # members of the first k that are known exactly are no rivals; all others have to be settled
            if not np.any(rivals & (open_ > 0)):
                break
        first = self._first(lower, k)
        return best.merged(Best(lower[first], self.missing[first], self.doc[first]), k)

    def _not_behind(self, now: Best) -> np.ndarray:
        """Documents whose id is not behind that of the last of the first k."""
        last = (bool(now.missing[-1]), int(now.doc[-1]))
        return (self.missing < last[0]) | ((self.missing == last[0]) & (self.doc <= last[1]))

    def _first(self, score: np.ndarray, k: int) -> np.ndarray:
        """Documents of the k highest scores above 0; rows are in the order of ids, so ties go to the smaller."""
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            bar = np.partition(score[at], len(at) - k)[len(at) - k]
            above, level = at[score[at] > bar], at[score[at] == bar]
            at = np.concatenate([above, level[: k - len(above)]])
        return at[np.lexsort((at, -score[at]))]


def search(indexed: DataFrame, items: list[dict[int, int]], stats: Statistics, k: int) -> DataFrame:
    """item (its number), doc_id and score: the first k of every task for every item."""
    kind = indexed.schema["doc_id"].dataType.simpleString()
    shared = indexed.sparkSession.sparkContext.broadcast((items, stats))

    def shards(batches):
        held, docs, postings = [], 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(begin, SHARD_DOCS)
                more = sum(map(len, part.column("term")))
                if held and (docs + part.num_rows > SHARD_DOCS or postings + more > SHARD_POSTINGS):
                    yield held
                    held, docs, postings = [], 0, 0
                held.append(part)
                docs, postings = docs + part.num_rows, postings + more
        if held:
            yield held

    def run(batches):
        items, stats = shared.value
        best = [NOTHING] * len(items)
        for held in shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            doc = table.column("doc_id").combine_chunks()
            number = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            term, tf = table.column("term").combine_chunks(), table.column("tf").combine_chunks()
            size = np.diff(term.offsets.to_numpy())
            shard = Shard(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), doc.is_null().to_numpy(zero_copy_only=False), number("n"), size, term.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False), stats)
            best = [shard.search(item, own, k) for item, own in zip(items, best)]
        for i, own in enumerate(best):
            if len(own.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.score), i)), pa.array(own.doc, mask=own.missing).cast(_arrow(kind)), pa.array(own.score)], names=["item", "doc_id", "score"])

    return indexed.mapInArrow(run, f"item long, doc_id {kind}, score long")


def _arrow(kind: str) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def rank(docs: DataFrame, items: DataFrame, folder: str, k: int = 20, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring rows of ``docs`` for each item, scores above 0 only.

    Null and empty texts have no terms, and without any a document counts nowhere and is never found. Equal scores go
    by ascending id; documents without an id count like others and come last among equals. Rows that repeat are
    documents of their own, equal items count once, unlike ones with one id are ranked apart. Long texts are read in
    slices of whole terms. Empty tables give an empty result; other columns are not looked at. ``folder`` is shared
    and gets the index of each block of items.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_TEXT))
    # one more column for Parquet to name, whatever the item's id is called
    of_block = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = of_block.where(F.col("block") == b).collect()
        counts = [Counter(t for part in terms(r.text.encode()) for t in part) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        path = f"{folder}/index-{b}"
        index(docs, vocabulary, id_col, text_col).write.parquet(path)
        indexed = spark.read.parquet(path)
        stats = statistics(indexed, len(vocabulary))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = search(indexed, [{vocabulary[t]: c for t, c in own.items()} for own in counts], stats, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
