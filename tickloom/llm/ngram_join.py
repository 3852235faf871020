"""Jaccard self-join of documents on their word n-grams, with Bayesian pruning of candidates.

Texts with the same set of shingles form one class; only classes are compared. Bands of MinHash values put classes
into buckets. Inside a bucket classes are compared on ever more MinHash values, of which a byte each is carried, and a
pair is dropped once the posterior probability that its similarity reaches the threshold falls below a tolerance.
Classes that hang together by the pairs left over form a cluster, and only within clusters are shingles looked at: a
cluster is cut into blocks of bounded size and every pair of blocks is one group of rows, whose pairs are pruned
in the same way and then verified on the shingles themselves. What leaves a group is a row for each class in it: its number of
links there and a neighbour to hang on, so the output is linear even where links are not.

In a bucket, a class that was reached is compared only with those that were not, so a bucket of near copies costs about its size and
one of unlike texts its square, on 160 bytes each. Work inside a cluster of mutually different near copies is the
square of its size, in blocks spread over all tasks.
A pair at the threshold shares no band with probability (1 - 0.8**5)**32, about 3e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.skew import salted_join
from tickloom.llm.textio import gram_starts, grams, hash_words, mix, per_text, release, split_words
from tickloom.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 32, 5
VALUES = BANDS * BAND_ROWS
#: posterior below which a pair is dropped, and how many values are compared at a time
TOLERANCE, STEP = 1e-7, 32
#: bounds of one block: classes and shingles; and classes of a bucket that are looked at together
BLOCK_CLASSES, BLOCK_SHINGLES, BUCKET_CLASSES = 256, 200_000, 2048

_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY = (_SEEDS[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[VALUES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of every k words of a text; a text of fewer words is one shingle, one without words none."""
    w = split_words(texts)
    h = hash_words(w)
    at = gram_starts(w, k)
    g = grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    first = np.searchsorted(at, w.first)
    out = []
    for i in range(len(texts)):
        own = g[first[i] : first[i + 1]]
        if not len(own) and w.first[i] < w.first[i + 1]:
            words = h[w.first[i] : w.first[i + 1]]
            own = grams(words, len(words))
        out.append(np.unique(own))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(best, (x[i : i + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n compared values, the fewest matches whose posterior of similarity >= threshold is not below the tolerance.

    Under a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches of n, and its tail above t is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(VALUES + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


class _Side:
    """Classes of one block: their ids, signatures (a byte of each MinHash value) and shingles."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        rows = sorted({r[0]: r for r in rows}.values())  # repeated rows count once
        self.nodes = np.array([r[0] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.signatures = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, VALUES)


def reached(signatures: np.ndarray, least: list[int]) -> np.ndarray:
    """For each signature the position of the one it hangs on: links are the pairs that no posterior rules out.

    Walks each component from its first member; whoever is reached leaves the list that later ones are compared with.
    """
    root, left = np.arange(len(signatures)), np.arange(len(signatures))
    while len(left):
        front, left = [left[0]], left[1:]
        first = front[0]
        while front and len(left):
            own = signatures[front.pop()]
            near, matches = left, np.zeros(len(left), np.int64)
            for at in range(0, VALUES, STEP):
                to = min(at + STEP, VALUES)
                matches = matches + (signatures[near, at:to] == own[at:to]).sum(axis=1)
                likely = matches >= least[to]
                near, matches = near[likely], matches[likely]
                if not len(near):
                    break
            if len(near):
                root[near] = first
                front += near.tolist()
                left = left[root[left] != first]
    return root


def block_links(a: _Side, b: _Side | None, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and similarity of all linked pairs between two blocks, or within one where ``b`` is None."""
    own = b is None
    b = a if own else b
    i, j = np.triu_indices(len(a.nodes), 1) if own else (x.ravel() for x in np.indices((len(a.nodes), len(b.nodes))))
    # a similarity of t needs sizes within that ratio
    near = np.minimum(a.sizes[i], b.sizes[j]) >= threshold * np.maximum(a.sizes[i], b.sizes[j]) - 1e-9
    i, j = i[near], j[near]
    matches = np.zeros(len(i), np.int64)
    for at in range(0, VALUES, STEP):
        if not len(i):
            break
        for c in range(at, min(at + STEP, VALUES)):
            matches += a.signatures[i, c] == b.signatures[j, c]
        likely = matches >= least[min(at + STEP, VALUES)]
        i, j, matches = i[likely], j[likely], matches[likely]
    if not len(i):
        return i, j, np.zeros(0)
    # exact: number the shingles of both blocks, then read each left class's marks at the shingles of the right block
    names, flat = np.unique(np.concatenate(a.sets if own else a.sets + b.sets), return_inverse=True)
    ends = np.cumsum(a.sizes)
    left = np.split(flat[: ends[-1]], ends[:-1])
    right = flat[: ends[-1]] if own else flat[ends[-1] :]
    starts = np.cumsum(b.sizes) - b.sizes
    mark, common = np.zeros(len(names), np.int32), np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order])) + 1
    for group in np.split(order, cuts):
        ids = left[i[group[0]]]
        mark[ids] = 1
        common[group] = np.add.reduceat(mark[right], starts)[j[group]]
        mark[ids] = 0
    similarity = common / (a.sizes[i] + b.sizes[j] - common)
    linked = similarity >= threshold - 1e-12
    return i[linked], j[linked], similarity[linked]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that every position is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one (cluster, low, high) at a time, of rows sorted by these three; without them."""
    key, rows = None, []
    for batch in batches:
        for own, row in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)))):
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield key, rows


def _compare(groups: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    least = least_matches(threshold, TOLERANCE)

    def run(batches):
        for (_, low, high), rows in _groups(batches):
            left, right = ([(n, s, g) for n, b, g, s in rows if b == block] for block in (low, high))
            if not left or not right:  # members are dealt by hash: a block may have none, and then nothing to meet
                continue
            a = _Side(left)
            b = None if low == high else _Side(right)
            i, j, similarity = block_links(a, b, threshold, least)
            if not len(i):
                continue
            nodes = a.nodes if b is None else np.concatenate([a.nodes, b.nodes])
            j = j if b is None else j + len(a.nodes)
            if pairs:
                out = [pa.array(np.minimum(nodes[i], nodes[j])), pa.array(np.maximum(nodes[i], nodes[j])), pa.array(similarity)]
                yield pa.RecordBatch.from_arrays(out, names=["u", "v", "similarity"])
                continue
            number = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            at = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[_roots(len(nodes), i, j)][at]), pa.array(number[at])], names=["u", "v", "links"])
        release()

    schema = "u long, v long, similarity double" if pairs else "u long, v long, links long"
    return groups.sortWithinPartitions("cluster", "low", "high").select("cluster", "low", "high", "node", "block", "signature", "shingles").mapInArrow(run, schema)


def _candidates(groups: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) between classes of a group that no posterior rules out, enough of them to keep together what hangs together."""
    least = least_matches(threshold, TOLERANCE)

    def run(batches):
        for _, rows in _groups(batches):
            rows = sorted(set(rows))
            nodes = np.array([n for n, _ in rows], np.int64)
            root = nodes[reached(np.frombuffer(b"".join(g for _, g in rows), np.uint8).reshape(-1, VALUES), least)]
            moved = root != nodes
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], names=["u", "v"])
        release()

    return groups.sortWithinPartitions("cluster", "low", "high").select("cluster", "low", "high", "node", "signature").mapInArrow(run, "u long, v long")


def _dealt(members: DataFrame) -> DataFrame:
    """Members of a cluster, each with its block of ``n_blocks``, once for every pair of blocks that it belongs to."""
    met = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return met.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).repartition("cluster", "low", "high")


class Join:
    """The stages of the join over the rows of ``docs``; written tables cut its lineage."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: dict[str, Column] | None = None):
        self.threshold, self.shingle, self.carry = threshold, shingle, list(carry or {})
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

        def sign(texts):
            sets = shingle_sets(texts, shingle)
            keys = pa.array([class_key(s) if len(s) else None for s in sets], pa.binary())
            values = [min_hashes(s) if len(s) else None for s in sets]
            bands = pa.array([None if v is None else band_keys(v) for v in values], pa.list_(pa.int64()))
            return [keys, pa.array([len(s) for s in sets], pa.int32()), bands, pa.array([None if v is None else v.astype(np.uint8).tobytes() for v in values], pa.binary())]

        with_more = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in (carry or {}).items()))
        signed = cut_lineage(per_text(with_more, "class_key binary, size int, bands array<bigint>, signature binary", sign))
        self.signed = signed.select("doc_id", "class_key", *self.carry)
        known = signed.where("class_key is not null and doc_id is not null")
        first = [F.first(c).alias(c) for c in ("size", "bands", "signature")]
        #: a row for each class, by its 128-bit key: its least document, its rows, and a number that holds as the table is written
        self.classes = cut_lineage(known.groupBy("class_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"), *first).withColumn("node", F.monotonically_increasing_id()))

    def _clusters(self) -> DataFrame:
        """node and candidate cluster of the classes that some bucket brings together."""
        keys = self.classes.select("node", F.explode("bands").alias("key"))
        shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("low < high")
        # near copies meet in many buckets; buckets of the same members are one
        shared = shared.groupBy("low", "high", "n", "mark").agg(F.min("key").alias("key"))
        members = keys.join(shared.select("key", "n"), "key").join(self.classes.select("node", "signature"), "node")
        n_blocks = F.ceil(F.col("n") / BUCKET_CLASSES).cast("int")
        members = members.select(F.col("key").alias("cluster"), "node", "signature", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("node", "key"), n_blocks).cast("int").alias("block"))
        return components(_candidates(_dealt(members), self.threshold))

    def _block_groups(self) -> DataFrame:
        clusters = self._clusters().withColumnRenamed("component", "cluster")
        members = clusters.join(self.classes.select("node", "class_key", "least_id", "size", "signature"), "node")
        blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"), F.count("*").alias("members"))
        members = salted_join(members, blocks, "cluster", "members", self.classes.count(), "inner")
        members = members.select(F.col("least_id").alias("doc_id"), "node", "class_key", "signature", "cluster", "n_blocks", F.pmod(F.xxhash64("node", F.lit("block")), F.col("n_blocks")).cast("int").alias("block"))
        shingle = self.shingle

        def read(texts):
            sets = shingle_sets(texts, shingle)
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([class_key(s) for s in sets], pa.binary())]

        found = self.docs.join(members, "doc_id").select("node", "text", "class_key", "signature", "cluster", "n_blocks", "block")
        shingled = per_text(found, "shingles binary, own_key binary", read)
        # an id that repeats with another text brings that text along; its class is another
        return _dealt(shingled.where("own_key = class_key").drop("own_key", "class_key"))

    def pairs(self) -> DataFrame:
        """Linked classes: left and right (their least documents) and their similarity."""
        ids = self.classes.select("node", "least_id")
        found = _compare(self._block_groups(), self.threshold, True)
        found = found.join(ids.toDF("u", "left"), "u").join(ids.toDF("v", "right"), "v")
        return found.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "similarity")

    def membership(self) -> DataFrame:
        """A row for every document: doc_id, class_id (the least id of all it is linked to, directly or not), text_id
        (the least id with its very shingles), n_copies of that, n_links to other texts.

        Rows without a word are linked to nothing and are their own class; rows with a null id get the class of their
        copies, or null.
        """
        local = cut_lineage(_compare(self._block_groups(), self.threshold, False))
        links = local.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
        joined = components(local.select("u", "v"))
        ids = self.classes.select("node", "class_key", "least_id", "n_copies")
        least = joined.join(ids, "node").groupBy("component").agg(F.min("least_id").alias("class_id"))
        linked = joined.join(least, "component").join(links, "node").select("node", "class_id", "n_links")
        table = ids.join(linked, "node", "left").select("class_key", F.coalesce("class_id", "least_id").alias("class_id"), F.col("least_id").alias("text_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        # a class may hold a third of all rows
        out = salted_join(self.signed, cut_lineage(table), "class_key", "n_copies", self.signed.count())
        alone = F.col("class_key").isNull()
        return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *self.carry)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` but those linked to a document of a smaller id; of rows with one id and text one stays.

    That is the one whose columns have the least hash, so it does not depend on the order of rows. Rows with a null id
    stay unless they are copies of a row with an id; null texts are linked to nothing.
    """
    same = F.xxhash64(text_col)
    found = Join(docs, threshold, id_col, text_col, carry={"own_text": same}).membership()
    # an id may repeat with other texts: a loser is an id with its text
    losers = found.where("doc_id <> class_id or doc_id is null and class_id is not null").select(F.col("doc_id").alias("loser"), "own_text").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), same.alias("same"), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]).alias("place"))
    kept = rows.join(losers, F.col("id").eqNullSafe(F.col("loser")) & (F.col("same") == F.col("own_text")), "left_anti")
    return kept.groupBy("id", "same").agg(F.min_by("row", "place").alias("row")).select("row.*")
