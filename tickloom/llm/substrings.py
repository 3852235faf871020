"""Repeated passages removed exactly: seeds on winnowed anchors, extended both ways.

A window is LENGTH consecutive words. It repeats where its words also start in a document of a smaller id; the words
of all such windows form maximal repeats of at least LENGTH words and are removed.

Anchors are K-word runs chosen by winnowing: of every LENGTH - K + 1 successive runs the one with the least hash
(the last of equals), so any repeated window has the same anchor, at the same place, wherever it stands. The context
of an anchor is the anchor with the LENGTH - K words on either side. It takes three joins:

1. Anchors meet on their hash, in packed blocks; the few hot ones meet on their context, and the least document of each
   context then on the hash, summed up before it is sent. Each batch of documents first combines its own: of equal contexts
   only the least document is sent. Where an earlier document has the same whole context, every window of the anchor
   repeats; where only the anchor is shared, the seed is left to be extended.
2. Seeds of the second kind are extended word by word within the context: each of their windows is looked up by its
   hash among the windows of the anchor's distinct contexts, with the least document of each.
3. The marks meet the texts; overlapping windows grow together into maximal repeats.

Nothing is compared pair by pair, and a passage in every document costs one row for each batch of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textio import carried, column_names, grams, hash_words, mix, pieces, release, split_words, Words
from tickloom.session import cut_lineage

LENGTH, K = 13, 5
#: bytes of text for one reducer; anchors of about so many rows or more are dealt by their contexts, as told by so many hits in a sample
REDUCER_BYTES, HOT, HITS = 16 << 20, 1 << 16, 16
_R = np.uint64(0x9E3779B97F4A7C15)


def anchors(w: Words, h: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Word positions of the anchors of all texts with ``length`` words or more, in ascending order."""
    span = length - k + 1
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = grams(h, k)
    best, at = g[span - 1 : span - 1 + n].copy(), np.full(n, span - 1)
    for j in range(span - 2, -1, -1):  # from the right: the last of equals stays
        smaller = g[j : j + n] < best
        best[smaller] = g[j : j + n][smaller]
        at[smaller] = j
    inside = np.flatnonzero(w.doc[:n] == w.doc[length - 1 :])
    return np.unique(inside + at[inside])


def contexts(w: Words, h: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Hash of each anchor's context; beyond a text's ends stands a mark of its own."""
    out = np.zeros(len(at), np.uint64)
    first, last = w.first[w.doc[at]], w.first[w.doc[at] + 1]
    for j in range(k - length, length):
        p = at + j
        inside = (p >= first) & (p < last)
        out = mix(out * _R + np.where(inside, h[np.clip(p, 0, max(len(h) - 1, 0))], np.uint64(1)))
    return out


def _reducers(docs: DataFrame) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // REDUCER_BYTES))


def _hot(docs: DataFrame, length: int, k: int) -> np.ndarray:
    """Hashes of the anchors that HOT rows or more have, as a sample of the documents tells; they decide where rows meet, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches):
            w = split_words(texts)
            h = hash_words(w)
            at = anchors(w, h, length, k)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(grams(h, k)[at].view(np.int64))], names=["hash"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, HOT // HITS))) == 0).select("doc_id", "text")
    found = sample.mapInArrow(run, "hash long").groupBy("hash").count().where(F.col("count") >= HITS)
    return np.sort(np.array([r.hash for r in found.select("hash").collect()], np.int64).view(np.uint64))


#: blocks: anchors dealt by hash; by hash and context; those that are marks already
PLAIN, BY_CONTEXT, MARKED = 0, 1, 2


def _anchor_blocks(docs: DataFrame, reducers: int, hot: np.ndarray, length: int, k: int) -> DataFrame:
    """Packed anchors by reducer. An anchor whose context an earlier document of its batch has is marked at once."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches):
            ids, keys = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("doc_id", "key"))
            w = split_words(texts)
            h = hash_words(w)
            at = anchors(w, h, length, k)
            if not len(at):
                continue
            doc = w.doc[at]
            hashes, context = grams(h, k)[at], contexts(w, h, at, length, k)
            order = np.lexsort((ids[doc], context, hashes))
            again = np.zeros(len(at), bool)
            a, b = order[:-1], order[1:]
            again[b] = (hashes[a] == hashes[b]) & (context[a] == context[b])
            # the least document of equal contexts in this batch
            group = np.cumsum(~again[order]) - 1
            head = order[np.flatnonzero(~again[order])]
            least = np.empty(len(at), np.int64)
            least[order] = ids[doc[head]][group]
            marked = least < ids[doc]
            sent = ~marked
            pos = (at - w.first[doc]).astype(np.int32)
            spread = np.isin(hashes, hot)
            bucket = (np.where(spread, mix(hashes * _R + context), hashes) >> np.uint64(33)) % np.uint64(reducers)
            block = bucket * np.uint64(2) + spread
            turn = np.flatnonzero(sent)[np.argsort(block[sent], kind="stable")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block[turn])) + 1, [len(turn)]])
            rows = [(int(bucket[turn[a]]), BY_CONTEXT if spread[turn[a]] else PLAIN, turn[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            # marks ride along with any reducer
            own = np.flatnonzero(marked)
            if len(own):
                rows.append((int(mix(keys[:1].view(np.uint64) ^ ids[:1].view(np.uint64))[0] % np.uint64(reducers)), MARKED, own))
            out = [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([x for _, x, _ in rows], pa.int8())]
            for values in (hashes, context, ids[doc], keys[doc], pos):
                out.append(pa.array([values[x].tobytes() for _, _, x in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["reducer", "block", "hash", "context", "doc", "dkey", "pos"])

    return docs.mapInArrow(run, "reducer int, block byte, hash binary, context binary, doc binary, dkey binary, pos binary")


#: kinds of marks: all windows of the anchor repeat; its windows must be looked up; its windows are looked up by others; one of the last two, if any
REPEATS, SEEDS, SOURCES, UNTOLD = 0, 1, 2, 3


def _dealt(blocks: DataFrame, reducers: int) -> DataFrame:
    """Every reducer's blocks in a partition of its own."""
    return blocks.repartitionById(reducers, F.col("reducer"))


def _told(found: list[np.ndarray], whole: bool) -> list[np.ndarray]:
    """doc, key, pos, kind, hash and context of the anchors that matter; ``whole``: all rows of a hash are here, not only of a context."""
    h, c, doc, key, pos = found
    order = np.lexsort((doc, c, h))
    h, c, doc, key, pos = (x[order] for x in (h, c, doc, key, pos))
    new_hash = np.concatenate([[True], h[1:] != h[:-1]])
    new_context = new_hash | np.concatenate([[True], c[1:] != c[:-1]])
    by_hash, by_context = np.flatnonzero(new_hash), np.flatnonzero(new_context)
    least_same = doc[by_context][np.cumsum(new_context) - 1]
    repeats = least_same < doc
    if not whole:
        return [doc, key, pos, np.where(repeats, REPEATS, UNTOLD), h, c]
    group = np.cumsum(new_hash) - 1
    least, most = np.minimum.reduceat(doc, by_hash)[group], np.maximum.reduceat(doc, by_hash)[group]
    # several contexts: the first document of each is a source, and a seed if an earlier document has the anchor
    several = (np.diff(np.append(np.searchsorted(by_context, by_hash), len(by_context))) > 1)[group]
    open_ = several & ~repeats & (least < most)
    kind = np.where(repeats, REPEATS, np.where(least < doc, SEEDS, SOURCES))
    told = repeats | open_
    return [x[told] for x in (doc, key, pos, kind, h, c)]


def _marks(blocks: DataFrame, reducers: int, hot: bool) -> DataFrame:
    """(doc_id, dkey, pos, kind) of the anchors that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts: dict[int, list[list[np.ndarray]]] = {PLAIN: [], BY_CONTEXT: []}
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32)

        def rows(doc, key, pos, kind, h, c):
            for i in range(0, len(doc), 65536):
                s = slice(i, i + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(key[s]), pa.array(pos[s]), pa.array(kind[s], pa.int8()), *((pa.array(x[s].view(np.int64)) for x in (h, c)) if hot else ())], names=["doc_id", "dkey", "pos", "kind", *(("hash", "context") if hot else ())])

        for batch in batches:
            for block, *blobs in zip(*(batch.column(c).to_pylist() for c in ("block", "hash", "context", "doc", "dkey", "pos"))):
                own = [np.frombuffer(x, t) for x, t in zip(blobs, kinds)]
                if block == MARKED:
                    yield from rows(own[2], own[3], own[4], np.full(len(own[2]), REPEATS), own[0], own[1])
                else:
                    parts[block].append(own)
        for block in (PLAIN, BY_CONTEXT):
            if own := parts.pop(block):
                found = [np.concatenate(x) for x in zip(*own)]
                del own
                yield from rows(*_told(found, block == PLAIN))
                del found
        release()

    found = _dealt(blocks, reducers).select("block", "hash", "context", "doc", "dkey", "pos").mapInArrow(run, "doc_id long, dkey long, pos int, kind byte" + ", hash long, context long" * hot)
    if not hot:
        return found
    found = cut_lineage(found)
    untold = found.where(F.col("kind") == UNTOLD)
    # one row for each hot hash
    open_ = untold.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("context").alias("one"), F.max("context").alias("other")).where("one < other and least < most").select("hash", "least")
    decided = untold.join(F.broadcast(open_), "hash").select("doc_id", "dkey", "pos", F.when(F.col("least") < F.col("doc_id"), SEEDS).otherwise(SOURCES).cast("byte").alias("kind"))
    return found.where(F.col("kind") != UNTOLD).select("doc_id", "dkey", "pos", "kind").unionByName(decided)


def _windows(found: DataFrame, length: int, k: int) -> DataFrame:
    """(window hash, doc_id, dkey, first word, is a seed's) of the windows of seeds and sources, by texts with their positions."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches):
            ids, keys = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("doc_id", "dkey"))
            w = split_words(texts)
            h = hash_words(w)
            wide = grams(h, length)
            out = [[] for _ in range(5)]
            for i, (seeds, sources) in enumerate(zip(batch.column("seeds").to_pylist(), batch.column("sources").to_pylist())):
                a, b = w.first[i], w.first[i + 1]
                for positions, is_seed in ((seeds, True), (sources, False)):
                    if positions:
                        p = (np.array(positions, np.int64)[:, None] + np.arange(k - length, 1)).ravel() + a
                        p = np.unique(p[(p >= a) & (p <= b - length)])
                        for column, values in zip(out, (wide[p].view(np.int64), np.full(len(p), ids[i]), np.full(len(p), keys[i]), (p - a).astype(np.int32), np.full(len(p), is_seed))):
                            column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["window", "doc_id", "dkey", "first", "seed"])

    return found.select("doc_id", "text", "dkey", "seeds", "sources").mapInArrow(run, "window long, doc_id long, dkey long, first int, seed boolean")


def _covered(n: int, repeats: list | None, first: list | None, length: int, k: int) -> np.ndarray:
    """Words inside repeated windows: whole contexts of anchors, and single windows by their first word."""
    step = np.zeros(n + 1, np.int64)
    if repeats:
        p = np.array(repeats, np.int64)
        np.add.at(step, np.maximum(p - (length - k), 0), 1)
        np.add.at(step, np.minimum(p + length, n), -1)
    if first:
        p = np.array(first, np.int64)
        np.add.at(step, p, 1)
        np.add.at(step, p + length, -1)
    return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, key) of every row, and by (doc_id, dkey) the anchors that repeat as a whole and the first words of further windows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    # rows without an id have no order among the others: they neither lose words nor cost others any
    known = rows.where("doc_id is not null and text is not null")
    reducers, hot = _reducers(known), _hot(known, length, k)
    marks = _marks(_anchor_blocks(known, reducers, hot, length, k), reducers, len(hot) > 0)
    at = marks.groupBy("doc_id", "dkey").agg(*(F.collect_set(F.when(F.col("kind") == kind, F.col("pos"))).alias(name) for name, kind in (("repeats", REPEATS), ("seeds", SEEDS), ("sources", SOURCES))))
    return rows, at


def remove_repeats(docs: DataFrame, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, carry: list[str] | None = None) -> DataFrame:
    """For every row doc_id, what ``finish(text, words, covered)`` returns as ``schema`` and, where asked for, the struct of ``carry``; repeated rows stay, each with the same result."""
    rows, at = repeats(docs, id_col, text_col, length, k)
    at = cut_lineage(at)
    known = rows.where("doc_id is not null and text is not null").withColumnRenamed("key", "dkey")
    looked_up = at.where((F.size("seeds") > 0) | (F.size("sources") > 0))
    # a repeated row brings its windows twice, with the same ids and places
    windows = _windows(known.join(looked_up, ["doc_id", "dkey"]), length, k)
    windows = cut_lineage(windows)
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "least")
    further = windows.where("seed").join(least, "window").where("least < doc_id").groupBy("doc_id", "dkey").agg(F.collect_set("first").alias("first"))
    marked = at.where(F.size("repeats") > 0).select("doc_id", "dkey", "repeats").join(further, ["doc_id", "dkey"], "full")
    marked = marked.select(F.col("doc_id").alias("_id"), F.col("dkey").alias("_key"), "repeats", "first")
    types = [{"long": pa.int64(), "string": pa.string()}[c.strip().split(" ")[1]] for c in schema.split(",")]
    all_rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"), carried(carry or []))
    all_rows = all_rows.join(marked, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "carried", "repeats", "first")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in pieces(batches):
            out = []
            for text, own, first in zip(texts, batch.column("repeats").to_pylist(), batch.column("first").to_pylist()):
                words = (text or b"").split()  # on bytes: the separators of words
                out.append(finish(text, words, _covered(len(words), own, first, length, k)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), *columns], names=["doc_id", "carried", *column_names(schema)])

    kind = docs.schema[id_col].dataType.simpleString()
    done = all_rows.mapInArrow(run, f"doc_id {kind}, carried {all_rows.schema['carried'].dataType.simpleString()}, {schema}")
    return done if carry is not None else done.drop("carried")


def _kept(words: list[bytes], covered: np.ndarray) -> list[bytes]:
    return [x for x, gone in zip(words, covered.tolist()) if not gone] if covered.any() else words


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: bytes, covered: np.ndarray) -> bytes:
    """The text without its covered words: runs of kept words as they stand, with a line feed between them where one was removed, else a space."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept = np.flatnonzero(~covered).tolist()
    out, last = [], None
    for i in kept:
        if last is not None and i != last + 1:
            gap = b"\n" if b"\n" in text[at[last][1] : at[i][0]] else b" "
            out += [text[begin : at[last][1]], gap]
        if last is None or i != last + 1:
            begin = at[i][0]
        last = i
    return b"".join(out) + (text[begin : at[last][1]] if kept else b"")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; a null text has no words."""

    def finish(_, words, covered):
        kept = _kept(words, covered)
        return len(words), int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    return remove_repeats(docs, finish, "n_words long, n_removed long, kept_sha256 string", id_col, text_col, length)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the struct of ``carry`` if given, n_removed and the text without its repeats; unchanged (null: null) where it has none."""

    def finish(text, words, covered):
        gone = int(covered.sum())
        kept = _cut(text, covered) if gone else text
        return gone, None if kept is None else kept.decode("utf-8", "replace")

    return remove_repeats(docs, finish, "n_removed long, cleaned string", id_col, text_col, length, carry=carry)
