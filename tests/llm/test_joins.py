"""Operators that compare documents, against brute force over all pairs; the pipeline's stages."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import PROSE, SCHEMA, TEXTS, rows
from tickloom.llm import components, ngram_join, queries, substrings
from tickloom.llm.textio import prepare

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def frame(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        if u != v:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in touched}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- Jaccard join


def brute_links(texts):
    """Shingle classes, links between their least ids, and the connected class of every id."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    classes = collections.defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[s].append(i)
    reps = sorted((min(v), k) for k, v in classes.items())
    links = {(a, b): len(x & y) / len(x | y) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1 :] if len(x & y) >= 0.8 * len(x | y)}
    parent = {i: min(classes[s]) if s else i for i, s in sets.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    number = collections.Counter(x for pair in links for x in pair)
    rep = {i: min(classes[s]) if s else i for i, s in sets.items()}
    return links, {i: (find(i), rep[i], len(classes[sets[i]]) if sets[i] else 1, number[rep[i]]) for i in sets}


def near_copies(seed, n, size=120):
    """Groups of edited copies of some texts, with unrelated ones between."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 and out:
            w = out[rng.randrange(len(out))].split() if rng.random() < 0.5 else base
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = base = [rng.choice(vocabulary) for _ in range(size + rng.randrange(60))]
        out.append(" ".join(w))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("block", [256, 7])
def test_join_against_brute_force(spark, monkeypatch, block):
    # small blocks cut the groups up, as large groups are
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    texts = near_copies(2, 90) + [(200, "a b c"), (201, "a b c"), (202, ""), (203, None), (204, "a b d")]
    links, expected = brute_links(texts)
    assert len(links) > 30
    join = ngram_join.Join(frame(spark, texts))
    assert {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.n_links) for r in join.membership().collect()} == expected
    got = {(r.left, r.right): r.similarity for r in join.pairs().collect()}
    assert got.keys() == links.keys() and all(abs(got[k] - links[k]) < 1e-9 for k in links)


def long_copies(groups, copies, size):
    """Groups of near copies of mutually different texts of ``size`` words; ids from 1."""
    out = []
    for g in range(groups):
        base = [f"g{g}x{k}" for k in range(size)]
        for c in range(copies):
            w = list(base)
            w[(c + 1) * size // (copies + 2)] = f"edit{c}"
            out.append(" ".join(w))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("groups, copies, size, most", [(12, 2, 150, 200), (6, 10, 250, 600), (1, 2, 110_000, None), (1, 10, 110_000, None)])
def test_blocks_without_a_member(spark, monkeypatch, groups, copies, size, most):
    # more blocks than members reach: few texts with more shingles than one block may have
    if most:
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", most)
    texts = long_copies(groups, copies, size)
    join = ngram_join.Join(frame(spark, texts))
    first = {i: (i - 1) // copies * copies + 1 for i, _ in texts}
    assert {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.n_links) for r in join.membership().collect()} == {i: (first[i], i, 1, copies - 1) for i in first}
    got = {(r.left, r.right) for r in join.pairs().collect()}
    assert got == {(a, b) for a in first for b in first if a < b and first[a] == first[b]}


def test_pruning_drops_only_the_unlikely():
    least = ngram_join.least_matches(0.8, 1e-7)
    assert least[0] == 0 and all(a <= b <= a + 1 for a, b in zip(least, least[1:]))
    rng = np.random.default_rng(0)
    for n in (32, 64, 160):  # a pair at the threshold is hardly ever dropped, one far below nearly always
        assert (rng.binomial(n, 0.8, 100_000) < least[n]).mean() < 1e-4
    assert (rng.binomial(160, 0.4, 10_000) < least[160]).mean() > 0.99


def test_join_on_odd_rows(messy, nothing):
    got = collections.defaultdict(list)
    for r in ngram_join.Join(messy).membership().collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    assert [got[i][0].class_id for i in (1, 2, 3, 4, 5, 8, 9)] == [1, 1, 3, 4, 5, 8, 8]
    assert got[6][0].class_id == got[13][0].class_id == 6 and got[6][0].n_links == 1  # very long near copies
    assert len(got[7]) == 2 and got[7][0].class_id == 7 and got[None][0].class_id is None
    assert ngram_join.Join(nothing).membership().count() == 0 and ngram_join.Join(nothing).pairs().count() == 0


def test_losers_are_told_by_id_and_text(spark):
    copied, clean = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    texts = [(1, copied), (2, copied), (2, clean), (None, copied), (None, "nobody else has these words"), (None, ""), (3, "another text of its own")]
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, texts)).collect())
    assert got == collections.Counter([texts[0], texts[2], *texts[4:]])


def test_one_of_each_keeps_the_columns_it_was_given(spark):
    """Columns named like the operator's own stay, and of rows with one id and text always the same one is kept."""
    from pyspark.sql import functions as F

    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "another text of its own"), (4, None)]
    df = frame(spark, texts)
    for name in ("_same", "same", "_loser", "loser", "_text", "own_text", "row", "id", "place", "_salt", "node", "class_key"):
        df = df.withColumn(name, F.col("doc_id") * 10)
    df = df.withColumn("source", F.monotonically_increasing_id().cast("string"))
    written = df.collect()
    kept = []
    for order in (1, 2, 3):
        again = spark.createDataFrame(written[order:] + written[:order], df.schema).repartition(order)
        out = ngram_join.one_of_each(again)
        assert out.columns == df.columns
        kept.append(sorted((tuple(r) for r in out.collect()), key=str))
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 3, 4] and all(r[5] == r[0] * 10 for r in kept[0])


def test_unlike_texts_do_not_chain(spark):
    """Texts that share half of their words have no link; hardly any is read a second time for them."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    texts = [(i, " ".join(shared + [f"t{i}x{rng.randrange(10**6)}" for _ in range(60)])) for i in range(2000)]
    join = ngram_join.Join(frame(spark, texts))
    assert join._block_groups().count() <= 2 * len(texts)
    assert {(r.class_id == r.doc_id, r.n_links) for r in join.membership().collect()} == {(True, 0)}


def test_walk_reaches_what_hangs_together():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (6, ngram_join.VALUES), dtype=np.uint8)
    rows = np.repeat(base, 30, axis=0)
    hit = rng.random(rows.shape) < 0.08
    rows[hit] = rng.integers(0, 256, int(hit.sum()), dtype=np.uint8)
    order = rng.permutation(len(rows))
    root = ngram_join.reached(rows[order], ngram_join.least_matches(0.8, 1e-7))
    groups = order // 30
    assert all((root[i] == root[j]) == (groups[i] == groups[j]) for i in range(180) for j in range(i))


# ---------------------------------------------------------------- repeated passages


def brute_repeats(texts, length):
    first = {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("vocabulary, length, k", [(2, 13, 5), (3, 6, 3), (4, 5, 2), (30, 4, 4)])
def test_repeats_against_brute_force(spark, vocabulary, length, k):
    rng = random.Random(vocabulary)
    texts = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüß"[:vocabulary], k=rng.randrange(0, 40)))) for i in rng.sample(range(-50, 1000), 80)]
    passage = " ".join(rng.choices("xyz", k=30))
    texts += [(2000 + i, f"{i} {passage} {texts[i][1]} {i}") for i in range(20)]

    def finish(_, w, covered):
        return len(w), int(covered.sum()), hashlib.sha256(b" ".join(substrings._kept(w, covered))).hexdigest()

    got = substrings.remove_repeats(frame(spark, texts), finish, "n_words long, n_removed long, kept_sha256 string", length=length, k=k)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats(texts, length)


def test_reducers_follow_the_text_and_hot_anchors_are_spread(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(substrings, "REDUCER_BYTES", 4000)
    monkeypatch.setattr(substrings, "HOT", 16)  # every document is in the sample
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [(i, " ".join(rng.choices("abcdefgh", k=60)) + f" {passage} " + " ".join(rng.choices("abcdefgh", k=60))) for i in rng.sample(range(1000), 120)] + [(5000, passage), (5000, passage)]
    docs = frame(spark, texts)
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS key")
    reducers, hot = substrings._reducers(rows), substrings._hot(rows, 13, 5)
    assert reducers == -(-sum(len(t) for _, t in texts) // 4000) and len(hot) >= 4
    blocks = substrings._dealt(substrings._anchor_blocks(rows, reducers, hot, 13, 5), reducers).selectExpr("*", "spark_partition_id() AS place").collect()
    assert all(r.place == r.reducer for r in blocks) and len({r.place for r in blocks}) == reducers
    places = collections.defaultdict(set)
    for r in blocks:
        if r.block == substrings.BY_CONTEXT:
            for x in np.frombuffer(r["hash"], np.uint64).tolist():
                places[x].add(r.place)
    assert places.keys() <= set(hot.tolist()) and max(map(len, places.values())) > reducers // 2
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect())
    assert got == brute_repeats(texts, 13)


@pytest.mark.parametrize("vocabulary, length, k", [(2, 13, 5), (3, 6, 3), (4, 5, 2)])
def test_repeats_with_hot_anchors(spark, monkeypatch, vocabulary, length, k):
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "HITS", 2)
    monkeypatch.setattr(substrings, "REDUCER_BYTES", 700)
    test_repeats_against_brute_force(spark, vocabulary, length, k)


def test_repeats_on_odd_rows(messy, nothing):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(messy).collect())
    assert got == brute_repeats(TEXTS, 13)
    assert substrings.digests(nothing).count() == 0
    cleaned = {r.doc_id: r for r in substrings.cleaned(messy).collect()}
    assert cleaned[3].cleaned is None and cleaned[5].cleaned == TEXTS[4][1] and cleaned[2].cleaned == "" and cleaned[13].n_removed == 80_000


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def staged(spark, messy, tmp_path_factory):
    """What every stage gets and gives, over the odd rows with further columns."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), messy, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{folder}/{name}")
        out[name] = (docs, spark.read.parquet(f"{folder}/{name}"))
        docs = out[name][1]
    return out


def test_stages_keep_the_columns(staged):
    for name, (before, after) in staged.items():
        if name != "packing":
            assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packing"]


def test_stages_decide(staged):
    ids = {name: sorted((r.doc_id for r in after.collect()), key=str) for name, (_, after) in staged.items()}
    assert not {3, 4, 5} & set(ids["language"]) and {1, 2, 6, 7} <= set(ids["language"])
    assert set(ids["near_duplicates"]) == {None, 1, 6, 7, 8, 10, 11, 12, 14} & set(ids["language"]) and ids["near_duplicates"].count(7) == 1
    text = {r.doc_id: r for r in staged["personal_data"][1].collect()}
    assert "bob.42" not in text[1].text and text[6].text == dict(TEXTS)[6] and all(r.n_chars == len(r.text) for r in text.values())
    assert {r.doc_id for r in staged["packing"][1].collect()} == set(text)


def test_cut_keeps_the_lines():
    covered = np.array([False, True, True, False, False, True, False])
    assert substrings._cut(b" a b\n c d  e\tf g ", covered) == b"a\nd  e g"
    assert substrings._cut(b"a b", np.array([True, True])) == b"" and substrings._cut(b" a b\n", np.array([False, False])) == b"a b"


def test_passages_leave_the_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = frame(spark, [(1, f"{PROSE}{passage}"), (2, f"another beginning {passage} and an end"), (3, passage), (4, PROSE.replace("fox", "cat"))])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, None).collect()}
    assert got == {1: f"{PROSE}{passage}", 2: "another beginning and an end", 4: got[4]} and got[4].startswith("The quick brown cat")


def test_every_query_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, query in {**queries.QUERIES, **corpus_pipeline.QUERIES}.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_over_a_table(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    spaces = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert 0 < len(spaces) and all(r[1] <= 4096 for r in spaces)


def test_rows_are_what_the_fixture_says():
    assert len(rows()) == len(TEXTS)
