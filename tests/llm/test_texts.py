"""Operators that read one text at a time, against libraries, plain Python or a round trip."""

import collections
import hashlib
import datetime
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from tickloom.llm import byte_bpe, language, media, packing, pii, quality_rules, queries, rule_ensemble, token_counts
from tickloom.llm.textio import prepare

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=lambda r: (r[0] is None, str(r)))


def want(fn):
    return sorted(((i, *fn(t)) for i, t in TEXTS), key=lambda r: (r[0] is None, str(r)))


# ---------------------------------------------------------------- counts and encodings


def test_token_counts(messy, nothing):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)

    def expected(t):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        return len((t or "").encode()), n, n > 2048

    got = token_counts.token_counts(messy, queries.WORD_TOKENIZER)
    assert by_id(got, "n_bytes", "n_tokens", "over_limit") == want(expected)
    assert token_counts.token_counts(nothing, queries.WORD_TOKENIZER).count() == 0


def test_cache_starts_over():
    cache = token_counts.Cache(len, 3, {b"the": 7})
    assert [cache[k] for k in (b"a", b"bb", b"ccc", b"dddd", b"the", b"bb")] == [1, 2, 3, 4, 7, 2]
    assert len(cache) <= 5


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(queries.BYTE_RANKS, public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(codec):
    table = codec.table
    assert sorted(table.values) == sorted(codec.ranks.values()) and len(table.keys) == len(codec.ranks)
    assert all(table.get(k) == v for k, v in codec.ranks.items())
    assert table.get(b"no such entry in the vocabulary") is None


def test_byte_bpe(messy, nothing, codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})

    def expected(t):
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())

    got = byte_bpe.round_trip(messy, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert by_id(got, "n_tokens", "ids_sha256", "decoded_sha256") == want(expected)
    encoded = byte_bpe.encode(messy, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in decoded.collect()) == collections.Counter((i, (t or "").encode()) for i, t in TEXTS)
    assert byte_bpe.round_trip(nothing, queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_short_pieces_merge_as_long_ones_do(codec, monkeypatch):
    pieces = [b"", b"a", b"aaaa", b"internationalisation", "éèê ñandú".encode(), bytes(range(256))[100:148], b"ab" * 24, b"\xff\xfe the"]
    short = [byte_bpe._merge_short(p, codec.ranks) for p in pieces]
    monkeypatch.setattr(byte_bpe, "SHORT", -1)
    assert short == [byte_bpe.merge(p, codec.ranks) for p in pieces]


def test_merge_against_library(codec):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    marks = ["a", "B", "é", "the", "er", "'s", "'", "́", " ", "\n", " ", "\x1c", "\x85", "1", "Σ", "漢", "…", "!", "😀", "re", "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(marks, rng.integers(0, 20)))
        ids = codec.encode(text)
        assert ids == ",".join(map(str, library.encode_ordinary(text))) and codec.decode(ids) == text.encode()


# ---------------------------------------------------------------- packing


def test_packing(messy, nothing):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    got = packing.pack_documents(messy, queries.WORD_TOKENIZER, capacity=64, open_bins=4).collect()
    ids = collections.defaultdict(list)
    for i, t in TEXTS:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    expected = sorted((str(i), p, 64 * p, len(own[64 * p : 64 * p + 64]), zlib.crc32(np.array(own[64 * p : 64 * p + 64], "<u4").tobytes())) for i, all_ in ids.items() for own in all_ for p in range(-(-len(own) // 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in map(sorted, bins.values()):
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert packing.pack_documents(nothing, queries.WORD_TOKENIZER).count() == 0


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(5)
    for limit in (1, 3, 50):
        fit, free = packing.BestFit(100, limit), {}
        made = 0
        for length in rng.integers(1, 101, 400).tolist():
            number, offset = fit.place(length)
            spaces = [s for s in free.values() if s >= length]
            if spaces:
                assert free[number] == min(spaces) and offset == 100 - min(spaces)
            else:
                if len(free) == limit:
                    fullest = min(free.values())
                    gone = fit_closed(free, fullest, fit)
                    del free[gone]
                assert number == made and offset == 0
                made += 1
                free[number] = 100
            free[number] -= length
            if not free[number]:
                del free[number]
            assert fit.open == len(free) <= limit


def fit_closed(free, space, fit):
    """The bin of that space that is no longer open."""
    still = {n for own in fit.bins for n in own}
    return next(n for n, s in free.items() if s == space and n not in still)


def test_packing_is_near_the_bound(spark):
    got = queries.op6_best_fit_packing(spark, SF)
    n, total = got.select("sequence_id").distinct().count(), got.agg({"length": "sum"}).first()[0]
    assert n <= 1.05 * -(-total // 4096) + 1


# ---------------------------------------------------------------- media


def test_media_round_trip(messy, nothing):
    def expected(t):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])

    stored = media.store(messy)
    got = media.digests(stored)
    assert by_id(got, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want(expected)
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in got.collect():
        if r.doc_id != 7:
            assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
    one, two = (r.feature for r in got.where("doc_id in (1, 2)").collect())
    assert one == two
    assert media.digests(media.store(nothing)).count() == 0
    clips = media.clips(stored).where("doc_id = 6").orderBy("clip").collect()
    assert clips[0].start_ms == 0 and all(a.end_ms == b.start_ms for a, b in zip(clips, clips[1:]))
    assert clips[-1].end_ms == 40 * len(media.read_avi(files[6]).frames)


def test_general_decoder_agrees_and_every_byte_survives():
    data = bytes(range(256)) * 48
    file = media.write_avi(media.padded(data))
    frames = media.parse_frames(media.read_avi(file).frames)
    for j, blocks in zip(frames, media.coefficients(frames)):
        assert (media._general(j, media._parts(j)) == blocks).all()
    assert media.decode(file).payload == media.padded(data)


def test_general_decoder_on_a_coded_scan():
    # grey, 8 x 8: DC category 2 (value 3), run of one zero then -1, end of block
    dc, ac = bytes([0x00, 0, 1, *[0] * 14, 2]), bytes([0x10, 0, 2, *[0] * 14, 0x11, 0x00])
    bits = "00" + "11" + "00" + "0" + "01"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    jpeg = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([2]) * 64) + media._segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0])) + media._segment(0xC4, dc + ac) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    j = media.parse_jpeg(jpeg)
    blocks = media.coefficients([j])
    assert blocks[0].tolist() == [[3, 0, -1, *[0] * 61]]
    assert media.histograms([j], blocks).sum() == pytest.approx(1)


def test_index_forms_and_broken_files(spark):
    prepare(spark)
    file = media.write_avi(bytes(range(192)) * 40)
    frames = media.read_avi(file).frames
    at = file.index(b"idx1")
    assert media.read_avi(file[:at]).frames == frames  # no index: in file order
    movi = file.index(b"movi")
    entries = [struct.unpack_from("<4sIII", file, at + 8 + 16 * i) for i in range(len(frames))]
    absolute = file[: at + 8] + b"".join(struct.pack("<4sIII", n, f, o + movi, s) for n, f, o, s in entries)
    assert media.read_avi(absolute).frames == frames
    df = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None), (3, bytearray(file[:300]))], "doc_id long, media binary")
    assert media.clips(df).count() == 0


def test_shots_adapt():
    flat, other = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    noisy = np.stack([flat + 0.01 * (i % 2) for i in range(10)] + [other] * 8)
    assert [(a, b) for a, b, _ in media.shots(noisy)] == [(0, 10), (10, 18)]


# ---------------------------------------------------------------- classifiers


def test_base_counts(messy, nothing, labels):
    def expected(t):
        raw = (t or "").encode()
        w = WORD.findall(raw)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in raw.split(b"\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(len(x.decode()) for x in w), len(re.findall(rb"[#*$%&|<>]", raw)), len(lines) - len(set(lines)), len(covered), failed

    got = quality_rules.judge(messy, None)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(got, *columns) == want(expected)
    assert all(r.kept == (not r.base_failed) for r in got.collect())
    assert quality_rules.train(nothing, labels) is None
    assert quality_rules.judge(nothing, None).count() == 0
    trained = quality_rules.train(messy, labels)
    assert quality_rules.judge(messy, trained).count() == len(TEXTS)


def test_quality_model_is_calibrated_and_ranks(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [r for r in queries.op2_quality_rules(spark, sf).collect() if r.doc_id in known and held(r.doc_id) and not r.base_failed]
    y, p = np.array([known[r.doc_id] for r in rows]), np.array([r.probability for r in rows])
    assert np.mean((p >= 0.5) == y) > 0.95 and abs(p.mean() - y.mean()) < 0.05
    assert np.mean([r.kept for r, q in zip(rows, y) if q]) > 0.98


def test_rules_compile_to_what_they_say(spark, messy, nothing, labels):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = rule_ensemble.fit(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in rule_ensemble.STATISTICS))
    got = np.array([r[0] for r in frame.select(rule_ensemble.compile_rules(model)).collect()])
    margin = model.bias + sum(w * rule_ensemble._holds(x, rule) for w, rule in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and np.mean((got > 0.5) == y) > 0.97
    assert 0 < len(model.rules) < 150
    empty = rule_ensemble.train(nothing, labels)
    assert empty.rules == [] and rule_ensemble.classify(nothing, empty).count() == 0
    assert all(0 <= r.score <= 1 for r in rule_ensemble.classify(messy, rule_ensemble.train(messy, labels)).collect())


def test_rule_ensemble_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_rule_ensemble(spark, sf).collect() if r.held_out and r.doc_id in known]
    assert len(rows) > 500 and np.mean([r.predicted == known[r.doc_id] for r in rows]) > 0.97


def test_language(spark, messy, nothing):
    rows = queries.op10_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    model = language.train(messy)
    got = {r.doc_id: r for r in language.identify(messy, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0 and got[1].lang_pred == "en"
    empty = language.train(nothing)
    assert empty.languages == [] and language.identify(nothing, empty).count() == 0
    assert {r.lang_pred for r in language.identify(messy, empty).collect()} == {"und"}


# ---------------------------------------------------------------- personal data


def test_permutations_are_bijections():
    f = pii.Feistel(b"key")
    for n in (1, 2, 3, 10, 97, 1000):
        moved = [f.permute(i, n, b"t") for i in range(n)]
        assert sorted(moved) == list(range(n)) and [f.restore(m, n, b"t") for m in moved] == list(range(n))


@pytest.mark.parametrize("text, kind", [
    ("card 4041894974608795.", "card"), ("4041 8949 7460 8795", "card"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"),
    ("ssn 123-45-6789", "ssn"), ("+1 (017) 555-7713%%%", "phone"), ("(212) 555-0187", "phone"), ("at 42.144.35.254.", "ip"), ("on 1987-03-12", "date"),
    ("12.3.1987", "date"), ("25/03/1987", "date"), ("03/25/1987", "date"), ("a Bob.x_42@mail8.example.com b", "email"), ('token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "secret"),
])
def test_values_move_within_their_format(text, kind):
    new, found = pii.Pseudonyms(b"k").replace(text)
    assert [f[0] for f in found] == [kind] and new != text
    again, refound = pii.Pseudonyms(b"k").replace(new)
    assert [f[0] for f in refound] == [kind] and again != new  # still valid
    if kind not in ("ip", "date", "email", "secret"):
        assert re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", new)) == re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", text))
    assert pii.Pseudonyms(b"k", undo=True).replace(new)[0] == text


@pytest.mark.parametrize("form", ["{d}.{m}.{y}", "{d:02d}.{m:02d}.{y}", "{d}.{m:02d}.{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}", "{y}-{m}-{d}", "{y}-{m:02d}-{d:02d}", "{y}/{m}/{d:02d}"])
def test_dates_keep_their_form(form):
    """Every number of a date keeps its count of digits, and every pseudonym leads back."""
    forward, back, seen = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True), {}
    for day in range(0, 9000, 37):
        date = datetime.date(1987, 1, 1) + datetime.timedelta(day)
        text = form.format(d=date.day, m=date.month, y=date.year)
        new, found = forward.replace(text)
        assert [f[0] for f in found] == ["date"] and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", text)
        assert back.replace(new)[0] == text
        seen[text] = new
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("text", ["4041894974608796", "3.0. 4.0. v1.2.3.4.5", "999.1.1.1", "000-12-3456", "1987-02-30", "DE89 3704 0044 0532 0130 01", "a@b", "no value at all"])
def test_other_values_stay(text):
    assert pii.Pseudonyms(b"k").replace(text) == (text, [])


@pytest.mark.parametrize("value, kind", [
    ("+1 (826) 555-4081", "phone"), ("+1 826 555 4081", "phone"), ("+44 20 7946 0958", "phone"), ("+33 12 34 56 78", "phone"),
    ("BE68 5390 0754 7034", "iban"), ("BE68539007547034", "iban"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("NO93 8601 1117 947", "iban"),
])
def test_values_end_where_others_begin(value, kind):
    alone = pii.Pseudonyms(b"k").replace(value)[0]
    assert alone != value
    for tail, kinds in ((" 190.137.223.204", ["ip"]), (" 4041 8949 7460 8795", ["card"]), (" 1987-03-12", ["date"]), (" 25/03/1987", ["date"]), (" 078-05-1120", ["ssn"]), (" AND", []), (" AND SO ON", []), (" IBAN 42", []), (" 42", []), (" 2021", []), (" bob@mail8.example.com", ["email"]), (f" {value}", [kind])):
        if tail in (" 42", " 2021") and value[:3] in ("+44", "+33"):
            continue  # whether a short number belongs to the value cannot be told there
        new, found = pii.Pseudonyms(b"k").replace(f"x {value}{tail}")
        assert new.startswith(f"x {alone} ") and [f[0] for f in found] == [kind, *kinds], (tail, new)
        assert pii.Pseudonyms(b"k", undo=True).replace(new)[0] == f"x {value}{tail}"
        if not kinds:
            assert new == f"x {alone}{tail}"


def test_a_value_behind_what_is_none():
    alone = pii.Pseudonyms(b"k").replace("BE68 5390 0754 7034")[0]
    assert pii.Pseudonyms(b"k").replace("AB12 BE68 5390 0754 7034 AND")[0] == f"AB12 {alone} AND"
    # too many digits for a phone as a whole, and a card that must stay whole
    new, found = pii.Pseudonyms(b"k").replace("+44 4539 1488 0343 6467")
    assert [f[0] for f in found] == ["card"]


def test_pseudonyms_link_documents_and_can_be_undone(messy, nothing):
    new = pii.pseudonymise(messy, b"k")
    got = {r.doc_id: r for r in new.collect()}
    assert got[1].text == got[2].text != dict(TEXTS)[1] and got[1].n_found == 4
    assert not re.search("555-7713|bob.42|42.144.35.254|4539 1488 0343 6467", got[1].text)
    assert [got[1].text[f.start : f.end] for f in got[1].found if f.kind == "email"][0].endswith("@mail8.example.com")
    assert got[3].text is None and got[4].text == "" and got[6].text == dict(TEXTS)[6]
    back = {r.doc_id: r.text for r in pii.pseudonymise(new, b"k", undo=True).collect()}
    assert back[1] == dict(TEXTS)[1]
    assert pii.pseudonymise(nothing).count() == 0


def test_rules_where_nothing_tells_the_rows_apart(spark):
    """Labelled rows of both classes with equal statistics leave the share of the class alone."""
    from pyspark.sql import functions as F

    for text in ("the same words in every text", ""):
        docs = prepare(spark).range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
        model = rule_ensemble.train(docs, marks)
        assert model.rules == []
        assert {r.score for r in rule_ensemble.classify(docs, model).select(F.round("score", 1).alias("score")).collect()} == {0.5}


def test_six_hundred_languages(spark):
    """Every language is learned and told, however many there are."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(0x400 + i)}" for i in range(600)]
    rows = [(k * 600 + i, f"{w} {w}{w} {w}", f"l{i:03d}") for k in range(4) for i, w in enumerate(words)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) >= 590
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    known = set(model.languages)
    assert sum(r.lang_pred == r.lang for r in got) > 0.97 * sum(r.lang in known for r in got)
