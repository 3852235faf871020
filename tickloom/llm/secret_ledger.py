"""Secrets in texts, through an incremental ledger of scanned contents.

Every version of every text is addressed by the SHA-256 of its content (its blob). The ledger is a table in a shared
folder with a row for each blob and scan: the rule versions applied and what they found. A run groups the texts by
address (copies meet on the map side), subtracts the pairs of blob and rule version that the ledger already has, scans
what is left, appends it, and joins the findings back to all rows that hold the content. A rule whose version changes
is scanned anew; the others are not.

Shuffled are each unlike text once, and 32 bytes for each row. A content that many rows share is dealt over as many
salts as its share of the rows asks for; the list of such contents has at most ``HOT`` rows by its definition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.textio import carried, pieces

#: a content held by more than one in HOT of all rows is salted
HOT = 4096
SCHEMA = "blob binary, rules array<string>, found array<struct<rule: string, start: long, end: long>>"


class Rule(NamedTuple):
    """Matches of ``pattern`` in UTF-8, of which ``group`` has at least ``least`` characters.

    A text that has none of ``hints`` in lower case has no match.
    """

    kind: str
    version: str
    pattern: bytes
    group: int = 0
    least: int = 0
    hints: tuple[bytes, ...] = ()
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds.
BASE = (
    Rule("assign", "1", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), True),
    Rule("access", "1", rb"AKIA[A-Z0-9]+", 0, 20, (b"akia",)),
    # a run is taken whole, so one of 24 and more is found as such
    Rule("hex", "1", rb"[0-9a-f]{24,}", 0, 24),
)
#: public token formats beside them
MORE = (
    Rule("pem", "1", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", hints=(b"private key-----",)),
    Rule("jwt", "1", rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=(b"eyj",)),
    Rule("hub", "1", rb"gh[pousr]_[A-Za-z0-9]{36,}", hints=(b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
)
RULES = BASE + MORE


class Scanner:
    """Spans, in code points, that some of the rules find in a text."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = {r.name: (r, re.compile(r.pattern, re.IGNORECASE if r.any_case else 0)) for r in rules}

    def scan(self, text: bytes, names: Sequence[str]) -> list[dict]:
        lower, found = text.lower(), []
        for name in names:
            rule, pattern = self.rules[name]
            if rule.hints and not any(h in lower for h in rule.hints):
                continue
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append({"rule": name, "start": m.start(), "end": m.end()})
        if found and not text.isascii():
            at = characters_before(text, sorted({f[side] for f in found for side in ("start", "end")}))
            for f in found:
                f["start"], f["end"] = at[f["start"]], at[f["end"]]
        return found


def characters_before(text: bytes, positions: Sequence[int], step: int = 1 << 20) -> dict[int, int]:
    """Characters of the UTF-8 text that begin before each of some rising positions, counted ``step`` bytes at a time."""
    data, out, last, n = np.frombuffer(text, np.uint8), {}, 0, 0
    for p in positions:
        while last < p:
            to = min(p, last + step)
            n += int(np.count_nonzero((data[last:to] & 0xC0) != 0x80))
            last = to
        out[p] = n
    return out


class Ledger:
    """What has been scanned; ``folder`` is shared by all executors and kept between runs."""

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES):
        if len({r.kind for r in rules}) != len(rules):
            raise ValueError("one rule for each kind")
        self.spark, self.folder, self.rules = spark, folder, tuple(rules)
        # an empty part, so that the table exists from the first run on
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(f"{folder}/scans")

    def scans(self) -> DataFrame:
        """All scans so far. A pair that two runs scanned at once is there twice, with equal findings."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/scans")

    def unseen(self, addressed: DataFrame) -> DataFrame:
        """blob, text and the current rules not yet applied to it; blobs without any are left out."""
        texts = addressed.groupBy("blob").agg(F.any_value("text").alias("text"))
        seen = self.scans().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        left = F.array_except(F.array(*[F.lit(r.name) for r in self.rules]), F.coalesce("seen", F.array().cast("array<string>")))
        return texts.join(seen, "blob", "left").select("blob", "text", left.alias("rules")).where(F.size("rules") > 0)

    def scan(self, addressed: DataFrame) -> None:
        """Scans what is unseen of (blob, text) and appends it. A failed run appends nothing and can be repeated."""
        rules = self.rules

        def run(batches):
            scanner = Scanner(rules)
            for batch, texts in pieces(batches):
                names = batch.column(2).to_pylist()
                found = pa.array([scanner.scan(t or b"", n) for t, n in zip(texts, names)], pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], names=["blob", "rules", "found"])

        self.unseen(addressed).mapInArrow(run, SCHEMA).write.mode("append").parquet(f"{self.folder}/scans")

    def findings(self) -> DataFrame:
        """blob and ``found`` (start, place of the kind among the rules, end; in this order) under the current rules; blobs without any are left out."""
        names = F.array(*[F.lit(r.name) for r in self.rules])
        found = F.flatten(F.collect_list(F.filter("found", lambda f: F.array_contains(names, f["rule"]))))
        ordered = F.array_sort(F.array_distinct(F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.array_position(names, f["rule"]).cast("int").alias("kind"), f["end"].alias("end")))))
        return self.scans().where(F.size("found") > 0).groupBy("blob").agg(ordered.alias("found")).where(F.size("found") > 0)

    def secrets(self, docs: DataFrame, summary: dict[str, Column] | None = None, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Every row of ``docs``: id, ``carried`` columns, and its spans or, with ``summary``, columns made of ``found`` once for each blob.

        A null text is an empty one. Rows that repeat stay, each with its findings; texts are scanned whole; an empty
        table gives an empty result. ``found`` is null where nothing is found.
        """
        addressed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), carried(list(carry))).withColumn("blob", F.unhex(F.sha2("text", 256)))
        self.scan(addressed.select("blob", "text"))
        paths = f"{self.folder}/paths"
        addressed.drop("text").write.mode("overwrite").parquet(paths)
        held = self.spark.read.schema(addressed.drop("text").schema).parquet(paths)
        rows = held.count()
        hot = held.groupBy("blob").count().where(F.col("count") * HOT > rows)
        hot = F.broadcast(hot.select("blob", F.ceil(F.col("count") * HOT / F.lit(max(rows, 1))).cast("int").alias("salts")))
        known = self.findings().join(hot, "blob", "left")
        known = known.select("blob", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), *([c.alias(n) for n, c in summary.items()] if summary else ["found"]))
        dealt = held.join(hot, "blob", "left").withColumn("salt", F.floor(F.rand(7) * F.coalesce("salts", F.lit(1))).cast("int"))
        names = list(summary) if summary else ["found"]
        return dealt.join(known, ["blob", "salt"], "left").select("doc_id", "carried", *names)


def spans(found: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", F.element_at(kinds, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ",")


def digests(docs: DataFrame, folder: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: numbers of base findings, the digest of their spans, and all spans. ``rules`` begin with the base ones."""
    found = F.col("found")
    base = F.filter(found, lambda f: f["kind"] <= len(BASE))

    def number(kind: int) -> Column:
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")

    summary = {f"n_{r.kind}": number(k) for k, r in enumerate(BASE, 1)}
    summary |= {"base_sha256": F.sha2(spans(base, rules), 256), "spans": spans(found, rules)}
    got = Ledger(docs.sparkSession, folder, rules).secrets(docs, summary, (), id_col, text_col)
    nothing = {**{n: F.lit(0).cast("long") for n in summary}, "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    return got.select("doc_id", *[F.coalesce(n, nothing[n]).alias(n) for n in summary])
