"""Secret scans: fixed patterns, and strings more likely random than ordinary.

Two character Markov models, of random strings and of ordinary identifiers, score every long token by
the log-likelihood ratio of its character pairs. Both are trained from labelled samples of the given
documents: what the fixed patterns find is labelled random, all other tokens ordinary. Their pair
counts are sums per character pair, so training gathers at most 2 * 66 * 66 numbers. Everything runs as
DataFrame expressions.

Defined results: null text counts as empty and has no spans; repeated rows give one row each;
offsets are code points, ends exclusive; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import text_rows

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Characters of scored tokens, and the shortest token that is scored.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
#: What stands for a fixed pattern's match while ordinary tokens are taken, and those: whole tokens that touch no match.
HIDDEN = "\x01"
PLAIN = r"(?<![\x01A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}+(?!\x01)"
#: Documents that the labelled sample holds on average, at most.
SAMPLE_DOCS = 20_000
#: Added to each pair count, and the log-likelihood ratio from which a token counts as random.
SMOOTHING, LEAST_RATIO = 0.5, 12.0
MASK = "[secret]"


#: Items of an array that are summed up at once, and characters of a text that are cut at once.
BLOCK, CUT = 128, 1024


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Before each of a few numbers, what those in front of it merge to, from 0."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(values, zero, lambda acc, v: F.struct(merge(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The same for many numbers: each block by itself, then the blocks, since a list that grows by one is copied each time."""

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.expr("CAST(array() AS array<array<int>>)"))

    def joined_blocks(cut: Column) -> Column:
        before = _scanned(F.transform(cut, lambda x: F.aggregate(x, F.lit(0), merge)), merge)
        return F.flatten(F.zip_with(cut, before, lambda x, front: F.transform(_scanned(x, merge), lambda y: merge(front, y))))

    return bound(bound(values, blocks), joined_blocks)


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, from the text between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    more = [] if value_group == 0 else [F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value")]
    cells = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), *more)

    def places(m: Column) -> Column:
        before = running(F.transform(m, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda x, y: x + y)

        def place(x: Column, at: Column) -> Column:
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["value" if more else "hit"].alias("value"))

        return F.zip_with(m, before, place)

    # the last gap has no match behind it
    return bound(bound(cells, lambda c: F.slice(c, 1, F.size(c) - 1)), places)


def _none() -> Column:
    return F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")


def base_matches(text: Column) -> dict[str, Column]:
    """The matches of each fixed pattern; cheap substring tests keep the regular expressions off most texts."""
    low = F.lower(text)
    hint = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    # a run of AKIA... or of hex digits is maximal, so the least length may stand in the pattern
    return {
        "assign": F.when(hint, F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)).otherwise(_none()),
        "access": F.when(text.contains("AKIA"), located(text, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")).otherwise(_none()),
        "hex": F.when(text.rlike(rf"[0-9a-f]{{{HEX_LEAST}}}"), located(text, rf"[0-9a-f]{{{HEX_LEAST},}}")).otherwise(_none()),
    }


def labelled_tokens(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): tokens of a bounded sample of documents, labelled by the fixed patterns; tokens that touch no match are ordinary."""
    rows = text_rows(docs, "doc_id", "text").filter("text IS NOT NULL")
    n = rows.count()
    # by id and text, so that copies of one text enter one by one
    part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(n, 1))))
    text = F.col("text")
    found = part.select("text", F.struct(*(c.alias(k) for k, c in base_matches(text).items())).alias("found"))
    every = F.concat(*(F.col("found")[k] for k in KINDS[:3]))
    labelled = found.select(F.array_distinct(F.transform(every, lambda m: m["value"])).alias("secret"), F.regexp_extract_all(_blanked(text, F.array_sort(every), HIDDEN), F.lit(PLAIN), F.lit(0)).alias("tokens"))
    hit = labelled.select(F.explode("secret").alias("token"), F.lit(True).alias("random"))
    plain = labelled.select(F.explode("tokens").alias("token"), F.lit(False).alias("random"))
    # ordinary words are written in capitals as well
    return hit.unionByName(plain).unionByName(plain.select(F.upper("token").alias("token"), "random"))


def train(tokens: DataFrame) -> list[float]:
    """The log-likelihood ratio of each character pair, row by row of ALPHABET."""
    # equal tokens are counted before they are taken apart
    counted = tokens.groupBy("token", "random").agg(F.count("*").alias("n"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2))))
    pairs = counted.filter(F.length("token") > 1).select("random", "n", pair.alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n")).filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    size = len(ALPHABET)
    counts = {True: [SMOOTHING] * size**2, False: [SMOOTHING] * size**2}
    for r in pairs.collect():
        counts[r["random"]][ALPHABET.index(r["pair"][0]) * size + ALPHABET.index(r["pair"][1])] += r["n"]
    for table in counts.values():
        for i in range(0, size**2, size):
            total = sum(table[i : i + size])
            table[i : i + size] = [math.log(x / total) for x in table[i : i + size]]
    return [a - b for a, b in zip(counts[True], counts[False], strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token over ALPHABET: positive means more likely random."""
    size = len(ALPHABET)
    table = F.expr("CAST(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') AS array<double>)")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        seen = (acc["last"] > 0) & (code > 0)
        add = F.when(seen, F.element_at(table, (acc["last"] - 1) * size + code)).otherwise(F.lit(0.0))
        return F.struct(code.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(codes, zero, step, lambda acc: acc["sum"])


def _piece(cuts: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1 of a text in pieces of CUT characters; only the pieces concerned are looked at."""
    a, b = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
    head = F.substring(F.get(cuts, a), start - a * CUT + 1, F.lit(CUT))
    tail = F.coalesce(F.substring(F.get(cuts, b), F.lit(1), end - b * CUT), F.lit(""))
    across = F.concat(head, F.array_join(F.slice(cuts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), tail)
    return F.when(start >= end, F.lit("")).when(a == b, F.substring(F.get(cuts, a), start - a * CUT + 1, end - start)).otherwise(across)


def _spliced(text: Column, found: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """text with put(start, end, new) in place of each of the spans found, which ascend by start and may overlap.

    What an earlier span covers is not put again: start is where the rest of a span begins, and new tells that the span
    overlaps none before it.
    """

    def whole(x: Column) -> Column:
        def step(s: Column, reached: Column) -> Column:
            start = F.greatest(s["start"], reached)
            return F.concat(_piece(x["cuts"], reached, start), put(start, F.greatest(s["end"], start), s["start"] >= reached))

        reach = running(F.transform(x["found"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        end = F.array_max(F.transform(x["found"], lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(x["found"], reach, step), ""), _piece(x["cuts"], end, F.length(text)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0)).alias("cuts"), found.alias("found"))
    return F.when(F.size(found) > 0, bound(parts, whole)).otherwise(text)


def _blanked(text: Column, found: Column, by: str = " ") -> Column:
    """text with spaces, or another character, in place of the spans found."""
    return _spliced(text, found, lambda start, end, new: F.repeat(F.lit(by), end - start))


def found_spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), base (spans of the fixed patterns) and spans (these and the random tokens), each by start, then kind.

    Tokens are looked for in what the fixed patterns leave of a text, so the rest of a token that they cut is scored too.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    found = base_matches(F.col("text"))

    def marked(kind: str, matches: Column) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*(marked(k, found[k]) for k in KINDS[:3]))))
    rows = rows.withColumn("open", _blanked(F.col("text"), F.col("base")))
    left = F.col("open")
    random = F.when(left.rlike(TOKEN), F.filter(located(left, TOKEN), lambda m: ratio(m["value"], model) >= LEAST_RATIO)).otherwise(_none())
    return rows.select("row", "base", F.array_sort(F.concat("base", marked("random", random))).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row, with models trained from the same documents."""
    rows = text_rows(docs, "doc_id", "text")
    return found_spans(rows, train(labelled_tokens(rows))).select("row.doc_id", "base", "spans")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by MASK, overlapping ones by one; all other columns and rows stay, null texts too."""
    found = found_spans(docs, train(labelled_tokens(docs)))
    text = F.col("row").getField("text")
    clean = _spliced(text, F.col("spans"), lambda start, end, new: F.when(new, F.lit(MASK)).otherwise(F.lit("")))
    return found.select(*((clean if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
