"""Secret scans with DataFrame functions alone: fixed patterns, and Shannon entropy in a sliding window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that is too short is no match, and no shorter part of it is one: the lengths stand in the pattern.
PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}

#: Candidates of the entropy scan, the order of their characters' counts, and by class: window and least bits a character.
CANDIDATE = "[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = {"entropy_hex": (24, 3.0), "entropy_text": (24, 3.9)}
#: What is no secret: candidates that are identifiers, paths and slugs of words, runs of one sign; and rich spans that say they are placeholders.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[A-Za-z_/=-]+$", r"^[0-9/_=+-]+$")
ALLOWED_SPAN = r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|0000"
#: Text before a candidate that says it is a digest or data.
ALLOWED_BEFORE = r"(?i)(sha[0-9]{1,3}[-:= ]|md5[-:= ]|commit |integrity[:= ]|base64,)$"


#: Matches whose places are summed up one after another; blocks of them are then put one after another.
BLOCK = 256


def _empty(fields: str):
    return F.expr(f"cast(array() as array<struct<{fields}>>)")


def _spans(kind: str, pattern: str, text: str = "text"):
    """array<struct<kind, start, end, said>> of the leftmost non-overlapping matches in text: gaps and matches alternate."""
    said, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(said, F.length), F.slice(F.transform(gaps, F.length), 1, F.size(said)), lambda m, g: F.struct(g.alias("g"), m.alias("m")))
    spans = F.zip_with(_places(sizes), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda e, m: F.struct(F.lit(kind).alias("kind"), e["start"].alias("start"), e["end"].alias("end"), m.alias("said")))
    return F.when(F.col(text).rlike(pattern), spans).otherwise(_empty("kind: string, start: int, end: int, said: string"))


def _let(x, f):
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _places(sizes):
    """array<struct<start, end>> from the gap before each match and its length; an array grows by one within a block only, so the work is in proportion to the matches."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))

    def placed(blocks):
        whole = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y["g"] + y["m"]))
        bases = F.aggregate(whole, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, bases, _within))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
    return _let(_let(sizes, cut), placed)


def _within(block, base):
    start = F.struct(base.alias("at"), _empty("start: int, end: int").alias("all"))

    def step(acc, x):
        first = acc["at"] + x["g"]
        return F.struct((first + x["m"]).alias("at"), F.array_append(acc["all"], F.struct(first.alias("start"), (first + x["m"]).alias("end"))).alias("all"))

    return F.aggregate(block, start, step, lambda acc: acc["all"])


def _masked(text: str, pattern: str, keep=None):
    """The text with blanks in place of the matches, but for those that are no match by `keep`."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    said = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: blank(m) if keep is None else F.when(keep(m), blank(m)).otherwise(m))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), said, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    return F.when(F.col(text).rlike(pattern), joined).otherwise(F.col(text))


#: The character that stands for a count of none.
_ZERO = 48


def _entropy_span(c, window: int, least: float):
    """The first and last place of the windows of c with that entropy or more, found by counts kept from window to window.

    The counts of ALPHABET's characters are the characters of a string, of which two change from window to window.
    With n(x) the count of x in the window, the entropy is log2(window) - sum(n log2 n) / window; as the window
    moves, one count rises and one falls, and the sum changes by those two terms.
    """
    table = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 2)])
    f = lambda n: F.element_at(table, n + 1)
    start = F.struct(F.lit(chr(_ZERO) * len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def moved(counts, at, by: int):
        return F.overlay(counts, F.chr((F.ascii(F.substring(counts, at, F.lit(1))) + by).cast("bigint")), at, F.lit(1))

    def step(acc, x):
        into, out = x["into"], x["out"]
        a = F.ascii(F.substring(acc["n"], into, F.lit(1))) - _ZERO
        more = moved(acc["n"], into, 1)
        b = F.coalesce(F.ascii(F.substring(more, out, F.lit(1))) - _ZERO, F.lit(1))
        counts = F.when(out.isNull(), more).otherwise(moved(more, F.coalesce(out, F.lit(1)), -1))
        s = acc["s"] + f(a + 1) - f(a) + F.when(out.isNull(), 0.0).otherwise(f(b - 1) - f(b))
        rich = (x["i"] >= window) & (F.lit(math.log2(window)) - s / window >= least)
        first, last = F.coalesce(acc["first"], F.when(rich, x["i"] - window)), F.when(rich, x["i"]).otherwise(acc["last"])
        return F.struct(counts.alias("n"), s.alias("s"), first.alias("first"), last.alias("last"))

    def scanned(places):
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), window), places)
        moves = F.transform(F.slice(F.zip_with(places, before, lambda x, y: F.struct(x.alias("into"), y.alias("out"))), 1, F.size(places)), lambda x, i: F.struct(x["into"].alias("into"), x["out"].alias("out"), (i + 1).alias("i")))
        return F.aggregate(moves, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(F.transform(F.split(c, ""), lambda x: F.instr(F.lit(ALPHABET), x)), scanned)


def _added(kind: str, window: int, least: float):
    """Entropy spans of one class from the column candidates."""
    hexadecimal = r"^[0-9a-fA-F]+$"
    digits_and_letters = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"

    def ours(x):
        c = x["said"]
        ok = c.rlike(hexadecimal) & c.rlike("[0-9]") & c.rlike("[a-fA-F]") if kind == "entropy_hex" else ~c.rlike(hexadecimal) & c.rlike(digits_and_letters)
        for rule in ALLOWED:
            ok = ok & ~c.rlike(rule)
        before = F.substring(F.col("text"), F.greatest(x["start"] - 11, F.lit(1)), F.least(x["start"], F.lit(12)))
        return ok & ~before.rlike(ALLOWED_BEFORE)

    found = F.transform(F.filter("candidates", ours), lambda x: F.struct(x["start"].alias("start"), x["said"].alias("said"), _entropy_span(x["said"], window, least).alias("e")))
    said = lambda x: F.substring(x["said"], x["e"]["first"] + 1, x["e"]["last"] - x["e"]["first"])
    found = F.filter(found, lambda x: x["e"]["first"].isNotNull() & ~said(x).rlike(ALLOWED_SPAN))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), (x["start"] + x["e"]["first"]).alias("start"), (x["start"] + x["e"]["last"]).alias("end")))


def secrets(df: DataFrame) -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>> in code points by start, then kind in order.

    Kinds: assign, access and hex by their patterns; entropy_hex and entropy_text for rich windows of what is left
    without those, unless an allow rule names them. A null text is empty; repeated rows each come back; null ids
    stay; an empty table gives an empty result; work and memory are in proportion to a text. Other columns are not read.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8
    rows = rows.select("*", *[_spans(k, p).alias(k) for k, p in PATTERNS.items()], _masked("text", _ASSIGN, long).alias("left"))
    for k in ("access", "hex"):
        rows = rows.withColumn("left", _masked("left", PATTERNS[k]))
    rows = rows.withColumn("assign", F.filter("assign", lambda x: long(x["said"]))).withColumn("candidates", _spans("candidate", CANDIDATE, "left"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.when(F.size("candidates") > 0, F.concat(*[_added(k, *x) for k, x in CLASSES.items()])).otherwise(_empty("kind: string, start: int, end: int"))
    order = F.array(*[F.lit(k) for k in (*KINDS, *CLASSES)])
    ranked = F.transform(F.concat(*[plain(k) for k in KINDS], added), lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return rows.select("doc_id", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash and all spans as text."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
