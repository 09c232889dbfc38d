"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only this method adds.
ADDED = ("url", "iban", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_URL = re.compile(r"(?:[A-Za-z0-9._%+-]+(?::[^\s/@]*)?@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?").match
_IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_ACCOUNT = re.compile(r"(?: {0,2}(?:no|nr|number|num)\b\.?)? {0,2}[:#=]? {0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])").match


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for w in ("http://", "https://", "ftp://"):
        a.add_word(w, ("url", len(w)))
    for w in ("IBAN", "Iban", "iban"):
        a.add_word(w, ("iban", len(w)))
    for w in ("account", "acct", "konto", "cuenta", "compte"):
        for form in (w, w.capitalize(), w.upper()):
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


class Scanner:
    """spans(text): (kind, start, end) in code points, kinds in order, then by start. The text is passed over once."""

    def __init__(self):
        self.automaton = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + ADDED}
        done = dict.fromkeys(found, 0)
        for last, (what, width) in self.automaton.iter(text):
            at = last - width + 1
            if what == "digit":
                if at >= done["ip"] and (at == 0 or not "0" <= text[at - 1] <= "9") and (m := _IP(text, at)):
                    done["ip"] = m.end()
                    if all(map(_octet, m[0].split("."))):
                        found["ip"].append(m.span())
                if at >= done["card"] and (m := _CARD(text, at)):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "") if m.end() - at <= 37 else ""
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            elif what == "at":
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN(text, at + 1)):
                    done["email"] = m.end()
                    found["email"].append((start, m.end()))
            elif what == "plus":
                if at >= done["phone"] and (m := _PHONE(text, at)):
                    done["phone"] = m.end()
                    if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif what == "url":
                if at >= done["url"] and (m := _URL(text, last + 1)):
                    end = m.start() + len(m[0].rstrip(".,;:!?)"))
                    done["url"] = end
                    found["url"].append((at, end))
            elif what == "iban":
                if (m := _IBAN(text, last + 1)) and m.start(1) >= done["iban"] and _mod97(m[1].replace(" ", "")):
                    done["iban"] = m.end(1)
                    found["iban"].append(m.span(1))
            elif (m := _ACCOUNT(text, last + 1)) and m.start(1) >= done["account"]:
                done["account"] = m.end(1)
                found["account"].append(m.span(1))
        return [(k, *x) for k in found for x in found[k]]


_scanner: list[Scanner] = []


def personal_data(df: DataFrame) -> DataFrame:
    """doc_id and spans, array<struct<kind, start, end>>, of each document; base kinds in order, then those the method adds.

    Kinds: email, ip, card, phone; url (a scheme and a host), iban (after its cue, valid mod 97), account (digits
    after an account cue). A null text is empty; repeated rows each come back; null ids stay. Other columns are not read.
    """

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        scan = _scanner[0].spans
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "")] for t in b.column(1).slice(at, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1024), pa.array(found, kind)], ["doc_id", "spans"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash, all spans as text and how many base spans there are."""
    said = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.transform(F.filter("spans", lambda x: x["kind"].isin(*KINDS)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(said, ",").alias("spans"), F.size(base).cast("long").alias("n_private"))


def base_hash(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in KINDS).encode()).hexdigest()
