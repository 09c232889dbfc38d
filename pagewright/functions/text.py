"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters, ligatures and confusable hyphens by code point.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
LIGATURES = "\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06"
HYPHENS = "\u2010\u2011\u2012\u2013\u2043\u02d7\u2212\u2796\ufe58\u06d4\u2cbb\u2cba\uff70\u30fc\uff0d\u2015\u2014"
# The classifier's limits and literals.
ENTROPY, ENTROPY_LENGTH, HEX_LENGTH, DIGITS_LENGTH, SHORTEST = 3.8, 8, 16, 8, 3
CONFIG_LITERALS = ("true", "false", "null", "yes", "no", "on", "off")
# Shapes by what a value must contain, one of several texts, and a pattern where that does not decide; a pattern is slow where nothing matches.
SHAPES = (
    ("url", (":",), r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"),
    ("template", ("{{",), r"\{\{.*?\}\}"),
    ("query", ("=",), r"[?&][A-Za-z0-9_.\-]+="),
    ("structured", ("{", "}", "[", "]"), None),
    ("structured", ('":',), r'":\s'),
    ("path", ("/",), r"^/|[^/\s]/[^/\s]+/"),
)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    signs = F.split(text, "")
    size = F.length(text)
    share = lambda c: F.size(F.filter(signs, lambda x: x == c)) / size
    return F.when(size == 0, 0.0).otherwise(F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c)))))


def classify(value: Column) -> Column:
    """Whether a value is checked as prose (`check`), or why it is skipped; the first rule that fits counts."""
    v = F.trim(value)
    out = F.when(v == "", "too_short")
    for name, needed, pattern in SHAPES:
        has = reduce(or_, [F.contains(v, F.lit(x)) for x in needed])
        out = out.when(has & v.rlike(pattern) if pattern else has, name)
    return (
        out.when(F.contains(v, F.lit(" ")), "check")
        .when(F.lower(v).isin(*CONFIG_LITERALS), "config_literal")
        .when(F.length(v) < SHORTEST, "too_short")
        .when((F.length(v) >= DIGITS_LENGTH) & v.rlike("^[0-9]+$"), "digits")
        .when((F.length(v) >= HEX_LENGTH) & v.rlike("^[0-9a-fA-F]+$"), "hex")
        .when((F.length(v) >= ENTROPY_LENGTH) & (F.round(entropy(v), 9) > ENTROPY), "high_entropy")
        .otherwise("check")
    )


def canonical(text: Column) -> Column:
    """Named entities decoded, tags as spaces, invisible characters dropped, dashes and quotes plain, white space single."""
    t = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&shy;", ""), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.translate(t, INVISIBLE, "")
    t = F.translate(t, "–‘’", "-''")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def excerpt(text: Column, at: Column, radius: int) -> Column:
    """Text around a place (from 1), `...` on each side that is cut, line ends as spaces."""
    start = F.greatest(at - radius, F.lit(1))
    cut = F.translate(F.substring(text, start, F.lit(2 * radius + 1)), "\r\n", "  ")
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(F.length(text) > start + 2 * radius, "...").otherwise(""))


def sanitized(field: Column, delimiter: str) -> Column:
    """A field for a delimited line: the delimiter as /, line ends and tabs as spaces, control and invisible characters dropped."""
    t = F.replace(field, F.lit(delimiter), F.lit("/"))
    t = F.translate(t, "\r\n\t\u2028\u2029", "     ")
    return F.translate(t, "".join(chr(c) for c in [*range(1, 32), *range(127, 160)] if chr(c) not in "\r\n\t") + INVISIBLE, "")


def guarded(field: Column) -> Column:
    """An apostrophe in front of what a spreadsheet would take for a formula."""
    return F.when(field.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), field)).otherwise(field)


def unguarded(field: Column) -> Column:
    """What guarded() was given."""
    return F.when(field.rlike(r"^'[=+\-@\t\r]"), F.substring(field, 2, 1 << 30)).otherwise(field)


def csv_line(delimiter: str, *fields: Column) -> Column:
    out = []
    for f in fields:
        x = sanitized(guarded(f), "\0")
        out.append(F.when(F.contains(x, F.lit(delimiter)) | F.contains(x, F.lit('"')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    return F.concat_ws(delimiter, *out)
