"""What needs a document's structure or a stack: one Arrow pass flattens a page, and queries read the flat rows.

The parser follows the document's own tags: void elements have no end, an end tag closes the nearest open element of
its name, and there are no implied ends. Comments are no text; script and style text keeps its element's name.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.quotes import quote_issues

# Elements without an end tag, elements inside a run of text, and containers for which bare text is an issue.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("b i em strong mark small u s span wbr".split())
CONTAINERS = frozenset("div section article aside header footer main".split())
OPAQUE = frozenset("script style noscript".split())
_NODE = pa.struct([("idx", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("text", pa.string()), ("lang", pa.string())])
NODES = "array<struct<idx: int, parent: int, kind: string, name: string, text: string, lang: string>>"


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[tuple[int, str, str | None]] = []

    def _add(self, kind, name, text):
        parent, inside, lang = self.open[-1] if self.open else (-1, "", None)
        self.nodes.append({"idx": len(self.nodes), "parent": parent, "kind": kind, "name": name or inside, "text": text, "lang": lang})

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self._add("element", tag, " ".join(f"{k}={v or ''}" for k, v in attrs))
        if tag not in VOID:
            above = self.open[-1][2] if self.open else None
            self.open.append((len(self.nodes) - 1, tag, own.get("lang") or above))

    def handle_startendtag(self, tag, attrs):
        self._add("element", tag, " ".join(f"{k}={v or ''}" for k, v in attrs))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                for _, name, _ in self.open[k + 1 :]:
                    self._add("unclosed", name, "")
                del self.open[k:]
                return
        self._add("unopened", tag, "")

    def handle_data(self, data):
        self._add("text", "", data)


def flatten(html: str | None) -> list[dict]:
    """Nodes in document order; what is never closed, or closed without being open, has a node of that kind."""
    parser = _Flat()
    parser.feed(html or "")
    parser.close()
    for _, name, _ in parser.open:
        parser._add("unclosed", name, "")
    return parser.nodes


def slices(batches, column: int, rows: int = 64, size: int = 1 << 20):
    """Parts of Arrow batches: some rows, with about a megabyte of a column's texts, or one longer text. What Python makes of a part is all that it holds."""
    for b in batches:
        at = held = 0
        for k, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            if k > at and (k - at == rows or held + (n or 0) > size):
                yield b.slice(at, k - at)
                at, held = k, 0
            held += n or 0
        if at < b.num_rows:
            yield b.slice(at)


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, url and one row a node."""

    def run(batches):
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([flatten(x) for x in part.column(2).to_pylist()], pa.list_(_NODE))], ["page_id", "url", "nodes"])

    spread = pages.select("page_id", "url", "html").repartition("page_id")
    return spread.mapInArrow(run, f"page_id long, url string, nodes {NODES}").select("page_id", "url", F.explode("nodes").alias("n")).select("page_id", "url", "n.*")


@query("h1_flattened_nodes")
def h1(spark, sf_dir):
    return nodes(table(spark, sf_dir, "pages_x"))


@query("h3_text_runs")
def h3(spark, sf_dir):
    """Text of one block: inline elements do not end a run; a node's block is its nearest element that is not inline."""

    def runs(html: str | None) -> list[tuple[str, str]]:
        flat, out = flatten(html), {}
        for n in flat:
            if n["kind"] == "text" and n["name"] not in OPAQUE:
                at = n["parent"]
                while at >= 0 and flat[at]["name"] in INLINE:
                    at = flat[at]["parent"]
                out.setdefault(at, []).append(n["text"])
        return [(flat[k]["name"] if k >= 0 else "", "".join(v).strip()) for k, v in out.items() if "".join(v).strip()]

    def run(batches):
        kind = pa.list_(pa.struct([("block", pa.string()), ("text", pa.string())]))
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[{"block": k, "text": t} for k, t in runs(x)] for x in part.column(1).to_pylist()], kind)], ["page_id", "runs"])

    pages = table(spark, sf_dir, "pages_x").select("page_id", "html").repartition("page_id")
    return pages.mapInArrow(run, "page_id long, runs array<struct<block: string, text: string>>").select("page_id", F.posexplode("runs").alias("pos", "r")).select("page_id", "pos", "r.*")


@query("q2_parser_errors")
def q2(spark, sf_dir):
    found = nodes(table(spark, sf_dir, "pages_x")).where("kind in ('unclosed', 'unopened')")
    return found.groupBy("page_id", F.concat_ws("/", F.lit("MALFORMED_HTML"), "kind", "name").alias("issue_type")).agg(F.count("*").alias("n"))


@query("q9_bare_text_dom")
def q9(spark, sf_dir):
    """Text that is a direct child of a container and not blank."""
    flat = nodes(table(spark, sf_dir, "pages_x"))
    return flat.where((F.col("kind") == "text") & F.col("name").isin(*CONTAINERS) & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).select("page_id", F.lit("BARE_TEXT_IN_CONTAINER").alias("issue_type"), F.trim("text").alias("detail"))


@query("j13_nearest_language")
def j13(spark, sf_dir):
    return nodes(table(spark, sf_dir, "pages_x")).where("kind = 'text'").groupBy("page_id", "lang").agg(F.count("*").alias("n"))


@query("q18_word_split_by_formatting")
def q18(spark, sf_dir):
    """Elements that hold three single-letter inline elements or more."""
    flat = nodes(table(spark, sf_dir, "pages_x").withColumn("html", F.concat("html", F.when(F.col("page_id") % 9 == 0, "<p><b>F</b>oo <b>B</b>ar <b>B</b>az</p>").otherwise(""))))
    single = flat.where((F.col("kind") == "text") & F.col("name").isin(*INLINE) & F.col("text").rlike(r"^\p{L}$")).select("page_id", F.col("parent").alias("idx"))
    outer = flat.where("kind = 'element'").select("page_id", "idx", F.col("parent").alias("outer"))
    return single.join(outer, ["page_id", "idx"]).groupBy("page_id", "outer").agg(F.count("*").alias("n")).where("n >= 3")


def decomposed(text: str) -> list[str]:
    """Base and mark pairs that compose to fewer characters, as composed."""
    return sorted({unicodedata.normalize("NFC", m[0]) for m in re.finditer(r"[^\W\d_][̀-ͯ]+", text) if len(unicodedata.normalize("NFC", m[0])) < len(m[0])})


def mixed_forms(text: str) -> list[str]:
    """Words of a page that occur composed and decomposed."""
    forms: dict[str, set[str]] = {}
    for w in re.findall(r"[^\W\d_][^\W_]*(?:[̀-ͯ][^\W_]*)*", text):
        forms.setdefault(unicodedata.normalize("NFC", w), set()).add(w)
    return sorted(k for k, v in forms.items() if len(v) > 1)


def _detect(df: DataFrame, detector, kind: str) -> DataFrame:
    """doc_id and one row for each thing that the detector says of a text."""

    def run(batches):
        for part in slices(batches, 1, 512):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([detector(x or "") for x in part.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "found"])

    found = df.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<string>")
    return found.select("doc_id", F.lit(kind).alias("issue_type"), F.explode("found").alias("detail"))


def _quoted(spark, sf_dir) -> DataFrame:
    """Lines of documents with their language, and signs of each system, paired and not, planted between words."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text")).where("trim(text) <> ''")
    said = F.col("text")
    for word, quoted in ((" the ", " “the” "), (" is ", " ‘is’ "), (" la ", " «la» "), (" und ", " „und“ "), (" de ", " l’eau de "), (" on ", ' "on" '), (" that ", " „that” "), (" en ", " ‹en ")):
        said = F.replace(said, F.lit(word), F.lit(quoted))
    return lines.select("doc_id", "lang", "line", said.alias("text"))


def _quotes(spark, sf_dir) -> DataFrame:
    """doc_id, line, issue_type, place (from 1) and sign."""

    def run(batches):
        kind = pa.list_(pa.struct([("issue_type", pa.string()), ("at", pa.int64()), ("sign", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [[{"issue_type": x.kind, "at": x.at + 1, "sign": x.sign} for x in quote_issues(t or "", (k or "")[:2])] for k, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["doc_id", "line", "found"])

    found = _quoted(spark, sf_dir).select("doc_id", "line", "lang", "text").mapInArrow(run, "doc_id long, line int, found array<struct<issue_type: string, at: long, sign: string>>")
    return found.select("doc_id", "line", F.inline("found"))


@query("q7_q8_quotes")
def q7(spark, sf_dir):
    return _quotes(spark, sf_dir).groupBy("doc_id", "issue_type").agg(F.count("*").alias("n"))


@query("q27_quote_locator")
def q27(spark, sf_dir):
    """Where each issue is, with ten characters on either side."""
    found = _quotes(spark, sf_dir).join(_quoted(spark, sf_dir).select("doc_id", "line", "text"), ["doc_id", "line"])
    first = F.greatest(F.col("at") - 10, F.lit(1)).cast("int")
    return found.select("doc_id", "line", "issue_type", "at", "sign", F.substring(F.col("text"), first, F.lit(21)).alias("excerpt"))


def _marked(spark, sf_dir) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "é", "é")).otherwise(F.concat("text", F.regexp_replace(F.substring("text", 1, 200), "ü", "ü")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


_MARKED = "select doc_id, case when doc_id % 3 = 0 then replace(text, 'é', 'e' || chr(769)) else text || replace(substr(text, 1, 200), 'ü', 'u' || chr(776)) end as text from {documents}"


@query("q4_decomposed_text", rf"select doc_id, 'DECOMPOSED_TEXT_IN_CONTENT' as issue_type, nfc_normalize(w) as detail from (select distinct doc_id, unnest(regexp_extract_all(text, '[\p{{L}}][\x{{0300}}-\x{{036f}}]+')) as w from ({_MARKED}) m) t where length(nfc_normalize(w)) < length(w) group by doc_id, nfc_normalize(w)")
def q4(spark, sf_dir):
    return _detect(_marked(spark, sf_dir), decomposed, "DECOMPOSED_TEXT_IN_CONTENT")


@query("q5_mixed_normalization", rf"select doc_id, 'MIXED_NORMALIZATION_IN_CONTENT' as issue_type, k as detail from (select doc_id, w, nfc_normalize(w) as k from (select distinct doc_id, unnest(regexp_extract_all(text, '[\p{{L}}][\p{{L}}\p{{N}}]*(?:[\x{{0300}}-\x{{036f}}][\p{{L}}\p{{N}}]*)*')) as w from ({_MARKED}) m) t) u group by doc_id, k having count(*) > 1")
def q5(spark, sf_dir):
    return _detect(_marked(spark, sf_dir), mixed_forms, "MIXED_NORMALIZATION_IN_CONTENT")


def script_literals(code: str) -> list[str]:
    """String literals of a script: quotes and templates without their `${}`; comments are passed over, object keys left out."""
    out, at, n = [], 0, len(code)
    while at < n:
        c = code[at]
        if code.startswith("//", at):
            end = code.find("\n", at)
            at = n if end < 0 else end
        elif code.startswith("/*", at):
            end = code.find("*/", at + 2)
            at = n if end < 0 else end + 2
        elif c in "'\"`":
            text, at = [], at + 1
            while at < n and code[at] != c:
                if code[at] == "\\" and at + 1 < n:
                    text.append({"n": "\n", "t": "\t"}.get(code[at + 1], code[at + 1]))
                    at += 2
                elif c == "`" and code.startswith("${", at):
                    depth, at = 1, at + 2
                    while at < n and depth:
                        depth += (code[at] == "{") - (code[at] == "}")
                        at += 1
                    text.append(" ")
                else:
                    text.append(code[at])
                    at += 1
            at += 1
            rest = code[at : at + 16].lstrip()
            if text and not rest.startswith(":"):
                out.append("".join(text))
        else:
            at += 1
    return out


@query("l11_script_literals")
def l11(spark, sf_dir):
    scripts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n").alias("text"))
    return _detect(scripts, script_literals, "SCRIPT_LITERAL")
