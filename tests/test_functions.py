"""Functions and structure operators on cases of their own."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import markup
from pagewright.streaming import events


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column).collect()]


def test_classes_of_values(spark):
    cases = {"": "too_short", "https://a/b": "url", "{{x}}": "template", "a?b=1": "query", "[1]": "structured", "/a": "path", "a/b/c": "path", "two words": "check", "True": "config_literal", "ab": "too_short", "12345678": "digits", "0123456789abcdef": "hex", "aB3$xY9!qZ7&kL2*wE5": "high_entropy", "word": "check"}
    assert dict(zip(cases, one(spark, T.classify(F.col("v")), *cases), strict=True)) == cases


def test_csv_fields(spark):
    assert one(spark, T.csv_line(";", F.col("v")), "=1", "a;b", 'q"q', "x\ty", "z") == ["'=1", '"a;b"', '"q""q"', "x y", "z"]


@pytest.mark.parametrize(("ref", "want"), [("/x", "https://h.example/x"), ("y.html", "https://h.example/a/y.html"), ("./y", "https://h.example/a/y"), ("//c/x", "https://c/x"), ("#t", None), ("?q", None), ("mailto:a@b", None), ("-3", None), (" ", None)])
def test_resolution(spark, ref, want):
    assert one(spark, U.resolve(F.col("v"), F.lit("https://h.example/a/b?x#y")), ref) == [want]


def test_admission(spark):
    got = one(spark, U.admission(F.col("v"), F.lit("https://h.example/"), ["https://h.example"]), "/a", "", "#x", "ftp://h/x", "http://127.0.0.1/", "https://o.example/")
    assert got == ["ok", "empty", "unresolvable", "scheme:ftp", "ip-literal:127.0.0.1", "off-host:o.example"]


def test_normalized_urls(spark):
    assert one(spark, U.normalized(F.col("v")), "https://H.Example/A/?q#f", "https://h.example") == ["https://h.example/A", "https://h.example"]


def test_entropy(spark):
    assert one(spark, T.entropy(F.col("v")), "aabb", "abcd", "aaaa", "") == [1.0, 2.0, 0.0, 0.0]


def test_flattened_pages():
    flat = markup.flatten('<html lang="de"><body><p>a<b>b</p><br></i><script>x < y</script></body></html>')
    assert [(n["kind"], n["name"]) for n in flat if n["kind"].startswith("un")] == [("unclosed", "b"), ("unopened", "i")]
    assert [n["text"] for n in flat if n["kind"] == "text"] == ["a", "b", "x < y"]
    assert all(n["lang"] == "de" for n in flat if n["kind"] == "text")


@pytest.mark.parametrize(("text", "want"), [("„a“", []), ("„a", ["QUOTE_UNMATCHED"]), ("„a“ «b»", ["QUOTE_SYSTEM_MIX"]), ("a”", ["QUOTE_UNMATCHED"]), ("„a”", ["QUOTE_WRONG_CLOSE"])])
def test_quotes(text, want):
    assert markup.quote_issues(text) == want


def test_normal_forms():
    assert markup.decomposed("café café") == ["é"] and markup.mixed_forms("café café x") == ["café"]


def test_script_literals():
    assert markup.script_literals("var a='it\\'s'; // 'no'\n/* \"no\" */ f(\"b\", `c ${d('x')} e`, {'key': 'v'})") == ["it's", "b", "c   e", "v"]


@pytest.mark.parametrize("build", [events.throughput, events.sessions])
def test_streams_equal_batches(spark, tmp_path, build):
    """Windows that the watermark has closed are those of the batch."""
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.write.parquet(str(tmp_path / "in"))
    events.run(spark, str(tmp_path / "in"), base.schema, build, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = {tuple(map(str, r)) for r in build(base.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    stream = {tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stream and stream <= batch


def test_first_visits(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.write.parquet(str(tmp_path / "in"))
    events.run(spark, str(tmp_path / "in"), base.schema, events.first_visits, str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.dropDuplicates(["user_id", "event_type"]).count() == base.dropDuplicates(["user_id", "event_type"]).count()


def test_image_metadata():
    import struct

    from pagewright.operators import images

    def tiff(order):
        gps = 8 + 2 + 12 * 2 + 4
        o = {"<": b"II*\0", ">": b"MM\0*"}[order]
        main = struct.pack(order + "H", 2) + struct.pack(order + "HHI", 0x013B, 2, 4) + b"Ann\0" + struct.pack(order + "HHII", 0x8825, 4, 1, gps) + bytes(4)
        data = gps + 2 + 12 * 2 + 4
        ifd = struct.pack(order + "H", 2) + struct.pack(order + "HHI", 1, 2, 2) + b"S\0\0\0" + struct.pack(order + "HHII", 2, 5, 3, data) + struct.pack(order + "I", gps)
        return o + struct.pack(order + "I", 8) + main + ifd + struct.pack(order + "6I", 10, 1, 30, 1, 36, 1)

    for order in "<>":
        tags = images.exif(tiff(order))
        assert tags == {"Artist": "Ann", "gps.LatitudeRef": "S", "gps.Latitude": "10 30 36"}
        assert images.degrees(tags["gps.Latitude"], tags["gps.LatitudeRef"]) == pytest.approx(-10.51)
        for n in range(len(tiff(order))):
            images.exif(tiff(order)[:n])  # damaged at any place: no error
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    caption = b"8BIM\x04\x04\0\0\0\0\0\x0a\x1c\x02\x78\0\x05Hello"
    packet = b'http://ns.adobe.com/xap/1.0/\0<x xmp:CreatorTool="T"><dc:creator><rdf:Seq><rdf:li>Bo</rdf:li></rdf:Seq></dc:creator></x>'
    jpeg = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff("<")) + segment(0xED, caption) + segment(0xE1, packet) + segment(0xC0, b"\x08\0\x10\0\x20\x03") + b"\xff\xd9"
    got = images.metadata(jpeg)
    assert (got["width"], got["height"], got["exif:Artist"], got["iptc:Caption"], got["xmp:dc:creator"], got["xmp:xmp:CreatorTool"]) == ("32", "16", "Ann", "Hello", "Bo", "T")
    assert images.xmp(b"<!DOCTYPE x><dc:title>t</dc:title>") == {} and images.metadata(None) == {}


@pytest.mark.parametrize(
    ("text", "language", "issues"),
    [
        ("„gut“ und „gut“", "de", []),
        ("„dobrze” mówi", "pl", []),
        ("„falsch” hier", "de", [("QUOTE_WRONG_CLOSE", 7)]),
        ("“one” and „zwei“", "en", [("QUOTE_SYSTEM_MIX", 10)]),
        ("«un» “deux”", "fr", [("QUOTE_SYSTEM_MIX", 5)]),
        ("„auf", "de", [("QUOTE_UNMATCHED", 0)]),
        ("zu” spät", "en", [("QUOTE_WRONG_OPEN", 2)]),
        ('“typographic" end', "en", [("QUOTE_MIXED_KIND", 12)]),
        ('"straight” end', "en", [("QUOTE_MIXED_KIND", 9)]),
        ('"straight" pair', "en", []),
        ("it’s the dogs’ l’eau", "en", []),
        ("l’eau d’un qu’il", "fr", []),
        ("‘inner’ it’s", "en", []),
        ("Kennedy’ego", "pl", []),
        ("dogs’ end", "de", [("QUOTE_WRONG_OPEN", 4)]),
        ("‘the dogs’ end", "en", []),
        ("❝x❞", "", []),
        ("", "de", []),
    ],
)
def test_quotes(text, language, issues):
    from pagewright.functions.quotes import quote_issues

    assert [(x.kind, x.at) for x in quote_issues(text, language)] == issues
