"""Metadata inside images: EXIF, IPTC and XMP of JPEG, PNG and WebP bytes, and what of it should not be published.

All offsets are checked against the bytes that are there; what is damaged is left out, never an error.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query, table

# EXIF tags by number, bytes of each TIFF type, IPTC fields, and the pointers to further directories.
TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0xA431: "BodySerialNumber"}
GPS = {1: "LatitudeRef", 2: "Latitude", 3: "LongitudeRef", 4: "Longitude", 5: "AltitudeRef", 6: "Altitude"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
IPTC = {5: "ObjectName", 25: "Keywords", 80: "Byline", 90: "City", 101: "Country", 116: "Copyright", 120: "Caption"}
POINTERS = {0x8769: "exif", 0x8825: "gps"}


def jpeg_segments(data: bytes):
    """(marker, payload) up to the scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def png_chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def webp_chunks(data: bytes):
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            return
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def exif(tiff: bytes) -> dict[str, str]:
    """Named tags of all directories of a TIFF block; a directory is read once, whatever points to it."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    out: dict[str, str] = {}
    todo, seen = [(struct.unpack(order + "I", tiff[4:8])[0], "main")], set()
    while todo:
        at, kind = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        count = struct.unpack(order + "H", tiff[at : at + 2])[0]
        for k in range(count):
            e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(e) < 12:
                break
            tag, form, n = struct.unpack(order + "HHI", e[:8])
            size = SIZES.get(form, 0) * n
            start = struct.unpack(order + "I", e[8:])[0] if size > 4 else at + 10 + 12 * k
            if not size or start + size > len(tiff):
                continue
            raw = tiff[start : start + size]
            if tag in POINTERS and form == 4:
                todo.append((struct.unpack(order + "I", raw[:4])[0], POINTERS[tag]))
            elif name := (GPS if kind == "gps" else TAGS).get(tag):
                out[f"gps.{name}" if kind == "gps" else name] = _value(raw, form, n, order)
    return out


def _value(raw: bytes, form: int, n: int, order: str) -> str:
    if form in (1, 2, 7):
        return str(raw[0]) if form == 1 and n == 1 else raw.split(b"\0")[0].decode("latin-1").strip()
    if form in (5, 10):
        pairs = struct.unpack(order + ("II" if form == 5 else "ii") * n, raw)
        return " ".join(f"{a / b:.9g}" if b else "nan" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return " ".join(map(str, struct.unpack(order + {3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}[form] * n, raw)))


def degrees(value: str, ref: str) -> float | None:
    """Degrees, minutes and seconds as one number, negative in the south and west."""
    parts = [float(x) for x in value.split()]
    if len(parts) != 3 or any(x != x for x in parts):
        return None
    return (-1 if ref in ("S", "W") else 1) * (parts[0] + parts[1] / 60 + parts[2] / 3600)


def iptc(block: bytes) -> dict[str, str]:
    """Named fields of the text records within image resource blocks."""
    out: dict[str, str] = {}
    at = block.find(b"8BIM\x04\x04")
    data = block[at + 6 :] if at >= 0 else b""
    k = data.find(b"\x1c\x02")
    while 0 <= k and k + 5 <= len(data) and data[k] == 0x1C:
        size = int.from_bytes(data[k + 3 : k + 5], "big")
        if name := IPTC.get(data[k + 2]):
            text = data[k + 5 : k + 5 + size].decode("utf-8", "replace")
            out[name] = f"{out[name]}, {text}" if name in out else text
        k += 5 + size
    return out


def xmp(packet: bytes) -> dict[str, str]:
    """Simple properties of an XMP packet; one with a document type, or of over a million characters, is not read."""
    text = packet.decode("utf-8", "replace")
    if len(text) > 1_000_000 or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return {}
    out = {m[1]: m[2].strip() for m in re.finditer(r"<((?:dc|xmp|photoshop|xmpRights):\w+)>([^<]+)</", text)}
    out |= {m[1]: re.sub(r"<[^>]*>", " ", m[2]).strip() for m in re.finditer(r"<((?:dc|xmp|photoshop|xmpRights):\w+)>\s*(<rdf:(?:Alt|Bag|Seq)>.*?)</\1>", text, re.S)}
    return out | {m[1]: m[2] for m in re.finditer(r'((?:dc|xmp|photoshop|xmpRights):\w+)="([^"]*)"', text)}


def metadata(data: bytes | None) -> dict[str, str]:
    """All named metadata of an image, by exif:, iptc: and xmp: names, with width and height where the header has them."""
    found: dict[str, dict[str, str]] = {"exif": {}, "iptc": {}, "xmp": {}}
    size: dict[str, str] = {}
    data = data or b""
    if data[:2] == b"\xff\xd8":
        for marker, body in jpeg_segments(data):
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                found["exif"] |= exif(body[6:])
            elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                found["xmp"] |= xmp(body[29:])
            elif marker == 0xED:
                found["iptc"] |= iptc(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                size = {"height": str(int.from_bytes(body[1:3], "big")), "width": str(int.from_bytes(body[3:5], "big"))}
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        for name, body in png_chunks(data):
            if name == b"IHDR" and len(body) >= 8:
                size = {"width": str(int.from_bytes(body[:4], "big")), "height": str(int.from_bytes(body[4:8], "big"))}
            elif name == b"eXIf":
                found["exif"] |= exif(body)
            elif name == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
                found["xmp"] |= xmp(body[22:])
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        for name, body in webp_chunks(data):
            if name == b"EXIF":
                found["exif"] |= exif(body.removeprefix(b"Exif\0\0"))
            elif name == b"XMP ":
                found["xmp"] |= xmp(body)
    elif data[:4] == b"GIF8" and len(data) >= 10:
        size = {"width": str(int.from_bytes(data[6:8], "little")), "height": str(int.from_bytes(data[8:10], "little"))}
    return size | {f"{k}:{n}": v for k, own in found.items() for n, v in own.items() if v}


def with_metadata(images: DataFrame) -> DataFrame:
    """asset_id and its metadata as a map, of the binary column bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(metadata(x).items()) for x in b.column(1).to_pylist()], pa.map_(pa.string(), pa.string()))], ["asset_id", "meta"])

    return images.select("asset_id", "bytes").mapInArrow(run, "asset_id long, meta map<string,string>")


def leaks(found: DataFrame) -> DataFrame:
    """asset_id and the kinds of metadata that say where, when, by whom or with what an image was made."""
    keys = F.map_keys("meta")
    has = lambda p: F.exists(keys, lambda k: k.rlike(p))
    kinds = {"GPS": "^exif:gps", "AUTHOR": "Artist|Byline|creator", "DEVICE": "Make|Model|Serial", "SOFTWARE": "Software|CreatorTool", "TIME": "DateTime|CreateDate", "RIGHTS": "Copyright|rights"}
    said = F.concat_ws("+", *[F.when(has(p), k) for k, p in kinds.items()])
    return found.select("asset_id", said.alias("leaks")).where("leaks <> ''")


def _pictures(spark, sf_dir) -> DataFrame:
    """A PNG for each part, of which some hold an EXIF chunk: made from bytes, as the tables have no images."""
    tiff = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHII", 0x0110, 2, 6, 38) + struct.pack("<HHII", 0x0131, 2, 4, int.from_bytes(b"abc\0", "little")) + b"\0\0\0\0" + b"Cam X\0"
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("asset_id"), 8, "0"), F.lit("00000040080200000000000000"))
    chunk = F.lit((len(tiff).to_bytes(4, "big") + b"eXIf" + tiff + b"\0\0\0\0").hex())
    return table(spark, sf_dir, "assets").select("asset_id", F.unhex(F.concat(head, F.when(F.col("asset_id") % 3 == 0, chunk).otherwise(""))).alias("bytes"))


@query("b4_image_metadata")
def b4(spark, sf_dir):
    return with_metadata(_pictures(spark, sf_dir)).select("asset_id", F.explode("meta").alias("name", "value"))


@query("b8_metadata_leaks", "select p_partkey as asset_id, 'DEVICE+SOFTWARE' as leaks from part where p_partkey % 3 = 0")
def b8(spark, sf_dir):
    return leaks(with_metadata(_pictures(spark, sf_dir)))


@query("b3_png_dimensions", "select p_partkey as asset_id, cast(p_partkey as bigint) as width, cast(64 as bigint) as height from part")
def b3(spark, sf_dir):
    """Straight from the header's bytes, without a Python worker."""
    part = lambda at: F.conv(F.hex(F.substring("bytes", at, 4)), 16, 10).cast("long")
    return _pictures(spark, sf_dir).select("asset_id", part(17).alias("width"), part(21).alias("height"))
