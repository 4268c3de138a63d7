"""XML topologies: bytes from any store that Spark reads, decoded and checked, a file a row, ids in file order."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Byte order marks and their encodings, the longer ones first.
MARKS = [(codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
#: How "<?" and "<" look without a mark.
STARTS = [(b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be"), (b"<\0", "utf-16-le"), (b"\0<", "utf-16-be")]


def detect_encoding(raw: bytes, name: str = "") -> tuple[str, int]:
    """(encoding, bytes of its mark): by the mark, else by the first bytes, else as declared, else UTF-8.

    A declaration that the bytes contradict is an error, and so is one of an unknown encoding.
    """
    found, skip = next(((e, len(m)) for m, e in MARKS if raw.startswith(m)), (None, 0))
    if found is None:
        found = next((e for m, e in STARTS if raw.startswith(m)), None)
    head = raw[skip : skip + 1024].decode(found or "latin-1", "ignore")
    declared = re.match(r"""<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z][\w.\-]*)["']""", head)
    if not declared:
        return found or "utf-8", skip
    try:
        own = codecs.lookup(declared[1]).name
    except LookupError:
        raise ValueError(f"{name}: unknown encoding {declared[1]!r}") from None
    if found is None and not re.match("utf-(16|32)", own):
        return own, skip
    if found is None or (own != found and not (own in ("utf-16", "utf-32") and found.startswith(own))):
        raise ValueError(f"{name}: declared as {declared[1]}, but written in {found or 'single bytes'}")
    return found, skip


def decoded(raw: bytes, name: str = "") -> Iterator[str]:
    """The text in pieces; a bad byte is an error that names the file and the byte's offset."""
    encoding, at = detect_encoding(raw, name)
    decoder = codecs.getincrementaldecoder(encoding)()
    while True:
        piece, held = raw[at : at + CHUNK], len(decoder.getstate()[0])
        try:
            yield decoder.decode(piece, final=at + CHUNK >= len(raw))
        except UnicodeDecodeError as e:
            raise ValueError(f"{name}: bad byte at offset {at - held + e.start} ({encoding}: {e.reason})") from None
        at += CHUNK
        if at >= len(raw):
            return


NODE, LINK = "id long, label string, x double, y double", "id long, label string, src long, dst long, capacity double, cost double"


def _number(text: str | None, name: str, what: str) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        raise ValueError(f"{name}: {what} is no number: {text!r}") from None


def parse_topology(raw: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """(nodes, links) of one SNDlib file in file order; what is not well formed, repeated or unknown is an error with the file's name."""
    parser = ElementTree.XMLPullParser(["end"])
    nodes, links, ids = [], [], {}
    try:
        for text in decoded(raw, name):
            parser.feed(text)
        parser.close()
    except ElementTree.ParseError as e:
        raise ValueError(f"{name}: {e}") from None
    for _, element in parser.read_events():
        tag = element.tag.rpartition("}")[2]
        own = {c.tag.rpartition("}")[2]: c for c in element.iter()}
        value = lambda key: own[key].text.strip() if key in own and own[key].text else None
        if tag == "node":
            label = element.get("id")
            if label is None or label in ids:
                raise ValueError(f"{name}: node id missing or repeated: {label!r}")
            ids[label] = len(nodes)
            nodes.append({"id": len(nodes), "label": label, "x": _number(value("x"), name, "x"), "y": _number(value("y"), name, "y")})
        elif tag == "link":
            ends = [value("source"), value("target")]
            unknown = [e for e in ends if e not in ids]
            if unknown:
                raise ValueError(f"{name}: unknown link end {unknown[0]!r}")
            module = own.get("preInstalledModule")
            part = {c.tag.rpartition("}")[2]: c.text for c in module.iter()} if module is not None else {}
            links.append({"id": len(links), "label": element.get("id"), "src": ids[ends[0]], "dst": ids[ends[1]], "capacity": _number(part.get("capacity"), name, "capacity") or 0.0, "cost": _number(part.get("cost"), name, "cost") or 0.0})
        if tag in ("node", "link"):
            element.clear()
    return nodes, links


def read_sndlib(spark: SparkSession, path: str, copy_capacity_as_cost: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of all SNDlib topologies of a file or folder, ``network`` being the file's name.

    Ids are in file order, for each file by itself; cost columns copy the capacities unless told otherwise.
    """
    from ..operators.storage import saved

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.list_(pa.struct([("id", pa.int64()), ("label", pa.string()), ("x", pa.float64()), ("y", pa.float64())])), pa.list_(pa.struct([("id", pa.int64()), ("label", pa.string()), ("src", pa.int64()), ("dst", pa.int64()), ("capacity", pa.float64()), ("cost", pa.float64())]))]
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, links = parse_topology(raw, name)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((re.sub(r".*/|\.[^./]*$", "", name), nodes, links), types)], names=["network", "nodes", "links"])

    found = saved(files.mapInArrow(run, f"network string, nodes array<struct<{NODE}>>, links array<struct<{LINK}>>".replace(" long", ": bigint").replace(" double", ": double").replace("label string", "label: string")))
    nodes = found.select("network", F.explode("nodes").alias("n")).select("network", "n.*")
    links = found.select("network", F.explode("links").alias("e")).select("network", "e.*")
    return nodes, links.withColumn("cost", F.col("capacity")) if copy_capacity_as_cost else links
