"""CSV, GML, SNDlib XML, JSON and YAML sources and sinks."""

from __future__ import annotations

import csv
import html
import io
import itertools
import json
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 text cells; duplicate column names and ragged rows are errors."""
    df = spark.read.options(**CSV_OPTIONS).csv(path)
    validate_columns(df.columns)
    return df


def validate_columns(names: Sequence[str]) -> None:
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate columns: {repeated}")


def typed(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Trimmed cells as types; a bad cell is an error, or null where not ``strict``."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise KeyError(f"unknown columns: {missing}")
    return df.withColumns({c: (F.trim(c).cast(t) if strict else F.trim(c).try_cast(t)) for c, t in types.items()})


def path_exists(spark, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CRLF part files; appending needs the columns that are there."""
    if append and path_exists(df.sparkSession, path):
        there = df.sparkSession.read.options(**CSV_OPTIONS).csv(path).columns
        if there != df.columns:
            raise ValueError(f"columns differ: {there}")
    df.write.options(header=True, quote='"', escape='"', lineSep="\r\n").csv(path, mode="append" if append else "errorifexists")


def write_csv_file(rows: Sequence[dict], path: str, append: bool = False) -> None:
    """One small file from driver rows; the header once, and it must match when appending."""
    names = list(rows[0]) if rows else []
    exists = append and os.path.exists(path) and os.path.getsize(path) > 0
    if exists:
        with open(path, newline="", encoding="utf-8-sig") as f:
            if next(csv.reader(f), []) != names:
                raise ValueError("columns differ")
    with open(path, "a" if append else "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, names)
        if not exists:
            writer.writeheader()
        writer.writerows(rows)


# --- GML -------------------------------------------------------------------------------------

_GML = re.compile(r'\s*(?:#[^\n]*\n\s*)*(?:([A-Za-z_][\w]*)|([-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?|[-+]?(?:INF|NAN))|"([^"]*)"|(\[)|(\]))')


def gml_entries(text: str, inside: str | None = None) -> Iterator[tuple[str | None, str, object]]:
    """(within, key, value) of the entries of a text, one at a time; a value is a number, a string or an ordered list of (key, value).

    The entries of lists under the key ``inside`` come by themselves as they are read, within that key, and the list itself last
    and empty, so that a long list is never held.
    """
    at, stack, key = 0, [[]], None
    names: list[str] = []
    text = text.strip()
    while at < len(text):
        m = _GML.match(text, at)
        if not m:
            raise ValueError(f"bad GML at {at}: {text[at : at + 20]!r}")
        at = m.end()
        name, number, string, begin, end = m.groups()
        if key is not None and name in ("NAN", "INF"):
            name, number = None, name
        if end:
            if key is not None or len(stack) == 1:
                raise ValueError("unbalanced ]")
            own = stack.pop()
            stack[-1].append((names.pop(), own))
        elif key is None:
            if name is None:
                raise ValueError(f"a key is missing at {at}")
            key = name
            continue
        else:
            if begin:
                stack.append([])
                names.append(key)
                key = None
                continue
            elif string is not None:
                stack[-1].append((key, html.unescape(string)))
            elif number is not None:
                stack[-1].append((key, float(number) if re.search(r"[.eEIN]", number) else int(number)))
            else:
                raise ValueError(f"bad value {name!r}")
            key = None
        if not names or names == [inside]:
            yield (names[0] if names else None, *stack[-1].pop())
    if len(stack) > 1 or key is not None:
        raise ValueError("unfinished GML")


def parse_gml(text: str) -> list[tuple[str, object]]:
    """Ordered (key, value) pairs; a value is a number, a string or such a list."""
    return [(key, value) for _, key, value in gml_entries(text)]


def fold(pairs: list[tuple[str, object]]) -> dict:
    """Repeated keys become lists; nested lists become dicts; ``_networkx_list_start`` marks one-element lists."""
    out: dict = {}
    for key, value in pairs:
        value = fold(value) if isinstance(value, list) else value
        if key in out:
            if not isinstance(out[key], list):
                out[key] = [out[key]]
            out[key].append(value)
        else:
            out[key] = value
    return {k: v[1:] if isinstance(v, list) and v and v[0] == "_networkx_list_start" else v for k, v in out.items()}


def gml_rows(text: str, kind: str, rest: list | None = None) -> Iterator[dict]:
    """The ``nodes`` or the ``links`` of the one graph of a text as they are read, then the checks: multigraphs, repeated ids or
    links and unknown ends are errors. Only ids and ends are held; what is neither node nor link goes to ``rest``."""
    ids, ends, rest, graphs = set(), [array("q"), array("q")], [] if rest is None else rest, 0
    for within, key, value in gml_entries(text, "graph"):
        if within is None:
            graphs += key == "graph" and isinstance(value, list)
        elif key == "node":
            row = fold(value)
            if row["id"] in ids:
                raise ValueError("duplicate node id")
            ids.add(row["id"])
            if kind == "nodes":
                yield row
        elif key == "edge":
            row = fold(value)
            for own, end in zip(ends, ("source", "target")):
                own.append(row[end])
            if kind == "links":
                yield row
        else:
            rest.append((key, value))
    if graphs != 1:
        raise ValueError("one graph is needed")
    graph = fold(rest)
    if graph.get("multigraph", 0):
        raise ValueError("multigraphs are not supported")
    u, v = (np.frombuffer(e, np.int64) if e else np.zeros(0, np.int64) for e in ends)
    if not graph.get("directed", 0):
        u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    if ((u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1])).any():
        raise ValueError("duplicate link")
    if not all(x in ids for e in ends for x in e):
        raise ValueError("unknown link end")


def load_gml(text: str) -> dict:
    """{directed, graph, nodes, links}; multigraphs, repeated ids or links and unknown ends are errors."""
    rest: list = []
    nodes, links = list(gml_rows(text, "nodes", rest)), list(gml_rows(text, "links"))
    graph = fold(rest)
    directed = bool(graph.pop("directed", 0))
    graph.pop("multigraph", 0)
    return {"directed": directed, "graph": graph, "nodes": nodes, "links": links}


def _gml_escape(s: str) -> str:
    return "".join(c if 32 <= ord(c) < 127 and c not in '&"' else f"&#{ord(c)};" for c in s)


def _gml_number(value) -> str:
    if value != value:
        return "NAN"
    return repr(value) if abs(value) != float("inf") else "+INF" if value > 0 else "-INF"


def gml_lines(key: str, value, indent: int = 1) -> Iterator[str]:
    """The lines of one entry; one-element lists are marked, empty ones have no lines."""
    pad = "  " * indent
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, dict):
        yield f"{pad}{key} ["
        for k, v in value.items():
            yield from gml_lines(k, v, indent + 1)
        yield f"{pad}]"
    elif isinstance(value, (list, tuple)):
        if len(value) == 1:
            yield f'{pad}{key} "_networkx_list_start"'
        for v in value:
            yield from gml_lines(key, v, indent)
    elif isinstance(value, (int, float)):
        yield f"{pad}{key} {_gml_number(value)}"
    else:
        yield f'{pad}{key} "{_gml_escape(str(value))}"'


def dump_gml(network: dict) -> str:
    out = ["graph ["]
    if network.get("directed"):
        out.append("  directed 1")
    for k, v in network.get("graph", {}).items():
        out += gml_lines(k, v)
    for n in network["nodes"]:
        out += gml_lines("node", n)
    for e in network["links"]:
        out += gml_lines("edge", e)
    return "\n".join([*out, "]"]) + "\n"


class _GmlFiles(InputPartition):
    """The paths of some GML files."""


PART_FILES, PART_BYTES = 2_000, 8 << 20


def _in_parts(files: list[tuple[str, int]]) -> list[_GmlFiles]:
    """Files (path, bytes) in partitions of up to ``PART_FILES`` files and about ``PART_BYTES``; a larger file is one of its own."""
    parts: list[list[str]] = []
    held = 0
    for path, size in files:
        if not parts or len(parts[-1]) == PART_FILES or held + size > PART_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(path)
        held += size
    return [_GmlFiles(p) for p in parts]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, or any store that Arrow opens), and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class GmlReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.kind = options["path"], options.get("kind", "nodes")

    def partitions(self):
        store, root = opened(self.folder)
        if store.get_file_info(root).type == fs.FileType.File:
            return [_GmlFiles([root])]
        found = store.get_file_info(fs.FileSelector(root))
        return _in_parts(sorted((f.path, f.size or 0) for f in found if f.path.endswith(".gml")))

    def read(self, partition):
        store, _ = opened(self.folder)
        for path in partition.value:
            with store.open_input_stream(path) as f:
                text = f.read().decode("utf-8")
            yield from self._rows(Path(path).stem, gml_rows(text, self.kind))

    def _rows(self, name, rows):
        for i, row in enumerate(rows):
            if self.kind == "nodes":
                yield name, row["id"], None, None, json.dumps({k: v for k, v in row.items() if k != "id"})
            else:
                yield name, i, row["source"], row["target"], json.dumps({k: v for k, v in row.items() if k not in ("source", "target")})


@dataclass
class _GmlWritten(WriterCommitMessage):
    folder: str
    names: list[str]


class GmlWriter(DataSourceWriter):
    """Rows (network, id, src, dst, attributes), those of a network together and nodes first, to one file a network.

    A task writes into a folder of its own under ``_temporary``; committing the job moves the files of the tasks that
    ended well, aborting it deletes the folder, so that a failed job leaves no file.
    """

    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite, self.directed = options["path"], overwrite, options.get("directed", "false") == "true"
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, rows):
        store, root = opened(self.folder)
        own, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for network, group in itertools.groupby(rows, key=lambda r: r["network"]):
            names.append(f"{network}.gml")
            with store.open_output_stream(f"{own}/{names[-1]}") as f:
                f.write(b"graph [\n  directed 1\n" if self.directed else b"graph [\n")
                for r in group:
                    rest = {k: v for k, v in json.loads(r["attributes"] or "{}").items() if v is not None}
                    lines = gml_lines("node", {"id": r["id"], **rest}) if r["src"] is None else gml_lines("edge", {"source": r["src"], "target": r["dst"], **rest})
                    f.write("".join(f"{line}\n" for line in lines).encode())
                f.write(b"]\n")
        return _GmlWritten(own, names)

    def commit(self, messages):
        store, root = opened(self.folder)
        names = [n for m in messages if m for n in m.names]
        there = {Path(f.path).name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".gml")}
        twice = {n for n, k in Counter(names).items() if k > 1}
        if twice or (there & set(names) and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"networks of several tasks, or there already: {sorted(twice or there & set(names))[:5]}")
        for name in there if self.overwrite else ():
            store.delete_file(f"{root}/{name}")
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        store, root = opened(self.folder)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)) and store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


class GmlSource(DataSource):
    """``spark.read.format("gml").option("kind", "nodes" | "links").load(path)``: a row for each node or
    link of every GML file of a path, attributes as JSON; a partition holds many small files or one large one. Writing takes such rows,
    clustered by network (see ``write_networks``)."""

    @classmethod
    def name(cls):
        return "gml"

    def schema(self):
        return "network string, id long, src long, dst long, attributes string"

    def reader(self, schema):
        return GmlReader(self.options)

    def writer(self, schema, overwrite):
        return GmlWriter(self.options, overwrite)


def register_gml(spark: SparkSession) -> None:
    spark.dataSource.register(GmlSource)


# --- settings --------------------------------------------------------------------------------


def read_setting(path: str):
    """JSON or YAML by suffix; integers of any size."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    if path.endswith((".yaml", ".yml")):
        return yaml.safe_load(text)
    raise ValueError(f"unknown setting format: {path}")


def write_setting(value, path: str) -> None:
    if path.endswith(".json"):
        text = json.dumps(value, indent=4)
    elif path.endswith((".yaml", ".yml")):
        out = io.StringIO()
        yaml.safe_dump(value, out, sort_keys=False, allow_unicode=True)
        text = out.getvalue()
    else:
        raise ValueError(f"unknown setting format: {path}")
    Path(path).write_text(text, encoding="utf-8")
