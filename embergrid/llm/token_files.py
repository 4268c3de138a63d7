"""Operator 6: token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt to parts in ascending doc_id order; each part is one ``part-N.bin`` of
little-endian ids (16 bits where the vocabulary fits, else 32) and one ``part-N.idx``: the magic
``EMBRTOK2``, the id width, the number of documents, the doc ids, n+1 offsets into the part, all
64-bit, and a byte for each document that says whether its id is null. The manifest, a table with a
row for each part, holds the bases: prefix sums of the ids of all parts before it, taken over blocks
of parts first. Files are written under a task's own name and renamed, so a repeated or lost task
leaves whole files only; they are read back by memory map where the folder is mounted.

A batch of texts is cut at single spaces, and its distinct chunks are encoded together: in a text
without double, leading or trailing spaces byte-level pre-tokens never reach over a space, so the
ids are those of the whole text. All other texts, those with the string of a special token, and all
texts under a tokenizer of another kind are encoded whole. A task remembers its first ``KNOWN``
chunks of at most ``KNOWN_BYTES`` bytes each, and forgets them when it ends.

Defined results: a null or empty text is its end id alone; rows of equal doc_id follow each other
in order of a hash of their texts, then of their texts, so that a hot doc_id spreads over parts;
null doc ids come first. Strings of special tokens get the ids that the library gives them; with
``special_as_text`` they are ordinary text. Extra columns play no part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, new_path, small_batches, trimmed, written

END_ID = 2
MAGIC = b"EMBRTOK2"
PART_DOCS = 8192
PART_BLOCK = 4096
JOINED = 256
KNOWN, KNOWN_BYTES = 200_000, 32
_encoders: dict[tuple[str, bool], "BatchEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class BatchEncoder:
    """Encodes a column of texts to flat ids and a count for each text."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.specials = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        self.by_chunks = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex and self.tokenizer.normalizer is None
        self.opens = np.zeros(size, dtype=bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.held = (np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _looked_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of a space and each distinct chunk, remembered or encoded."""
        found = pc.index_in(chunks, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        missing = chunks.filter(pa.array(new))
        flat, starts, sizes = self._chunks(missing.to_pylist())
        held, at, lengths = self.held
        every = np.concatenate([held, flat])
        pick = found.fill_null(0).to_numpy().astype(np.int64)
        pick[new] = len(at) + np.arange(len(missing))
        at, lengths = np.concatenate([at, len(held) + starts]), np.concatenate([lengths, sizes])
        keep = np.flatnonzero(pc.less_equal(pc.binary_length(missing), KNOWN_BYTES).to_numpy(zero_copy_only=False))[: KNOWN - len(self.known)]
        if len(keep):
            old = len(self.known)
            own = _ragged(flat, starts[keep], sizes[keep])
            self.known = pa.concat_arrays([self.known, missing.take(pa.array(keep))])
            self.held = (np.concatenate([held, own]), np.concatenate([at[:old], len(held) + np.cumsum(sizes[keep]) - sizes[keep]]), np.concatenate([lengths[:old], sizes[keep]]))
        return every, at[pick], lengths[pick]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter((i for x in own for i in x), self.dtype, int(sizes.sum())), sizes

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of a space and each chunk; many are encoded as one text, a chunk begins where an id opens with a space."""
        flat, _ = self._whole([" " + " ".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)])
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) == len(chunks):
            return flat, starts, np.diff(np.append(starts, len(flat)))
        flat, sizes = self._whole([" " + c for c in chunks])
        return flat, np.cumsum(sizes) - sizes, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        whole = pc.equal(column, "")
        if self.by_chunks:
            for found in (pc.match_substring(column, "  "), pc.starts_with(column, " "), pc.ends_with(column, " "), *(pc.match_substring(column, s) for s in self.specials)):
                whole = pc.or_(whole, found)
            whole = whole.to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(n, dtype=bool)
        flat, sizes = self._whole(column.filter(pa.array(whole)).to_pylist())
        if whole.all():
            return flat, sizes
        # without a space before it, a text's first chunk has ids of its own
        split = pc.split_pattern(column.filter(pa.array(~whole)), " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        index, known = coded.indices.to_numpy(), len(coded.dictionary)
        a, starts, lengths = self._looked_up(coded.dictionary)
        b, own = self._whole(split.flatten().take(pa.array(bounds[:-1])).to_pylist())
        index = index.copy()
        index[bounds[:-1]] = known + np.arange(len(bounds) - 1)
        starts, lengths = np.concatenate([starts, len(a) + np.cumsum(own) - own]), np.concatenate([lengths, own])
        ids = _ragged(np.concatenate([a, b]), starts[index], lengths[index])
        total = np.concatenate([[0], np.cumsum(lengths[index])])
        by_chunks = np.diff(total[bounds])
        every = np.zeros(n, np.int64)
        every[whole], every[~whole] = sizes, by_chunks
        if not whole.any():
            return ids, every
        at = np.zeros(n, np.int64)
        at[whole], at[~whole] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(by_chunks) - by_chunks
        return _ragged(np.concatenate([flat, ids]), at, every), every


def encoder(path: str, special_as_text: bool = False) -> BatchEncoder:
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = BatchEncoder(path, special_as_text)
    return _encoders[key]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def _put(fs: pafs.FileSystem, path: str, chunks) -> None:
    """Write under a name of its own, then rename."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(temporary, path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, part_docs: int = PART_DOCS, special_as_text: bool = False) -> DataFrame:
    """Encode (doc_id, text) into ``folder``; gives the manifest (part, docs, tokens, first_doc, base), which lies beside the files."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, -(-docs.count() // part_docs))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, special_as_text)
        fs, root = _filesystem(folder)
        enc.forget()
        keys, nulls, counts = [], [], [np.zeros(0, np.int64)]

        def encoded():
            for batch in batches:
                own = batch.column(0)
                keys.append(own.fill_null(0).to_numpy())
                nulls.append(own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                ids, sizes = enc.encode(batch.column(1))
                counts.append(sizes + 1)
                yield np.insert(ids, np.cumsum(sizes), end_id).tobytes()

        name = f"{root}/part-{part:06d}"
        _put(fs, f"{name}.bin", encoded())
        enc.forget()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")
        docs = len(offsets) - 1
        _put(fs, f"{name}.idx", [MAGIC, np.array([enc.dtype.itemsize, docs], dtype="<i8").tobytes(), *[k.astype("<i8").tobytes() for k in keys], offsets.tobytes(), *[x.tobytes() for x in nulls]])
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [int(offsets[-1])]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = written(ordered.mapInArrow(trimmed(run), "part int, docs long, tokens long"), "parts")
    path = f"{folder}/manifest"
    with_bases(rows).write.parquet(path)
    return spark.read.parquet(path)


def with_bases(parts: DataFrame, block: int = PART_BLOCK) -> DataFrame:
    """``first_doc`` and ``base``: prefix sums of docs and tokens within blocks of parts, and over the blocks' sums."""
    rows = parts.withColumn("block", F.floor(F.col("part") / block))
    every = Window.partitionBy("one").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).withColumn("one", F.lit(0))
    sums = sums.select(F.col("block").alias("b"), *[F.coalesce(F.sum(c).over(every), F.lit(0)).alias(c) for c in ("d", "t")])
    inner = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"own_{c}") for c in ("docs", "tokens")])
    out = rows.join(sums, F.col("block") == F.col("b"))
    return out.select("part", "docs", "tokens", (F.col("d") + F.col("own_docs")).alias("first_doc"), (F.col("t") + F.col("own_tokens")).alias("base"))


def open_part(folder: str, part: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, offsets, token ids) of a part; the ids are memory-mapped on a mounted folder."""
    fs, root = _filesystem(folder)
    name = f"{root}/part-{part:06d}"
    with fs.open_input_stream(f"{name}.idx") as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.idx is no token index")
    width, n = (int(x) for x in np.frombuffer(raw, "<i8", 2, 8))
    keys, offsets = np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, "<i8", n + 1, 24 + 8 * n)
    nulls = np.frombuffer(raw, np.uint8, n, 32 + 16 * n).astype(bool)
    keys, dtype = pa.array(keys, pa.int64(), mask=nulls), f"<u{width}"
    if not offsets[-1]:
        return keys, offsets, np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return keys, offsets, np.memmap(f"{name}.bin", dtype=dtype, mode="r")
    with fs.open_input_stream(f"{name}.bin") as f:
        return keys, offsets, np.frombuffer(f.read(), dtype)


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, offsets, ids = open_part(folder, part)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([keys, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a part is a task's work
    tasks = max(1, manifest.count())
    return manifest.select("part", "base").repartition(tasks, "part").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read_tokens(folder, write_tokens(documents(spark, sf_dir), folder))
