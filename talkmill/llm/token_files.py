"""Token ids in binary files: each document compressed alone, with one shared dictionary.

A file (``.tok``) holds documents in ascending doc_id order::

    header   8 bytes magic, 4 bytes id width, 8 bytes xxh64 of the dictionary
    frames   one zstandard frame a document: its ids, little-endian, compressed
             with the shared dictionary
    index    24 bytes a document: doc_id (signed), offset of the frame, ids
    footer   8 bytes offset of the index, 8 bytes number of documents, 8 bytes how
             many of them, at the front, have no doc_id, 8 bytes magic

The dictionary lies beside the files. A reader checks its hash, reads footer and
index, and can then fetch one short document without touching the others. Ids
take two bytes where the vocabulary allows it, else four.

The dictionary is trained on a bounded sample (see :func:`train_dictionary`); it
affects the size of the files only, never their content. Every document is written.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.bytewords import layout
from talkmill.llm.chunks import Remembered
from talkmill.llm.shared import fresh_path, materialise, set_quiet_threads, slices

MAGIC = b"TOKFILE2"
HEADER, FOOTER = struct.Struct("<8sIQ"), struct.Struct("<QQQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
END_ID = 2
SAMPLE, DICTIONARY_BYTES = 400, 1 << 16
#: A sample document is cut into pieces of so many ids, of which so many are used.
PIECE_IDS, MOST_PIECES = 1024, 4096
#: Text bytes aimed at in one file.
FILE_BYTES = 128_000_000
MOST_CHUNKS = 500_000
SLICE_BYTES = 6_000_000
CHUNKS_A_CALL = 200

_BYTE = np.arange(256)
#: Printable ASCII, its letters, white space, and bytes that can't begin white space of any kind.
_SOLID = (_BYTE > 0x20) & (_BYTE < 0x7F)
_LETTER = np.isin(_BYTE, np.frombuffer(string.ascii_letters.encode(), np.uint8))
_BLANK = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_FIRM = _SOLID | (_BYTE >= 0xC3) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3, 0xEF])
#: (byte, next byte) between which every split of this kind has a cut: a word's end, and the blank behind something.
_CUT = _SOLID[:, None] & _BLANK[None, :] | _LETTER[:, None] & ((_BYTE < 128) & ~_LETTER)[None, :]

_encoders: dict[tuple[str, int], Encoder] = {}


def find_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin. Cuts are sure ones of the pre-tokenizer's pattern only.

    Its pattern never looks back, so a chunk that begins at a cut is split alike
    alone and in its text. A blank before something solid begins a piece (of
    white space, the pattern leaves the last); letters end before other ASCII; a lone line feed
    is a piece. Wherever that isn't sure, there is no cut and the chunk is longer.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        cut[1:] = _CUT.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        firm = _FIRM[data]
        cut[:-1] |= (data[:-1] == 32) & firm[1:]
        cut[2:] |= (data[1:-1] == 10) & _SOLID[data[:-2]] & firm[2:]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, equal to those of the tokenizers library.

    Texts are cut where the library's pre-tokenizer surely cuts; each distinct chunk is
    encoded by the library once and remembered. New chunks that begin with their only
    blank go to it together in one call, and are told apart in its answer by the tokens that
    begin with a blank; if those are not as many as the chunks, and for other chunks,
    each goes alone. Texts that hold an added token, or tokenizer files of another kind,
    go to the library whole.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        set_quiet_threads()
        self.kind = "<u2" if width == 2 else "<u4"
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.cuts = self._cuts_alike()
        vocabulary = self.library.get_vocab(True)
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.blank_first[i] = token.startswith("\u0120")
        self.chunks = Remembered(self._learn, self.kind, MOST_CHUNKS)

    def _cuts_alike(self) -> bool:
        import json

        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("post_processor") is None

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids; a null text is empty."""
        data, offsets = layout(texts)
        if not self.cuts:
            return self._whole([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)])
        cuts = find_cuts(data, offsets)
        ids, at = self.chunks.gather(data, cuts)
        ends = at[np.searchsorted(cuts, offsets)].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            parts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            special = [i for i, part in enumerate(parts) if any(a in part for a in self.added)]
            for i, x in zip(special, self._whole([parts[i] for i in special]), strict=True):
                out[i] = x
        return out

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(new)
        together = [i for i, c in enumerate(new) if c[0] == 32 and len(c) > 1 and _FIRM[c[1]] and c.count(b" ") == 1]
        for begin in range(0, len(together), CHUNKS_A_CALL):
            some = together[begin : begin + CHUNKS_A_CALL]
            (ids,) = self._whole([b"".join([new[i] for i in some])])
            first = np.flatnonzero(self.blank_first[ids]).tolist()
            if len(first) == len(some):
                for i, a, b in zip(some, first, [*first[1:], len(ids)], strict=True):
                    found[i] = ids[a:b]
        alone = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(alone, self._whole([new[i] for i in alone]), strict=True):
            found[i] = x
        return np.concatenate(found), np.array(list(map(len, found)), np.int64)


def encoder(path: str, width: int) -> Encoder:
    """One encoder a Python worker."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def _sample_pieces(path: str, width: int):
    """Whole sample documents as serialized ids, in pieces."""
    end = END_ID.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x.tobytes() + end for x in encoder(path, width).encode(batch.column("text"))]
            step = PIECE_IDS * width
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + step] for x in raw for i in range(0, len(x), step)], pa.binary())], names=["piece"])

    return run


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int) -> bytes:
    """A zstandard dictionary from a bounded sample; empty only for an empty table.

    The sample: SAMPLE documents, the first by a hash of id and text, whole, cut into pieces of
    PIECE_IDS ids, of which the first MOST_PIECES by hash count. Where they are too
    few for the trainer, they are the dictionary themselves (plain content).
    """
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(SAMPLE)
    texts = keyed.join(F.broadcast(chosen), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    pieces = texts.mapInArrow(_sample_pieces(tokenizer_path, width), "piece binary").orderBy(F.xxhash64("piece"), "piece").limit(MOST_PIECES).collect()
    samples = [bytes(r["piece"]) for r in pieces]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sorted(set(samples)))[:DICTIONARY_BYTES]


def _compress(tokenizer_path: str, width: int, dictionary, cuts):
    """(doc_id, text) to (part, doc_id, n, frame); part: how many cuts are not above doc_id, 0 for a null."""
    end = END_ID.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary.value), write_content_size=True, write_checksum=True)
        coder = encoder(tokenizer_path, width)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            ids = coder.encode(batch.column("text"))
            n = [len(x) + 1 for x in ids]
            frames = [packer.compress(x.tobytes() + end) for x in ids]
            names = batch.column("doc_id")
            part = np.where(names.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts.value, pc.fill_null(names, 0).to_numpy(zero_copy_only=False), "right"))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), names, pa.array(n, pa.int64()), pa.array(frames, pa.binary())], names=["part", "doc_id", "n", "frame"])

    return run


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _File:
    """One file being written, under a name of its own until it is complete."""

    def __init__(self, folder: str, part: int, width: int, dictionary_hash: int) -> None:
        self.fs, root = _open(folder)
        self.name = f"{part:06d}.tok"
        self.final, self.own = f"{root}/{self.name}", f"{root}/_{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.out.write(HEADER.pack(MAGIC, width, dictionary_hash))
        self.at, self.part, self.index, self.ids, self.nameless = HEADER.size, part, [], 0, 0

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.nameless += doc_id is None
        self.index.append((doc_id or 0, self.at, n))
        self.at += len(frame)
        self.ids += n

    def close(self) -> tuple[int, str, int, int]:
        self.out.write(np.array(self.index, INDEX).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.index), self.nameless, MAGIC))
        self.out.close()
        # A repeated task writes the same bytes; not every file system replaces on a move.
        if self.fs.get_file_info(self.final).type == pafs.FileType.File:
            self.fs.delete_file(self.own)
        else:
            self.fs.move(self.own, self.final)
        return self.part, self.name, len(self.index), self.ids


def _write(folder: str, width: int, dictionary_hash: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "docs", "ids"])

        current = None
        for batch in batches:
            for part, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame")), strict=True):
                if current is None or current.part != part:
                    if current is not None:
                        yield batch_of([current.close()])
                    current = _File(folder, part, width, dictionary_hash)
                current.add(doc_id, n, frame)
        if current is not None:
            yield batch_of([current.close()])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, vocabulary: int = 50_257) -> tuple[str, DataFrame]:
    """Encode the whole texts of (doc_id, text), append END_ID to each, write the files.

    Files hold consecutive ranges of doc_id in ascending order, rows without one
    first; rows with equal doc_id stand together, shorter ones first. A null text is
    empty. Other columns are ignored. Returns the folder and the manifest (part, file,
    docs, ids), one row a file. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or fresh_path(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, width)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zstd") as out:
        out.write(dictionary)
    stats = docs.agg(F.count("doc_id").alias("named"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(spark.sparkContext.defaultParallelism, (stats["bytes"] or 0) // FILE_BYTES + 1)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if stats["named"] else []
    # Rows are dealt by range without a second look at the texts: only ids were read for the cuts.
    share = spark.sparkContext.broadcast
    frames = docs.mapInArrow(_compress(tokenizer_path, width, share(dictionary), share(np.array(cuts, np.int64))), "part long, doc_id long, n long, frame binary")
    dealt = frames.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id", "n", "frame")
    manifest = dealt.mapInArrow(_write(folder, width, xxhash.xxh64_intdigest(dictionary)), "part long, file string, docs long, ids long")
    return folder, materialise(manifest, "manifest")


class TokenFile:
    """Random access to one file; the dictionary's hash is checked."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None) -> None:
        fs, root = _open(folder)
        if dictionary is None:
            dictionary = read_dictionary(folder)
        self.source = fs.open_input_file(f"{root}/{name}")
        magic, width, digest = HEADER.unpack(self.source.read_at(HEADER.size, 0))
        self.index_at, n, self.nameless, closing = FOOTER.unpack(self.source.read_at(FOOTER.size, self.source.size() - FOOTER.size))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{name}: not a complete token file")
        if digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{name}: written with another dictionary")
        self.index = np.frombuffer(self.source.read_at(n * INDEX.itemsize, self.index_at), INDEX)
        self.kind = "<u2" if width == 2 else "<u4"
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _frame(self, i: int) -> tuple[int, int]:
        return int(self.index["offset"][i]), int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.index_at

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(frame), self.kind).astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file, read alone."""
        begin, end = self._frame(i)
        return self._ids(self.source.read_at(end - begin, begin))

    def some(self, a: int, b: int) -> list[np.ndarray]:
        """The ids of the documents a to b - 1, read in one go."""
        begin, end = self._frame(a)[0], self._frame(b - 1)[1]
        data = self.source.read_at(end - begin, begin)
        return [self._ids(data[x - begin : y - begin]) for x, y in map(self._frame, range(a, b))]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document with this id."""
        named = self.index["doc_id"][self.nameless :]
        a, b = np.searchsorted(named, doc_id, "left"), np.searchsorted(named, doc_id, "right")
        return [self.ids(self.nameless + i) for i in range(a, b)]


def read_dictionary(folder: str) -> bytes:
    fs, root = _open(folder)
    with fs.open_input_file(f"{root}/dictionary.zstd") as source:
        return source.read()


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _read(folder, manifest, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "ids")


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """As :func:`read_token_files`, with the crc32 of each document's ids in their place."""
    return _read(folder, manifest, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), "ids_crc32")


def _read(folder: str, manifest: DataFrame, column: str, make, name: str) -> DataFrame:
    """One row a file, each with the ids of all files before it, is dealt to a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                dictionary = read_dictionary(folder) if dictionary is None else dictionary
                source = TokenFile(folder, file, dictionary)
                index = source.index
                starts = start + np.cumsum(index["n"]).astype(np.int64) - index["n"].astype(np.int64)
                for a in range(0, len(index), 500):
                    b = min(len(index), a + 500)
                    ids = pa.array(index["doc_id"][a:b], mask=np.arange(a, b) < source.nameless)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts[a:b]), pa.array(index["n"][a:b].astype(np.int64)), make(source.some(a, b))], names=["doc_id", "start", "n_tokens", name])

    # The manifest has one narrow row for FILE_BYTES of text, so its running sum is one task's work at any size.
    before = "coalesce(sum(ids) over (order by part rows between unbounded preceding and 1 preceding), 0)"
    listed = manifest.select("part", "file", F.expr(before).alias("start"))
    files = max(1, manifest.count())
    listed = listed.select(F.expr("cast(row_number() over (order by part) - 1 as int)").alias("nth"), "file", "start").repartitionById(files, F.col("nth"))
    return listed.select("file", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
