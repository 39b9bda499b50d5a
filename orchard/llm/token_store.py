"""Token-ID files: one zstandard frame per document, a document index in a
skippable frame, and a trailing seek table with a checksum per frame.

File layout (all integers little-endian)::

    zstd frame 0 .. n-1      ids of one document each, unsigned 16 or 32 bit
    skippable frame (0x184D2A50)  JSON head, n x int64 doc ids, n x uint8 "id is null"
    skippable frame (0x184D2A5E)  seek table: n x (u32 compressed size, u32
                             decompressed size, u32 low half of xxh64 of the ids),
                             u32 n, u8 0x80 (checksums), u32 0x8F92EAB1

The last frame follows the public zstd seekable layout, so a reader takes the
tail, finds a document's frame by prefix sums and decompresses only that.

``write_token_files`` range-partitions by doc_id and writes one file per
partition through ``pyarrow.fs`` to the shared folder; names carry a random
part, and the manifest row of the committed task says which file counts, so a
retried task never mixes with an earlier attempt.

Defined cases: a null text is empty (its ids are the end id alone); repeated
rows are kept, ordered by (doc_id, hash of the text); null doc_ids come first;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import json
import struct
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import stored
from orchard.session import scratch_path

SEEK_MAGIC, SEEK_FOOT, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CACHE_PIECES = 1_200_000  # about 200 bytes each
# the byte-level sign of each byte: itself where printable in Latin-1, else the next free code point from 256
_OTHER = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
SIGNS = "".join(chr(256 + _OTHER.index(b)) if b in _OTHER else chr(b) for b in range(256))
OLD_LETTERS = "\u0600"  # letters below are letters in every Unicode version in use
TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class PieceEncoder:
    """Byte-level BPE through the tokenizers library with a bounded cache.

    The library cuts a text at word borders before merging, so the ids of a
    text whose white space is only single spaces and single line ends are the
    ids of its pieces (" word", "\\nword") one after another, and a trailing
    run of ASCII punctuation is a unit of its own.  New pieces of a space and
    letters alone are one unit each and go through the library's merges together, as
    byte signs and not cut again.  Other new pieces go through the library together, as one text each for those that begin with a space and with
    a line end; the only ids that begin with a space (or are a line end) are the
    first of their pieces, which gives the borders back.  Any other text goes
    through the library whole.
    """

    def __init__(self, path: str, dtype=np.uint32, cache: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype, self.limit, self.cache, self.tails = np.dtype(dtype), cache, {}, {}
        self.line_id = self._ids("\n")[0]
        self.line = np.array([self.line_id], self.dtype).tobytes()
        vocab = self.tok.get_vocab()
        self.letters = self._letters(vocab)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the byte-level sign for a space

    def _letters(self, vocab: dict):
        """The library's merges without its cutting step, if that step is byte-level and cuts at word
        borders, nothing changes the text and no merge of letters spans a space; else None."""
        conf = json.loads(self.tok.to_str())
        pre = conf["pre_tokenizer"] or {}
        back = {ord(c): b for b, c in enumerate(SIGNS)}
        over = "".join(t.translate(back).encode("latin-1").decode("utf-8", "replace")
                       for t in vocab if t not in self.added and "\u0120" in t.lstrip("\u0120"))
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or conf["normalizer"] \
                or any(c.isalpha() or c == "\ufffd" for c in over):
            return None
        return self.tok.model.tokenize

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _learn(self, pieces: list[str], lines: bool) -> None:
        """Cache pieces that all begin with a line end, or all with a space (left out here)."""
        if not lines and self.letters:
            plain = [p for p in pieces if p.isalpha() and (p.isascii() or max(p) < OLD_LETTERS)]
            for i in range(0, len(plain), 1000):
                some = plain[i:i + 1000]
                signs = codecs.charmap_decode((" " + " ".join(some)).encode(), "strict", SIGNS)[0]
                self._cut(some, [t.id for t in self.letters(signs)], lines)
            pieces = list(set(pieces).difference(plain))
        for i in range(0, len(pieces), 50_000):
            some = pieces[i:i + 50_000]
            self._cut(some, self._ids("".join(some) if lines else " " + " ".join(some)), lines)

    def _cut(self, some: list[str], ids: list[int], lines: bool) -> None:
        """Cache each piece with its part of the ids of all."""
        ids = np.array(ids, np.uint32)
        at = np.flatnonzero(ids == self.line_id if lines else self.spaced[ids])
        if len(at) != len(some):  # a piece with a border inside: one by one
            self.cache.update((p, self._whole(p if lines else " " + p)) for p in some)
            return
        w, raw = self.dtype.itemsize, ids.astype(self.dtype).tobytes()
        cut = (np.append(at, len(ids)) * w).tolist()
        self.cache.update((p, raw[x:y]) for p, x, y in zip(some, cut, cut[1:], strict=False))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not text.replace("\n", "").isprintable() or any(t in text for t in self.added):  # other white space, controls, added tokens
            return self._whole(text)
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\n" + parts[0]
        different = set(parts)
        if "" in different or "\n" in different:  # doubled, leading or trailing white space
            return self._whole(text)
        cache = self.cache
        new = different.difference(cache)
        if new:
            if len(cache) + 2 * len(new) > self.limit:
                cache.clear()
                new = different
            tailed = {}
            for p in new:
                if p[-1] in TAIL and (core := p.rstrip(TAIL)) and core[-1].isalpha():
                    tailed[p] = core
            need = {tailed.get(p, p) for p in new}.difference(cache)
            self._learn([p for p in need if p[0] != "\n"], False)
            self._learn([p for p in need if p[0] == "\n"], True)
            for p, core in tailed.items():
                tail = p[len(core):]
                if tail not in self.tails:
                    if len(self.tails) > self.limit // 8:
                        self.tails.clear()
                    self.tails[tail] = self._whole(tail)
                cache[p] = cache[core] + self.tails[tail]
        return b"".join(map(cache.__getitem__, parts))[len(self.line):]


def pack_file(docs: Iterable[tuple[int | None, bytes]], out, dtype, level: int = 3) -> tuple[int, int]:
    """Write (doc_id, ids) in the given order; returns (documents, ids)."""
    z = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    seek, ids, nulls, total, width = [], [], bytearray(), 0, np.dtype(dtype).itemsize
    for doc_id, raw in docs:
        frame = z.compress(raw)
        out.write(frame)
        seek.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        ids.append(doc_id or 0)
        nulls.append(doc_id is None)
        total += len(raw) // width
    head = json.dumps({"format": "orchard-tokens-1", "width": width, "documents": len(ids), "ids": total}).encode()
    index = struct.pack("<I", len(head)) + head + np.array(ids, "<i8").tobytes() + bytes(nulls)
    out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    table = b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEK_FOOT)
    out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
    return len(ids), total


class TokenFile:
    """Random access to one token file; reads only the tail and asked frames."""

    def __init__(self, handle):
        self.f, size = handle, handle.size()
        n, flags, foot = struct.unpack("<IBI", self._at(size - 9, 9))
        if foot != SEEK_FOOT or flags != 0x80:
            raise ValueError("no seek table")
        start = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        body = self._at(int(self.offset[-1]) + 8, start - 8 - int(self.offset[-1]) - 8)
        k = struct.unpack("<I", body[:4])[0]
        self.head = json.loads(body[4:4 + k])
        self.doc_ids = np.frombuffer(body[4 + k:4 + k + 8 * n], "<i8")
        self.null = np.frombuffer(body[4 + k + 8 * n:], np.uint8).astype(bool)
        self.dtype = np.dtype(f"<u{self.head['width']}")
        self.z = zstandard.ZstdDecompressor()

    def _at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        size, raw_size, check = (int(x) for x in self.table[i])
        raw = self.z.decompress(frame if frame is not None else self._at(int(self.offset[i]), size))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, self.dtype)

    def find(self, doc_id: int) -> list[int]:
        """Frames of a document id (repeated rows have several)."""
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.null).tolist()

    def scan(self, step: int = 8 << 20):
        """(i, ids) of every frame, reading the file in runs of about ``step`` bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offset, self.offset[i] + step, "right")) - 1)
            buf = memoryview(self._at(int(self.offset[i]), int(self.offset[j] - self.offset[i])))
            for k in range(i, j):
                a = int(self.offset[k] - self.offset[i])
                yield k, self.ids(k, bytes(buf[a:a + int(self.table[k, 0])]))
            i = j


_ENCODERS: dict = {}


def _encoder(path: str, dtype) -> PieceEncoder:
    key = (path, np.dtype(dtype).str)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, dtype)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None,
                      vocab: int = 50_257, files: int | None = None) -> tuple[DataFrame, str]:
    """Encode ``docs(doc_id, text)`` and write files in ascending doc_id order;
    returns the stored manifest (part, file, n_docs, n_ids) and the folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = "<u2" if vocab <= 1 << 16 and end_id < 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, first = _encoder(tokenizer_path, dtype), next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rows():
            b = first
            while b is not None:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    yield doc_id, enc.encode(text) + end
                b = next(batches, None)

        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
        with fs.open_output_stream(name) as out:
            docs_n, ids_n = pack_file(rows(), out, dtype)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name],
                                          "n_docs": pa.array([docs_n], pa.int64()), "n_ids": pa.array([ids_n], pa.int64())})

    rows = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    # one row per token file: one small table file, not one (and its checksum, each with a process for its mode) per task
    return stored(rows.repartition(1), "token-manifest"), path


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per stored document, from the files alone: doc_id, start,
    n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian), file, frame."""
    spark = manifest.sparkSession
    # one row per file: the running sum orders file rows, never documents
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    work = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                with fs.open_input_file(name) as f:
                    t = TokenFile(f)
                    n, crc = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
                    for i, ids in t.scan():
                        n[i], crc[i] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t.doc_ids, pa.int64(), mask=t.null), pa.array(start + np.cumsum(n) - n), pa.array(n),
                         pa.array(crc), pa.array([name.rpartition("/")[2]] * len(t)), pa.array(np.arange(len(t)))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame"])

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long")
