"""Token ids as Arrow files of equal-length sequences.

A file is an Arrow IPC file whose batches hold two fixed-size lists of one length:
``ids`` (unsigned 16 or 32 bits) and ``mask`` (bits; false only in the padding that
fills a file's last sequence). Reading maps the file and hands out views, so a
sequence anywhere costs no copy and no scan. Documents follow one another without
gaps in ascending key order; beside each file an index file holds each document's
key, first token and number of tokens, since an end id may also occur in a text.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, saved

SEQUENCE = 2048
#: Sequences in a batch: 256 of 2048 16-bit ids are 1 MB.
BATCH = 256
#: Words whose ids a worker keeps, those of the latest half of them at least.
KEPT = 400_000
#: Bytes of texts that are encoded at once, about; a longer text is by itself.
AT_ONCE = 4 << 20

_WORKER: dict = {}


class _Letters(dict):
    """For ``str.translate``: letters as the tokenizer's normalizer and pre-tokenizer leave them in a word, each asked of the library once.

    A space stands for characters that need their neighbours: all but letters, and letters that another one may compose
    with (from U+1100 on) or that become more than letters.
    """

    def __init__(self, tokenizer):
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        pieces = self.cut(f"a{self.normal(chr(code))}a") if code < 0x1100 and chr(code).isalpha() else []
        self[code] = pieces[0][0][1:-1] if len(pieces) == 1 else " "
        return self[code]


class WordEncoder:
    """Encodes texts as the tokenizer does, a white-space separated word at a time, each different word of a batch once.

    Holds for tokenizers whose pre-tokenizer drops white space, so that no token spans it, and takes a run of letters
    or of punctuation as one pre-token. A word of letters, with or without punctuation behind, goes to the library's model
    in the letters' normal form, and these ids are kept; any other word goes through the whole tokenizer by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _Letters(self.tokenizer)
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab().values()) < 1 << 16 else np.dtype("<u4")
        #: Ids of letters (none, if they must go with their word) and, after a space, of what goes whole; the older half was known before.
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, core: str) -> bytes | None:
        normal = core.translate(self.letters)
        if " " in normal:
            return None
        ids = [t.id for t in self.model.tokenize(normal)]
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def words(self, words: pa.Array) -> list[bytes]:
        """Little-endian ids of each of some different words."""
        cores = pc.ascii_rtrim(words, characters=string.punctuation)
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        whole, cores = (x.to_numpy(zero_copy_only=False).tolist() for x in (words, cores))
        if len(self.known) > KEPT // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for c in cores:  # no set difference with the keys, which would go through all that is known
            if c not in known:
                known[c] = older[c] if c in older else self._core(c)
        # what stands behind the letters: nothing, punctuation, or None if the word goes whole
        rests = [None if known[c] is None else w[len(c) :] for w, c in zip(whole, cores)]
        odd = {i: f" {w}" for i, (w, r) in enumerate(zip(whole, rests)) if r is None}
        need = [w for w in {*odd.values(), *(f" {r}" for r in set(rests) - {None})} if w not in known]
        known.update((w, older[w]) for w in need if w in older)
        need = [w for w in need if w not in known]
        known.update(zip(need, self._whole([w[1:] for w in need])))
        behind = {r: known[f" {r}"] for r in set(rests) - {None}}
        return [known[odd[i]] if r is None else known[c] + behind[r] if r else known[c] for i, (c, r) in enumerate(zip(cores, rests))]

    def encode_array(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, each with ``end`` behind, and where each text begins, with the whole number last."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        raw = [*self.words(coded.dictionary), np.array(end, self.kind).tobytes()]
        ids, sizes = np.frombuffer(b"".join(raw), self.kind), np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        at = np.insert(coded.indices.to_numpy(), ends, len(raw) - 1)  # words by number; each text's end is one more
        n = sizes[at]
        upto = np.cumsum(n)
        first = (np.cumsum(sizes) - sizes)[at] - (upto - n)
        return ids[np.repeat(first, n) + np.arange(len(at) and upto[-1])], np.concatenate([[0], upto[ends + np.arange(len(ends))]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, at = self.encode_array(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


class SequenceWriter:
    """Packs ids into fixed-size-list batches of an Arrow IPC file."""

    def __init__(self, out, kind: np.dtype, length: int = SEQUENCE):
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.held, self.n = bytearray(), 0

    def _put(self, raw: bytes, valid: int) -> None:
        ids = pa.array(np.frombuffer(raw, self.kind))
        mask = pa.array(np.arange(len(ids)) < valid)
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((ids, mask), self.schema)], schema=self.schema))

    def add(self, raw: bytes) -> None:
        self.held += raw
        self.n += len(raw) // self.kind.itemsize
        step = BATCH * self.length * self.kind.itemsize
        at = 0
        while len(self.held) - at >= step:
            self._put(bytes(self.held[at : at + step]), step)
            at += step
        if at:
            del self.held[:at]

    def close(self) -> None:
        if self.held:
            valid = len(self.held) // self.kind.itemsize
            self._put(bytes(self.held) + bytes(-len(self.held) % (self.length * self.kind.itemsize)), valid)
        self.writer.close()


class SequenceReader:
    """Zero-copy access to the sequences of a file; ``source`` is a memory map or an open file."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.size = len(self.reader.get_batch(0)) if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.size + len(self.reader.get_batch(n - 1)) if n else 0

    def batch(self, i: int) -> np.ndarray:
        """The ids of a batch, sequences after one another, as a view."""
        return self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of a sequence and its mask, as views."""
        b, k = self.reader.get_batch(i // self.size), i % self.size
        return b.column(0)[k].values.to_numpy(zero_copy_only=True), b.column(1)[k].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start on; a view if they are in one batch."""
        step, parts = self.size * self.length, []
        while n > 0:
            at = start % step
            part = self.batch(start // step)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def write(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 2, length: int = SEQUENCE, folder: str | None = None) -> DataFrame:
    """Writes the files and returns their list: part, path, n_docs, n_tokens, start (ids in all files before).

    Texts are dealt to files by ranges of the key (null first; ties by text), so
    file and position order is key order. An attempt writes under a name of its own
    and only the list, saved when all files are written, says which files count:
    a lost or repeated task leaves no trace.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    kind = dict(docs.select(key).dtypes)[key]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("_k")).sortWithinPartitions(F.asc_nulls_first("_k"), "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, writer = TaskContext.get().partitionId(), encoder(tokenizer), None
        n_docs = 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs, path = pafs.FileSystem.from_uri(folder)
                fs.create_dir(path, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                out, beside = fs.open_output_stream(f"{path}/{name}.arrow"), fs.open_output_stream(f"{path}/{name}.index.arrow")
                writer = SequenceWriter(out, enc.kind, length)
                shape = pa.schema([("key", b.column(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(beside, shape)
            starts, ns = [], []
            blocks = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                ids, at = enc.encode_array(b.column(1).slice(s, e - s), (end_id,))
                starts.append(at[:-1] + writer.n)
                ns.append(np.diff(at))
                writer.add(ids.tobytes())
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ns))], schema=shape))
            n_docs += b.num_rows
        if writer:
            writer.close()
            index.close()
            out.close()
            beside.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([writer.n])], ["part", "path", "n_docs", "n_tokens"])

    files = saved(rows.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return saved(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("key_type", F.lit(kind)), "token-starts")


def read(files: DataFrame, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(f"{path}.arrow") as f, _open(f"{path}.index.arrow") as g:
                    tokens, index = SequenceReader(f), pa.ipc.open_file(g)
                    for i in range(index.num_record_batches):
                        x = index.get_batch(i)
                        at, n = x.column(1).to_numpy(), x.column(2).to_numpy()
                        crc = [zlib.crc32(tokens.tokens(s, k).astype("<u4").tobytes()) for s, k in zip(at.tolist(), n.tolist())]
                        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(at + base), x.column(2), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("path", "start", "part").repartition(n, "part").select("path", "start").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, start, n_tokens, ids_crc32 of all documents, from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("word_bpe_49k.json")))
