"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once; at each position its output links
give every piece that ends there, and each relaxes the best score up to the
position. A character that no single-character piece covers may be taken as
unknown and becomes its bytes' pieces. A model's scores are used as they are: the
segmentation is the one of the largest sum, which is the first of the library's
n-best list for a unigram model of these pieces; ties keep the path found first.

Decoding undoes encoding for every text: the library writes U+2581 for a space, so
a U+2581 of the text itself is encoded as bytes here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Score of an unknown character below the lowest piece's, as in the library.
UNKNOWN = 10.0
#: Words whose ids a worker keeps; beyond it starts afresh.
KEPT = 400_000
#: Piece types of the model file.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_WORKER: dict = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = raw[at : at + n], at + n
        yield tag >> 3, kind, value


def load(raw: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """Pieces (text, score, type) of a model file and whether a space is put before each text.

    Of the normalizer that is the only setting that is honoured; a model that maps characters, removes white space or
    doesn't escape it is refused.
    """
    pieces, prefix = [], True
    for number, _, value in _fields(raw):
        if number == 1:
            f = {n: v for n, _, v in _fields(value)}
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
        elif number == 3:
            f = {n: v for n, _, v in _fields(value)}
            if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("the model's normalizer maps characters or changes white space, which isn't supported")
            prefix = bool(f.get(3, 1))
    return pieces, prefix


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, raw: bytes):
        import ahocorasick

        self.pieces, self.prefix = load(raw)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unk = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNK), 0)
        self.automaton = ahocorasick.Automaton()
        for i, (p, score, t) in enumerate(self.pieces):
            if t in (NORMAL, USER):
                self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.low = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0) - UNKNOWN
        #: No piece has a space after something else: words can be encoded one by one.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _, t in self.pieces if t in (NORMAL, USER))
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str, marks: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best segmentation; positions in ``marks`` hold a U+2581 of the text itself."""
        n = len(text)
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        done = 0  # positions up to here have their best score
        best[1:] = [float("-inf")] * n
        single = [False] * (n + 1)
        low = self.low

        def unknown(upto):
            """Unknown characters for the positions that the automaton has left behind."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done] and best[done - 1] + low > best[done]:
                    best[done], back[done] = best[done - 1] + low, (1, -1)

        for end, (length, score, i) in self.automaton.iter(text):
            if end > done:
                unknown(end)
            start = end + 1 - length
            if marks and not marks.isdisjoint(range(start, end + 1)):
                continue
            if length == 1:
                single[end + 1] = True
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (length, i)
        unknown(n)
        out: list[int] = []
        at = n
        while at:
            length, i = back[at]
            if i >= 0:
                out.append(i)
            else:
                raw = text[at - 1].encode("utf-8", "surrogatepass")
                out += [self.bytes.get(x, self.unk) for x in reversed(raw)]
            at -= length
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; none for an empty text."""
        if not text:
            return b""
        if SPACE in text or not self.by_word:
            marked = (SPACE if self.prefix else "") + text
            shift = len(marked) - len(text)
            marks = frozenset(i + shift for i, c in enumerate(text) if c == SPACE)
            return np.array(self.viterbi(marked.replace(" ", SPACE), marks), "<u4").tobytes()
        get, out = self.known.get, []
        for word in self._words(text):
            ids = get(word)
            if ids is None:
                if len(self.known) >= KEPT:
                    self.known.clear()
                ids = self.known[word] = np.array(self.viterbi(word), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def _words(self, text: str) -> list[str]:
        """The normalized text cut before each run of spaces and after each line end, where no piece goes across."""
        marked = ((" " if self.prefix else "") + text).split(" ")
        out, spaces = [], 0
        if marked[0]:
            out.append(marked[0])
        for w in marked[1:]:
            spaces += 1
            if w:
                out.append(SPACE * spaces + w)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        out = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            p, _, t = self.pieces[i]
            if t == BYTE:
                out.append(int(p[3:5], 16))
            elif t != CONTROL:
                out += p.replace(SPACE, " ").encode()
        text = out.decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text.startswith(" ") else text


def coder(path: str) -> Pieces:
    """This worker's coder for a model file; kept between tasks."""
    if path not in _WORKER:
        with open(path, "rb") as f:
            _WORKER[path] = Pieces(f.read())
    return _WORKER[path]


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns ``keep``, n_tokens, ids_crc32, decoded_ok (decoding gives the text back) and, if asked for, ids.

    A kept column that is called like one of these is given as ``kept_`` and its name; columns that aren't kept don't
    matter. A null text is encoded as an empty one: no ids; an empty table gives no rows; rows that repeat are encoded each. A narrow pass over whole texts; the model file must be
    on every executor, as part of an installed package or added with ``SparkContext.addFile``.
    """
    kinds = dict(docs.select(*keep).dtypes)
    results = ("n_tokens", "ids_crc32", "decoded_ok", "ids")
    given = [f"kept_{k}" if k in results else k for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids = [c.encode(t) for t in texts]
                cols = [*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts)])]
                names = [*given, *results[:3]]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                    names.append(results[3])
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"`{g}` {kinds[k]}" for g, k in zip(given, keep)) + ", n_tokens long, ids_crc32 long, decoded_ok boolean" + ", ids array<int>" * with_ids
    return docs.select(*[F.col(k).alias(g) for g, k in zip(given, keep)], F.col(text).alias("_piece_text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and decoded_ok of every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
