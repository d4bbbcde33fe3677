"""SentencePiece encoding and decoding with a distinct-chunk table.

When no piece of the model crosses a whitespace marker, a text is a sequence of marked
words that are segmented independently. A worker keeps a table of the distinct chunks it
has met; each is segmented once, and the ids of a text are the table's entries joined by
position. A newline starts a chunk too if no longer piece contains one. A model for which
neither holds is applied to whole texts. The result is that of the library either way.

Defined results: null and empty texts have no ids and decode to the empty text; equal
texts get equal ids; texts of any length are encoded whole; an empty table stays empty;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_by_bytes, small_batches

#: A worker's table is emptied when it holds this many chunks; only speed depends on it.
TABLE_CHUNKS = 120_000
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """Encodes and decodes with one model; keeps the distinct-chunk table."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.marker = self.sp.piece_to_id(MARK)
        lines = not any("\n" in p for p in plain)
        probe = "a éﬁ  A\n"  # the chunks below assume text that no normalization changes
        as_is = self.sp.decode(self.sp.encode(probe)) == probe and self.sp.encode("a")[:1] == self.sp.encode(" a")[-1:]
        self.chunked = as_is and pieces[self.marker] == MARK and not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        rest = f"[^ {MARK}\n]*" if lines else f"[^ {MARK}]*"
        self.cut = re.compile(f"[ {MARK}]+{rest}" + (f"|\n+{rest}" if lines else "")).findall
        self.table: dict[str, tuple[int, ...]] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Segment new chunks. The library marks the start of what it is given: that stands
        for a chunk's own first marker, or is taken off again before a newline."""
        marked = [c for c in chunks if c[0] != "\n"]
        for c, ids in zip(marked, self.sp.encode([c[1:] for c in marked], num_threads=1), strict=True):
            self.table[c] = tuple(ids) if len(c) > 1 else (self.marker,)
        lines = [c for c in chunks if c[0] == "\n"]
        for c, ids in zip(lines, self.sp.encode(lines, num_threads=1), strict=True):
            self.table[c] = tuple(ids[1:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.chunked:
            return self.sp.encode(texts, num_threads=1)
        if len(self.table) > TABLE_CHUNKS:
            self.table.clear()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.table)
        if new:
            self._learn(list(new))
        get = self.table.__getitem__
        return [list(chain.from_iterable(map(get, chunks))) for chunks in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids) if ids else []


_codecs: dict[str, ChunkCodec] = {}


def codec(model: str) -> ChunkCodec:
    if model not in _codecs:
        _codecs[model] = ChunkCodec(model)
    return _codecs[model]


def encoded(docs: DataFrame, *, keep: list[str], text: str = "text", model: str | None = None, finish: Callable[[list[list[int]], list[str]], list[pa.Array]] | None = None, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """``keep`` columns plus what ``finish(ids, decoded)`` makes of each batch; by default
    the ids and the decoded text."""
    model = model or default_model()
    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:-1]))
    done = finish or (lambda ids, out: [pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in pieces_by_bytes(batches, "t"):
            ids = c.encode(part.column(len(keep)).to_pylist())
            made = done(ids, c.decode(ids))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*part.schema.names[: len(keep)], *[f"m{i}" for i in range(len(made))]])

    made = [f.strip().split(" ", 1) for f in re.split(r",(?![^<]*>)", schema)]
    out = source.mapInArrow(work, ", ".join([kinds, *[f"m{i} {kind}" for i, (_, kind) in enumerate(made)]]))
    return out.toDF(*keep, *[name for name, _ in made])


def digests(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the text."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x)).encode()) for x in ids], pa.string()), pa.array([sha(x.encode()) for x in decoded], pa.string())]
