"""Encoding and decoding with a SentencePiece model of byte-pair type, as a max-plus scan."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = 65_536         # characters of a chunk; longer documents are scanned in parallel
KNOWN = 250_000        # words and beginnings of words that a worker remembers
NONE = -np.inf


class Pieces:
    """Vocabulary of a model, and which pieces may stand side by side.

    Byte-pair encoding merges, again and again, the neighbours whose union has the best score. A sequence of pieces is
    the encoding of its text exactly if every two neighbours are the encoding of theirs: a merge across a border would
    already happen between these two alone. So encoding is a walk through pieces in which each step weighs 0 if the two
    may stand side by side and minus infinity if not, and walks over parts of a text combine as max-plus matrices.
    """

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or proto.trainer_spec.model_type != 2:
            raise ValueError("a byte-pair model without text normalisation is wanted")
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.scores = {p: proto.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        inner = {x for p in self.ids if len(p) > 1 for x in p}
        cut = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        #: Words: no piece goes on from another character to a blank, nor over one of the characters cut at.
        if any(a != BLANK and b == BLANK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece reaches over the border of two words")
        self.words = re.compile(f"{BLANK}+[^{BLANK}{cut}]*|[^{BLANK}{cut}]+|[{cut}]" if cut else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.ends: dict = {}  # pieces as a tree of characters, read from their ends
        for p in self.ids:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = {}
        self.shown = [bytes([self.values[i]]) if i in self.values else p.replace(BLANK, " ").encode() for i, p in enumerate(self.text)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.bits = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves, best score first, then the leftmost."""
        parts, score = list(text), self.scores.get
        values = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while values and (best := max(values)) > NONE:
            i = values.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del values[i]
            if i:
                values[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(values):
                values[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def beside(self, a: str, b: str) -> bool:
        """Whether piece ``b`` may follow piece ``a``; an empty ``a`` stands for the begin of a word."""
        key = a, b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def packed(self, parts: list[str]) -> bytes:
        """Ids as little-endian numbers of four bytes; a character without piece becomes its bytes."""
        return b"".join([self.bits.get(p) or np.array([self.bytes[b] for b in p.encode()], "<i4").tobytes() for p in parts])

    def spans(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place."""
        return [e for e in range(at + 1, min(len(text), at + self.longest) + 1) if e == at + 1 or text[at:e] in self.ids]

    def word(self, text: str) -> tuple[bytes, str]:
        """Ids of one word, and its last piece.

        The encoding of a beginning of a word does not depend on what follows, so a word is the encoding of what stands
        before its last piece, then that piece: of all pieces that end the word, the one that may follow there. Words
        and beginnings are remembered.
        """
        got = self.known.get(text)
        if got is not None:
            return got
        if len(text) > 64:
            return self.long_word(text)
        if len(self.known) >= KNOWN:
            self.known.clear()
        for s in self.starts(text, len(text)):
            piece = text[s:]
            ids, before = self.word(text[:s]) if s else (b"", "")
            if (before or not s) and self.beside(before, piece):
                got = ids + self.packed([piece]), piece
                break
        else:
            got = b"", ""  # a beginning in the middle of a character pair that always merges: no piece may end here
        self.known[text] = got
        return got

    def starts(self, text: str, end: int) -> list[int]:
        """Starts of the pieces that end at a place, the farthest first."""
        node, s, found = self.ends, end, []
        while s:
            node = node.get(text[s - 1])
            if node is None:
                break
            s -= 1
            if "" in node:
                found.append(s)
        found.reverse()
        return found or [end - 1]

    def long_word(self, text: str) -> tuple[bytes, str]:
        """The same from the left, for words too long to remember their beginnings."""
        last = [""] * (len(text) + 1)
        for e in range(1, len(text) + 1):
            for s in self.starts(text, e):
                if (last[s] or not s) and self.beside(last[s], text[s:e]):
                    last[e] = text[s:e]
                    break
        parts, e = [], len(text)
        while e:
            parts.append(last[e])
            e -= len(last[e])
        return self.packed(parts[::-1]), last[-1]

    def run(self, text: str) -> bytes:
        """Ids of a text that begins and ends at borders of words."""
        word, known = self.word, self.known.get
        return b"".join([(known(w) or word(w))[0] for w in self.words.findall(text)])

    # boundary states: the piece that covers the last character before a boundary, as (start, end) relative to it

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces of ``text`` that start before ``at`` and end there or later."""
        return [(s - at, e - at) for s in range(max(0, at - self.longest), at) for e in self.spans(text, s) if e >= at]

    def transfer(self, text: str, a: int, b: int, first: list, then: list) -> tuple[np.ndarray, dict]:
        """Max-plus matrix from the states at ``a`` to those at ``b``, and the walks' best values at every piece between."""
        value: dict[tuple[int, int], np.ndarray] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, (s, e) in enumerate(first):
            v = np.full(len(first), NONE)
            v[i] = 0
            value[a + s, a + e] = v
            ends.setdefault(a + e, []).append((a + s, a + e))
        for at in range(a, b):
            for s, e in ends.get(at, []):
                for end in self.spans(text, at):
                    if self.beside(text[s:e], text[at:end]):
                        v = value.get((at, end))
                        if v is None:
                            ends.setdefault(end, []).append((at, end))
                            value[at, end] = value[s, e].copy()
                        else:
                            np.maximum(v, value[s, e], out=v)
        empty = np.full(len(first), NONE)
        return np.array([value.get((b + s, b + e), empty) for s, e in then]).T.reshape(len(first), len(then)), value

    def walk(self, text: str, a: int, b: int, start: tuple[int, int], stop: tuple[int, int]) -> list[str]:
        """The pieces after ``start`` up to ``stop``, traced back from it."""
        _, value = self.transfer(text, a, b, [start], [stop])
        by_end: dict[int, list[tuple[int, int]]] = {}
        for s, e in value:
            by_end.setdefault(e, []).append((s, e))
        at, goal, parts = (b + stop[0], b + stop[1]), (a + start[0], a + start[1]), []
        while at != goal:
            parts.append(text[at[0]:at[1]])
            at = next(p for p in by_end[at[0]] if self.beside(text[p[0]:p[1]], text[at[0]:at[1]]))
        return parts[::-1]

    def decoded(self, ids: np.ndarray) -> str:
        """Text of ids: pieces with blanks for spaces, runs of byte pieces as UTF-8; the space put in front is taken off."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _loaded(key: str, model: bytes) -> Pieces:
    return Pieces(model)


class Model:
    """The bytes of a model file, read on the driver and sent with the tasks (half a megabyte); read once for each worker."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            self.data = f.read()
        self.key = hashlib.sha256(self.data).hexdigest()

    def __call__(self) -> Pieces:
        return _loaded(self.key, self.data)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return (a[:, :, None] + b[None]).max(axis=1)


def escaped(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def chunks_of(text: str, pieces: Pieces, size: int) -> list[int]:
    """Boundaries of chunks of about ``size`` characters, at the last border of two words of a chunk if it has one."""
    cuts = [0]
    while len(text) - cuts[-1] > size:
        end = cuts[-1] + size
        border = next((i for i in range(end, cuts[-1], -1) if text[i] == BLANK and text[i - 1] != BLANK), end)
        cuts.append(border)
    return [*cuts, len(text)]


def at_border(text: str, i: int) -> bool:
    return i in (0, len(text)) or (text[i] == BLANK and text[i - 1] != BLANK)


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of all columns but the text), ``text`` and ``ids`` (packed, four bytes each).

    With ``decoded``, the column ``decoded`` holds the text that the ids give, worked out in the same pass.

    The ids are those of the model's own encoder. A document of at most ``chunk`` characters is one chunk. Longer ones
    are cut, the chunks spread over tasks; each gives the max-plus matrix between the states at its two boundaries; the
    matrices of a document, in order, tell the state at every boundary; then each chunk is traced back by itself. At the
    border of two words there is only one state, elsewhere (words longer than a chunk) the pieces across the boundary.

    Null text: null ids; empty text: no ids. A literal U+2581 is encoded like a space, as the model's encoder does.
    Repeated rows and null columns are kept as they are; an empty table gives none.
    """
    load = Model(model)
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    read = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    read = read.withColumn("ids", F.lit(None).cast("binary"))
    if decoded:
        read = read.withColumn("decoded", F.lit(None).cast("string"))
    shape, names = read.schema, read.columns

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [None if t is None else load().run(escaped(t)) for t in part.column(1).to_pylist()]
                back = [pa.array([None if x is None else load().decoded(np.frombuffer(x, "<i4")) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), *back], names)

    one = F.col("text").isNull() | (F.char_length("text") < chunk)
    large = _parallel(spark, read.where(~one).select("row", "text"), load, chunk)
    return read.where(one).mapInArrow(small, shape).unionByName(decode(large, model) if decoded else large)


def _parallel(spark, read: DataFrame, load: Model, chunk: int) -> DataFrame:
    """Encoding of long documents, chunk by chunk."""
    from featlake.session import settle

    # a row is told apart by its place in this table
    table = settle(read.withColumn("doc", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = escaped(text.as_py())
                cuts = chunks_of(text, pieces, chunk)
                rows = {"doc": [], "chunk": [], "left": [], "right": [], "near": []}
                for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lo = a if at_border(text, a) else max(0, a - pieces.longest)
                    hi = z if at_border(text, z) else min(len(text), z + pieces.longest)
                    for k, v in zip(rows, (doc, i, a - lo, hi - z, text[lo:hi]), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows["doc"], pa.int64()), pa.array(rows["chunk"], pa.int32()), pa.array(rows["left"], pa.int32()),
                                                  pa.array(rows["right"], pa.int32()), pa.array(rows["near"], pa.string())], list(rows))

    parts = table.select("doc", "text").mapInArrow(cut, "doc long, chunk int, left int, right int, near string").repartition("doc", "chunk")

    def bounds(pieces: Pieces, near: str, left: int, right: int):
        a, b = left, len(near) - right
        return a, b, (pieces.states(near, a) if left else [(0, 0)]), (pieces.states(near, b) if right else [(0, 0)])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for batch in batches:
            found = []
            for left, right, near in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                a, b, first, then = bounds(pieces, near, left, right)
                m = np.zeros((1, 1)) if not left and not right else transfer_between(pieces, near, a, b, first, then)
                found.append(np.array([*m.shape, *m.ravel()]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], ["doc", "chunk", "left", "right", "matrix"])

    def states(t: pa.Table) -> pa.Table:
        """States at all boundaries of one document: prefixes from the left, then the choice from the right."""
        t = t.sort_by("chunk")
        ms = []
        for x in t.column("matrix").to_pylist():
            v = np.frombuffer(x)
            ms.append(v[2:].reshape(int(v[0]), int(v[1])))
        before = [np.zeros((1, 1))]
        for m in ms[:-1]:
            before.append(times(before[-1], m))
        state, chosen = 0, []
        for v, m in zip(before[::-1], ms[::-1], strict=True):
            new = int(np.argmax(v[0] + m[:, state]))
            chosen.append((new, state))
            state = new
        chosen.reverse()
        return pa.table([t.column("doc"), t.column("chunk"), pa.array([c[0] for c in chosen], pa.int32()), pa.array([c[1] for c in chosen], pa.int32())], ["doc", "chunk", "enter", "leave"])

    chosen = (parts.mapInArrow(matrices, "doc long, chunk int, left int, right int, matrix binary").groupBy("doc")
              .applyInArrow(states, "doc long, chunk int, enter int, leave int"))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for batch in batches:
            out = []
            for left, right, near, enter, leave in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                a, b, first, then = bounds(pieces, near, left, right)
                out.append(traced(pieces, near, a, b, first[enter], then[leave], bool(left), bool(right)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc", "chunk", "ids"])

    ids = (parts.join(chosen, ["doc", "chunk"]).select("doc", "chunk", "left", "right", "near", "enter", "leave").mapInArrow(trace, "doc long, chunk int, ids binary")
           .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
           .select("doc", F.expr("aggregate(parts.ids, cast('' as binary), (x, y) -> x || y)").alias("ids")))
    return table.join(ids, "doc").select("row", "text", "ids")


def first_border(pieces: Pieces, near: str, a: int, b: int) -> int:
    """First border of two words after ``a``, or ``b``."""
    return next((i for i in range(a + 1, b) if near[i] == BLANK and near[i - 1] != BLANK), b)


def last_border(pieces: Pieces, near: str, a: int, b: int) -> int:
    return next((i for i in range(b - 1, a, -1) if near[i] == BLANK and near[i - 1] != BLANK), a)


def transfer_between(pieces: Pieces, near: str, a: int, b: int, first: list, then: list) -> np.ndarray:
    """Matrix of a chunk whose boundaries are not both borders: whole words inside have one state and weigh nothing."""
    x, y = first_border(pieces, near, a, b), last_border(pieces, near, a, b)
    start = [(0, 0)] if first == [(0, 0)] else first
    if x >= b:
        return _matrix(pieces, near, a, b, start, then)
    return _matrix(pieces, near, a, x, start, [(0, 0)]) + _matrix(pieces, near, y, b, [(0, 0)], then)


def _matrix(pieces: Pieces, near: str, a: int, b: int, first: list, then: list) -> np.ndarray:
    """Matrix of a part of one word. A state (0, 0) is a border: any piece that ends there, or none yet."""
    if then != [(0, 0)]:
        return pieces.transfer(near, a, b, first, then)[0]
    ends = [(s - b, e - b) for s in range(max(0, b - pieces.longest), b) for e in pieces.spans(near[:b], s) if e == b]
    return pieces.transfer(near[:b], a, b, first, ends)[0].max(axis=1, keepdims=True)


def traced(pieces: Pieces, near: str, a: int, b: int, enter: tuple, leave: tuple, left: bool, right: bool) -> bytes:
    """Ids of the pieces that end in a chunk after its entering state, up to and with the leaving state."""
    if not left and not right:
        return pieces.run(near)
    x, y = (first_border(pieces, near, a, b) if left else a), (last_border(pieces, near, a, b) if right else b)
    if left and right and x >= b:
        return pieces.packed(pieces.walk(near, a, b, enter, leave))
    out = b""
    if left:
        word = near[:x]
        goals = [(s - x, 0) for s in range(max(0, x - pieces.longest), x) if x - s == 1 or word[s:x] in pieces.ids]
        goal = next(g for g in goals if pieces.transfer(word, a, x, [enter], [g])[0][0, 0] > NONE)
        out += pieces.packed(pieces.walk(word, a, x, enter, goal))
    out += pieces.run(near[x:y])
    if right:
        out += pieces.packed(pieces.walk(near, y, b, (0, 0), leave))
    return out


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The same rows with ``decoded``: the text of ``ids`` (null for null)."""
    load = Model(model)
    shape = encoded.withColumn("decoded", F.lit(None).cast("string")).schema
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for b in batches:
            text = [None if x is None else pieces.decoded(np.frombuffer(x, "<i4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, shape)
