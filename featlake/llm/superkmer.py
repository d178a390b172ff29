"""Removal of token runs that already occur in a document with a smaller id.

Both exact-repeat operators (windows of words, runs of bytes) share one flow:

1. *batches*: documents are packed, a few megabytes each, into a table in the shared folder; later steps address a
   document by batch and place.
2. *announce*: the consecutive windows of ``k`` tokens that share a minimiser (the least scrambled hash of the window's
   ``m``-token pieces) form a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser a
   second document also has can matter. A batch sends its distinct minimisers, packed and with a mark on those that two
   of its own documents have, to their buckets and gets back those that are marked or that others have too.
3. *buckets*: these super-k-mers travel as packed strings to the bucket of their minimiser. One that a smaller document
   of the same chunk of a batch also holds is settled before and travels without its text, so a group of copies costs
   one string for each chunk. A bucket finds, for every window, the smallest document that has it; how is what the two operators
   differ in. It sends the covered token ranges back.
4. *documents*: ranges meet their batch and the covered tokens are removed.

The number of buckets follows the measured length of all texts, so a bucket stays of one size.

Rows without id or text have no windows that count, neither as source nor as copy. Rows that share an id are never
each other's source. Texts longer than a chunk are cut into overlapping pieces, so no window is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.llm.common import U64, mixed, pack, rolled, shuffle_partitions, sliding_min, spread, unpack
from featlake.session import settle

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
NEVER = np.iinfo(np.int64).max
BATCH = 4 << 20       # bytes of text for one stored batch
CHUNK = 2 << 20       # bytes of text that a task works on at a time
BUCKET = 4 << 20      # bytes of text for one bucket; overlapping strings that others share may be as long
LONGEST = 64          # windows of one super-k-mer at most; longer runs are cut
STEP = 64 << 10       # windows whose minimisers are worked out at a time
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Tokens:
    """Token hashes of some texts laid end to end; token ``t`` is ``text[left[t]:right[t]]``."""

    text: np.ndarray
    hashes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # tokens of each text


def byte_tokens(texts: list[bytes]) -> Tokens:
    a = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(len(a) + 1, dtype=np.int32)
    hashes = a.astype(U64)
    hashes += U64(1)
    return Tokens(a, hashes, at[:-1], at[1:], np.array([len(t) for t in texts], np.int64))


def word_tokens(texts: list[bytes]) -> Tokens:
    """Words parted by ASCII white space; the text is rewritten with one space after each word."""
    raw = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    space = SPACE[raw]
    after = np.append(False, ~space[:-1])[:len(space)]  # the byte before belongs to a word
    keep = ~space | after
    ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64)
    counts = np.diff(np.append(0, np.cumsum(space & after)[ends - 1])) if len(texts) else np.zeros(0, np.int64)
    text, space = raw[keep].copy(), space[keep]
    text[space] = 32
    right = np.flatnonzero(space).astype(np.int32)
    left = np.append(np.int32(0), right[:-1] + np.int32(1))[:len(right)].astype(np.int32)
    return Tokens(text, _word_hashes(text, left, right), left, right, counts)


def _word_hashes(text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if not len(left):
        return np.zeros(0, U64)
    start = np.zeros(len(text), np.int32)
    start[left] = left
    place = np.arange(len(text), dtype=np.int32) - np.maximum.accumulate(start)
    power = np.full(int(place.max()) + 1, 0xC2B2AE3D27D4EB4F, U64)
    power[0] = 1
    value = (text.astype(U64) + U64(1)) * np.multiply.accumulate(power)[place]
    value[right] = 0
    return mixed(np.add.reduceat(value, left) + (right - left).astype(U64))


def byte_pieces(raw: bytes, k: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces of one chunk at most that overlap by a window less one token; with the first token's place."""
    for at in range(0, max(1, len(raw) - k + 1), CHUNK):
        yield at, raw[at:at + CHUNK + k - 1]


def word_pieces(raw: bytes, k: int) -> Iterator[tuple[int, bytes]]:
    if len(raw) <= CHUNK:
        yield 0, raw
        return
    at, base, tail = 0, 0, []
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        words = tail + raw[at:end].split()
        yield base - len(tail), b" ".join(words)
        base += len(words) - len(tail)
        tail, at = words[-(k - 1):], end


@dataclass(frozen=True)
class Method:
    """What the two operators differ in: tokens, window and minimiser length, and how a bucket compares windows.

    ``smallest(tokens, owners, k)`` gets the distinct strings of a bucket and the smallest document of each; it
    returns, for all windows of all strings in order, the smallest document that has the window.
    """

    k: int
    m: int
    tokenise: Callable[[list[bytes]], Tokens]
    pieces: Callable[[bytes, int], Iterator[tuple[int, bytes]]]
    smallest: Callable[[Tokens, np.ndarray, int], np.ndarray]
    parts: Callable[[bytes], list | bytes]  # a text's tokens, for cutting
    joined: Callable[[list], bytes]


def small(a: np.ndarray) -> np.ndarray:
    """Narrowest unsigned type that holds the values."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


# --- batches -----------------------------------------------------------------------------------------------------


def packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, row) as compressed tables of one batch each, ordered by id with nulls last."""
    place, count = TaskContext.get().partitionId(), itertools.count()
    held, size = [], 0

    def flush():
        t = pa.Table.from_batches(held).sort_by("id")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([place << 32 | next(count)], pa.int64()), pa.array([blob], pa.binary())], ["batch", "docs"])

    for b in batches:
        sizes = np.cumsum([size] + [len(x.as_py() or b"") for x in b.column(1)])
        at = 0
        for i in range(b.num_rows):
            if sizes[i + 1] - sizes[at] + size >= BATCH or i + 1 - at >= 50_000:
                held.append(b.slice(at, i + 1 - at))
                yield flush()
                held, size, at = [], 0, i + 1
        if at < b.num_rows:
            held.append(b.slice(at))
            size += int(sizes[-1] - sizes[at])
    if held:
        yield flush()


def opened_batch(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def pieces_of(docs: pa.Table, method: Method) -> Iterator[list[tuple[int, int, bytes]]]:
    """(place of the document, first token, bytes) of what a batch holds, at most about ``CHUNK`` bytes at a time."""
    held, size = [], 0
    for d, (i, text) in enumerate(zip(docs.column("id"), docs.column("text"), strict=True)):
        if i.is_valid and text.is_valid:
            for base, piece in method.pieces(text.as_py(), method.k):
                held.append((d, base, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def minimisers(hashes: np.ndarray, k: int, m: int) -> np.ndarray:
    """Least scrambled hash of the ``m``-token pieces of every window; beside the result only a step of windows is held."""
    out = np.empty(max(0, len(hashes) - k + 1), U64)
    for at in range(0, len(out), STEP):
        out[at:at + STEP] = sliding_min(mixed(rolled(hashes[at:at + STEP + k - 1], m)), k - m + 1)
    return out


def superkmers(tok: Tokens, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each super-k-mer, and its minimiser."""
    mins = minimisers(tok.hashes, k, m)
    if not len(mins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), mins
    ends = np.cumsum(tok.counts)
    whole = tok.counts >= k
    mark = np.zeros(len(tok.hashes) + 1, np.int8)
    mark[(ends - tok.counts)[whole]] = 1
    mark[(ends - k + 1)[whole]] -= 1
    valid = np.cumsum(mark, dtype=np.int8)[:len(mins)].astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (mins[1:] != mins[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    value = mins[first]
    part, place = spread(-(-(last - first + 1) // LONGEST))  # no string grows long, as they would in periodic texts
    first = first[part] + place * LONGEST
    return first, np.minimum(first + LONGEST - 1, last[part]), value[part]


# --- announce ----------------------------------------------------------------------------------------------------


def homes(value: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (high half) and tag (low half) of minimisers."""
    return ((value >> U64(32)) % U64(buckets)).astype(np.int64) << 32 | (value & U64(0xFFFFFFFF)).astype(np.int64)


def by_head(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a sorted array of (head << 32 | tail) with one head each."""
    return (p for p in np.split(rows, np.flatnonzero(np.diff(rows >> 32)) + 1) if len(p))


def owned(home: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct homes in order, with the smallest and the largest document that has each."""
    order = np.argsort(home, kind="stable")
    home = home[order]
    heads = np.flatnonzero(np.diff(home, prepend=-1))
    if not len(heads):
        return home, least, most
    return home[heads], np.minimum.reduceat(least[order], heads), np.maximum.reduceat(most[order], heads)


def announce(batches: Iterator[pa.RecordBatch], method: Method, buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for batch, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            docs = opened_batch(blob.as_py())
            ids = docs.column("id").fill_null(NEVER).to_numpy()
            found = [(np.zeros(0, np.int64),) * 3]
            for held in pieces_of(docs, method):
                tok = method.tokenise([x[2] for x in held])
                first, _, value = superkmers(tok, method.k, method.m)
                piece = np.searchsorted(np.cumsum(tok.counts) - tok.counts, first, side="right") - 1
                owner = ids[np.array([x[0] for x in held], np.int64)[piece]]
                found.append(owned(homes(value, buckets), owner, owner))
            home, least, most = owned(*map(np.concatenate, zip(*found, strict=True)))  # over all chunks of the batch
            parts = list(by_head(home))
            marks = np.split(least < most, np.cumsum([len(p) for p in parts])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0] >> 32) for p in parts], pa.int32()), pa.array([batch] * len(parts), pa.int64()),
                                              pa.array([pack(np.diff(p & 0xFFFFFFFF, prepend=0).astype(np.uint32), np.packbits(m)) for p, m in zip(parts, marks, strict=False)], pa.binary())],
                                             ["bucket", "batch", "tags"])


def in_several(t: pa.Table) -> pa.Table:
    """Of the tags announced to one bucket, those of more than one batch or marked by one, sent back to each that has them."""
    bucket = t.column("bucket")[0].as_py()
    sent = [unpack(x) for x in t.column("tags").to_pylist()]
    tags = [np.cumsum(x.astype(np.int64)) for x, _ in sent]
    every, n = np.unique(np.concatenate(tags), return_counts=True)
    many = np.union1d(every[n > 1], np.concatenate([x[np.unpackbits(m, count=len(x)).astype(bool)] for x, (_, m) in zip(tags, sent, strict=True)]))
    mine = [x[np.isin(x, many, assume_unique=True)] for x in tags]
    return pa.table([t.column("batch"), pa.array([pack(np.array([bucket], np.int64), x.astype(np.uint32)) for x in mine], pa.binary())], ["batch", "tags"])


# --- strings to their buckets ------------------------------------------------------------------------------------


def ship(lists: pa.Table, batches: pa.Table, method: Method, buckets: int, fold: bool) -> pa.Table:
    """Super-k-mers of a batch whose minimiser another document has too, packed by bucket."""
    parts = [unpack(x) for x in lists.column("tags").to_pylist()]
    told = np.sort(np.concatenate([np.zeros(0, np.int64), *[int(b[0]) << 32 | x.astype(np.int64) for b, x in parts]]))
    names, numbers, blobs = [], [], []
    for batch, blob in zip(batches.column("batch").to_pylist(), batches.column("docs"), strict=True):
        docs = opened_batch(blob.as_py())
        ids = docs.column("id").fill_null(NEVER).to_numpy()
        for held in pieces_of(docs, method):
            for name, packed in _packed(held, ids, told, method, buckets, fold):
                names.append(name)
                numbers.append(batch)
                blobs.append(packed)
    return pa.table([pa.array(names, pa.int32()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])


def _packed(held: list, ids: np.ndarray, told: np.ndarray, method: Method, buckets: int, fold: bool) -> Iterator[tuple[int, bytes]]:
    places, bases = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
    tok = method.tokenise([x[2] for x in held])
    first, last, value = superkmers(tok, method.k, method.m)
    home = homes(value, buckets)
    begins = np.cumsum(tok.counts) - tok.counts
    piece = np.searchsorted(begins, first, side="right") - 1
    order = np.argsort(home, kind="stable")
    heads = np.flatnonzero(np.diff(home[order], prepend=-1))
    if not len(heads):
        return
    owner = ids[places[piece]]
    many = np.isin(home[order][heads], told)
    order = order[np.repeat(many, np.diff(np.append(heads, len(order))))]
    if not len(order):
        return
    keep = np.sort(order)
    first, last, home, piece, owner = first[keep], last[keep], home[keep], piece[keep], owner[keep]
    raw = tok.text.tobytes()
    text = [raw[a:b] for a, b in zip(tok.left[first].tolist(), tok.right[last + method.k - 1].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    source = np.fromiter(map(seen.setdefault, text, range(len(text))), np.int64, len(text))
    done = (owner[source] < owner) & fold
    start, windows, place = bases[piece] + first - begins[piece], last - first + 1, places[piece]
    order = np.argsort(home >> 32, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(home[order] >> 32)) + 1):
        docs, local = np.unique(place[part], return_inverse=True)
        live = part[~done[part]]
        strings = [text[i] for i in live.tolist()]
        tag = home[live] & 0xFFFFFF
        yield int(home[part[0]] >> 32), pack(
            small(docs), ids[docs], small(np.diff(local, prepend=0)), small(start[part]), small(windows[part]), done[part].astype(np.uint8),
            (tag & 255).astype(np.uint8), (tag >> 8 & 255).astype(np.uint8), (tag >> 16).astype(np.uint8),
            small(np.array([len(x) for x in strings], np.int64)), np.frombuffer(b"".join(strings), np.uint8))


# --- buckets -----------------------------------------------------------------------------------------------------


@dataclass
class Bucket:
    """Super-k-mers of one bucket: batch, place and id of the document, first token and window count of each.

    ``u`` is the place of its text in ``strings``, -1 if it came without or no second document has the minimiser.
    """

    batch: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    done: np.ndarray
    u: np.ndarray
    strings: list[bytes]
    owner: np.ndarray  # smallest document of each string


def opened(t: pa.Table) -> Bucket:
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    texts = []
    for number, blob in zip(t.column("batch").to_pylist(), t.column("blob").to_pylist(), strict=True):
        docs, d, local, s, w, gone, t0, t1, t2, sizes, text = unpack(blob)
        local = np.cumsum(local.astype(np.int64))
        for c, v in zip(cols, (np.full(len(local), number), docs[local].astype(np.int64), d[local], s.astype(np.int64), w.astype(np.int64), gone.astype(bool),
                               t0.astype(np.int64) | t1.astype(np.int64) << 8 | t2.astype(np.int64) << 16), strict=True):
            c.append(v)
        texts.append((text, np.append(0, np.cumsum(sizes.astype(np.int64)))))
    batch, place, ids, start, windows, done, tags = map(np.concatenate, cols)
    live = np.flatnonzero(~done)
    order = np.argsort(tags, kind="stable")
    heads = np.flatnonzero(np.diff(tags[order], prepend=-1)) if len(order) else order
    owner = ids[live][order]
    shared = np.zeros(len(live), bool)
    if len(order):
        many = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
        shared[order] = np.repeat(many, np.diff(np.append(heads, len(order))))
    strings: dict[bytes, int] = {}
    u = np.full(len(ids), -1, np.int64)
    at = 0
    for text, cut in texts:
        raw, mine = text.tobytes(), np.flatnonzero(shared[at:at + len(cut) - 1])
        for i, a, b in zip((live[at + mine]).tolist(), cut[mine].tolist(), cut[mine + 1].tolist(), strict=True):
            u[i] = strings.setdefault(raw[a:b], len(strings))
        at += len(cut) - 1
    least = np.full(len(strings), NEVER)
    np.minimum.at(least, u[u >= 0], ids[u >= 0])
    return Bucket(batch, place, ids, start, windows, done, u, list(strings), least)


def covered(b: Bucket, method: Method) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of the bucket, first and last token (exclusive) of the runs that a smaller document also holds."""
    whole = [np.flatnonzero(b.done)]
    out = []
    if b.strings:
        tok = method.tokenise(b.strings)
        n = tok.counts - method.k + 1
        least = method.smallest(tok, b.owner, method.k)
        first = np.cumsum(n) - n
        low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
        e = np.flatnonzero(b.u >= 0)
        e = e[low[b.u[e]] < b.ids[e]]
        full = high[b.u[e]] < b.ids[e]
        whole.append(e[full])
        e = e[~full]
        sizes = n[b.u[e]]
        for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(np.cumsum(sizes) // (4 << 20))) + 1):
            mine = e[part]
            if not len(mine):
                continue
            group, j = spread(sizes[part])
            hit = least[first[b.u[mine]][group] + j] < b.ids[mine][group]
            head, tail = hit.copy(), hit.copy()
            head[1:] &= ~hit[:-1] | (j[1:] == 0)
            tail[:-1] &= ~hit[1:] | (j[1:] == 0)
            head, tail = np.flatnonzero(head), np.flatnonzero(tail)
            who = mine[group[head]]
            out.append((who, b.start[who] + j[head], b.start[who] + j[tail] + method.k))
    w = np.concatenate(whole)
    out.append((w, b.start[w], b.start[w] + b.windows[w] + method.k - 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def settle_bucket(t: pa.Table, method: Method) -> pa.Table:
    b = opened(t)
    entry, start, end = covered(b, method)
    batch, place = b.batch[entry], b.place[entry]
    order = np.lexsort((start, place, batch))
    names, blobs = [], []
    for p in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
        if len(p):
            names.append(int(batch[p[0]]))
            blobs.append(pack(small(np.diff(place[p], prepend=0)), small(start[p]), small(end[p] - start[p])))
    return pa.table([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "ranges"])


# --- documents ---------------------------------------------------------------------------------------------------


def merged(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of ranges, as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()


def cut_documents(ranges: pa.Table, batches: pa.Table, method: Method) -> pa.Table:
    found = [unpack(x) for x in ranges.column("ranges").to_pylist()]
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if found:
        place = np.concatenate([np.cumsum(f[0].astype(np.int64)) for f in found])
        start, size = (np.concatenate([f[i].astype(np.int64) for f in found]) for i in (1, 2))
        order = np.argsort(place, kind="stable")
        place, start, size = place[order], start[order], size[order]
        for p in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
            spans[int(place[p[0]])] = start[p], start[p] + size[p]
    out = []
    span = pa.list_(pa.field("element", pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    for blob in batches.column("docs").to_pylist():
        docs = opened_batch(blob)
        total, gone, kept, runs = [], [], [], []
        for d, raw in enumerate(docs.column("text")):
            raw = raw.as_py()
            parts = method.parts(raw or b"")
            a, b = merged(*spans[d]) if d in spans else ([], [])
            total.append(len(parts))
            gone.append(sum(b) - sum(a))
            kept.append(None if raw is None else method.joined([parts[x:y] for x, y in zip([0, *b], [*a, len(parts)], strict=True)]))
            runs.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
        out.append(pa.table([docs.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, span)],
                            ["row", "n_tokens", "n_removed", "kept", "spans"]))
    return pa.concat_tables(out)


# --- the flow ----------------------------------------------------------------------------------------------------


def _batches(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, int, T.StructType]:
    """The table of batches, the number of buckets, and the type of ``row``."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.cast("binary").alias("text"), row.alias("row"))
    table = settle(read.mapInArrow(packed_batches, "batch long, docs binary"))
    length = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return table, max(2 * shuffle_partitions(spark), -(-length // BUCKET)), read.schema["row"].dataType


def _shipped(table: DataFrame, method: Method, buckets: int, fold: bool) -> DataFrame:
    told = (table.mapInArrow(lambda it: announce(it, method, buckets), "bucket int, batch long, tags binary")
            .groupBy("bucket").applyInArrow(in_several, "batch long, tags binary"))
    return (told.groupBy("batch").cogroup(table.groupBy("batch"))
            .applyInArrow(lambda a, b: ship(a, b, method, buckets, fold), "bucket int, batch long, blob binary"))


def without_repeats(docs: DataFrame, method: Method, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of the columns in ``carry``, all but the text if None), ``n_tokens``,
    ``n_removed``, ``kept`` (the bytes left, null for a null text) and ``spans`` (removed runs of tokens, end exclusive)."""
    table, buckets, row = _batches(docs, id_col, text_col, [c for c in docs.columns if c != text_col] if carry is None else carry)
    shape = T.StructType([T.StructField("row", row), T.StructField("n_tokens", T.LongType()), T.StructField("n_removed", T.LongType()),
                          T.StructField("kept", T.BinaryType()), T.StructField("spans", SPANS)])
    ranges = _shipped(table, method, buckets, True).groupBy("bucket").applyInArrow(lambda t: settle_bucket(t, method), "batch long, ranges binary")
    return ranges.groupBy("batch").cogroup(table.groupBy("batch")).applyInArrow(lambda a, b: cut_documents(a, b, method), shape)


def bucket_rows(docs: DataFrame, method: Method, id_col: str, text_col: str, each: Callable[[Bucket], pa.Table], shape: str) -> DataFrame:
    """What ``each`` makes of the buckets, all copies present with their text."""
    table, buckets, _ = _batches(docs, id_col, text_col, [])
    return _shipped(table, method, buckets, False).groupBy("bucket").applyInArrow(lambda t: each(opened(t)), shape)
