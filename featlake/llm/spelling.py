"""Groups of spelling variants: pairs of words one edit apart, from blocked Gram matrices of their letter counts.

One inserted or deleted letter changes one letter count by one, one replaced letter changes two, so the squared distance of
the count vectors of two near words is 1 or 2. The products of blocks of count vectors give all squared distances of a
block at once; the pairs at most 2 apart are then compared letter by letter.

Not every two words need to meet. The alphabet is cut into ``PARTS`` parts. An edit touches two parts at most, so near words agree in
all counts of at least ``PARTS - 2`` parts: each word goes to one block for each choice of so many parts, which holds the words
with these counts and with lengths L and L + 1. A pair counts in the first choice in which it agrees. Blocks above ``TILE`` words are split
into tiles, and each two tiles meet in a group of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.session import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 26 + 64  # a to z, then U+00C0 to U+00FF
DROP = 97  # a run whose checksum this divides loses a letter
SHORTEST, FEWEST = 5, 3  # letters and occurrences of a word
PARTS = 4
TILE = 2048
MERGED = 384  # small blocks are multiplied together until they hold so many words
PIECE = 1 << 20  # characters of a text that are cut into words at a time
HELD = 200_000  # different words a task counts before it hands them on


def pieces_of(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, none of which ends within a run."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (m := RUN.match(text, end)):
            end = m.end()
        yield text[at:end]
        at = end


def spelled(ident: str, run: str) -> str:
    """The word that a lower-cased run of the document stands for."""
    h = zlib.crc32(f"{ident}:{run}".encode())
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """Rows (id as text, text in lower case) as (word, n), words of at least ``shortest`` letters."""
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return got

    for batch in batches:
        low = pc.ascii_lower(batch.column(1))
        for ident, text in zip(batch.column(0), low, strict=True):
            ident = ident.as_py() or ""
            for piece in pieces_of(text.as_py() or ""):
                for run, n in Counter(RUN.findall(piece)).items():
                    if len(run) >= shortest:
                        word = spelled(ident, run)
                        if len(word) >= shortest:
                            total[word] += n
                if len(total) > HELD:
                    yield out()
    if total:
        yield out()


def words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur ``fewest`` times in all texts; null texts have none, a null id counts as empty text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    each = rows.mapInArrow(lambda it: counted(it, shortest), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


# --- words as arrays ---------------------------------------------------------------------------------------------


class Spelled:
    """Letters of many words end to end, and how often each word holds each letter."""

    def __init__(self, words: list[str]):
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.letters = np.where(code < 0xC0, code - ord("a"), code - 0xC0 + 26).astype(np.int16)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(owner * LETTERS + self.letters, minlength=len(words) * LETTERS).reshape(-1, LETTERS)


def choices(parts: int) -> list[tuple[int, ...]]:
    """The sets of ``parts - 2`` parts, in a fixed order."""
    return list(combinations(range(parts), parts - 2))


def keyed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) as (choice, key, role, word, n): the block of each choice with the word's length (role 0) and with the length below (role 1)."""
    of_part = [np.flatnonzero(np.arange(LETTERS) % parts == p) for p in range(parts)]
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = whole.slice(at, 20_000)
            w = Spelled(batch.column(0).to_pylist())
            counts = w.counts.astype(np.uint32)
            for c, chosen in enumerate(choices(parts)):
                cols = np.concatenate([of_part[p] for p in chosen])
                for role in (0, 1):
                    sign = np.ascontiguousarray(np.concatenate([(w.length - role)[:, None].astype(np.uint32), counts[:, cols]], axis=1))
                    key = np.fromiter((xxhash.xxh64_intdigest(r, c) for r in sign), np.uint64, len(sign)).view(np.int64)
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(key), pa.array(np.full(n, role, np.int32)), batch.column(0), batch.column(1)],
                                                     ["choice", "key", "role", "word", "n"])


def one_edit(w: Spelled, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether word ``b`` follows from word ``a`` by one replaced letter, or by one inserted letter if it is longer by one."""
    out = np.zeros(len(a), bool)
    for length in np.unique(w.length[a]):
        step = max(1, 2_000_000 // int(length))
        for longer in (0, 1):
            at = np.flatnonzero((w.length[a] == length) & (w.length[b] == length + longer))
            for s in range(0, len(at), step):
                some = at[s:s + step]
                x = w.letters[w.start[a[some]][:, None] + np.arange(length)]
                y = w.letters[w.start[b[some]][:, None] + np.arange(length + longer)]
                if longer:
                    ahead = np.cumprod(x == y[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                    behind = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
                    out[some] = ahead + behind >= length
                else:
                    out[some] = (x != y).sum(axis=1) == 1
    return out


def first_choice(w: Spelled, a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """The first choice of parts in which the words of a pair agree; -1 if there is none."""
    differ = w.counts[a] != w.counts[b]
    part = np.stack([differ[:, p::parts].any(axis=1) for p in range(parts)], axis=1)
    out = np.full(len(a), -1)
    for c, chosen in reversed(list(enumerate(choices(parts)))):
        out[~part[:, chosen].any(axis=1)] = c
    return out


def close_pairs(w: Spelled, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the words ``left`` and ``right`` with squared distances of 2 at most, from one product of their counts."""
    used = np.flatnonzero(w.counts[left].any(axis=0) | w.counts[right].any(axis=0))
    x, y = w.counts[np.ix_(left, used)].astype(np.float64), w.counts[np.ix_(right, used)].astype(np.float64)
    kind = np.float32 if max(float((x * x).sum(axis=1).max()), float((y * y).sum(axis=1).max())) < 1 << 22 else np.float64  # where sums of squares are exact
    x, y = x.astype(kind), y.astype(kind)
    apart = x @ y.T
    apart *= -2
    apart += (x * x).sum(axis=1)[:, None]
    apart += (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero(apart <= 2)
    return left[i], right[j]


def near_in(w: Spelled, block: np.ndarray, side: np.ndarray, role: np.ndarray, choice: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of the same block, each once: the first word has role 0.

    ``side`` is 0 for words of a block that is not split, 1 and 2 for those of two tiles that meet.
    """
    low = np.flatnonzero(role == 0)
    a, b = close_pairs(w, low, np.arange(len(block))) if len(low) else (low, low)
    ok = (block[a] == block[b]) & ((side[a] == 0) | (side[a] != side[b])) & ((role[b] == 1) | (a < b))
    a, b = a[ok], b[ok]
    ok = first_choice(w, a, b, parts) == choice[a]
    a, b = a[ok], b[ok]
    ok = one_edit(w, a, b)
    return a[ok], b[ok]


def blocks_met(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (choice, key, group, side, role, word, n) as near pairs (a, n_a, b, n_b), both ways round.

    A group is whole before it is multiplied: small ones together, as many as hold ``MERGED`` words.
    """
    names = ["choice", "key", "group", "side", "role", "word", "n"]
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch]).rename_columns(names)
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= 20_000:
            tag = np.stack([held.column(c).to_numpy() for c in ("choice", "key", "group")])
            last = np.flatnonzero((tag[:, 1:] != tag[:, :-1]).any(axis=0))
            if len(last):
                yield from _met(held.slice(0, int(last[-1]) + 1), parts)
                held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield from _met(held, parts)


def _met(rows: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    choice, key, group, side, role = (rows.column(c).to_numpy() for c in ("choice", "key", "group", "side", "role"))
    new = np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
    block = np.cumsum(new) - 1
    starts = np.r_[np.flatnonzero(new), len(new)]
    words, n = rows.column("word"), rows.column("n")
    first = 0
    while first < len(starts) - 1:
        last = first + 1
        while last < len(starts) - 1 and starts[last + 1] - starts[first] <= MERGED:
            last += 1
        lo, hi = int(starts[first]), int(starts[last])
        first = last
        if hi - lo < 2:
            continue
        w = Spelled(words.slice(lo, hi - lo).to_pylist())
        a, b = near_in(w, block[lo:hi], side[lo:hi], role[lo:hi], choice[lo:hi], parts)
        if len(a):
            x, y = np.r_[a, b] + lo, np.r_[b, a] + lo
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (words.take(x), n.take(x), words.take(y), n.take(y))], ["a", "n_a", "b", "n_b"])


def near_pairs(vocab: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(a, n_a, b, n_b) for each two words of ``vocab`` (word, n; letters as in ``RUN``, without A-Z, each word once) that are one edit apart, both ways round.

    More parts make more and smaller blocks, for larger vocabularies; the result is the same.
    """
    rows = settle(vocab.select("word", "n").mapInArrow(lambda it: keyed(it, parts), "choice int, key long, role int, word string, n long"))
    many = settle(rows.groupBy("choice", "key").agg(F.count("*").alias("size")).where(F.col("size") > tile)
                  .select("choice", "key", F.ceil(F.col("size") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("word"), "tiles").cast("int")
    dealt = rows.join(many, ["choice", "key"], "left").select("choice", "key", "role", "word", "n", F.coalesce("tiles", F.lit(1)).alias("tiles")).withColumn("tile", own)
    dealt = dealt.select("choice", "key", "role", "word", "n", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("choice", "key", (low * F.col("tiles") + high).cast("long").alias("group"), side.cast("int").alias("side"), "role", "word", "n")
    dealt = dealt.repartition("choice", "key", "group").sortWithinPartitions("choice", "key", "group")
    return dealt.mapInArrow(lambda it: blocks_met(it, parts), "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the last word that the chain of ``forms`` (word, form) leads to. A chain must end; its length may double each round."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now
    raise RuntimeError(f"no end after {rounds} rounds")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = 2, id_col: str = "doc_id", text_col: str = "text",
             parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its more frequent spelling and the last one of that chain.

    A word's form is the most frequent word one edit away (ties: the smallest in code-point order), if it occurs ``times`` as often;
    counts at least double along a chain for the default, so chains end. Null and empty texts have no words; rows that repeat
    an id or a text count each time; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that chains end")
    vocab = settle(words(docs, shortest, fewest, id_col, text_col))
    pairs = near_pairs(vocab, parts, tile)
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = settle(pairs.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best))
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    strong = F.col("form_n") >= times * F.col("n")
    known = settle(known.select("word", "n", "n_near", F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
