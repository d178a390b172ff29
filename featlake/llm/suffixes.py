"""Exact deduplication of byte strings with enhanced suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from featlake.llm.common import U64, rolled, spread
from featlake.llm.superkmer import NEVER, Bucket, Method, Tokens, bucket_rows, byte_pieces, byte_tokens, without_repeats

EDGE = 3 << 256  # a string's left end differs from every other left neighbour, so it counts as two


def eights(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, first byte highest; zeros follow the end."""
    a = np.append(text, np.zeros(8, np.uint8)).astype(U64)
    for step in (1, 2, 4):
        a = a[:-step] << U64(8 * step) | a[step:]
    return a[:len(text) + 1]


def suffix_array(tok: Tokens, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that share their first ``k`` bytes with another one and can start a maximal repeat.

    Returns the string and the place in it of each suffix, in order (hash of the first ``k`` bytes, then the bytes after
    them), the common prefix with the one before (0 where the first ``k`` bytes differ), and the byte to the left
    (256: none). Where all suffixes of one ``k``-byte prefix have the same left byte, every repeat among them goes
    on to the left, so none of them is maximal and they are left out before sorting.
    """
    n = tok.counts - k + 1
    string, j = spread(n)
    at = (np.cumsum(tok.counts) - tok.counts)[string] + j
    hashes = rolled(tok.hashes, k)[at]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]  # a prefix that stands once is no repeat
    string, j, at, hashes = string[order], j[order], at[order], hashes[order]
    word = eights(tok.text)
    equal = hashes[1:] == hashes[:-1]
    steps = [*range(0, k - 7, 8), k - 8]
    true = equal & np.logical_and.reduce([word[at[1:] + s] == word[at[:-1] + s] for s in steps])
    if (true != equal).any():  # two prefixes share a hash: part them by their bytes
        order = np.lexsort([word[at + s] for s in reversed(steps)])
        string, j, at = string[order], j[order], at[order]
        true = np.logical_and.reduce([word[at[1:] + s] == word[at[:-1] + s] for s in steps])
    left = np.where(j > 0, tok.text[at - 1].astype(np.int64), 256)
    heads = np.flatnonzero(np.append(True, ~true)) if len(at) else np.zeros(0, np.int64)
    if not len(heads):
        return string, j, at, left
    sizes = np.diff(np.append(heads, len(at)))
    most = np.maximum.reduceat(left, heads)
    diverse = (sizes > 1) & ((np.minimum.reduceat(left, heads) != most) | (most == 256))
    keep, run = np.repeat(diverse, sizes), np.repeat(np.arange(len(heads)), sizes)
    string, j, at, left, run = string[keep], j[keep], at[keep], left[keep], run[keep]
    rest = tok.counts[string] - j - k  # bytes after the prefix
    keys = []
    for s in range(0, int(rest.max(initial=0)), 8):
        w = word[np.minimum(at + k + s, len(tok.text))]
        short = np.clip(8 - (rest - s), 0, 8).astype(U64)
        keys.append(np.where(short == 8, U64(0), w >> (U64(8) * np.minimum(short, U64(7))) << (U64(8) * np.minimum(short, U64(7)))))
    order = np.lexsort([rest, *reversed(keys), run])
    string, j, left, run, rest = string[order], j[order], left[order], run[order], rest[order]
    lcp = np.zeros(len(run), np.int64)
    open_ = run[1:] == run[:-1]
    for key in keys:
        x = key[order][1:] ^ key[order][:-1]
        same = sum((x < U64(1 << b)).astype(np.int64) for b in range(8, 64, 8)) + (x == 0)
        lcp[1:] += np.where(open_, same, 0)
        open_ &= x == 0
    inside = run[1:] == run[:-1]
    lcp[1:] = np.where(inside, k + np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1])), 0)
    return string, j, lcp, left


def intervals(lcp: np.ndarray, left: np.ndarray, owner: np.ndarray):
    """Common-prefix interval tree, bottom up by one scan with a stack.

    Yields (first, last exclusive, length, smallest owner) of the intervals whose suffixes differ in the byte to
    their left: the maximal repeats.
    """
    stack: list[list] = []
    marks = [EDGE if c == 256 else 1 << c for c in left.tolist()]
    for i, (depth, mark, own) in enumerate(zip([*lcp.tolist(), 0], [*marks, 0], [*owner.tolist(), NEVER], strict=True)):
        first, below, least = i - 1, (marks[i - 1] if i else 0), (int(owner[i - 1]) if i else NEVER)
        while stack and stack[-1][0] > depth:
            size, first, seen, low = stack.pop()
            below, least = below | seen, min(least, low)
            if below & (below - 1):
                yield first, i, size, least
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2] |= below
                stack[-1][3] = min(stack[-1][3], least)
            else:
                stack.append([depth, first, below, least])


def by_intervals(tok: Tokens, owners: np.ndarray, k: int) -> np.ndarray:
    """Smallest document of every window, from the maximal repeats that cover it."""
    n = tok.counts - k + 1
    out = np.repeat(owners, n)
    first = np.cumsum(n) - n
    string, j, lcp, left = suffix_array(tok, k)
    where = first[string] + j
    best = np.full(len(where), NEVER)  # of the deeper repeats that a suffix is in, which reach further
    found = []
    for lo, hi, size, least in intervals(lcp, left, owners[string]):
        new = lo + np.flatnonzero(best[lo:hi] > least)
        if len(new):
            best[new] = least
            found.append((least, size - k + 1, where[new].tolist()))
    for least, size, places in sorted(found, key=lambda x: -x[0]):  # the smallest document is written last
        for p in places:
            out[p:p + size] = least
    return out


def method(window: int = 50, minimiser: int = 20) -> Method:
    return Method(window, min(minimiser, window), byte_tokens, byte_pieces, by_intervals, bytes, b"".join)


def remove_repeated_bytes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Remove every byte covered by ``window`` bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes and judged as they came in. Result: one row for each input row with ``row`` (the columns in
    ``carry``, all if None), ``n_tokens`` bytes, ``n_removed``, ``kept`` (the bytes left) and ``spans`` (maximal removed
    runs of bytes). ``window`` is 8 at least.

    A null text is empty; a row without id keeps all its bytes and is no source; rows that share an id are no source
    for each other; shorter texts and an empty table pass unchanged.
    """
    return without_repeats(docs, method(window), id_col, text_col, carry)


def repeat_groups(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats with all their occurrences: (bucket, repeat, length, text, doc_id, start), one row for each.

    A repeat is maximal among the strings of its bucket, which reach as far as one minimiser rules; longer repeats
    appear as a chain of overlapping ones. ``text`` is binary.
    """
    how = method(window)

    def each(b: Bucket) -> pa.Table:
        rows = {"repeat": [], "length": [], "text": [], "doc_id": [], "start": []}
        groups: list[tuple[list, int]] = []
        if b.strings:
            tok = how.tokenise(b.strings)
            string, j, lcp, left = suffix_array(tok, window)
            groups = [(list(zip(string[lo:hi].tolist(), j[lo:hi].tolist(), strict=True)), size) for lo, hi, size, _ in intervals(lcp, left, b.owner[string])]
        users: dict[int, list[int]] = {}
        for i in np.flatnonzero(b.u >= 0).tolist():
            users.setdefault(int(b.u[i]), []).append(i)
        known = {(s, size) for g, size in groups for s, p in g if p == 0}
        groups += [([(s, 0)], len(b.strings[s])) for s, who in users.items() if len(who) > 1 and (s, len(b.strings[s])) not in known]
        for r, (g, size) in enumerate(groups):
            for s, p in g:
                for i in users[s]:
                    for c, v in zip(rows.values(), (r, size, b.strings[s][p:p + size], int(b.ids[i]), int(b.start[i]) + p), strict=True):
                        c.append(v)
        return pa.table([pa.array(rows["repeat"], pa.int32()), pa.array(rows["length"], pa.int32()), pa.array(rows["text"], pa.binary()),
                         pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64())], list(rows))

    return bucket_rows(docs, how, id_col, text_col, each, "repeat int, length int, text binary, doc_id long, start long")
