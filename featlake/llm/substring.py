"""Exact substring deduplication on windows of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from featlake.llm.common import rolled
from featlake.llm.superkmer import Method, Tokens, spread, without_repeats, word_pieces, word_tokens


def by_sorting(tok: Tokens, owners: np.ndarray, k: int) -> np.ndarray:
    """Smallest document of every window: windows are sorted by hash, equal neighbours compared by their words."""
    n = tok.counts - k + 1
    string, j = spread(n)
    at = (np.cumsum(tok.counts) - tok.counts)[string] + j
    hashes = rolled(tok.hashes, k)[at]
    order = np.argsort(hashes)
    left, right, raw = tok.left[at][order], tok.right[at + k - 1][order], tok.text.tobytes()
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1
    pairs = zip(left[same].tolist(), right[same].tolist(), left[same - 1].tolist(), right[same - 1].tolist(), strict=True)
    equal = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in pairs), bool, len(same))
    if not equal.all():  # two windows share a hash: sort by the words themselves
        words = [raw[a:b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        again = sorted(range(len(words)), key=words.__getitem__)
        order = order[again]
        same = np.array([i for i in range(1, len(again)) if words[again[i]] == words[again[i - 1]]], np.int64)
    else:
        same = same[equal]
    new = np.ones(len(order), bool)
    new[same] = False
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[string][order], heads)
    out = np.empty(len(order), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return out


def method(window: int = 13, minimiser: int = 4) -> Method:
    return Method(window, min(minimiser, window), word_tokens, word_pieces, by_sorting, bytes.split,
                  lambda runs: b" ".join(w for r in runs for w in r))


def remove_repeated_words(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Remove every word covered by ``window`` consecutive words that also start in a document with a smaller id.

    Words are parted by ASCII white space and compared unchanged. Windows are judged on the input. Result: one row for
    each input row with ``row`` (the columns in ``carry``, all if None), ``n_tokens`` words, ``n_removed``, ``kept``
    (the words left, joined by one space, as bytes) and ``spans`` (removed runs of words).

    A null text has no words; a row without id keeps all its words and is no source; rows that share an id are no
    source for each other; texts below the window, empty texts and an empty table pass unchanged.
    """
    return without_repeats(docs, method(window), id_col, text_col, carry)
