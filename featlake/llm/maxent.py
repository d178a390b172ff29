"""A hashed maximum-entropy language model.

Words are leaves of a tree of classes with ``WAYS`` ways each, so the probability of a word is a product of small softmaxes, one for each class
on the way to it. A softmax adds up a prior, and one row of ``WAYS`` weights for each feature of the context: the word before and, in the first ``WIDE`` classes
of the way, the two before and the one before the last (a skip). Rows are found by hashing the feature with the class. The prior gives each word
its add-half share of the training tokens, so a model without weights is the base model, and weights tell what the context changes.

Training is rounds of gradient steps. In a round each learner goes once over its documents, in small batches of sparse gradients
scaled by their history, from the same weights; Spark then averages each row over the learners by the number of times they
met it, a few learners at a time. All words of the corpus are counted. The most frequent ones, at most ``HEAD``, have leaves of their own; all others share
one leaf and, within it, their add-half shares, which a join finds for them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import U64, mixed
from featlake.session import settle

END = b" "  # stands for the end of a text; no word holds a space
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20  # bytes of a text that are cut into words at a time
HELD = 300_000  # different words a task counts before it hands them on
HEAD = 1 << 18  # words with a leaf of their own: bounds what is broadcast and fetched
LONGEST = 64  # bytes of such a word
WAYS = 16
BITS = 18  # 2^BITS rows of weights: bounds the model's memory, 17 MB
RATE = 0.35
ROUNDS = 2
WIDE = 2  # classes on the way to a word that see all features
SLICE = 4_096  # rows of weights that are handed on together
FAN = 32  # learners whose rows are averaged by one task
MINI = 8_192  # tokens of a gradient step
LEARNER_TOKENS = 1 << 23  # training tokens of a learner, about


def remainder(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % 5


# --- tokens ------------------------------------------------------------------------------------------------------


def token_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, a piece at a time; the last list ends with the end."""
    text, at = text or b"", 0
    while len(text) - at > PIECE and (m := SPACE.search(text, at + PIECE)):
        yield text[at:m.start()].lower().split()
        at = m.end()
    yield [*text[at:].lower().split(), END]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (token, n)."""
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])
        total.clear()
        return got

    for batch in batches:
        for text in batch.column(0):
            for tokens in token_lists(text.as_py()):
                total.update(tokens)
                if len(total) > HELD:
                    yield out()
    if total:
        yield out()


def counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts, the end of each included."""
    return texts.mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


# --- classes -----------------------------------------------------------------------------------------------------


@dataclass
class Classes:
    """A tree over the words 0, 1, ... of the given weights: the classes on the way to each word end to end, and the way taken in each."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    way: np.ndarray
    prior: np.ndarray  # log of each way's share, one row for each class


def classes(weight: np.ndarray) -> Classes:
    """Each class cuts its words, in falling weight, into ``WAYS`` runs of about equal weight, until a run is one word.

    The middle of the first of more than ``WAYS`` words lies in the lower half, that of the last one in the last run, so every cut parts them.
    """
    order = np.argsort(-weight, kind="stable")
    w = weight[order].astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(w)])
    group = np.zeros(len(w), np.int64)  # class of each open word
    open_ = np.arange(len(w)) if len(w) > 1 else np.zeros(0, np.int64)
    nodes, ways, owners, made = [], [], [], 0
    while len(open_):
        first = np.r_[True, group[open_][1:] != group[open_][:-1]]
        ident = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        size = np.diff(np.r_[starts, len(open_)])
        place = np.arange(len(open_)) - starts[ident]
        low, high = total[open_[starts]], total[open_[np.r_[starts[1:], len(open_)] - 1] + 1]
        even = ((total[open_] + w[open_] / 2 - low[ident]) / (high - low)[ident] * WAYS).astype(np.int64).clip(0, WAYS - 1)
        way = np.where(size[ident] <= WAYS, place, even)
        nodes.append(made + ident)
        ways.append(way)
        owners.append(open_)
        made += len(starts)
        run = ident * WAYS + way
        alone = np.bincount(run, minlength=len(starts) * WAYS)[run] == 1
        group[open_] = run
        open_ = open_[~alone]
    if not nodes:
        one = np.zeros(len(w), np.int64)
        return Classes(one, one, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((1, WAYS), np.float32))
    node, way, owner = (np.concatenate(x) for x in (nodes, ways, owners))
    share = np.zeros((made, WAYS))
    np.add.at(share, (node, way), w[owner])
    with np.errstate(divide="ignore"):
        prior = np.log(share / share.sum(axis=1, keepdims=True))
    prior[np.isneginf(prior)] = -1e30
    word = order[owner]
    sort = np.argsort(word, kind="stable")  # levels stay in order
    length = np.bincount(word, minlength=len(w))
    return Classes(np.cumsum(length) - length, length, node[sort], way[sort], prior.astype(np.float32))


@dataclass
class Model:
    """What learners and scorers need: the head's words and counts, the classes, and the weights."""

    words: pa.Array
    n: np.ndarray
    tokens: int
    types: int
    tree: Classes
    bits: int
    weights: np.ndarray
    history: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def rare(self) -> int:
        """The leaf of all words outside the head; one more stands for the place before a text."""
        return len(self.words)

    @property
    def rare_mass(self) -> float:
        return self.tokens - float(self.n.sum()) + 0.5 * (self.types - len(self.n) + 1)


_IDS: dict[str, dict[bytes, int]] = {}  # of the last model a worker has met


def ids_of(model: Model) -> dict[bytes, int]:
    if model.key not in _IDS:
        _IDS.clear()
        _IDS[model.key] = {w: i for i, w in enumerate(model.words.to_pylist())}
    return _IDS[model.key]


@dataclass
class Steps:
    """The classes on the ways to some words, the first of each word before the second, and so on.

    ``row`` has the rows of weights of the word before, for each class, then those of the other two features, for the first ``wide`` classes each.
    """

    token: np.ndarray
    node: np.ndarray
    way: np.ndarray
    wide: int
    row: np.ndarray


def steps(model: Model, word: np.ndarray, before: np.ndarray, before2: np.ndarray) -> Steps:
    t = model.tree
    start, length = t.start.take(word), t.length.take(word)
    token, at, wide, open_ = [], [], 0, np.flatnonzero(length)
    level = 0
    while len(open_):
        token.append(open_)
        at.append(start.take(open_) + level)
        level += 1
        wide += len(open_) * (level <= WIDE)
        open_ = open_[length.take(open_) > level]
    if not token:
        none = np.zeros(0, np.int64)
        return Steps(none, none, none, 0, none)
    token, at = np.concatenate(token), np.concatenate(at)
    node = t.node.take(at)
    a, b = before.astype(U64) + U64(1), before2.astype(U64) + U64(1)
    feature = [mixed(a), mixed((a << U64(24)) + b), mixed((b << U64(24)) + (U64(1) << U64(60)))]
    salt = node.astype(U64) * U64(0x9E3779B97F4A7C15)
    row = np.concatenate([feature[0].take(token) ^ salt, feature[1].take(token[:wide]) ^ salt[:wide], feature[2].take(token[:wide]) ^ salt[:wide]])
    row *= U64(0xD1342543DE82EF95)
    row ^= row >> U64(32)
    row *= U64(0x9E3779B97F4A7C15)
    row >>= U64(64 - model.bits)
    return Steps(token, node, t.way.take(at), wide, row.view(np.int64))


def weighed(model: Model, s: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each step the weights of all ways as exponentials, their sum, and the log of the probability of the way taken."""
    z, n = model.tree.prior.take(s.node, axis=0), len(s.node)
    z += model.weights.take(s.row[:n], axis=0)
    z[:s.wide] += model.weights.take(s.row[n:n + s.wide], axis=0)
    z[:s.wide] += model.weights.take(s.row[n + s.wide:], axis=0)
    np.minimum(z, 60, out=z)  # far above what training reaches; exp stays finite
    taken = z.ravel().take(np.arange(n) * WAYS + s.way).astype(np.float64)
    np.exp(z, out=z)
    total = z @ np.ones(WAYS, np.float32)
    return z, total, taken - np.log(total)


def learn(model: Model, word: np.ndarray, before: np.ndarray, before2: np.ndarray, met: np.ndarray) -> None:
    """One gradient step on a batch of tokens; ``met`` counts how often a row was used."""
    s = steps(model, word, before, before2)
    n = len(s.node)
    if not n:
        return
    slope, total, _ = weighed(model, s)
    slope *= (1 / total)[:, None]
    slope.ravel()[np.arange(n) * WAYS + s.way] -= 1
    order = np.argsort(s.row)
    sort = s.row.take(order)
    starts = np.flatnonzero(np.r_[True, sort[1:] != sort[:-1]])
    times = np.diff(np.r_[starts, len(sort)])
    row = sort.take(starts)
    of = np.concatenate([np.arange(n), np.arange(s.wide), np.arange(s.wide)]).take(order)  # the step of each use
    sums = slope.take(of.take(starts), axis=0)
    many = np.flatnonzero(times > 1)  # most rows are met once; only the others are added up
    if len(many):
        size = times.take(many)
        first = np.cumsum(size) - size
        at = np.repeat(starts.take(many) - first, size) + np.arange(size.sum())
        sums[many] = np.add.reduceat(slope.take(of.take(at), axis=0), first, axis=0)
    met[row] += times
    history = model.history.take(row) + np.einsum("ij,ij->i", sums, sums) / WAYS
    model.history[row] = history
    sums *= (RATE / np.sqrt(history))[:, None]
    model.weights[row] = model.weights.take(row, axis=0) - sums


@dataclass
class Pending:
    """Tokens of several texts and their contexts, waiting to be worked on."""

    word: list = field(default_factory=list)
    before: list = field(default_factory=list)
    before2: list = field(default_factory=list)
    row: list = field(default_factory=list)
    size: int = 0

    def add(self, row: int, ids: np.ndarray, last: tuple[int, int]) -> None:
        self.word.append(ids)
        self.before.append(np.concatenate([last[1:], ids[:-1]]))
        self.before2.append(np.concatenate([last, ids[:-2]])[:len(ids)])
        self.row.append(np.full(len(ids), row))
        self.size += len(ids)

    def take(self) -> Iterator[tuple[np.ndarray, ...]]:
        parts = [np.concatenate(x) for x in (self.word, self.before, self.before2, self.row)]
        self.__init__()
        for at in range(0, len(parts[0]), MINI):
            yield tuple(p[at:at + MINI] for p in parts)


def coded(text: bytes | None, ids: dict[bytes, int], rare: int, named: bool = True) -> Iterator[tuple[np.ndarray, tuple[int, int], list[bytes]]]:
    """A text's words as numbers a piece at a time, the two before each piece, and its words outside the head, if ``named``."""
    last = (rare + 1, rare + 1)
    for tokens in token_lists(text):
        code = np.fromiter(map(ids.get, tokens, repeat(rare)), np.int64, len(tokens))
        if len(code):
            yield code, last, [tokens[i] for i in np.flatnonzero(code == rare).tolist()] if named else []
            last = (*last, *code[-2:].tolist())[-2:]


def learned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Texts as (slice, learner, rows): what a learner made of each slice of the weights, packed."""
    ids, met = ids_of(model), np.zeros(1 << model.bits, np.float32)
    model = replace(model, weights=model.weights.copy(), history=model.history.copy())
    old = model.history.copy()
    held = Pending()
    for batch in batches:
        for text in batch.column(0):
            for code, last, _ in coded(text.as_py(), ids, model.rare, named=False):
                held.add(0, code, last)
                if held.size >= 8 * MINI:
                    for word, before, before2, _row in held.take():
                        learn(model, word, before, before2, met)
    if held.size:
        for word, before, before2, _row in held.take():
            learn(model, word, before, before2, met)
    learner = TaskContext.get().partitionId()
    for i in range(0, len(met), SLICE):
        row = np.flatnonzero(met[i:i + SLICE])
        if len(row):
            got = packed(row, met[i + row], model.history[i + row] - old[i + row], model.weights[i + row])
            yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([learner], pa.int32()), pa.array([got], pa.binary())], ["slice", "learner", "rows"])


def packed(row: np.ndarray, met: np.ndarray, history: np.ndarray, weights: np.ndarray) -> bytes:
    return row.astype(np.int32).tobytes() + np.column_stack([met, history, weights]).astype(np.float32).tobytes()


def unpacked(rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(rows) // (4 * (3 + WAYS))
    return np.frombuffer(rows, np.int32, n), np.frombuffer(rows, np.float32, offset=4 * n).reshape(n, 2 + WAYS)


def averaged(t: pa.Table) -> pa.Table:
    """Rows of several learners as one: weights by how often they were met, histories added up."""
    total = np.zeros((SLICE, 2 + WAYS))
    for rows in t.column("rows"):
        row, v = unpacked(rows.as_py())
        v = v.astype(np.float64)
        total[row, :2] += v[:, :2]
        total[row, 2:] += v[:, 2:] * v[:, :1]
    row = np.flatnonzero(total[:, 0])
    got = packed(row, total[row, 0], total[row, 1], total[row, 2:] / total[row, :1])
    return pa.table([pa.array([t.column("slice")[0].as_py()], pa.int32()), pa.array([t.column("learner")[0].as_py() // FAN], pa.int32()), pa.array([got], pa.binary())], ["slice", "learner", "rows"])


def train(texts: DataFrame, known: DataFrame, head: int = HEAD, bits: int = BITS, rounds: int = ROUNDS) -> Model:
    """Model of the given texts (one binary column), whose words ``known`` counts (token, n).

    Each text belongs to one round. What reaches the driver is bounded by ``head`` words of ``LONGEST`` bytes, and ``2^bits`` rows of weights.
    """
    spark = texts.sparkSession
    n, types = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 8).cast("int")  # counts in steps of an eighth of a power of two
    sizes = known.where(F.octet_length("token") <= LONGEST).groupBy(step.alias("step")).agg(F.count("*").alias("size")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in sizes:
        if held + r["size"] > head:
            break
        least, held = r["step"], held + r["size"]
    if least is None:
        words, count = pa.array([], pa.binary()), np.zeros(0, np.int64)
    else:
        got = known.where((F.octet_length("token") <= LONGEST) & (step >= least)).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
        words, count = got.column("token").combine_chunks(), got.column("n").to_numpy()
    model = Model(words, count, n, types, None, bits, np.zeros((1 << bits, WAYS), np.float32), np.ones(1 << bits, np.float32))
    model.tree = classes(np.append(count + 0.5, model.rare_mass))
    learners = max(1, -(-n // (LEARNER_TOKENS * rounds)))
    column = texts.columns[0]
    for turn in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(model)
        some = texts.where(F.pmod(F.xxhash64(f"`{column}`"), rounds) == turn).coalesce(learners)
        schema = "slice int, learner int, rows binary"
        parts = some.mapInArrow(lambda it, sent=sent: learned(it, sent.value), schema)
        left = learners
        while True:  # no task averages more than FAN learners
            parts = parts.groupBy("slice", F.expr(f"learner div {FAN}").alias("team")).applyInArrow(averaged, schema)
            left = -(-left // FAN)
            if left == 1:
                break
            parts = settle(parts)
        for r in parts.select("slice", "rows").toLocalIterator():
            row, v = unpacked(r["rows"])
            row = row + r["slice"] * SLICE
            model.history[row] += v[:, 1]
            model.weights[row] = v[:, 2:]
        sent.destroy()
    model.key = uuid.uuid4().hex
    return model


# --- scores ------------------------------------------------------------------------------------------------------


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) as (row, id, held_out, n_tokens, n_head, base, score, others): log10 sums of the head's words and, for the others, of their leaf alone."""
    ids = ids_of(model)
    base = np.log10(np.append(model.n + 0.5, 1.0))  # shares are divided at the end
    for batch in batches:
        m = batch.num_rows
        tokens, heads, plain, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        others: list[list[bytes]] = [[] for _ in range(m)]
        held = Pending()

        def work() -> None:
            for word, before, before2, row in held.take():
                s = steps(model, word, before, before2)
                if len(s.node):
                    best[:] += np.bincount(row[s.token], weighed(model, s)[2], m)
                plain[:] += np.bincount(row, base[word], m)
                tokens[:] += np.bincount(row, minlength=m)
                heads[:] += np.bincount(row, word < model.rare, m).astype(np.int64)

        done = 0
        for i, text in enumerate(batch.column(2)):
            for code, last, rest in coded(text.as_py(), ids, model.rare):
                held.add(i, code, last)
                others[i] += rest
                if held.size >= 4 * MINI:
                    work()
        if held.size:
            work()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(heads), pa.array(plain), pa.array(best / np.log(10)), pa.array(others, pa.list_(pa.binary()))],
                                         ["id", "held_out", "n_tokens", "n_head", "base", "score", "others"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, bits: int = BITS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; both scores are log10 probabilities of the text.

    Texts whose id's crc32 (as text) leaves 1 by 5 are held out; a null id is not. Null and empty texts are one token, the end.
    Rows that repeat an id or a text are scored, and learned, each time. Words that training texts do not hold share one half count, in
    both models. Without training texts both scores are 0. Other columns are not read.
    """
    held_out = F.coalesce(remainder(F.col(f"`{id_col}`")) == 1, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    texts = rows.where("not held_out").select("text")
    known = settle(counts(texts))
    model = train(texts, known, head, bits, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, history=np.zeros(0, np.float32)))
    kind = dict(rows.dtypes)["id"]
    each = rows.mapInArrow(lambda it: scored(it, sent.value), f"id {kind}, held_out boolean, n_tokens long, n_head long, base double, score double, others array<binary>")
    each = settle(each.withColumn("row", F.monotonically_increasing_id()))
    rare = each.where(F.size("others") > 0).select("row", F.explode("others").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    found = rare.join(known, "token", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    rest = found.groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_met"), F.sum(log).alias("log"))
    n, mass = model.tokens, model.tokens + 0.5 * (model.types + 1)
    zero = F.lit(0)
    return each.join(rest, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_met", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", zero) - F.col("n_tokens") * float(np.log10(mass))).alias("base_score"),
        (F.col("score") + F.coalesce("log", zero) - F.coalesce("n_rare", zero) * float(np.log10(model.rare_mass))).alias("score"))
