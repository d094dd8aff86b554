"""Log-bilinear language model, trained with noise-contrastive estimation.

Every word belongs to a class: the commonest words are their own, all others share classes by
their last bytes. The neural part is log-bilinear over classes: the class before gives a vector,
a context matrix turns it into a prediction, and its product with the next class's vector plus
a bias is the next class's score. Scores are normalised over all classes by batched matrix
products. Inside a shared class a word has its discounted share of the class's tokens, and one
unseen word per class has what the discount leaves, so probabilities of all tokens sum to one.

All learning rows are read. Token counts are gathered over the whole corpus, summed in every
task before the shuffle. Class pairs are counted over the whole corpus too; their table is of
fixed size, and noise-contrastive estimation over it is exact in expectation (every pair and all
noise with their weights), so the fit does not sample. Counts of the commonest ``HOT`` tokens
are broadcast; other tokens meet their counts in one join, added up by row and token before.

Tokens are told apart by 128 bits of hash. A row without words is one end token. Rows whose
``learn`` is null don't teach; with nothing learned every token has probability one. Repeated
rows and null ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.store import written
from demandspark.llm.words import NOT_SPACE, chunks, hash_spans, lanes, signed, slices, words

#: Classes: the end of a text, common words, and shared classes.
COMMON = 511
SHARED = 128
CLASSES = 1 + COMMON + SHARED
#: Tokens whose counts are broadcast, 20 bytes each.
HOT = 1 << 19
DISCOUNT = 0.75
#: Text whose tokens are held at once, in bytes.
SLICE = 4 << 20
_SEED2 = 0x5851F42D4C957F2D


@dataclass
class Tokens:
    """Tokens of a batch without the ends: two hashes, shared class, and the first by row."""

    h1: np.ndarray
    h2: np.ndarray
    shared: np.ndarray
    row_first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_first) - 1), np.diff(self.row_first))


def tokens(column: pa.Array) -> Tokens:
    h1, h2, shared, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for chunk in chunks(column):
        found = words(chunk, NOT_SPACE)
        h1.append(hash_spans(chunk.data, found.starts, found.ends))
        h2.append(hash_spans(chunk.data, found.starts, found.ends, _SEED2))
        size = found.ends - found.starts
        tail = lanes(chunk.data)[found.ends - np.minimum(size, 3)] & ((np.uint64(1) << (8 * np.minimum(size, 3)).astype(np.uint64)) - np.uint64(1))
        with np.errstate(over="ignore"):
            shared.append(((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 7)).astype(np.int32) + 1 + COMMON)
        counts.append(found.counts)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return Tokens(np.concatenate(h1), np.concatenate(h2), np.concatenate(shared), first)


def _runs(h1: np.ndarray, h2: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where a new token starts among hashes in ``order``."""
    a, b = h1[order], h2[order]
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool))


def token_counts(docs: DataFrame, text: str, learn: Column) -> DataFrame:
    """(h1, h2, shared, n) over the learning rows, without ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 0, 4 * SLICE)):
            t = tokens(batch.column(0))
            order = np.argsort(t.h1, kind="stable")
            at = _runs(t.h1, t.h2, order)
            first = order[at]
            n = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(t.h1[first])), pa.array(signed(t.h2[first])), pa.array(t.shared[first]), pa.array(n, pa.int64())],
                ["h1", "h2", "shared", "n"],
            )

    made = docs.where(learn).select(text).mapInArrow(count, "h1 long, h2 long, shared int, n long")
    return made.groupBy("h1", "h2", "shared").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Known tokens by first hash: second hash and a value."""

    h1: np.ndarray
    h2: np.ndarray
    value: np.ndarray

    def get(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The value of each token, 0 if unknown."""
        out = np.zeros(len(h1), self.value.dtype)
        if len(self.h1) and len(h1):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
            same = (self.h1[at] == h1) & (self.h2[at] == h2)
            out[same] = self.value[at[same]]
        return out


def _table(rows: pa.Table, value: np.ndarray) -> Table:
    h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    # Of tokens that share the first hash only one can be found here; the join has the others.
    h1, at = np.unique(h1, return_index=True)
    return Table(h1, h2[at], value[at])


def classes_of(t: Tokens, common: Table) -> np.ndarray:
    own = common.get(t.h1, t.h2)
    return np.where(own > 0, own, t.shared)


def _pairs(cls: np.ndarray, row_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class) of all tokens with their ends, row by row; 0 is end and start."""
    n_rows = len(row_first) - 1
    after = np.zeros(len(cls) + n_rows, np.int32)
    place = np.arange(len(cls)) + np.repeat(np.arange(n_rows), np.diff(row_first))
    after[place] = cls
    before = np.zeros_like(after)
    before[1:] = after[:-1]
    return before, after


def pair_counts(docs: DataFrame, text: str, learn: Column, common: Table) -> np.ndarray:
    """How often each class follows each, over the learning rows."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in (part for batch in batches for part in slices(batch, 0, SLICE)):
            t = tokens(batch.column(0))
            before, after = _pairs(classes_of(t, shared.value), t.row_first)
            total += np.bincount(before * CLASSES + after, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["pair", "n"])

    made = docs.where(learn).select(text).mapInArrow(count, "pair long, n long")
    rows = made.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


@dataclass
class LogBilinear:
    """Vectors of the class before, context matrix, vectors and biases of the next class."""

    before: np.ndarray
    context: np.ndarray
    after: np.ndarray
    bias: np.ndarray

    def log10(self) -> np.ndarray:
        """log10 probability of each class (column) after each class (row)."""
        s = self.before @ self.context @ self.after.T + self.bias
        s -= s.max(1, keepdims=True)
        return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)


def fit(pairs: np.ndarray, size: int = 40, noise: float = 25.0, rounds: int = 250, rate: float = 0.05, seed: int = 1) -> LogBilinear:
    """Noise-contrastive estimation: tell the pairs of the corpus from pairs whose second class
    is drawn from the classes' frequencies, ``noise`` of these for each of those."""
    n = len(pairs)
    rng = np.random.default_rng(seed)
    total = max(pairs.sum(), 1.0)
    drawn = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * n)
    context_n = pairs.sum(1)
    m = LogBilinear(
        rng.normal(0, 0.1, (n, size)), np.eye(size) + rng.normal(0, 0.01, (size, size)), rng.normal(0, 0.1, (n, size)), np.log(drawn)
    )
    names = ("before", "context", "after", "bias")
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    # Rare contexts get a share of the step that their count alone would not give them.
    weight = 1 / np.sqrt(context_n + 1)
    weight *= total / max((context_n * weight).sum(), 1e-9)
    data = pairs * weight[:, None] / total
    false = noise * (context_n * weight / total)[:, None] * drawn[None]
    level = np.log(noise * drawn)
    for step in range(1, rounds + 1):
        at = m.before @ m.context
        p = 1 / (1 + np.exp(-np.clip(at @ m.after.T + m.bias - level, -30, 30)))
        g = data * (1 - p) - false * p
        grads = {"before": g @ m.after @ m.context.T, "context": m.before.T @ (g @ m.after), "after": g.T @ at, "bias": g.sum(0)}
        now = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, grad in grads.items():
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
            getattr(m, k).__iadd__(now * move)
    return m


@dataclass
class Scorer:
    """What a task needs to score rows."""

    model: LogBilinear
    common: Table
    hot: Table
    class_tokens: np.ndarray
    class_types: np.ndarray
    end_count: int
    n: int
    v: int

    def unseen(self) -> np.ndarray:
        """log10 of what an unseen word has in each class, times the class's tokens."""
        return np.log10(np.where(self.class_tokens > 0, DISCOUNT * self.class_types, 1))


def _trained(docs: DataFrame, text: str, learn: Column) -> tuple[Scorer, DataFrame]:
    counts = written(token_counts(docs, text, learn), "token-counts")
    n_rows = docs.where(learn).count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "h1", "h2").limit(COMMON).toArrow()
    common = _table(top, np.arange(1, len(top) + 1, dtype=np.int32))
    # The count from which on tokens are hot: steps of an eighth of a doubling.
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for row in steps:
        if taken + row["count"] > HOT:
            break
        taken, least = taken + row["count"], row["step"]
    hot_rows = counts.where(step >= (least if least is not None else 1 << 30)).select("h1", "h2", "n").toArrow()
    hot = _table(hot_rows, hot_rows.column("n").to_numpy())
    by_class = counts.groupBy("shared").agg(F.sum("n"), F.count("*")).collect()
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class:
        class_tokens[row[0]], class_types[row[0]] = row[1], row[2]
    np.subtract.at(class_tokens, top.column("shared").to_numpy(), top.column("n").to_numpy())
    np.subtract.at(class_types, top.column("shared").to_numpy(), 1)
    model = fit(pair_counts(docs, text, learn, common)) if n_rows else fit(np.zeros((CLASSES, CLASSES)), rounds=0)
    return Scorer(model, common, hot, class_tokens, class_types, n_rows, n + n_rows, v + (n_rows > 0)), counts


def _scores(s: Scorer, t: Tokens, table: np.ndarray, unseen: np.ndarray) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """(tokens with end, known, base and model sums by row) of what can be told here, and the
    other tokens by row."""
    n_rows, rows = len(t.row_first) - 1, t.rows()
    cls = classes_of(t, s.common)
    before, after = _pairs(cls, t.row_first)
    size = np.diff(t.row_first) + 1
    own = np.add.reduceat(table[before, after], np.cumsum(size) - size, dtype=np.float64) if n_rows else np.zeros(0)
    c = s.hot.get(t.h1, t.h2)
    known = c > 0
    shared = cls > COMMON
    inside = -np.log10(np.maximum(s.class_tokens[cls], 1)) * shared
    seen = known & shared
    inside[seen] += np.log10(c[seen] - DISCOUNT)
    model = own + np.bincount(rows, inside, minlength=n_rows)
    base = np.bincount(rows[known], np.log10(c[known] + 0.1), minlength=n_rows) + np.log10(s.end_count + 0.1)
    rare = np.flatnonzero(~known)
    order = rare[np.lexsort((t.h2[rare], t.h1[rare], rows[rare]))]
    a, b, r = t.h1[order], t.h2[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (r[1:] != r[:-1])])) if len(a) else np.zeros(0, np.int64)
    at = order[new]
    rest = {
        "row": rows[at], "h1": signed(t.h1[at]), "h2": signed(t.h2[at]), "tf": np.diff(np.append(new, len(order))),
        "unseen": unseen[cls[at]], "inside": shared[at],
    }
    return [size, np.bincount(rows[known], minlength=n_rows) + (s.end_count > 0), base, model], rest


def scored(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``base_score``: each token's log10((c + 0.1) / (N + 0.1 * (V + 1))); ``score``: the model's.
    """
    scorer, counts = _trained(docs, text, learn)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, row long, id {kind}, held boolean, n_tokens long, n_known long, base double, model double, h1 long, h2 long, tf long, unseen double, inside boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part, done = shared.value, TaskContext.get().partitionId(), 0
        table = s.model.log10() if s.n else np.zeros((CLASSES, CLASSES))
        unseen = s.unseen()
        for batch in (part for batch in batches for part in slices(batch, 2, SLICE)):
            n = batch.num_rows
            (size, known, base, model), rest = _scores(s, tokens(batch.column(2)), table, unseen)
            ids, held = batch.column(0), batch.column(1)
            row = done + np.arange(n)
            nothing = lambda k, kind: pa.nulls(k, kind)
            # Rows of their own, spread by hashes that are asked for nothing.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(row), ids, held, pa.array(size, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base), pa.array(model), pa.array(row), pa.array(np.full(n, part, np.int64)), nothing(n, pa.int64()), nothing(n, pa.float64()), nothing(n, pa.bool_()),
                ],
                names,
            )
            k = len(rest["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k, part, np.int32)), pa.array(done + rest["row"]), nothing(k, ids.type), nothing(k, pa.bool_()), nothing(k, pa.int64()), nothing(k, pa.int64()),
                    nothing(k, pa.float64()), nothing(k, pa.float64()), pa.array(rest["h1"]), pa.array(rest["h2"]), pa.array(rest["tf"], pa.int64()), pa.array(rest["unseen"]), pa.array(rest["inside"]),
                ],
                names,
            )
            done += n

    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col), held_out, F.col(text)).mapInArrow(score, schema)
    c = F.col("n").cast("double")
    found = rows.join(counts.select("h1", "h2", "n"), ["h1", "h2"], "left")
    each = F.col("tf").isNotNull()
    z = float(np.log10(scorer.n + 0.1 * (scorer.v + 1)))
    inside = F.when(F.col("inside"), F.when(c.isNotNull(), F.log10(c - DISCOUNT)).otherwise(F.col("unseen"))).otherwise(0.0)
    sums = found.groupBy("part", "row").agg(
        F.max("id").alias(id_col),
        F.max("held").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(each, F.when(c.isNotNull(), F.col("tf")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(each, F.col("tf") * F.log10(F.coalesce(c, F.lit(0.0)) + 0.1)).otherwise(F.col("base"))).alias("base_sum"),
        F.sum(F.when(each, F.col("tf") * inside).otherwise(F.col("model"))).alias("score"),
    )
    return sums.select(
        id_col, "held_out", "n_tokens", "n_known", F.lit(scorer.n).cast("long").alias("train_tokens"),
        (F.col("base_sum") - z * F.col("n_tokens")).alias("base_score"), "score",
    )
