"""Mixing to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic. Cell weights start as the cells'
shares of the tokens and are raked: in turn each of the three marginals is scaled to its target,
until every marginal is within ``CLOSE`` of it (or ``MOST_SWEEPS`` rounds are done, which
``marginals`` shows). The ratio of a cell's weight to its share, times the kept share of all
tokens, is the probability of its documents, and no probability exceeds one, as no document is
taken twice. So that the sample meets the targets all the same, cells are raked again under that
bound: those at one stay there, the others of a value are scaled to what is left of its target.
Fewer tokens than ``keep`` are kept if there are too few of some value. A document is taken if a
hash of its id is below its probability.

Targets are shares by value; a marginal without given targets gets each value's share of the
tokens to a power below one, which lifts small sources. Values without a target have target
zero, targets of values that don't occur are left out, the rest is scaled to one. All columns of
expressions: no Python runs on the data, and cells stay in Spark. There is one rule for few and many
cells; many are grouped and joined where few are windowed.

Null source or language is a value of its own. Documents without tokens weigh nothing and keep
the probability ``keep``. Repeated ids are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.store import free_name, written

#: How far a marginal may be off, as a fraction of its target, and rounds at most.
CLOSE = 1e-12
MOST_SWEEPS = 300
KEEP = 0.6
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
DIMENSIONS = tuple(POWERS)
#: A topic is the first whose marks occur in the text, else GENERAL.
TOPICS = (("legal", ("icense", "opyright")), ("contact", ("@",)), ("web", ("http",)), ("technical", ("token", "password", "secret", "$$$")))
GENERAL = "general"
_CHECK_EVERY = 3
#: With a marginal this far off, the kept share is lowered by a step and raking begins anew; how near
#: to its limit the kept share begins.
_FAR = 1e-3
_INSIDE, _LOWER = 0.98, 0.9
#: Rounds of the SQL, which can't ask for the error; enough for ``CLOSE`` where values are mixed.
_SQL_SWEEPS = 16
#: Cells are broadcast up to so many rows, about 100 bytes each.
BROADCAST_ROWS = 100_000
#: More cells than this are not summed by window, as one value may hold most of them.
WINDOW_ROWS = 100_000


def topic_of(text: str = "text") -> Column:
    t = F.col(text)
    out = None
    for name, marks in TOPICS:
        found = F.lit(False)
        for mark in marks:
            found = found | t.contains(mark)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(GENERAL)


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _value(column: Column) -> Column:
    """A value as text that no null can equal."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _targets(dim: str, given: dict[str | None, float] | None) -> Column:
    """The unscaled target of a cell's value, from the marginal column ``m_<dim>``."""
    if given is None:
        return F.pow(F.col(f"m_{dim}"), F.lit(POWERS[dim]))
    out = F.lit(0.0)
    for value, share in given.items():
        out = F.when(F.col(dim) == ("-" if value is None else f"={value}"), float(share)).otherwise(out)
    return out


def _with_marginal(now: DataFrame, dim: str, name: str, wide: bool, weight: Column | None = None) -> DataFrame:
    """The cells ``now`` and the sum of their weights ``w`` (or ``weight``) over all cells of the
    same value of ``dim``.

    ``wide``: there are so many cells that no task may hold those of one value. Weights are then
    combined in every task, and each value's sum is joined to its cells.
    """
    weight = F.col("w") if weight is None else weight
    if not wide:
        return now.withColumn(name, F.sum(weight).over(Window.partitionBy(dim)))
    now = written(now, "weights")
    sums = written(now.groupBy(dim).agg(F.sum(weight).alias(name)), "marginal")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return now.join(sums, dim)


def _error(now: DataFrame, weight: Column, wide: bool) -> float:
    """How far the marginals of ``weight`` are off, as a fraction of their targets."""
    for d in DIMENSIONS:
        now = _with_marginal(now, d, f"__{d}", wide, weight)
    off = [F.max(F.abs(F.col(f"__{d}") - F.col(f"t_{d}")) / F.greatest(f"t_{d}", F.lit(1e-12))) for d in DIMENSIONS]
    return now.agg(F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in off])).first()[0]


def _raked(now: DataFrame, wide: bool) -> DataFrame:
    """``now`` with weights ``w`` whose marginals are the targets."""
    for sweep in range(1, MOST_SWEEPS + 1):
        for d in DIMENSIONS:
            now = _with_marginal(now, d, "own", wide)
            now = now.withColumn("w", F.when(F.col("own") > 0, F.col("w") * F.col(f"t_{d}") / F.col("own")).otherwise(0.0)).drop("own")
        if sweep % _CHECK_EVERY == 0:
            now = written(now, "raked")
            if _error(now, F.col("w"), wide) <= CLOSE:
                break
    return now


def _under_bound(now: DataFrame, keep: float, wide: bool) -> tuple[DataFrame, float]:
    """``now`` with weights ``x`` whose values ``least(x, 1 / kept share)`` meet the targets, and the
    share of all tokens that is kept, at most ``keep``.

    Cells at probability one are left there, the others of a value are scaled to what is left of
    its target. A value of which less is there than its target asks for lowers the share.
    """
    marginals = [now.where(F.col(f"t_{d}") > 0).agg(F.min(F.col(f"m_{d}") / F.col(f"t_{d}"))).first()[0] for d in DIMENSIONS]
    most = now.agg(F.max(F.col("w") / F.col("share"))).first()[0]
    reach = min([m for m in marginals if m is not None], default=keep)
    # Right at its limit a value's cells would grow without end.
    kept = keep if reach >= keep else _INSIDE * reach
    # At one over the largest ratio no cell is at its bound, and raking alone meets the targets.
    while most and kept * most > 1 + 1e-9:
        tried, off = now.withColumn("x", F.col("w")), None
        cap = F.col("share") / F.lit(kept)
        for sweep in range(1, MOST_SWEEPS + 1):
            for d in DIMENSIONS:
                full = F.col("x") >= cap
                tried = _with_marginal(tried, d, "fixed", wide, F.when(full, cap).otherwise(0.0))
                tried = _with_marginal(tried, d, "free", wide, F.when(full, 0.0).otherwise(F.col("x")))
                left = F.col(f"t_{d}") - F.col("fixed")
                scale = F.when((left > 0) & (F.col("free") > 0), left / F.col("free")).when(
                    F.col("fixed") + F.col("free") > 0, F.col(f"t_{d}") / (F.col("fixed") + F.col("free"))
                )
                tried = tried.withColumn("x", F.least(F.col("x") * F.coalesce(scale, F.lit(0.0)), F.lit(1e100))).drop("fixed", "free")
            if sweep % _CHECK_EVERY == 0:
                tried = written(tried, "bounded")
                before, off = off, _error(tried, F.least(F.col("x"), cap), wide)
                # Where the targets can't be met under the bound the error stays what it is.
                if off <= CLOSE or (before is not None and off > _FAR and off > 0.999 * before):
                    break
        if off <= _FAR:
            return tried, kept
        kept = max(_LOWER * kept, 1 / most)
    return now.withColumn("x", F.col("w")), kept


def marginals(found: DataFrame) -> DataFrame:
    """(dim, value, target, reached) from rows of cells as ``cells`` gives them: raked and expected
    shares of the tokens of the sample."""
    total = found.agg(F.sum("w").alias("w"), F.sum(F.col("tokens") * F.col("probability")).alias("s"))
    parts = [
        found.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("w").alias("target"), F.sum(F.col("tokens") * F.col("probability")).alias("reached"))
        for d in DIMENSIONS
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(F.broadcast(total))
    return out.select("dim", "value", (F.col("target") / F.col("w")).alias("target"), (F.col("reached") / F.col("s")).alias("reached"))


def cells(rows: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(source, lang, topic, tokens, w, probability) from rows of (source, lang, topic, n_tokens).

    The expected sample meets the targets, where needed with fewer tokens than ``keep`` of all.
    """
    targets = targets or {}
    sums = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    total, n_cells = sums.agg(F.sum("tokens"), F.count("*")).first()
    total, wide = total or 0, n_cells > window_rows
    now = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("w", F.col("share"))
    for d in DIMENSIONS:
        # A marginal's values are in the cells; its targets are scaled over one row for each.
        now = _with_marginal(now, d, f"m_{d}", wide).withColumn(f"t_{d}", _targets(d, targets.get(d)))
    now = written(now, "targets")
    scale = now.agg(*[F.sum(F.col(f"t_{d}") * F.col("w") / F.col(f"m_{d}")).alias(d) for d in DIMENSIONS]).first()
    for d in DIMENSIONS:
        now = now.withColumn(f"t_{d}", F.col(f"t_{d}") / F.lit(float(scale[d] or 1.0)))
    now, kept = _under_bound(_raked(now, wide), keep, wide)
    return now.select(*DIMENSIONS, "tokens", "w", F.least(F.lit(1.0), F.col("x") / F.col("share") * F.lit(float(kept))).alias("probability"))


def chance(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _joined(rows: DataFrame, found: DataFrame, names: dict[str, str], probability: str, keep: float) -> DataFrame:
    found = written(found.select(*[F.col(d).alias(names[d]) for d in DIMENSIONS], F.col("probability").alias(probability)), "probabilities")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    out = rows.join(found, list(names.values()), "left")
    return out.withColumn(probability, F.coalesce(probability, F.lit(keep)))


def sampled(docs: DataFrame, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep: float = KEEP) -> DataFrame:
    """(id, source, lang, topic, n_tokens, probability, kept) for every row."""
    rows = written(
        docs.select(
            F.col(id_col), F.col(source).alias("own_source"), F.col(lang).alias("own_lang"), _value(F.col(source)).alias("source"), _value(F.col(lang)).alias("lang"),
            _value(topic_of(text)).alias("topic"), token_count(text).alias("n_tokens"),
        ),
        "tokens",
    )
    out = _joined(rows, cells(rows, targets, keep=keep), {d: d for d in DIMENSIONS}, "probability", keep)
    return out.select(
        id_col, F.col("own_source").alias("source"), F.col("own_lang").alias("lang"), F.substring("topic", 2, 99).alias("topic"), "n_tokens",
        F.round("probability", 6).alias("probability"), (chance(id_col) < F.col("probability")).alias("kept"),
    )


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep: float = KEEP) -> DataFrame:
    """The sampled rows of ``docs``, columns as they were."""
    keys = {"source": _value(F.col(source)), "lang": _value(F.col(lang)), "topic": _value(topic_of(text))}
    found = cells(docs.select(*[c.alias(d) for d, c in keys.items()], token_count(text).alias("n_tokens")), targets, keep=keep)
    names = {d: free_name(docs, f"__{d}") for d in DIMENSIONS}
    probability = free_name(docs, "__probability")
    rows = docs.withColumns({names[d]: keys[d] for d in DIMENSIONS})
    return _joined(rows, found, names, probability, keep).where(chance(id_col) < F.col(probability)).select(*docs.columns)


def _oracle(sweeps: int = _SQL_SWEEPS, keep: float = KEEP) -> str:
    topic = "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(text, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in TOPICS
    ) + f" ELSE '{GENERAL}' END"
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic,
              coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "a AS (SELECT *, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS w FROM c)",
        "m AS (SELECT *, " + ", ".join(f"sum(w) OVER (PARTITION BY {x}) AS m_{x}" for x in DIMENSIONS) + " FROM a)",
        "r0 AS MATERIALIZED (SELECT *, " + ", ".join(f"pow(m_{x}, {p}) / sum(pow(m_{x}, {p}) * w / m_{x}) OVER () AS t_{x}" for x, p in POWERS.items()) + " FROM m)",
    ]
    k = 0
    for _ in range(sweeps):
        for x in DIMENSIONS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{x} / sum(w) OVER (PARTITION BY {x}) AS w) FROM r{k})")
            k += 1
    reach = "least(" + ", ".join(f"min(m_{x} / t_{x}) OVER ()" for x in DIMENSIONS) + ")"
    steps.append(f"g AS (SELECT *, {reach} AS reach FROM r{k})")
    steps.append(f"h AS (SELECT *, CASE WHEN reach >= {keep} THEN {keep}::DOUBLE ELSE {_INSIDE} * reach END AS kept FROM g)")
    steps.append("x0 AS MATERIALIZED (SELECT *, w AS x, share / kept AS cap FROM h)")
    k = 0
    for _ in range(sweeps):
        for x in DIMENSIONS:
            sums = f"sum(CASE WHEN x >= cap THEN cap ELSE 0 END) OVER (PARTITION BY {x}) AS fixed, sum(CASE WHEN x >= cap THEN 0 ELSE x END) OVER (PARTITION BY {x}) AS free"
            scale = f"CASE WHEN t_{x} > fixed AND free > 0 THEN (t_{x} - fixed) / free WHEN fixed + free > 0 THEN t_{x} / (fixed + free) ELSE 0 END"
            steps.append(f"x{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (fixed, free) REPLACE (least(x * {scale}, 1e100) AS x) FROM (SELECT *, {sums} FROM x{k}))")
            k += 1
    probability = f"coalesce(least(1.0, x / share * kept), {keep})"
    return "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round({probability}, 6)::DOUBLE AS probability,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)} < {probability} AS kept
        FROM d LEFT JOIN x{k} q ON d.source IS NOT DISTINCT FROM q.source AND d.lang IS NOT DISTINCT FROM q.lang AND d.topic = q.topic"""


ORACLE_SQL = _oracle()
