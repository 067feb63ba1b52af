"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells of source, language and topic. The cells' token weights are raked to the
three target marginals in turn until all agree. A cell's rate, its raked weight over its own tokens,
calibrates the sampling of its documents: the whole part of the rate as copies for certain, one more with
the chance of the rest, drawn by a hash of the document id, so reruns agree.

The targets are shares of tokens. By default they temper the corpus's own: share ** ``TEMPER``,
which lifts small categories and lowers a source that holds a third of all rows.

Targets that no positive weights meet (a category of one marginal that comes with none of another's) have no fit. Raking goes
on until the greatest relative error of a marginal is ``TOLERANCE`` or falls no more; that error, the residual, is told in
every result row, with whether the fit is reached, and a warning is given where it is not.

Nulls: a null category is a category of its own; a null text has no tokens (it takes its cell's rate,
1 where the cell has none). Rows with the same id share one draw: repeated rows are all kept, or copied, alike. Texts of any length count
whole. An empty table gives no rows. ``sampled`` returns all columns of the documents, whatever their names: the operator's own
get names that the table does not have.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written

TEMPER = 0.8
SEED = 17
MARGINALS = ("source", "lang", "topic")
#: Cycles between two tests of the fit, the largest relative error that counts as fitted, and the share of its
#: error that a test must leave behind for raking to go on.
CYCLES, TOLERANCE, STALL = 4, 1e-6, 0.05
_NULL = "\x00null"


def topic(text: Column, n_words: Column) -> Column:
    """A document's kind: table, code, mail, notice, short, long or prose."""
    marks = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(5 * marks > n_words, "table")
        .when(text.contains("License") | text.contains("Copyright"), "notice")
        .when(text.contains("@") | text.contains("://"), "mail")
        .when(text.contains("{") | text.contains("};") | text.contains(' = "'), "code")
        .when(n_words < 100, "short")
        .when(n_words > 1000, "long")
        .otherwise("prose")
    )


def annotated(documents: DataFrame, names: list[str]) -> DataFrame:
    """The documents with their source, language, topic and tokens (words) under these names."""
    text = text_or_empty()
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    step = documents.withColumns({names[0]: F.coalesce("source", F.lit(_NULL)), names[1]: F.coalesce("lang", F.lit(_NULL)), names[3]: tokens})
    return step.withColumn(names[2], topic(text, F.col(names[3])))


def cells_of(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every document."""
    step = annotated(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text"), ["_source", "_lang", "_topic", "_tokens"])
    return step.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"))


def tempered(cells: DataFrame, column: str, temper: float) -> DataFrame:
    """Target shares of a marginal: the corpus's own shares to the power ``temper``, made to sum to 1."""
    own = cells.groupBy(column).agg(F.sum("tokens").alias("n")).withColumn("raised", F.col("n").cast("double") ** temper)
    total = own.agg(F.sum("raised")).first()[0]
    return own.select(column, (F.col("raised") / F.lit(float(total or 1.0))).alias(f"target_{column}"))


def raked(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """The cells with ``weight``, token shares fitted to the targets (column, target_<column>), and the residual.

    Categories without a target keep their own share. A marginal that no positive cells can meet stays as near as it gets.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0))
    for column, target in targets.items():
        fitted = fitted.join(target, column, "left")
        own = F.sum("weight").over(W.partitionBy(column))
        fitted = fitted.withColumn(f"target_{column}", F.coalesce(f"target_{column}", own))
    residual, before = 0.0, float("inf")
    while total:
        for _ in range(CYCLES):
            for column in targets:
                own = F.sum("weight").over(W.partitionBy(column))
                fitted = fitted.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"target_{column}") / own).otherwise(F.lit(0.0)))
        fitted = written(spark, fitted, "cells")
        # Of a category with a target of 0, the error is its share.
        error = lambda c: F.abs(F.col(f"w_{c}") - F.col(f"t_{c}")) / F.when(F.col(f"t_{c}") > 0, F.col(f"t_{c}")).otherwise(F.lit(1.0))
        sums = fitted
        for c in targets:
            sums = sums.withColumns({f"w_{c}": F.sum("weight").over(W.partitionBy(c)), f"t_{c}": F.first(f"target_{c}").over(W.partitionBy(c))})
        # A category without any tokens can have no share, whatever its target.
        residual = float(sums.where("tokens > 0").agg(F.max(F.greatest(*(error(c) for c in targets), F.lit(0.0)))).first()[0] or 0.0)
        if residual <= TOLERANCE or residual > (1 - STALL) * before:
            break
        before = residual
    return fitted, residual


def rates_of(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER) -> DataFrame:
    """Cells of (source, lang, topic, tokens) rows with their rate, the fit's residual and whether it is reached."""
    cells = written(spark, docs.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = {c: (targets or {}).get(c, None) for c in MARGINALS}
    wanted = {c: t if t is not None else tempered(cells, c, temper) for c, t in wanted.items()}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted, residual = raked(spark, cells, wanted)
    if residual > TOLERANCE:
        warnings.warn(f"the targets are met but for a relative error of {residual:.2g}", stacklevel=3)
    rate = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(total) / F.col("tokens")).otherwise(F.lit(1.0))
    return fitted.select(*MARGINALS, rate.alias("rate"), F.lit(residual).alias("residual"), F.lit(residual <= TOLERANCE).alias("converged"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """Whole part of the rate, and one more with the chance of the rest, by a hash of the id."""
    draw = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed(spark: SparkSession, documents: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, rate, copies, residual and converged of every document.

    ``targets``: for some of source, lang and topic a table (column, target_<column>) of shares that sum to 1.
    """
    docs = written(spark, cells_of(documents), "tokens")
    out = docs.join(rates_of(spark, docs, targets, temper), list(MARGINALS)).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    back = {c: F.when(F.col(c) != _NULL, F.col(c)) for c in ("source", "lang")}
    return out.withColumns(back).select("doc_id", *MARGINALS, "tokens", "rate", "copies", "residual", "converged")


def sampled(spark: SparkSession, documents: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """The documents with their own columns, each in as many rows as ``mixed`` gives it copies.

    The words are counted once, into a copy of the documents in the shared folder; the rates go to that, so the texts are not
    shuffled while the cells are few.
    """
    own = [free_name(documents, c) for c in (*MARGINALS, "tokens", "rate", "copies")]
    docs = written(spark, annotated(documents, own[:4]), "annotated")
    rates = rates_of(spark, docs.select(*(F.col(o).alias(c) for o, c in zip(own, (*MARGINALS, "tokens")))), targets, temper)
    rates = rates.select(*(F.col(c).alias(o) for o, c in zip(own, MARGINALS)), F.col("rate").alias(own[4]))
    kept = docs.join(rates, own[:3]).withColumn(own[5], copies(F.col(own[4]), F.col("doc_id").cast("long"), seed).cast("int")).where(F.col(own[5]) > 0)
    every = kept.withColumn(own[5], F.explode(F.array_repeat(F.lit(0), F.col(own[5]))))
    return every.select(*(F.col(f"`{c}`") for c in documents.columns))
