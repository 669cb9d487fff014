"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket. The bucket in which a source's budget ends is refined
by the next bits of the hash, and only that one; after all levels a threshold per source is left,
and documents are taken by comparing their hash with it. Nothing is sorted, and thresholds are
nested: a smaller budget takes a subset of what a larger one takes.

A null or empty text has no words and nothing of it is taken. A null source is a source of its own
(the last one). The hash is of id and text, so documents that share an id, or have none, are told
apart; only rows with equal id and text have one hash and are taken together. Repeated rows are
separate documents. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellquery.llm.scratch import save, unused
from cellquery.operators.numbering import dense_number

#: Bits of a level of the histogram, and levels: 32 bits of the hash are used.
LEVEL_BITS = 8
LEVELS = 4
#: Parts by which rows of one source are spread when they meet their threshold.
SALTS = 32


def word_count(text: Column) -> Column:
    """Maximal runs of other characters than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash32(key: Column, content: Column) -> Column:
    """The first 32 bits of the MD5 of the key and the text, which any SQL engine can follow."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(content, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``_source, source_size, target``: ``share`` of all sizes dealt by weight.

    Sources in code point order (null last) take the weights in turn. A target stops at ``most``
    times its source's size; the excess is dealt to the others by weight until none is above. Each
    round sums one row; sources stay distributed.
    """
    ranked = dense_number(sources, ["_last", "_source"], "_rank")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(turns, (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = save(ranked.select("_source", "source_size", weight.alias("_weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    budget, level, capped = share * total, 0.0, -1
    while True:
        full = cap <= F.col("_weight") * F.lit(level)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(full, 1)), F.lit(0)),
        ).first()
        if row[2] == capped or row[1] == 0:
            break
        capped, level = row[2], (budget - row[0]) / row[1]
    if row[1] == 0:
        goal = cap
    else:
        goal = F.when(full, cap).otherwise(
            F.col("_weight") * F.lit(budget - row[0]) / F.lit(float(row[1]))
        )
    return ranked.select("_source", "source_size", F.least(goal, cap).alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """``_source, _whole, _below``: whole repeats, and the hash below which one more is taken.

    At each level the open documents are those in the boundary bucket of their source; their words
    are summed by source and next bits. The last bucket is taken if that ends nearer to the budget.
    """
    size = F.col("source_size").cast("double")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = goals.select(
        "_source", whole.alias("_whole"), (F.col("target") - whole * size).alias("_need")
    ).withColumn("_prefix", F.lit(0).cast("long"))
    open_docs = slim.select("_source", "size", "_hash").withColumn("_prefix", F.lit(0).cast("long"))
    for step in range(1, LEVELS + 1):
        shift = 32 - LEVEL_BITS * step
        bucket = F.shiftright("_hash", shift)
        sums = open_docs.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        upto = Window.partitionBy("_source").orderBy("_bucket")
        sums = sums.withColumn("_upto", F.sum("_sum").over(upto))
        edge = (
            sums.join(state, "_source")
            .filter(F.col("_upto") > F.col("_need"))
            .groupBy("_source")
            .agg(F.min_by(F.struct("_bucket", "_sum", "_upto"), "_bucket").alias("_edge"))
        )
        last = step == LEVELS
        before = F.col("_edge._upto") - F.col("_edge._sum")
        take = F.col("_edge._upto") - F.col("_need") < F.col("_need") - before
        past = F.when(take, 1).otherwise(0) if last else F.lit(0)
        ended = F.col("_edge").isNull()  # a source without words
        state = save(
            state.join(edge, "_source", "left").select(
                "_source",
                "_whole",
                F.when(ended, F.col("_need")).otherwise(F.col("_need") - before).alias("_need"),
                F.when(ended, F.shiftleft("_prefix", LEVEL_BITS))
                .otherwise(F.col("_edge._bucket") + past)
                .alias("_prefix"),
            )
        )
        if not last:
            open_docs = (
                slim.select("_source", "size", "_hash")
                .withColumn("_prefix", F.shiftright("_hash", shift))
                .join(state.select("_source", "_prefix"), ["_source", "_prefix"])
            )
    return state.select("_source", "_whole", F.col("_prefix").alias("_below"))


def limits_of(
    slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """``_source, _salt, source_size, target, _whole, _below`` from ``_source, _null, size, _hash``."""
    totals = slim.groupBy("_source").agg(
        F.sum("size").alias("source_size"), F.max("_null").alias("_last")
    )
    goals = save(targets(totals, list(weights), share, most))
    limits = goals.join(thresholds(slim, goals), "_source")
    return save(limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, size, source, source_size, target, copies, taken`` and the columns of ``keep``.

    ``copies`` says how often the mix holds the document (0: not at all); ``taken`` is ``copies``
    times its words. The words taken of a source differ from its target by less than the words of
    the documents that share one hash at its threshold.
    """
    source = F.col(source_col).cast("string")
    slim = save(
        docs.select(
            F.col(id_col).alias("id"),
            word_count(F.col(text_col)).alias("size"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("_source"),
            hash32(F.col(id_col), F.col(text_col)).alias("_hash"),
            *[F.col(c).alias(f"_keep_{c}") for c in keep],
        )
    )
    limits = limits_of(slim.withColumn("_null", F.col("source").isNull()), weights, share, most)
    copies = F.col("_whole") + (F.col("_hash") < F.col("_below")).cast("long")
    copies = F.when(F.col("size") > 0, F.least(copies, F.lit(most))).otherwise(0)
    return (
        slim.withColumn("_salt", (F.col("_hash") % SALTS).cast("int"))
        .join(limits, ["_source", "_salt"])
        .withColumn("copies", copies.cast("long"))
        .select(
            "id",
            "size",
            "source",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            *[F.col(f"_keep_{c}").alias(c) for c in keep],
        )
    )


def take(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: each row of ``docs`` (all columns) as often as it is taken.

    The copies of a document follow from its source, its words and its hash, so only thresholds meet
    the rows, and texts stay where they are when those are small.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    slim = save(
        docs.select(
            word_count(F.col(text_col)).alias("size"),
            F.col(source_col).isNull().alias("_null"),
            source.alias("_source"),
            hash32(F.col(id_col), F.col(text_col)).alias("_hash"),
        )
    )
    most = options.get("most", 2)
    limits = limits_of(slim, **options)
    names = {n: unused(n, docs.columns) for n in ("_source", "_hash", "_salt", "_copy", "_whole", "_below")}
    met = limits.select("_source", "_salt", "_whole", "_below").withColumnsRenamed(names)
    hashed = docs.withColumns({names["_source"]: source, names["_hash"]: hash32(F.col(id_col), F.col(text_col))})
    copies = F.col(names["_whole"]) + (F.col(names["_hash"]) < F.col(names["_below"])).cast("long")
    copies = F.least(copies, F.lit(most)).cast("int")
    return (
        hashed.withColumn(names["_salt"], (F.col(names["_hash"]) % SALTS).cast("int"))
        .join(met, [names["_source"], names["_salt"]])
        .filter((copies > 0) & (word_count(F.col(text_col)) > 0))
        .withColumn(names["_copy"], F.explode(F.sequence(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
