"""Mixing sources to target weights by Poisson replication, with a global shuffle; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.session import cut_lineage

SEED = 17
#: Source weights are the number of documents to this power unless targets are given.
TEMPERATURE = 0.7
#: Larger means are summed from equal parts of at most this mean, each with a draw of its own.
PART_MEAN = 256.0
#: Hash bits of a draw.
DRAW_BITS = 52


def rates(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, total: int | None = None, source_col: str = "source") -> DataFrame:
    """Per source (null is one of them): _mix_source, _mix_rate, the mean number of copies of each of its documents.

    A source with weight w and n documents gets the rate ``w / sum of weights * total / n``; ``total`` is the number of
    documents unless given.  ``targets`` names weights by source; sources without one get none.
    """
    sizes = docs.groupBy(F.col(source_col).alias("_mix_source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in targets.items():
            weight = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    weights, documents = weighed.agg(F.sum("weight"), F.sum("n")).first()  # two numbers
    wanted = float((documents or 0) if total is None else total)
    rate = F.col("weight") / F.lit(weights) * F.lit(wanted) / F.col("n") if weights else F.lit(0.0)
    return weighed.select("_mix_source", rate.alias("_mix_rate"))


def thresholds(mean: Column) -> Column:
    """Distribution function of a Poisson mean up to ``PART_MEAN``, from 0 until the rest is below the draw's resolution."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["c"])


def draw(key: Column, part: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the MD5 of the seed, the part and the key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), part.cast("string"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << DRAW_BITS))


def mix(
    docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """All columns of ``docs``, each row as often as its Poisson draw says, in a global random order; and the columns
    _mix_copy (from 1) and _mix_order (the shuffle key).

    The draw depends on seed and id alone: rows that repeat an id have equal draws, null ids count as the empty text.
    Null sources are a source.  Text is not looked at.  An empty table gives an empty table.  Columns of these two names
    are replaced; others may have any name.
    """
    plain = docs.drop("_mix_copy", "_mix_order", "_mix_source", "_mix_rate")
    mean = F.col("_mix_rate")
    parts = F.greatest(F.lit(1), F.ceil(mean / PART_MEAN).cast("int"))
    table = cut_lineage(  # its file size tells Spark whether it can be broadcast
        rates(plain, targets, temperature, total, source_col)
        .select("_mix_source", parts.alias("_mix_parts"), thresholds(mean / parts).alias("_mix_cdf")), "mix-rates",
    )
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0),
        lambda n, part: n + F.size(F.filter("_mix_cdf", lambda c: c <= draw(key, part, seed))),
    )
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("_mix_copy").cast("string"), key).cast("binary"))
    drawn = plain.join(table, plain[source_col].eqNullSafe(table["_mix_source"])).withColumn("_mix_n", copies).where("_mix_n > 0")
    return (
        drawn.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).withColumn("_mix_order", order)
        .select(*(F.col(f"`{c}`") for c in plain.columns), "_mix_copy", "_mix_order")
        .repartition("_mix_order").sortWithinPartitions("_mix_order")
    )


def oracle_sql(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """DuckDB SQL for doc_id, source, copy, order_key, text of ``mix`` over ``documents``, for means up to ``PART_MEAN``."""
    return f"""
    WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    weighed AS (SELECT source, n, pow(n::DOUBLE, {temperature}) AS w FROM sizes),
    mean AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS m FROM weighed),
    cdf AS (
      SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM mean
      UNION ALL
      SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k + 1 <= ceil(m + 12 * sqrt(m) + 24)
    ), lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
    drawn AS (
      SELECT doc_id, d.source, text,
             len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{seed}|1|' || doc_id), 1, {DRAW_BITS // 4}))::BIGINT / {float(1 << DRAW_BITS)})) AS n
      FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
    ), copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM drawn)
    SELECT doc_id, source, copy::INTEGER AS copy, md5('{seed}|order|' || copy || '|' || doc_id) AS order_key, text FROM copies
    """
