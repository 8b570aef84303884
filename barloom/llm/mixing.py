"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a target of words: its share by weight, never above `repeat` times
what it holds, the excess shared again by weight. The mix is cut into blocks of equal
size. Sources compete for blocks with the quotients target / (2a + 1), the shards of a
source compete for the source's blocks with shard size / (2a + 1); both quotas are
integers that add up. Inside a shard the documents lie in a seeded order, the shard's
words are cut into equal blocks, and a seeded permutation says which blocks are taken
once more than the others. What a document gives follows from the blocks it overlaps.

Only column expressions and windows are used. Rows are (document, source, size), never
texts. A source is split into shards of about `shard_rows` documents, so a source with a
third of all rows is many window partitions. The only windows without a partition run
over one row per source.

Defined results: a null text has size 0 and takes nothing; a null source is a source of
its own, ordered last; repeated rows are documents of their own; an empty table gives an
empty result; a source without words has target 0. Rows without an id, or that share one, are
spread over the shards by their texts. Columns of the table beyond id, source and text are
ignored unless named in `keep`; texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored, word_count

#: A prime above any number of blocks in a shard, so its multiples permute the blocks.
_STEP = 2147483647
#: Levels that a narrowing of an apportionment counts quotients at, and narrowings.
GRID, NARROWINGS = 16, 2


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5,
            repeat: int = 2) -> DataFrame:
    """Adds `weight` and `target` to one row per `source` with its `source_size`.

    Sources are filled in the order in which they reach their ceiling. If all before a
    source are at their ceiling and the rest goes by weight, the level is `lam`; it is
    the right one for the first source whose ceiling it does not pass, and no later row
    gives a higher one.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ceiling = F.col("source_size") * F.lit(float(repeat))
    s = sources.withColumn("_rn", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_ratio", ceiling / F.col("weight"))
    before = Window.orderBy("_ratio", "_rn").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))
    open_weight = (F.sum("weight").over(everything)
                   - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_lam", left / open_weight)
    level = F.max(F.when(F.col("_lam") <= F.col("_ratio"), F.col("_lam"))).over(everything)
    # Without a fitting row (share >= repeat) every source is at its ceiling.
    s = s.withColumn("target", F.least(ceiling, F.coalesce(level * F.col("weight"), ceiling)))
    return s.drop("_rn", "_ratio", "_lam")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str],
                 out: str) -> DataFrame:
    """Splits the `seats` of each group among its parties by the highest votes / (2a + 1).

    Of S seats for m parties with V votes, every quotient above V / (2S - m) wins and none
    below V / (2S + m) does, since a party has floor((v / t + 1) / 2) quotients of at least t.
    Each of the `NARROWINGS` counts them at `GRID` levels in between, one sum per level, and
    keeps the two levels around S. Only the quotients between the last two (and one beyond on
    either side, for rounding) are ranked. The result is the exact rule, ties by `order`. Equal
    votes stay together however fine the levels are. Parties without votes get no seat.
    """
    p = stored(parties.withColumn("_one", F.lit(0)))
    keys = ["_one", *group]
    v, t = F.col(votes), F.col
    total = p.where(v > 0).groupBy(*keys).agg(
        F.sum(v).alias("_v"), F.max(v).alias("_top"), F.count(F.lit(1)).alias("_m"), F.max(seats).alias("_s"))
    most = 2 * t("_s") - t("_m")
    level = total.select(*keys, "_s", (t("_v") / (2 * t("_s") + t("_m"))).alias("_lo"),
                         F.when(most > 0, F.least(t("_v") / most, "_top")).otherwise(t("_top")).alias("_hi"))

    def at_least(bar):
        return F.floor((v / bar + 1) / 2).cast("long")

    for _ in range(NARROWINGS):
        bars = {i: t("_lo") + (t("_hi") - t("_lo")) * (i / GRID) for i in range(1, GRID)}
        counted = p.where(v > 0).join(level, keys).groupBy(*keys, "_s", "_lo", "_hi").agg(
            *[F.sum(at_least(bar)).alias(f"_n{i}") for i, bar in bars.items()])
        level = counted.select(
            *keys, "_s",
            F.greatest("_lo", *[F.when(t(f"_n{i}") >= t("_s"), bar) for i, bar in bars.items()]).alias("_low"),
            F.least("_hi", *[F.when(t(f"_n{i}") <= t("_s"), bar) for i, bar in bars.items()]).alias("_hi"),
        ).withColumnRenamed("_low", "_lo")
    p = p.join(stored(level.drop("_s")), keys, "left")
    sure = F.when(v > 0, F.greatest(at_least(t("_hi")) - 1, F.lit(0).cast("long"))).otherwise(0).cast("long")
    p = p.withColumn("_sure", sure)
    given = p.groupBy(*keys).agg(F.sum("_sure").alias("_given"))
    asked = p.where(v > 0).select(*keys, *[c for c in parties.columns if c not in group], "_lo", "_sure", F.explode(
        F.sequence(F.col("_sure"), F.greatest(at_least(t("_lo")), t("_sure")))).alias("_a"))
    ranked = asked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(
        F.desc(v / (2 * F.col("_a") + 1)), *order, "_a"))).join(given, keys)
    won = ranked.where(F.col("_rank") <= F.col(seats) - F.col("_given"))
    same = [*group, *order]
    won = won.groupBy(*same).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_k_{c}") for c in same], "_won")
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return (p.join(won, match, "left")
            .withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .select(*parties.columns, out))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeat: int = 2,
                block_words: int = 64, shard_rows: int = 4096, seed: int = 17,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken and the columns named in `keep`.
    `taken` counts repeats and never exceeds `repeat` * size.
    """
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                               word_count(F.col("text")).alias("size"),
                               F.xxhash64("doc_id", "text").alias("_row"), *keep))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                          F.count(F.lit(1)).alias("_docs"))
    t = targets(sources, weights, share, repeat)
    t = t.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy())
                                       / block_words).cast("long"))
    t = sainte_lague(t, [], "target", "_seats", ["source"], "_blocks")
    t = stored(t.select("source", "source_size", "target", "_blocks",
                        F.ceil(F.col("_docs") / shard_rows).cast("long").alias("_shards")))

    rows = (sized.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
            .select("d.*", "source_size", "target", "_blocks",
                    F.pmod(F.xxhash64("_row", F.lit(seed)), F.col("_shards")).alias("_shard"),
                    F.xxhash64(F.lit(seed), "_row", F.lit("order")).alias("_key")))
    rows = rows.select(  # one key without nulls for the windows and the join below
        "*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"))
    shards = (rows.groupBy("_src", "_shard", "_blocks")
              .agg(F.sum("size").alias("_words")).where("_words > 0"))
    shards = sainte_lague(shards, ["_src"], "_words", "_blocks", ["_shard"], "_quota")
    shards = shards.select("_src", "_shard", "_words", F.greatest(
        F.round(F.col("_words") / block_words), F.lit(1)).cast("long").alias("_cut"), "_quota")
    # A block is taken `repeat` times at most.
    shards = shards.withColumn("_quota", F.least("_quota", F.col("_cut") * repeat))

    order = Window.partitionBy("_src", "_shard").orderBy("_key", "doc_id", "size")
    placed = rows.withColumn("_from", F.sum("size").over(order) - F.col("size"))
    d = placed.join(shards, ["_src", "_shard"], "left")
    start, end = F.col("_from"), F.col("_from") + F.col("size")

    def holder(position):  # the block that holds a position: blocks start at floor(i * words / cut)
        return F.expr(f"(({position} + 1) * _cut - 1) div _words")

    def edge(i):
        return F.floor(i * F.col("_words") / F.col("_cut"))

    more = F.pmod(F.col("_quota"), F.col("_cut"))
    shift = F.pmod(F.xxhash64("_src", "_shard", F.lit(seed)), F.col("_cut"))

    def picked(i):
        step = F.pmod(F.lit(_STEP).cast("long"), F.col("_cut"))
        return F.pmod(i * step + shift, F.col("_cut")) < more

    blocks = F.sequence(holder("_from"), holder("(_from + size - 1)"))
    extra = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, i: acc + F.when(
        picked(i), F.least(end, edge(i + 1)) - F.greatest(start, edge(i))).otherwise(0).cast("long"))
    taken = F.when((F.col("size") > 0) & F.col("_quota").isNotNull(),
                   F.expr("_quota div _cut") * F.col("size") + extra).otherwise(0)
    return d.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
                    *keep)


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 17, **settings) -> DataFrame:
    """The rows of `docs` as often as the mix takes them: 0, 1, .. `repeat` times.

    The words taken of a document are rounded to whole documents by a seeded draw, so a
    source's words come near its target and no text is cut.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                                 F.coalesce(F.col(text), F.lit("")))))
    keyed = docs.withColumn("_barloom_key", key)
    mix = mix_sources(keyed.select("doc_id", "source", F.col(text).alias("text"), "_barloom_key"), seed=seed,
                      keep=("_barloom_key",), **settings)
    draw = F.when(F.col("size") > 0, F.pmod(F.xxhash64("_barloom_key", F.lit(seed)), F.col("size")))
    times = F.when(F.col("size") > 0, F.expr("(taken + _barloom_draw) div size")).otherwise(0)
    # Rows that are equal throughout share their words evenly, so one verdict serves all.
    chosen = stored(mix.withColumn("_barloom_draw", draw).groupBy("_barloom_key").agg(
        F.max("size").alias("size"), F.floor(F.avg("taken")).cast("long").alias("taken"), F.max("_barloom_draw").alias("_barloom_draw"))
        .withColumn("_barloom_times", times).where("_barloom_times > 0").select("_barloom_key", "_barloom_times"))
    return (keyed.join(small_side(chosen), "_barloom_key")
            .withColumn("_barloom_turn", F.explode(F.array_repeat(F.lit(1), F.col("_barloom_times").cast("int"))))
            .select(*docs.columns))
