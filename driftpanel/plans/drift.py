"""What the ledger is for: cost, drift, spread between models, data quality.

Inputs are ledger rows with ``model``, ``deployment``, ``composite_key``,
``day``, ``micros``, ``emitted_score``, ``ev_score``, ``score`` and ``tokens``.
Scores enter sums as decimals, so results do not depend on the order in which
tasks finish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT = "decimal(18,6)"
DAY_MICROS = 86_400_000_000
TOKEN_KINDS = ("input_uncached", "cached_read", "cache_write", "output_tokens", "reasoning_tokens")


def exact(value: Column) -> Column:
    return value.cast(EXACT)


def mean_of(value: str) -> Column:
    return F.try_divide(F.sum(exact(F.col(value))).cast("double"), F.count(value))


def spread_of(value: str) -> Column:
    return F.stddev_samp(value)


def price_validity(prices: DataFrame, last_micros: Column, keys: Sequence[str] = ("model",)) -> DataFrame:
    """One row per price and day it is valid on, up to ``last_micros``."""
    by_key = Window.partitionBy(*keys).orderBy("effective_micros")
    bounded = prices.withColumn("until", F.lead("effective_micros").over(by_key)).withColumn(
        "last", F.coalesce(F.col("until") - 1, F.greatest(last_micros, F.col("effective_micros")))
    )
    first_day = F.floor(F.col("effective_micros") / DAY_MICROS)
    last_day = F.floor(F.col("last") / DAY_MICROS)
    return bounded.withColumn("epoch_day", F.explode(F.sequence(first_day, last_day))).drop("last")


def cost_as_of(calls: DataFrame, prices: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cost of each call at the price in force when it was made.

    Prices are spread over the days they hold, so the as-of join is an equi-join
    on the keys and day; neither side needs to be small and a busy model is split by
    day. A call before the first price has no cost.
    """
    horizon = calls.agg(F.max("micros")).scalar()
    valid = price_validity(prices, horizon, keys).select(*keys, "epoch_day", "effective_micros", "until", "price")
    at = F.col("micros")
    placed = calls.withColumn("epoch_day", F.floor(at / DAY_MICROS))
    c, p = placed.alias("c"), valid.alias("p")
    hit = (
        (F.col("c.epoch_day") == F.col("p.epoch_day"))
        & (F.col("p.effective_micros") <= F.col("c.micros"))
        & (F.col("p.until").isNull() | (F.col("c.micros") < F.col("p.until")))
    )
    for key in keys:
        hit = (F.col(f"c.{key}") == F.col(f"p.{key}")) & hit
    return c.join(p, hit, "left").select(
        "c.*", F.col("p.price").alias("price"), (F.col("c.tokens") * F.col("p.price")).alias("cost")
    ).drop("epoch_day")


def cost_by_kind(calls: DataFrame, prices: DataFrame, call: Sequence[str],
                 kinds: Sequence[str] = TOKEN_KINDS) -> DataFrame:
    """Cost of each kind of token of each call; prices hold per model and kind.

    A count that the provider did not itemise is null and stays so: its cost is not
    known. Tokens of a kind without a price have no cost either, unless there are none.
    """
    lines = calls.select(*call, "model", "micros", *kinds).unpivot(
        [*call, "model", "micros"], list(kinds), "kind", "tokens")
    priced = cost_as_of(lines, prices, ("model", "kind"))
    return priced.withColumn("cost", F.when(F.col("tokens") == 0, 0.0).otherwise(F.col("cost")))


def call_costs(lines: DataFrame, call: Sequence[str]) -> DataFrame:
    """Per call: what is known of its cost, and how many kinds are missing from that.

    ``cost`` is null unless every kind is known and priced.
    """
    known = F.coalesce(F.sum(exact(F.col("cost"))).cast("double"), F.lit(0.0))
    summed = lines.groupBy(*call).agg(
        known.alias("known_cost"), F.count_if(F.col("tokens").isNull()).alias("unknown_kinds"),
        F.count_if(F.col("tokens").isNotNull() & F.col("cost").isNull()).alias("unpriced_kinds"),
    )
    complete = (F.col("unknown_kinds") == 0) & (F.col("unpriced_kinds") == 0)
    return summed.withColumn("cost", F.when(complete, F.col("known_cost")))


def drift_by_day(ledger: DataFrame) -> DataFrame:
    """Daily mean per model, against the day before and the first day."""
    daily = ledger.groupBy("model", "day").agg(
        F.count("score").alias("n"), mean_of("score").alias("mean_score"), spread_of("score").alias("sd_score")
    )
    days = Window.partitionBy("model").orderBy("day")
    first = F.first("mean_score").over(days.rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(
        "*",
        (F.col("mean_score") - F.lag("mean_score").over(days)).alias("vs_previous"),
        (F.col("mean_score") - first).alias("vs_first"),
    )


def panel_drift(ledger: DataFrame, panel_jobs: DataFrame) -> DataFrame:
    """Drift on fixed panels: each posting against itself.

    A model's reference for a posting is its mean on the first day it scored it under that
    panel, so a panel that changes starts anew and what differs between postings cancels.
    Per panel, model and day: postings of the panel, those scored, those seen for the first
    time (they have no pair yet), and mean, spread and standard error of the paired
    differences. Null without a pair, or two for the spread. Scores of postings outside
    the panel don't count. ``ledger`` has panel_id, stablekey, model, day, score.
    """
    key = ["panel_id", "stablekey"]
    members = panel_jobs.select(*key).distinct()
    sizes = members.groupBy("panel_id").agg(F.count("*").alias("panel_size"))
    scored = ledger.filter(F.col("score").isNotNull()).join(members, key, "left_semi")
    daily = scored.groupBy(*key, "model", "day").agg(mean_of("score").alias("mean"))
    # One row per day is left of a posting, however often it was scored.
    days = Window.partitionBy(*key, "model").orderBy("day")
    against = daily.withColumn("nth", F.row_number().over(days)).withColumn("reference", F.first("mean").over(days))
    pairs = against.withColumn("diff", F.when(F.col("nth") > 1, F.round(exact(F.col("mean")) - exact(F.col("reference")), 6).cast("double")))
    summed = pairs.groupBy("panel_id", "model", "day").agg(
        F.count("*").alias("scored"), F.count_if(F.col("nth") == 1).alias("first_seen"), F.count("diff").alias("pairs"),
        mean_of("diff").alias("mean_diff"), spread_of("diff").alias("sd_diff"),
    )
    return summed.join(sizes, "panel_id").withColumn("se_diff", F.col("sd_diff") / F.sqrt("pairs"))


def model_variance(ledger: DataFrame) -> DataFrame:
    """Spread between models on one posting and day; each model counts once."""
    per_model = ledger.groupBy("day", "composite_key", "model").agg(mean_of("score").alias("score"))
    return per_model.groupBy("day", "composite_key").agg(
        F.count("*").alias("models"),
        spread_of("score").alias("sd_between"),
        (F.max("score") - F.min("score")).alias("score_range"),
    ).filter(F.col("models") > 1)


def host_gap(ledger: DataFrame) -> DataFrame:
    """Same model, posting and day on several hosts: largest gap of their means."""
    per_host = ledger.groupBy("model", "day", "composite_key", "deployment").agg(
        mean_of("score").alias("score")
    )
    return per_host.groupBy("model", "day", "composite_key").agg(
        F.count("*").alias("hosts"), (F.max("score") - F.min("score")).alias("gap")
    ).filter(F.col("hosts") > 1)


def batch_size_effect(ledger: DataFrame, calls: DataFrame) -> DataFrame:
    """Scores and tokens by batch size. The share per posting is derived, not measured."""
    scored = ledger.groupBy("batch_size").agg(
        F.count("score").alias("events"), mean_of("score").alias("mean_score")
    )
    spent = calls.groupBy("batch_size").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens")
    )
    # A batch size without a score, or without a call, is a finding too.
    both = scored.join(spent, "batch_size", "full_outer").fillna(0, ["events", "calls", "tokens"])
    return both.withColumn(
        "derived_tokens_per_job", F.when(F.col("calls") > 0, F.col("tokens") / (F.col("calls") * F.col("batch_size")))
    )


def ev_coverage(ledger: DataFrame) -> DataFrame:
    """How often the expected value exists, and how far it is from the emitted score."""
    gap = exact(F.col("ev_score")) - exact(F.col("emitted_score"))
    return ledger.groupBy("model").agg(
        F.count("*").alias("events"),
        F.count("ev_score").alias("with_ev"),
        (F.count("ev_score") / F.count("*")).alias("coverage"),
        (F.sum(gap).cast("double") / F.count("ev_score")).alias("mean_gap"),
    )


def loss_rates(events: DataFrame, sent: DataFrame) -> DataFrame:
    """Share of uncorrelated and of dropped results per model and batch size.

    A model all of whose calls failed has no events; it is the worst case, not a missing one.
    """
    kept = events.groupBy("model", "batch_size").agg(
        F.count("*").alias("events"), F.count_if(F.col("emitted_score") == -2).alias("sentinels")
    )
    asked = sent.groupBy("model", "batch_size").agg(
        F.sum("jobs_sent").alias("jobs_sent"), F.sum("scores_parsed").alias("scores_parsed")
    )
    counts = ["events", "sentinels", "jobs_sent", "scores_parsed"]
    return kept.join(asked, ["model", "batch_size"], "full_outer").fillna(0, counts).select(
        "model", "batch_size", "events", "sentinels",
        (F.col("jobs_sent") - F.col("scores_parsed")).alias("dropped"),
        F.when(F.col("events") > 0, F.col("sentinels") / F.col("events")).alias("sentinel_rate"),
    )


def length_covariate(calls: DataFrame) -> DataFrame:
    """How tokens follow description length."""
    return calls.groupBy("model").agg(
        F.count("*").alias("n"),
        F.corr("description_bytes", "tokens").alias("correlation"),
        F.regr_slope("tokens", "description_bytes").alias("tokens_per_byte"),
    )


def failures_by_class(calls: DataFrame) -> DataFrame:
    return (
        calls.filter(F.col("error_class") != "").groupBy("model", "error_class")
        .agg(F.count("*").alias("failures"))
    )


def live_span(jobs: DataFrame, now_epoch: Column) -> DataFrame:
    """Days a posting stayed visible, and whether it is gone."""
    return jobs.select(
        "composite_key", "first_epoch", "last_epoch",
        ((F.col("last_epoch") - F.col("first_epoch")) / 86400).alias("live_days"),
        (F.col("last_epoch") < now_epoch - 48 * 3600).alias("vanished"),
    )


def contributor_effect(ledger: DataFrame) -> DataFrame:
    """Cell means by contributor and model, and what the two margins leave unexplained.

    The margins come from the cells' sums, not from the ledger again.
    """
    cells = ledger.groupBy("contributor_id", "model").agg(
        F.sum(exact(F.col("score"))).alias("total"), F.count("score").alias("n")
    )

    def mean_over(key: str) -> Column:
        window = Window.partitionBy(key)
        return F.sum("total").over(window).cast("double") / F.sum("n").over(window)

    cell = F.col("total").cast("double") / F.col("n")
    overall = cells.agg(F.sum("total").cast("double") / F.sum("n")).scalar()
    return cells.select(
        "contributor_id", "model", "n", cell.alias("cell_mean"),
        mean_over("contributor_id").alias("contributor_mean"),
        mean_over("model").alias("model_mean"),
        (cell - mean_over("contributor_id") - mean_over("model") + overall).alias("interaction"),
    )


def noise_floor(ledger: DataFrame) -> DataFrame:
    """Spread of repeated scores of one posting by one model within a day, per model."""
    repeats = ledger.groupBy("model", "composite_key", "day").agg(
        F.count("score").alias("repeats"), spread_of("score").alias("sd")
    ).filter(F.col("repeats") > 1)
    return repeats.groupBy("model").agg(
        F.count("*").alias("groups"), F.avg("sd").alias("mean_sd"), F.max("sd").alias("max_sd")
    )


def comparable_runs(ledger: DataFrame) -> DataFrame:
    """Sets of runs that may be compared: same configuration, instructions, temperature."""
    return ledger.groupBy("config_id", "instructions_version", "temperature_sent").agg(
        F.countDistinct("run_id").alias("runs"), F.count("*").alias("events"), mean_of("score").alias("mean_score")
    )
