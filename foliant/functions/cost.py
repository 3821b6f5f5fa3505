"""Closed-form estimates of provider traffic and the calibration of models, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Measured constants of the estimate.
CONDENSE_OVERHEAD = 900
SYNTHESIS_OVERHEAD = 500
ENVELOPE = 1.55
OVERSHOOT = 1.30
SYNTHESIS_SHAVE = 0.90
TRIM_SHARE = 0.50
TRIM_SHAVE = 0.94
EXPANSION = 1.15
SPREAD = 0.30
TOKENS_PER_PAGE = 450
#: model: (factor of the ratio asked for, overshoot)
CALIBRATIONS = {"gemini-3.6-flash": (0.85, 1.30), "openai/gpt-5.6-luna": (0.67, 1.30)}


def condense_traffic(tokens: Column, chapters: Column, chunks: Column, ratio: float, translate: bool = False, overshoot: Column | None = None) -> dict[str, Column]:
    """Prompt and completion tokens and calls of condensing, smoothing and trimming, and translating if asked."""
    tokens, chapters, chunks = (c.cast("double") for c in (tokens, chapters, chunks))
    condensed = tokens * ratio * (F.lit(OVERSHOOT) if overshoot is None else overshoot)
    smooth = condensed * SYNTHESIS_SHAVE
    trimmed = smooth * TRIM_SHARE
    prompt = (tokens + CONDENSE_OVERHEAD * chunks) + (condensed + SYNTHESIS_OVERHEAD * chapters) + (trimmed + SYNTHESIS_OVERHEAD * (chapters * TRIM_SHARE))
    completion = condensed * ENVELOPE + smooth * ENVELOPE + trimmed * TRIM_SHAVE * ENVELOPE
    calls = chunks + chapters + chapters * TRIM_SHARE
    if translate:
        final = smooth * TRIM_SHAVE
        prompt, completion, calls = prompt + final + SYNTHESIS_OVERHEAD * chapters, completion + final * EXPANSION * ENVELOPE, calls + chapters
    return {"prompt_tokens": F.rint(prompt).cast("long"), "completion_tokens": F.rint(completion).cast("long"), "calls": F.rint(calls).cast("long")}


def translate_traffic(tokens: Column, units: Column, per_batch: int = 40) -> dict[str, Column]:
    batches = F.ceil(units / per_batch)
    return {
        "prompt_tokens": F.rint(tokens.cast("double") + SYNTHESIS_OVERHEAD * batches).cast("long"),
        "completion_tokens": F.rint(tokens.cast("double") * EXPANSION * ENVELOPE).cast("long"),
        "calls": batches.cast("long"),
    }


def pages(tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(tokens.cast("double") / TOKENS_PER_PAGE).cast("long"))


def target_tokens(tokens: Column, ratio: float) -> Column:
    return F.greatest(F.rint(tokens.cast("double") * ratio).cast("long"), F.lit(100).cast("long"))


def calibrated(models: DataFrame, spark: SparkSession) -> DataFrame:
    """models(model) with ask_factor, overshoot and whether the model is calibrated; exact names only."""
    known = spark.createDataFrame([(m, *v) for m, v in CALIBRATIONS.items()], "model string, ask double, over double")
    joined = models.join(F.broadcast(known), "model", "left")  # two rows
    return joined.select("model", F.coalesce("ask", F.lit(1.0)).alias("ask_factor"), F.coalesce("over", F.lit(OVERSHOOT)).alias("overshoot"), F.col("ask").isNotNull().alias("calibrated"))
