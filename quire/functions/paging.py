"""Page numbering, progress fractions and retry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import stage_progress

# Refinement covers this part of the overall bar; retry policy.
REFINING_START = 0.62
REFINING_END = 0.86 - 0.01
RETRYABLE_STATUS = [408, 409, 425, 429, 500, 502, 503, 504]
MAX_RETRIES = 3
MAX_DELAY_SECONDS = 30.0


def page_index(page_number: Column) -> Column:
    return page_number - 1


def page_number(index: Column) -> Column:
    return index + 1


def clamp_page(number: Column, page_count: Column) -> Column:
    """Page number limited to the document; null for an empty document."""
    return F.when(page_count > 0, F.least(F.greatest(number, F.lit(1)), page_count))


def is_valid_page(number: Column, page_count: Column) -> Column:
    return number.between(F.lit(1), page_count)


def completion(done: Column, page_count: Column) -> Column:
    """Finished share in 0..1; 0 for an empty document."""
    clamped = F.least(F.greatest(done, F.lit(0)), page_count).cast("double")
    return F.when(page_count > 0, F.try_divide(clamped, page_count.cast("double"))).otherwise(F.lit(0.0))


def clamp_unit(value: Column) -> Column:
    """Limit to 0..1, keeping null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def refinement_progress(index: Column, page_count: Column, fraction: Column) -> Column:
    overall = (index.cast("double") + clamp_unit(fraction)) / F.greatest(page_count, F.lit(1)).cast("double")
    return F.lit(REFINING_START) + F.lit(REFINING_END - REFINING_START) * overall


def displayed_progress(progress: Column, stage: Column) -> Column:
    return F.coalesce(progress, stage_progress(stage))


def is_retryable(status: Column, attempt: Column, max_retries: int = MAX_RETRIES) -> Column:
    return status.isin(RETRYABLE_STATUS) & (attempt < max_retries)


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Server-given delay when present, else exponential; both capped."""
    wait = F.coalesce(
        F.when(retry_after.isNotNull(), F.greatest(retry_after, F.lit(0.0))),
        F.pow(F.lit(2.0), attempt.cast("double")),
    )
    return F.least(wait, F.lit(MAX_DELAY_SECONDS))
