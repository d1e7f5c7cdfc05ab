"""Which configured sources may be read: a known adapter and a basis that permits the use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADAPTERS = ("rss", "submissions", "structured-feed")
# On what basis a source may be read; the second row takes a statement of the licence and its terms.
FREE_BASES = ("public_feed", "user_submission", "company_website")
STATED_BASES = ("open_data", "licensed_api", "permitted_page")
WEB = r"^https?://\S+$"


def licence_problems(basis: Column, attestation: Column, terms_url: Column) -> Column:
    """array<string> of what is wrong with a licence; empty for a valid one."""
    blank = F.coalesce(F.trim(attestation) == "", F.lit(True))
    web = F.coalesce(terms_url.rlike(WEB), F.lit(False))
    stated = basis.isin(*STATED_BASES)
    known = F.coalesce(basis.isin(*FREE_BASES, *STATED_BASES), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~known, "basis"),
            F.when(stated & blank, "attestation"),
            F.when((stated & ~web) | (known & ~stated & terms_url.isNotNull() & ~web), "terms_url"),
        )
    )


def judged(configs: DataFrame) -> DataFrame:
    """`configs` with skipped: why a source is not read (disabled, unknown adapter, no valid licence: ...); null for one that is.

    configs: id, adapter, enabled, basis, attestation, terms_url.
    """
    problems = licence_problems(F.col("basis"), F.col("attestation"), F.col("terms_url"))
    unknown = ~F.coalesce(F.col("adapter").isin(*ADAPTERS), F.lit(False))
    why = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when(unknown, "unknown adapter").when(F.size(problems) > 0, F.concat(F.lit("no valid licence: "), F.array_join(problems, "; ")))
    return configs.withColumn("skipped", why)
