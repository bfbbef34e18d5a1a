"""Known vulnerabilities, from a table of advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.scalars import advisory_ecosystem, advisory_severity

_ORD = 2 * 10**12


def advisory_findings(artifacts: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding for each advisory of an artifact's exact version; the rule and the evidence are the advisory's id.
    Artifacts of an ecosystem that the database lacks get the note that the lookup has no answer.

    advisories: ecosystem (the database's spelling), name, version, id, summary, db_severity, severity.
    """
    keyed = artifacts.select("digest", advisory_ecosystem(F.col("ecosystem")).alias("ecosystem"), "name", "version")
    hits = keyed.join(advisories, ["ecosystem", "name", "version"])
    told = F.concat(F.lit("known vulnerability "), F.col("id"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), F.col("summary"))).otherwise(""))
    unknown = artifacts.filter(advisory_ecosystem(F.col("ecosystem")).isNull())
    told_off = unknown.select("digest", F.format_string('osv: unsupported ecosystem "%s"', F.coalesce("ecosystem", F.lit(""))).alias("error")).distinct()
    found = hits.select("digest", F.lit("osv").alias("stage"), F.col("id").alias("rule"), advisory_severity(F.col("db_severity"), F.col("severity")).alias("severity"), told.alias("description"), F.col("id").alias("evidence"), F.lit(_ORD).cast("long").alias("ord"))
    return found.unionByName(unavailable_findings(unknown, told_off))


def unavailable_findings(artifacts: DataFrame, answered: DataFrame) -> DataFrame:
    """A note for artifacts that the advisory lookup has no answer for; it never blocks. answered: digest, error."""
    rule, severity, description = fixed.GATE_RULES["advisories"]
    missing = artifacts.select("digest").distinct().join(answered, "digest", "left").filter(F.col("error").isNotNull())
    return missing.select("digest", F.lit("osv").alias("stage"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(description).alias("description"), F.col("error").alias("evidence"), F.lit(_ORD + 1).cast("long").alias("ord"))
