"""Licence compliance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SPDX ids allowed by default, strong copyleft, weak copyleft.
ALLOWED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0")
STRONG = ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")
WEAK = ("MPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.1", "EUPL-1.2")


def check_licenses(deps: DataFrame, licenses: DataFrame, allowed: Iterable[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """group, artifact, version, license, status, reason of each dependency (group, artifact, version), once
    for each group and artifact (the least version).

    licenses: (group, artifact, spdx), a table in place of a lookup over the
    network; what it lacks is UNKNOWN. overrides: "group:artifact" -> SPDX id, first.
    """
    spark = deps.sparkSession
    ok = list(ALLOWED if allowed is None else allowed)
    one = deps.groupBy("group", "artifact").agg(F.min("version").alias("version"))
    known = licenses.groupBy("group", "artifact").agg(F.min("spdx").alias("spdx"))
    own = spark.createDataFrame(list((overrides or {}).items()), "key string, own string")
    out = one.join(known, ["group", "artifact"], "left").join(F.broadcast(own), F.concat_ws(":", "group", "artifact") == F.col("key"), "left")
    out = out.withColumn("license", F.coalesce("own", "spdx", F.lit("UNKNOWN")))
    lic = F.col("license")
    strong, weak, none, other = "is a strong copyleft licence", "is a weak copyleft licence", "could not be determined", "is not in the allowed list"
    status = F.when(lic.isin(ok), "OK").when(lic.isin(list(STRONG)), "VIOLATION").when(lic.isin(list(WEAK)), "WARNING").when(lic == "UNKNOWN", "UNKNOWN").otherwise("WARNING")
    reason = F.when(lic.isin(ok), "is in the allowed list").when(lic.isin(list(STRONG)), strong).when(lic.isin(list(WEAK)), weak).when(lic == "UNKNOWN", none).otherwise(other)
    return out.select("group", "artifact", "version", "license", status.alias("status"), F.concat_ws(" ", lic, reason).alias("reason"))


def find_license_violations(deps: DataFrame, licenses: DataFrame, allowed: Iterable[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """check_licenses without the OK rows; UNKNOWN ones stay."""
    return check_licenses(deps, licenses, allowed, overrides).filter(F.col("status") != "OK")
