"""Column functions on CI target URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses the landed data uses.  The run filter has no slash at
# its end, the document rule has one, so a run can pass the first and still have
# no document (its duration stays null).
RUN_PREFIX = "https://prow.ci.openshift.org/view/gs"
VIEW_PREFIX = "https://prow.ci.openshift.org/view/gs/"
DOCUMENT_BASE = "https://gcsweb-ci.apps.ci.l2s4.p1.openshiftapps.com/gcs"
DOCUMENT_NAME = "prowjob.json"


def is_ci_run_url(url: Column, prefix: str = RUN_PREFIX) -> Column:
    return F.coalesce(F.startswith(url, F.lit(prefix)), F.lit(False))


def job_url(
    url: Column, prefix: str = VIEW_PREFIX, base: str = DOCUMENT_BASE, name: str = DOCUMENT_NAME
) -> Column:
    """Address of the job document behind a view URL; null for any other URL."""
    path = F.regexp_replace(F.replace(url, F.lit(prefix), F.lit("")), "/+$", "")
    return F.when(
        F.startswith(url, F.lit(prefix)), F.concat(F.lit(f"{base}/"), path, F.lit(f"/{name}"))
    )
