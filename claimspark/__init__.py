"""claimspark: claim matching, stance and evaluation as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a ``Column`` helper; Catalyst plans all of the work.
"""

from claimspark.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
