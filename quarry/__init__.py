"""quarry — corpus preparation and execution-based evaluation for text-to-SQL data, on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (usable through ``df.transform``) or a
``Column -> Column`` helper built from built-in Catalyst expressions, so the same code runs on a
laptop sample or a cluster.
"""

from quarry.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
