"""shotspark: launch-monitor shot analytics as Spark DataFrame plans.

Every public function is lazy (DataFrame in, DataFrame out) and takes ``by``:
the leading group keys (``("user_id",)`` computes every player in one job,
``()`` reproduces single-frame behaviour).
"""

from shotspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
