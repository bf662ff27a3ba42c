"""mailsieve: mail and text classification analytics as Spark DataFrame functions.

Every public function takes and returns DataFrames (or Columns for the scalar
helpers in ``mailsieve.functions``); nothing is collected to the driver except
small, size-bounded lookup tables (class lists, thresholds).
"""

from mailsieve.session import get_spark, checkpoint_dir, read_table

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
