"""webloom: Spark-native operators over crawled web content and its event logs.

Pages, responses, search queries, documents and client events are plain
DataFrames; every operator takes DataFrames (or Columns) and returns a
DataFrame, so Catalyst plans the whole pipeline.
"""

from webloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
