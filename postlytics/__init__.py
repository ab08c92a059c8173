"""postlytics: engagement analytics for social-media post tables on Spark.

Everything is a lazy DataFrame operator.  The usual flow is::

    posts = sources.posts_from_events(spark, sf_dir)      # or sources.read_export(...)
    pre = operators.preprocess(posts)                      # Prepared(df, roles, denominator)
    operators.er_by_weekday(pre).show()
"""

from postlytics.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
