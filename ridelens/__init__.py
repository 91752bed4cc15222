"""ridelens: booking analytics (cleaning, segmentation, demand forecasting) on Spark.

Every public function maps DataFrame -> DataFrame (or fits a small parameter set with one
aggregate and returns it).  Nothing runs at import time.
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
