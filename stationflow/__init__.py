"""stationflow: a Spark-native engine for keyed observation series.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` / list of ``Column`` for expression builders). Series are described
by :class:`stationflow.spec.SeriesSpec`.
"""

from stationflow.spec import SeriesSpec

__all__ = ["SeriesSpec"]
