"""Series description shared by every windowed operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """A keyed, ordered series.

    ``station`` partitions the series, ``time`` orders it and ``tiebreak``
    makes the order total (reports can share a timestamp). Every window in the
    library orders by ``(time, tiebreak)`` so results never depend on an
    unstable sort.
    """

    station: str = "station_id"
    time: str = "datetime"
    tiebreak: str | None = None

    def order_cols(self) -> list[Column]:
        cols = [F.col(self.time)]
        if self.tiebreak:
            cols.append(F.col(self.tiebreak))
        return cols

    def order_names(self) -> list[str]:
        return [self.time] + ([self.tiebreak] if self.tiebreak else [])

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.station).orderBy(*self.order_cols())


OBS_SPEC = SeriesSpec("station_id", "datetime", "event_id")
