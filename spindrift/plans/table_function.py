"""The decomposition forecast as a table function for SQL.

    SELECT * FROM fit_forecast(96, TABLE(rows) PARTITION BY series_id ORDER BY t)

reads the rows of one partition at a time, in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import decompose

SCHEMA = "series_id string, window_start int, h int, point double, lower double, upper double"


class FitForecast:
    """Rows need `series_id` and `y`; `window_start` parts them further where it is there."""

    def __init__(self):
        self.key, self.values, self.horizon = None, [], 0

    def eval(self, horizon: int, row: Row):
        if row["y"] is not None:
            known = row.asDict()
            self.key, self.horizon = (known["series_id"], known.get("window_start")), horizon
            self.values.append(float(row["y"]))

    def terminate(self):
        if self.values and self.horizon > 0:
            o = decompose.Options()
            fit = decompose.fit_window(np.array(self.values), 0, o)
            point, h = decompose.ahead(fit, self.horizon, o), np.arange(self.horizon)
            growth = np.sqrt(1 + h / fit["n"])
            for k, p, low, high in zip(h.tolist(), point.tolist(), (point + fit["q_lo"] * growth).tolist(), (point + fit["q_hi"] * growth).tolist(), strict=True):
                yield (*self.key, k, p, low, high)


def register(spark: SparkSession, name: str = "fit_forecast") -> None:
    spark.udtf.register(name, udtf(FitForecast, returnType=SCHEMA))
