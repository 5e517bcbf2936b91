"""User functions over a table: whole batches of points in, values and gradients out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ridgeline.operators.domain import Domain


def evaluate(df: DataFrame, functions, domain: Domain | None = None, tasks: int | None = None, gradients: bool = False, **arguments) -> DataFrame:
    """id, fx (array, a value for each output) and, if asked, grad (array of arrays) of every row of df (id, x).

    functions: one or several; each takes an array (rows, inputs) and `arguments`, and gives (rows,) or (rows, outputs);
    with gradients, that and (rows, inputs) or (rows, outputs, inputs). With a domain, x is normalised: functions get
    points in its units, and gradients are chained back. With `tasks`, that many evaluate side by side; results carry
    id, so rows may finish in any order. Null points, and rows on which a value isn't finite, have null fx and grad.
    """
    functions = functions if isinstance(functions, (list, tuple)) else [functions]
    center, scale = domain.center_scale() if domain else (0.0, 1.0)
    center, scale = np.array(center, float), np.array(scale, float)

    def run(batches):
        for batch in batches:
            out = {"id": batch["id"].to_numpy(), "fx": [None] * len(batch)} | ({"grad": [None] * len(batch)} if gradients else {})
            some = np.flatnonzero(batch["x"].notna().to_numpy())
            if len(some):
                x = np.stack(batch["x"].iloc[some].to_numpy()).astype(float) / scale + center
                found = [f(x, **arguments) for f in functions]
                values = [np.asarray(r[0] if gradients else r, float).reshape(len(x), -1) for r in found]
                fx = np.hstack(values)
                slopes = np.concatenate([np.asarray(r[1], float).reshape(len(x), v.shape[1], -1) for r, v in zip(found, values)], axis=1) / scale if gradients else None
                fine = np.isfinite(fx).all(axis=1)
                for k in np.flatnonzero(fine):
                    out["fx"][some[k]] = fx[k].tolist()
                    if gradients:
                        out["grad"][some[k]] = slopes[k].tolist()
            yield pd.DataFrame({c: v if c == "id" else pd.Series(v, dtype=object) for c, v in out.items()})

    points = df.select("id", "x")
    points = points.repartition(tasks) if tasks else points
    return points.mapInPandas(run, "id long, fx array<double>" + (", grad array<array<double>>" if gradients else ""))
