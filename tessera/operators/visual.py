"""Pass-through steps that draw aggregates. Drawing needs matplotlib; without it the aggregates are written as CSV."""

from __future__ import annotations

from pathlib import Path

from tessera.frame import AnnotatedFrame
from tessera.operators.statistics import density_grid, histogram
from tessera.plans.step import Step, describe, input, output


def _pyplot():
    try:
        from matplotlib import pyplot
    except ImportError:
        return None
    return pyplot


class PlotLatLon(Step):
    """A map of positions per cell, saved as ``<output_dir>/<filename>``; the data passes unchanged."""

    def __init__(self, output_dir: str, filename: str = "lat-lon.png", cell: float = 1.0):
        self.output_dir, self.filename, self.cell = str(output_dir), filename, cell

    @describe("Draw positions")
    @input({"x": {"unit": "deg"}, "y": {"unit": "deg"}})
    @output({})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        cells = density_grid(df.df, self.get_name("x"), self.get_name("y"), self.cell).toPandas()
        path = Path(self.output_dir) / self.filename
        path.parent.mkdir(parents=True, exist_ok=True)
        if (plt := _pyplot()) is None:
            cells.to_csv(path.with_suffix(".csv"), index=False)
        else:
            figure, axes = plt.subplots()
            axes.scatter(cells["lon"], cells["lat"], c=cells["n"], s=4)
            figure.savefig(path)
            plt.close(figure)
        return df


class PlotHistograms(Step):
    """A histogram of every ranged column, in ``<output_dir>``; the data passes unchanged."""

    def __init__(self, output_dir: str, prefix: str = "histogram", bins: int = 50):
        self.output_dir, self.prefix, self.bins = str(output_dir), prefix, bins

    @describe("Draw histograms")
    @input({})
    @output({})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        from pyspark.sql.types import NumericType

        folder = Path(self.output_dir)
        folder.mkdir(parents=True, exist_ok=True)
        for field in df.schema:
            if not isinstance(field.dataType, NumericType):
                continue
            low, high = df.minmax(field.name)
            if low is None or low == high:
                continue
            made = histogram(df.df, field.name, self.bins, float(low), float(high)).toPandas().sort_values("bin")
            path = folder / f"{self.prefix}-{field.name}"
            if (plt := _pyplot()) is None:
                made.to_csv(f"{path}.csv", index=False)
            else:
                figure, axes = plt.subplots()
                axes.bar(made["edge"], made["n"], width=(high - low) / self.bins, align="edge")
                figure.savefig(f"{path}.png")
                plt.close(figure)
        return df
