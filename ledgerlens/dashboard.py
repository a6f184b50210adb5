"""The PNG dashboard: panels over small frames, drawn on the driver; needs matplotlib, which the engine does not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .operators import compare, risk

try:
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot
except ImportError:  # an optional extra
    pyplot = None


def panels(df: DataFrame, config: Config = Config()) -> dict[str, list[tuple]]:
    """(label, value) rows of each panel over enriched transactions with in_period; every frame is grouped or a top-n before it is collected."""
    now = df.where("in_period")
    mine = now.where("is_target")
    month = mine.where("month is not null").groupBy("month").agg((100 * F.avg((~F.col("has_eld_activity")).cast("double"))).alias("no_eld"), F.sum("transaction_amount").alias("spend")).orderBy("month")
    rows = {
        "Significance (-log10 p)": compare.family(now, config).select("metric", -F.log10(F.greatest("p_value", F.lit(1e-12)))),
        "No ELD match by month (%)": month.select("month", "no_eld"),
        "Spend by month": month.select("month", "spend"),
        "Products": mine.groupBy("product_clean").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_clean").limit(5),
        "Highest risk": risk.top(risk.profile(mine, config=config), "composite_risk_score", "driver_name", config.output.top_n).select("driver_name", "composite_risk_score"),
        "Highest volume": risk.top(risk.volumes(mine), "total_volume", "driver_name", config.output.top_n).select("driver_name", "total_volume"),
    }
    return {title: [tuple(r) for r in frame.collect()] for title, frame in rows.items()}


def draw(df: DataFrame, path: str, config: Config = Config()) -> str:
    """Writes the panels as a PNG and returns its path."""
    if pyplot is None:
        raise RuntimeError("the dashboard needs matplotlib")
    figure, axes = pyplot.subplots(2, 3, figsize=(18, 9))
    for axis, (title, rows) in zip(axes.flat, panels(df, config).items()):
        axis.barh([str(r[0]) for r in rows][::-1], [float(r[1] or 0) for r in rows][::-1])
        axis.set_title(title)
    figure.suptitle(config.target.name)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return path
