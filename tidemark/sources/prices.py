"""Price panels and symbol lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("open", "high", "low", "close", "volume")
EXCHANGES = ("NASDAQ", "NYSE", "AMEX")  # fixed value: exchanges of the universe


def normalise_panel(wide: DataFrame, separator: str = "|", date: str = "date") -> DataFrame:
    """Columns ``ticker|field`` to one row per (ticker, date); rows without any price are dropped."""
    tickers: dict[str, list[str]] = {}
    for name in wide.columns:
        if separator in name:
            ticker, field = name.split(separator, 1)
            tickers.setdefault(ticker, []).append(field.lower())
    fields = [f for f in (*FIELDS, "adj close") if any(f in have for have in tickers.values())]
    source = {c.lower(): c for c in wide.columns}

    def cell(ticker, field):
        name = source.get(f"{ticker}{separator}{field}".lower())
        return (F.col(f"`{name}`") if name else F.lit(None)).cast("double").alias(field.replace(" ", "_"))

    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[cell(t, f) for f in fields]) for t in tickers])
    long = wide.select(F.col(date).alias("date"), F.inline(rows))
    return long.dropna(how="all", subset=[f.replace(" ", "_") for f in fields])


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One data set, split by ticker hash and sorted by (ticker, date)."""
    writer = panel.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, tickers and date range; tickers are counted after a partial grouping."""
    return panel.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    ).agg(
        F.sum("n").alias("total_rows"), F.count("*").alias("unique_tickers"),
        F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
    )


def ticker_universe(symbols: DataFrame) -> DataFrame:
    """Listed on a main exchange, at most five letters and nothing else."""
    return symbols.where(
        F.col("exchange").isin(*EXCHANGES) & F.col("symbol").rlike(r"^\p{IsAlphabetic}{1,5}$")
    )


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    out = batches[0]
    for more in batches[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
