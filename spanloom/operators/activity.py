"""Sessions from activity: runs of one key's events without a pause longer than the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import micros


def _cell(gap_us: int) -> Column:
    return F.expr(f"_t div {gap_us} - if(_t < 0 and _t % {gap_us} <> 0, 1, 0)")


def _sweep(events: DataFrame, gap_us: int) -> DataFrame:
    """The sorted deltas of ``(_k, _t)`` with the number of the session each belongs to."""
    events = events.where(F.col("_t").isNotNull())
    cells = events.groupBy("_k", _cell(gap_us).alias("_cell")).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    deltas = cells.select(
        "_k",
        "_cell",
        F.explode(
            F.array(
                F.struct(F.col("_lo").alias("at"), F.lit(1).alias("d"), F.col("_n").alias("n")),
                F.struct((F.col("_hi") + gap_us).alias("at"), F.lit(-1).alias("d"), F.lit(0).cast("long").alias("n")),
            )
        ).alias("_e"),
    ).select("_k", "_cell", "_e.at", "_e.d", "_e.n")
    # at one instant openings go before closings: a distance of exactly the gap stays inside
    line = Window.partitionBy("_k").orderBy(F.col("at"), F.col("d").desc())
    swept = deltas.withColumn("_open", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return swept.withColumn(
        "_no",
        F.sum(F.when((F.col("_open") == 0) & (F.col("d") < 0), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
        + F.when((F.col("_open") == 0) & (F.col("d") < 0), 0).otherwise(1),
    )


def sessions_by_gap(df: DataFrame, key: str, ts: str, gap_us: int = 1_800_000_000) -> DataFrame:
    """Sweep-line sessions: ``(key, session_no, start_us, end_us, duration_us, n_events)``.

    Every event opens an interval at its time (+1) that closes ``gap_us`` later (-1); where the
    running sum of these deltas returns to zero a session ends. An event exactly ``gap_us`` after
    the one before still belongs to its session.

    Events are first folded into cells of one gap's width: two events of one cell are never
    further apart than the gap, so a cell is one interval from its first to its last event. That
    fold combines map-side and leaves per key at most (time span / gap) cells however many rows
    the key has, which bounds the later sort of a hot key.

    Rows without timestamp are left out. Rows with a null key form the sessions of the null key.
    Repeated rows count as events. An empty table yields no session. Other columns are ignored.
    """
    closed = _sweep(df.select(F.col(key).alias("_k"), micros(F.col(ts)).alias("_t")), gap_us)
    return (
        closed.groupBy("_k", "_no")
        .agg(F.min("at").alias("start_us"), (F.max("at") - gap_us).alias("end_us"), F.sum("n").alias("n_events"))
        .select(
            F.col("_k").alias(key),
            F.col("_no").cast("long").alias("session_no"),
            "start_us",
            "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "n_events",
        )
    )


def label_sessions(df: DataFrame, key: str, ts: str, gap_us: int = 1_800_000_000) -> DataFrame:
    """``df`` with ``session_no`` per row: the number of its session within its key, null without time.

    All rows of a cell (one gap's width of time) share a session, so rows are labelled by an
    equi-join on key and cell; no task sorts the rows of a key.
    """
    rows = df.withColumn("_t", micros(F.col(ts)))
    cells = _sweep(rows.select(F.col(key).alias("_k"), "_t"), gap_us).where(F.col("d") > 0).select(F.col("_k").alias("_ck"), F.col("_cell").alias("_cc"), F.col("_no").cast("long").alias("session_no"))
    rows = rows.withColumn("_rc", _cell(gap_us))
    return rows.join(cells, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_rc") == F.col("_cc")), "left").drop("_t", "_rc", "_ck", "_cc")
