"""Failure cut-off while results arrive, in any order within the watermark.

Results are collected in small windows of time. When a window is closed, what
it does to a group's streak is summed up in one row: its first failures, its
trailing ones, and the first abort inside it. A stateful step per group composes
these rows in time order; its state is the number of trailing failures.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.functions.fixed_values import FAILURE_LIMIT


def window_summaries(stream: DataFrame, group: list[str], time: str, micros: str, row_id: str, limit: int, width: str, late: str) -> DataFrame:
    """One row per closed window and group, of the results that have an id."""
    row = F.struct(F.col(micros).cast("bigint").alias("micros"), F.col(row_id).cast("bigint").alias("id"), "success")
    closed = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows = F.filter("rows", lambda r: r["id"].isNotNull())
    read = closed.withColumn("rows", rows).filter(F.size("rows") > 0)
    size = F.size("rows")
    first_ok = F.array_position(F.transform("rows", lambda r: r["success"]), True)
    last_ok = F.array_position(F.reverse(F.transform("rows", lambda r: r["success"])), True)
    at = F.struct(F.col("rows")[0]["micros"].alias("micros"), F.col("rows")[0]["id"].alias("id"))
    start = F.struct(F.lit(0).alias("run"), F.when(F.lit(False), at).alias("abort"))

    def step(acc, r):
        run = F.when(r["success"], 0).otherwise(acc["run"] + 1)
        found = F.when(acc["abort"].isNull() & (run == limit), F.struct(r["micros"].alias("micros"), r["id"].alias("id"))).otherwise(acc["abort"])
        return F.struct(run.alias("run"), found.alias("abort"))

    abort = F.aggregate("rows", start, step).getField("abort")
    leading = F.when(first_ok > 0, first_ok - 1).otherwise(size).cast("int")
    return read.select(
        *group,
        F.unix_micros("w.start").alias("start"),
        (first_ok == 0).alias("failed"),
        F.transform(F.slice("rows", F.lit(1), F.least(leading, F.lit(limit))), lambda r: r["micros"]).alias("lead_micros"),
        F.transform(F.slice("rows", F.lit(1), F.least(leading, F.lit(limit))), lambda r: r["id"]).alias("lead_ids"),
        F.when(first_ok == 0, size).otherwise(last_ok - 1).cast("bigint").alias("trailing"),
        abort["micros"].alias("abort_micros"),
        abort["id"].alias("abort_id"),
    )


def streamed_aborts(
    stream: DataFrame,
    group: list[str],
    time: str,
    micros: str,
    row_id: str,
    limit: int = FAILURE_LIMIT,
    width: str = "1 minute",
    late: str = "10 minutes",
) -> DataFrame:
    """(group, micros, id) of the first ``limit``-th failure in a row of each group."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    keys = ", ".join(f"`{g}` {fields[g]}" for g in group)
    summaries = window_summaries(stream, group, time, micros, row_id, limit, width, late)
    # Null in windows without an abort, so they travel as text, which keeps all digits.
    texts = summaries.withColumns({c: F.col(c).cast("string") for c in ("abort_micros", "abort_id")})
    return texts.groupBy(*group).transformWithStateInPandas(
        Streaks([*group, micros, row_id], limit), f"{keys}, `{micros}` bigint, `{row_id}` bigint", "append", "none"
    )


class Streaks(StatefulProcessor):
    """Composes a group's windows; those of a trigger come together, and no earlier one can follow."""

    def __init__(self, columns: list[str], limit: int):
        self.columns, self.limit = columns, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "trailing bigint, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trailing, done = self.state.get() if self.state.exists() else (0, False)
        found = None
        for w in pd.concat(list(rows)).sort_values("start").to_dict("records"):
            if done:
                break
            if trailing + len(w["lead_ids"]) >= self.limit:
                place = self.limit - trailing - 1
                found = (w["lead_micros"][place], w["lead_ids"][place])
            elif pd.notna(w["abort_id"]):
                found = (w["abort_micros"], w["abort_id"])
            done = found is not None
            trailing = min(self.limit - 1, trailing + w["trailing"] if w["failed"] else w["trailing"])
        self.state.update((int(trailing), bool(done)))
        if found is not None:
            yield pd.DataFrame([[*key, int(found[0]), int(found[1])]], columns=self.columns)

    def close(self) -> None:
        pass
