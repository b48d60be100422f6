"""A limit of requests for each key, in windows that begin with a key's first request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_MS = 60_000
MOST = 100


def limited(requests: DataFrame, key: str, ts: str, order: str, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """(key, order, in_window, blocked) of each request; a request after a window's end begins a new one.

    Each window begins where the last one ended, so a key's requests are read in order by one task, as a stream:
    what it holds is one count and one end.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms")
    rows = requests.select(key, order, ms, F.col(ts).alias("_ts"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, reset, count = [], 0, 0
        for batch in batches:
            counts = []
            for k, t in zip(batch[key], batch["_ms"]):
                if held != [k]:
                    held, reset, count = [k], None, 0
                if reset is None or t > reset:
                    reset, count = t + window_ms, 0
                count += 1
                counts.append(count)
            out = batch[[key, order]].assign(in_window=counts)
            yield out.assign(blocked=out["in_window"] > most)

    return rows.repartition(key).sortWithinPartitions(key, "_ts", order).mapInPandas(run, f"{kinds}, in_window int, blocked boolean")


def limited_stream(requests: DataFrame, key: str, ts: str, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """The same over a stream, with each key's count and reset time as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = requests.schema[key].dataType.simpleString()

    def each(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, reset = state.get if state.exists else (0, None)
        out = []
        for t in sorted(x for b in batches for x in b["ms"]):
            count, reset = (1, t + window_ms) if reset is None or t > reset else (count + 1, reset)
            out.append((group[0], t, count, count > most))
        state.update((count, reset))
        yield pd.DataFrame(out, columns=[key, "ms", "in_window", "blocked"])

    keyed = requests.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).groupBy(key)
    return keyed.applyInPandasWithState(each, f"{key} {kind}, ms long, in_window int, blocked boolean", "count int, reset long", "append", GroupStateTimeout.NoTimeout)
