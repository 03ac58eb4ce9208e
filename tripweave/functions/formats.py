"""Times of trips and encoded polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGAPORE_MS = 8 * 3_600_000


def departure_seconds(day_ms: Column, time_ms: Column) -> Column:
    """Epoch seconds of a local time of day (UTC+8) on the day that starts at ``day_ms``."""
    return F.floor((day_ms + time_ms - SINGAPORE_MS) / 1000).cast("long")


def decode_polyline(text: str | None) -> list[tuple[float, float]]:
    """(lat, lng) of an encoded polyline: zigzag deltas of 1e-5 degrees in chunks of five bits."""
    if not text:
        return []
    out, at, place = [], 0, [0, 0]
    while at < len(text):
        for k in (0, 1):
            value, shift = 0, 0
            while at < len(text):
                chunk = ord(text[at]) - 63
                at += 1
                value |= (chunk & 31) << shift
                shift += 5
                if chunk < 32:
                    break
            place[k] += ~(value >> 1) if value & 1 else value >> 1
        out.append((place[0] / 1e5, place[1] / 1e5))
    return out


def polyline_points(text: Column) -> Column:
    """array<struct<lat,lng>>; decoding is sequential, so it runs in Arrow batches."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"lat": a, "lng": b} for a, b in decode_polyline(t)])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<lat:double,lng:double>>")(text)
