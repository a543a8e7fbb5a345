"""Column functions: parsing, identifiers, classification, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.schemas import RUNGS

MIN_THRESHOLD = 0.01
EARTH_KM = 6371.0

# Band codes by severity, labels of bands
BANDS = ["2", "5", "10", "25", "50", "100"]
BAND_LABELS = {"unknown": "Unknown", "below_2": "Normal", "2": "2-year", "5": "5-year", "10": "10-year", "25": "25-year", "50": "50-year", "100": "100-year"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_double(c: Column | str) -> Column:
    """A number or numeric text as double; blank or unreadable text and NaN are null, infinity stays."""
    x = F.trim(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_utc(c: Column | str) -> Column:
    """Timestamp of ISO text or a timestamp in the session's zone (UTC); offsets are converted; unreadable: null."""
    return F.try_to_timestamp(_col(c).cast("string"))


def normalize_reach_id(c: Column | str, floating: bool = False) -> Column:
    """Trimmed text, null if blank; ``123.0`` becomes ``123``. floating: the column is a double."""
    text = _col(c).cast("bigint").cast("string") if floating else _col(c).cast("string")
    return F.nullif(F.regexp_replace(F.trim(text), r"^([0-9]+)\.0+$", "$1"), F.lit(""))


def valid_threshold(c: Column | str, least: float = MIN_THRESHOLD) -> Column:
    c = _col(c)
    return F.when(finite(c) & (c >= least), c)


def classify(peak: Column | str, ladder: Sequence[Column | str] = RUNGS) -> Column:
    """struct(return_period_band, severity_score, is_flagged) of a peak on six rungs.

    Without a peak or a valid first rung it is unknown; from there the first rung that is missing, invalid or
    above the peak stops the climb.
    """
    peak = _col(peak)
    rungs = [valid_threshold(r) for r in ladder]

    def band(name: str, score: int) -> Column:
        return F.struct(F.lit(name).alias("return_period_band"), F.lit(score).alias("severity_score"), F.lit(score > 0).alias("is_flagged"))

    out = F.when(peak.isNull() | rungs[0].isNull(), band("unknown", 0)).when(peak < rungs[0], band("below_2", 0))
    for i, rung in enumerate(rungs[1:]):
        out = out.when(rung.isNull() | (peak < rung), band(BANDS[i], i + 1))
    return out.otherwise(band(BANDS[-1], len(BANDS)))


def reach_id_fallback(props: Column | str, as_text: bool = False) -> Column:
    """First non-blank identifier of a JSON text, as a truncated number in text; null if it isn't one.

    as_text: keep the first non-blank one as it is.
    """
    props = _col(props)
    names = ["reach_id", "provider_reach_id", "LINKNO", "COMID", "HYRIV_ID"]
    raw = F.coalesce(*(F.nullif(F.trim(F.get_json_object(props, f"$.{n}")), F.lit("")) for n in names))
    if as_text:
        return raw
    number = raw.try_cast("double")
    return F.when(finite(number), number.cast("bigint").cast("string"))


def valid_time(base: Column | str, hours: Column | str) -> Column:
    return _col(base) + F.make_dt_interval(F.lit(0), _col(hours).cast("int"))


def first_not_null(*columns: Column | str) -> Column:
    """The first of ``columns`` that isn't null."""
    return F.coalesce(*map(_col, columns))


def interp_linear(x: Column | str, stops: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear, clamped at both ends."""
    x = _col(x).cast("double")
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x.isNotNull(), F.lit(float(stops[-1][1])))


def distance_rad(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean in (lat, lon) radians, without a cosine and without a wrap at the date line."""
    a, b = F.radians(_col(lat1)) - F.radians(_col(lat2)), F.radians(_col(lon1)) - F.radians(_col(lon2))
    return F.sqrt(a * a + b * b)


def area_ratio(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def match_score(km: Column, ratio: Column, weight: float) -> Column:
    return km + F.abs(F.ln(ratio)) * weight


def run_id_to_time(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMddHH"))


def time_to_run_id(c: Column | str, daily: bool = False) -> Column:
    """``yyyyMMddHH``; daily: the day's 00 run."""
    return F.date_format(_col(c), "yyyyMMdd'00'" if daily else "yyyyMMddHH")


def flood_tile_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` as it is, ``YYYYMMDD`` with dashes, else null."""
    c = F.trim(_col(c))
    dashed = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(c.rlike(r"^\d{8}$"), dashed)


def band_label(c: Column | str) -> Column:
    """Reader's name of a band; unknown codes stay."""
    c = _col(c)
    names = F.create_map(*(F.lit(x) for kv in BAND_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, c), c)


def bbox_key(west, south, east, north, step: float = 2.0) -> Column:
    """A box snapped to a grid (halves up), as text."""
    snap = lambda c: (F.floor(_col(c) / step + 0.5) * step).cast("bigint").cast("string")
    return F.concat_ws(",", *(snap(c) for c in (west, south, east, north)))


def payload_json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*(_col(c).alias(name) for name, c in fields.items())))
