"""Scoring requests as a table (P25-P27): JSON decode, defaults, validation, feature rows.

The single-request HTTP handler becomes a batch job: a table of JSON bodies
in, a table of responses (or rejections with the validation message) out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C
from wattspark.functions import calendar as cal
from wattspark.functions import encoding as enc

WHOLE_NUMBER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
INVALID_JSON = "Invalid JSON in request body"


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator, which the optimiser neither repeats nor moves filters through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _whole(kind: Column, text: Column, default: int) -> Column:
    """A whole number as ``int()`` reads it: fractions are cut off, digits in a string count, true is 1; else null."""
    number = F.when(kind == "STRING", F.when(text.rlike(WHOLE_NUMBER), F.regexp_replace(F.trim(F.regexp_replace(text, r"\s", "")), "_", ""))) \
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit("1")).otherwise(F.lit("0"))) \
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text)
    # values beyond the range of int stay invalid, whatever their size
    read = F.greatest(F.lit(-1.0), F.least(F.lit(1e6), number.try_cast("double"))).cast("int")
    read = F.when(number.try_cast("double") <= -1, F.lit(-1)).otherwise(read)
    return F.when(kind.isNull(), F.lit(default)).otherwise(F.when(number.isNotNull(), read))


def _truth(kind: Column, text: Column, default: bool) -> Column:
    """As ``bool()``: null, false, zero and what is empty are false, everything else (any other string too) is true."""
    false = F.when(kind == "VOID", F.lit(True)).when(kind == "BOOLEAN", text == "false").when(kind == "STRING", text == "") \
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double") == 0).otherwise(text.isin("[]", "{}"))
    return F.when(kind.isNull(), F.lit(default)).otherwise(~false)


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Decode each JSON body; a missing key takes its default, a present one is read or marked.

    Numbers and truth values are coerced as the original's ``int()`` and
    ``bool()`` do; ``day_type`` is lower-cased, ``season`` and ``household_id``
    are kept as sent (case-sensitive). ``malformed`` marks a body that is no
    JSON object; ``unreadable`` names the first field that is present but not
    readable as its type (a null, text in a number, a number in a name); its
    column is null. The body is decoded once.
    """
    d = C.REQUEST_DEFAULTS
    names = list(d)
    read = _once(df, _v=F.try_parse_json(F.col(body)))
    read = _once(read, **{f"_f{i}": F.try_variant_get("_v", f"$.{n}", "variant") for i, n in enumerate(names)})
    read = _once(read, **{f"_k{i}": F.schema_of_variant(f"_f{i}") for i in range(len(names))},
                 **{f"_t{i}": F.try_variant_get(f"_f{i}", "$", "string") for i in range(len(names))}, _kind=F.schema_of_variant("_v"))
    kind = {n: F.col(f"_k{i}") for i, n in enumerate(names)}
    text = {n: F.col(f"_t{i}") for i, n in enumerate(names)}

    def name(n: str) -> Column:
        return F.when(kind[n].isNull(), F.lit(d[n])).otherwise(F.when(kind[n] == "STRING", text[n]))

    out = _once(read, hour=_whole(kind["hour"], text["hour"], d["hour"]), day_type=F.lower(name("day_type")), season=name("season"),
                load_shedding_stage=_whole(kind["load_shedding_stage"], text["load_shedding_stage"], d["load_shedding_stage"]),
                has_backup_power=_truth(kind["has_backup_power"], text["has_backup_power"], d["has_backup_power"]),
                household_id=name("household_id"),
                malformed=~F.coalesce(F.col("_kind").startswith("OBJECT"), F.lit(False)))
    unreadable = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("hour", "day_type", "load_shedding_stage")])
    out = out.withColumn("unreadable", F.when(~F.col("malformed"), unreadable))
    return out.drop("_v", "_kind", *[f"_{x}{i}" for x in "fkt" for i in range(len(names))])


def validation_error(hour="hour", day_type="day_type", season="season", stage="load_shedding_stage",
                     household="household_id"):
    """The first failing rule's message, or null for a valid request; a name that is missing fails its rule."""
    m = C.VALIDATION_MESSAGES

    def fails(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))
    return (F.when(fails(F.col(hour).between(0, 23)), F.lit(m[0]))
            .when(fails(F.col(day_type).isin(*C.DAY_TYPES)), F.lit(m[1]))
            .when(fails(F.col(season).isin(*C.SEASON_MID_MONTH.keys())), F.lit(m[2]))
            .when(fails(F.col(stage).between(0, C.MAX_STAGE)), F.lit(m[3]))
            .when(fails(F.col(household).isin(*C.HOUSEHOLDS)), F.lit(m[4])))


def validate_requests(parsed: DataFrame) -> DataFrame:
    """Add ``error`` (null when valid) and ``is_valid``; malformed JSON goes first, then unreadable fields, then the rules."""
    err = F.when(F.col("malformed"), F.lit(INVALID_JSON)) \
        .when(F.col("unreadable").isNotNull(), F.concat(F.col("unreadable"), F.lit(" cannot be read"))) \
        .otherwise(validation_error())
    return _once(parsed, error=err).withColumn("is_valid", F.col("error").isNull())


def request_features(valid: DataFrame) -> DataFrame:
    """The 21 model features of a request: weekday -> Monday (0), weekend -> Saturday (5),
    month from the season, no post-outage flag."""
    weekend = F.col("day_type") != "weekday"
    stage = F.col("load_shedding_stage")
    df = valid.withColumns({
        "day_of_week": F.when(weekend, F.lit(5)).otherwise(F.lit(0)),
        "is_weekend": weekend.cast("int"),
        "month": cal.month_of_season("season"),
    })
    hs, hc = enc.cyclical("hour", 24)
    ds, dc = enc.cyclical("day_of_week", 7)
    df = df.withColumns({
        "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc,
        "is_load_shedding": (stage > 0).cast("int"),
        "post_load_shedding": F.lit(0),
        "load_shedding_stage_normalized": stage / F.lit(float(C.MAX_STAGE)),
    })
    return df.select("*", *enc.one_hot("season", C.SEASONS, "season"),
                     *enc.household_one_hot_default("household_id"))
