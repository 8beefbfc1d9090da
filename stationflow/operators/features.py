"""Window features over keyed series (W01–W03, W09, F08) in a skew-proof form.

New feature columns are added by one ``select`` over the same rows, which
replaces the positional column concatenation of the reference (J06).

A plain ``Window.partitionBy(station)`` puts a whole station in one task; a
weather network has few stations and one may hold a third of all rows. Here
every ROWS-frame feature is evaluated over *chunks of whole time buckets*:

1. Rows are counted per (station, time bucket), with map-side combine. A prefix
   sum over that small table tells how many rows come before each bucket; the
   bucket's chunk is that number divided by ``chunk_rows``.
2. Only stations of more than one chunk need a table: for each chunk its first
   bucket and the bucket from which ``halo`` rows before it are sure to be. It
   holds at most 2 N / ``chunk_rows`` chunks for N rows, and is broadcast. A row
   finds its chunk by halving, in generated code, so it never copies the table.
3. Every row names its chunk, and the chunks it is halo of, before it moves: one
   exchange by (station, chunk), one sort, one window. Halo rows are dropped.

The result equals the plain per-station window (``tests/test_features.py``
checks both forms), and a task sees one chunk: ``chunk_rows`` rows, the rows of
one bucket and the halo's buckets. ``chunk_rows`` and ``bucket`` never change the
result, and building a plan runs no job. A table whose planned size cannot hold
more than ``chunk_rows`` rows is a single chunk per station and takes the plain
form, as does ``chunk_rows=None``. Rows with a NULL station or time form series
and buckets of their own and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationflow.spec import SeriesSpec

# Rows per window chunk; bounds the largest group any window task sees.
CHUNK_ROWS = 1 << 20
# Time bucket of the chunk table ("day", "hour", "minute"): chunks begin and end
# between buckets, so one task gets at least the rows of one station and bucket.
INDEX_BUCKET = "hour"
# A row is planned with at least so many bytes; below CHUNK_ROWS such rows a
# table is one chunk.
ROW_BYTES = 16
# Halvings of a search: 2 ** 27 chunks of one station are more than Spark broadcasts.
SEARCH_STEPS = 27

# Default lag and rolling parameters (rows).
DEFAULT_LAGS = (1, 3, 6, 12, 24, 48, 168)
DEFAULT_WINDOWS = (24, 168)
DEFAULT_LAG_VARS = ("temperature", "dewpoint", "sea_level_pressure")
DEFAULT_ROLL_VARS = ("temperature", "dewpoint")


# Width of a bucket when the series is ordered by a number instead of a time.
INDEX_NUMERIC_WIDTH = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _bucket_no(df: DataFrame, time: str, bucket: str) -> Column:
    """A number that never falls along the series order; NULL times come first."""
    t, typ = F.col(time), dict(df.dtypes)[time]
    if typ == "date":
        no = F.unix_date(t).cast("long")
    elif typ == "timestamp_ntz":
        no = F.unix_date(t.cast("date")).cast("long")
        for unit, size, part in (("hour", 24, F.hour), ("minute", 60, F.minute)):
            if bucket != "day":
                no = no * size + part(t)
            if bucket == unit:
                break
    elif typ == "timestamp":
        no = F.floor(F.unix_micros(t) / F.lit({"day": 86_400, "hour": 3600, "minute": 60}[bucket] * 1_000_000)).cast("long")
    else:
        no = F.when(F.isnan(t.cast("double")), F.lit(MOST)).otherwise(F.floor(t / F.lit(INDEX_NUMERIC_WIDTH)).cast("long"))
    return F.coalesce(no, F.lit(LEAST))


def chunk_table(df: DataFrame, spec: SeriesSpec, halo: int, chunk_rows: int, bucket: str = INDEX_BUCKET) -> DataFrame:
    """``_s`` and ``_chunks`` for stations of more than one chunk: one list of
    (no, lo, first, start, after): the chunk's number, the
    first bucket of its halo, its own first bucket, how many rows come before it,
    and the chunks after it that have a halo in its buckets."""
    counts = (df.select(F.col(spec.station).alias("_s"), _bucket_no(df, spec.time, bucket).alias("_b"))
              .groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_b"))
    c = counts.select("_s", "_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"))
    size = F.lit(chunk_rows)
    home = F.floor(F.col("_before") / size)
    # every chunk that may begin fewer than `halo` rows after this bucket's last row
    last = F.floor((F.col("_upto") + F.lit(halo - 1)) / size) if halo > 0 else home
    c = c.select("_s", "_b", "_before", home.alias("_home"), F.explode(F.sequence(home, F.greatest(home, last))).alias("no"))
    own = F.col("_home") == F.col("no")
    chunks = c.groupBy("_s", "no").agg(F.min("_b").alias("lo"), F.min(F.when(own, F.col("_b"))).alias("first"),
                                       F.min(F.when(own, F.col("_before"))).alias("start")).where(F.col("first").isNotNull())
    per = chunks.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("no", "lo", "first", "start"))).alias("_all")).where(F.size("_all") > 1)
    each = lambda x: [x[k].alias(k) for k in ("no", "lo", "first", "start")]
    reach = -(-halo // chunk_rows) + 1  # a halo is in no more chunks before

    def after(i):
        later = F.transform(F.slice("_all", i + 2, F.lit(reach)), lambda y: F.struct(*each(y)))
        return F.filter(later, lambda y: y["lo"] < F.get(F.col("_all"), i + 1)["first"])

    whole = F.transform("_all", lambda x, i: F.struct(*each(x), after(i).alias("after")))
    return per.select("_s", F.array(whole).alias("_chunks"))


def _search(df: DataFrame, values: str, x: str, out: str) -> DataFrame:
    """Adds ``out``: how many of the rising array ``values`` are not above ``x``. A
    select per halving stays in generated code (short enough for Java to compile); a
    higher-order function would copy the array for every row."""
    d = df.select("*", F.lit(0).alias(out))
    for step in [1 << k for k in reversed(range(SEARCH_STEPS))]:
        more = F.get(F.col(values), F.col(out) + (step - 1)) <= F.col(x)
        d = d.select(*df.columns, (F.col(out) + F.when(more, step).otherwise(0)).alias(out))
    return d


def dealt(df: DataFrame, spec: SeriesSpec, halo: int, chunk_rows: int, bucket: str = INDEX_BUCKET) -> DataFrame:
    """The rows with ``_k`` (station and chunk), ``_h`` (whether the row is halo
    there) and ``_start`` (rows of the station before the chunk); a row is there
    once for its chunk and once for each chunk it is halo of."""
    table = chunk_table(df, spec, halo, chunk_rows, bucket).select("_s", F.col("_chunks")[0].alias("_all"))
    table = table.select("*", F.transform("_all", lambda x: x["first"]).alias("_firsts"))
    b = _bucket_no(df, spec.time, bucket)
    d = df.withColumn("_b", b).join(F.broadcast(table), F.col(spec.station).eqNullSafe(F.col("_s")), "left")
    d = _search(d.select(*df.columns, "_b", "_all", "_firsts"), "_firsts", "_b", "_i")
    home = F.get(F.col("_all"), F.col("_i") - 1)
    kinds = ("no", "lo", "first", "start")
    zero = F.lit(0).cast("long")
    only = F.array(F.struct(zero.alias("no"), F.col("_b").alias("lo"), F.col("_b").alias("first"), zero.alias("start")))
    found = F.concat(F.array(F.struct(*[home[k].alias(k) for k in kinds])), home["after"])
    d = d.select(*df.columns, "_b", F.explode(F.when(F.col("_all").isNull(), only).otherwise(found)).alias("_c")).where(F.col("_c.lo") <= F.col("_b"))
    return d.select(*df.columns, F.struct(F.col(spec.station).alias("s"), F.col("_c.no").alias("no")).alias("_k"),
                    (F.col("_b") < F.col("_c.first")).alias("_h"), F.col("_c.start").alias("_start"))


def chunk_window(spec: SeriesSpec) -> WindowSpec:
    return Window.partitionBy("_k").orderBy(*spec.order_cols())


def one_chunk(df: DataFrame, chunk_rows: int | None) -> bool:
    """Whether the plain form is asked for, or the planned size of ``df`` is below
    that of ``chunk_rows`` rows (Spark's own estimate; no job runs)."""
    if chunk_rows is None:
        return True
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= chunk_rows * ROW_BYTES


def windowed(df: DataFrame, spec: SeriesSpec, build: Callable[[WindowSpec], list[Column]],
             halo: int, chunk_rows: int | None = CHUNK_ROWS, keep_index: bool = False,
             bucket: str = INDEX_BUCKET) -> DataFrame:
    """Evaluates ``build(w)`` (window Columns whose ROWS frames reach at most
    ``halo`` rows back and none forward) per series, chunked. ``keep_index`` adds
    ``_rix``, the 0-based position of the row in its series."""
    if one_chunk(df, chunk_rows):
        # one exchange, one sort, one Window node for all columns
        w = spec.window()
        return df.select("*", *build(w), *([(F.row_number().over(w) - 1).cast("long").alias("_rix")] if keep_index else []))
    d = dealt(df, spec, halo, chunk_rows, bucket)
    w = chunk_window(spec)
    own = F.sum(F.when(F.col("_h"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    index = [(F.col("_start") + own - 1).alias("_rix")] if keep_index else []
    return d.select("*", *build(w), *index).where(~F.col("_h")).drop("_k", "_h", "_start")


def row_index(df: DataFrame, spec: SeriesSpec, bucket: str = INDEX_BUCKET, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Adds ``_rix``: 0-based position of the row in its series order; rows with a
    NULL station or time are numbered too."""
    return windowed(df, spec, lambda w: [], 0, chunk_rows, True, bucket)


def lag_columns(w: WindowSpec, cols, lags) -> list[Column]:
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}h") for c in cols for k in lags]


def lags(df: DataFrame, spec: SeriesSpec, cols=DEFAULT_LAG_VARS, lags=DEFAULT_LAGS,
         chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``{c}_lag_{k}h`` = value k rows earlier in the same station."""
    return windowed(df, spec, lambda w: lag_columns(w, cols, lags), max(lags), chunk_rows)


# Rolling statistic name → aggregate.
ROLL_STATS = {"ma": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling_columns(w: WindowSpec, cols, windows, stats=("ma", "std", "min", "max"),
                    min_periods: int = 1, leak_free: bool = False) -> list[Column]:
    out = []
    for c in cols:
        for k in windows:
            fw = w.rowsBetween(-k, -1) if leak_free else w.rowsBetween(-(k - 1), 0)
            for s in stats:
                e = ROLL_STATS[s](c).over(fw)
                if min_periods > 1:
                    e = F.when(F.count(c).over(fw) >= min_periods, e)
                out.append(e.alias(f"{c}_{s}_{k}h"))
    return out


def rolling(df: DataFrame, spec: SeriesSpec, cols=DEFAULT_ROLL_VARS, windows=DEFAULT_WINDOWS,
            stats=("ma", "std", "min", "max"), min_periods: int = 1, leak_free: bool = False,
            chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Rolling mean/sample std/min/max over the last k rows (incl. current
    unless ``leak_free``), NULLs ignored, ``min_periods`` non-NULL values required."""
    halo = max(windows) if leak_free else max(windows) - 1
    return windowed(df, spec, lambda w: rolling_columns(w, cols, windows, stats, min_periods, leak_free),
                    halo, chunk_rows)


def rolling_range(df: DataFrame, spec: SeriesSpec, cols, hours, stats=("ma",), span: int = 8) -> DataFrame:
    """W02 by time instead of rows: frame = the last k hours (RANGE on microseconds).

    A station's time is cut into spans of ``span`` times the longest frame; a row
    also goes to the next span if a frame there reaches back to it. A task holds
    one span of one station; ``span`` never changes the result. Rows without a
    time are peers of each other only."""
    micros = F.unix_micros(F.col(spec.time).cast("timestamp"))
    reach = max(hours) * 3_600_000_000 - 1
    width = F.lit((reach + 1) * span)
    cell = F.floor(F.col("_epoch") / width)
    next_ = (cell + 1) * width - F.col("_epoch") <= reach
    d = df.withColumn("_epoch", micros).withColumn("_home", cell)
    d = d.withColumn("_cell", F.explode(F.when(next_, F.array(cell, cell + 1)).otherwise(F.array(cell))))
    w = Window.partitionBy(spec.station, "_cell").orderBy("_epoch")
    out = [ROLL_STATS[s](c).over(w.rangeBetween(-k * 3_600_000_000 + 1, 0)).alias(f"{c}_{s}_{k}h_range")
           for c in cols for k in hours for s in stats]
    return d.select("*", *out).where(F.col("_home").eqNullSafe(F.col("_cell"))).drop("_epoch", "_home", "_cell")


def time_series_features(df: DataFrame, spec: SeriesSpec, lag_vars, lag_list, roll_vars, windows,
                         chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """W01 + W02 in one select: one exchange and one sort feed every window column."""
    halo = max(max(lag_list), max(windows) - 1)
    return windowed(df, spec, lambda w: lag_columns(w, lag_vars, lag_list)
                    + rolling_columns(w, roll_vars, windows), halo, chunk_rows)


def run_length(df: DataFrame, spec: SeriesSpec, predicate: Column, min_run: int,
               chunk_rows: int | None = CHUNK_ROWS, out: str = "run_position") -> DataFrame:
    """Position of each row inside its run of consecutive rows meeting
    ``predicate`` (NULL outside runs) and ``{out}_flag`` = position ≥ ``min_run``.

    Gaps-and-islands without a whole-series window: inside a chunk, the position
    counts from the last row that breaks the run; a run that is open at the
    chunk's start goes on from the last break before, a prefix max over the
    small table of chunks.
    """
    if one_chunk(df, chunk_rows):
        # position, run starts and the running max of the last start, all over
        # one station window (one exchange, one sort)
        w = spec.window()
        p = F.coalesce(predicate, F.lit(False))
        d = df.select("*", p.alias("_p"), F.row_number().over(w).alias("_rix"))
        d = d.select("*", (F.col("_p") & ~F.coalesce(F.lag("_p").over(w), F.lit(False))).alias("_start"))
        last = F.max(F.when(F.col("_start"), F.col("_rix"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        d = d.select("*", F.when(F.col("_p"), F.col("_rix") - last + 1).cast("long").alias(out))
        return (d.select("*", F.coalesce(F.col(out) >= min_run, F.lit(False)).alias(f"{out}_flag"))
                .drop("_p", "_start", "_rix"))
    d = dealt(df.withColumn("_p", F.coalesce(predicate, F.lit(False))), spec, 0, chunk_rows)
    w = chunk_window(spec)
    d = d.select("*", F.row_number().over(w).alias("_rn"))
    broken = F.max(F.when(~F.col("_p"), F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.select("*", broken.alias("_last"))
    # position in the station of each chunk's last break, and of the last one before the chunk
    per = d.groupBy("_k").agg((F.first("_start") + F.max("_last")).alias("_at"))
    before = Window.partitionBy("_s").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("_k").alias("_key"), F.col("_k.s").alias("_s"), F.col("_k.no").alias("_no"), "_at")
    per = per.select("_key", F.coalesce(F.max("_at").over(before), F.lit(0)).alias("_open"))
    d = d.join(per, F.col("_k") == F.col("_key"))  # structs: NULL stations are equal
    pos = F.col("_rn") - F.coalesce(F.col("_last"), F.col("_open") - F.col("_start"))
    res = d.select(*df.columns, F.when(F.col("_p"), pos).cast("long").alias(out))
    return res.select("*", F.coalesce(F.col(out) >= min_run, F.lit(False)).alias(f"{out}_flag"))


# Name patterns of the feature catalogue groups.
CATALOG_PATTERNS = {"temporal": r"(_sin|_cos)$", "lag": r"_lag_", "rolling": r"_(ma|std|min|max)_\d+h$",
                    "interaction": r"(_diff|_product|_ratio|_interaction|_approx)$",
                    "station": r"^station_(?!id$)"}


def feature_catalog(df: DataFrame) -> DataFrame:
    """count of columns per name group, totals, rows and completeness %.

    Column names are plan metadata; the only data pass is one null-count
    aggregate over all columns.
    """
    import re

    names = df.columns
    counts = {g: sum(1 for c in names if re.search(p, c)) for g, p in CATALOG_PATTERNS.items()}
    nulls = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   sum((F.count_if(F.col(c).isNull()) for c in names), F.lit(0)).alias("n_nulls"))
    meta = [F.lit(v).alias(f"n_{g}") for g, v in counts.items()] + [F.lit(len(names)).alias("n_columns")]
    return nulls.select(*meta, "n_rows", "n_nulls",
                        (F.lit(100.0) * (F.lit(1.0) - F.col("n_nulls") / (F.col("n_rows") * F.lit(len(names)))))
                        .alias("completeness_pct"))
