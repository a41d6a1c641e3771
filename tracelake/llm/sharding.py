"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to hash parts; how many rows each part sends to each shard is drawn exactly from the
multivariate hypergeometric law, given the part's row count and what the shards still lack. Each
part permutes its rows and sends the drawn counts; each shard permutes what it got. The result is a
uniform random permutation cut into shards whose row counts differ by one at most.

Everything is DataFrame functions. Hypergeometric deviates come from the ratio-of-uniforms
rejection of Stadlober (1990), folded with higher-order functions over hashed uniforms, so reruns
and recomputed tasks agree. The matrix has max_parts x shards entries at most, the only broadcast.

Defined cases: nulls are values like any other; rows equal in every column are interchangeable; an
empty table gives an empty result; fewer rows than shards leave some shards empty; long texts only count
as bytes and never move. Where the input has columns of the names added, the added ones end in "_".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_name, own_columns, quoted, shared_checkpoint

SEED = 20_240_607
ROWS_PER_PART = 1 << 16
MIN_PARTS = 8
MAX_PARTS = 1 << 10
ATTEMPTS = 64
#: Fixed values of the ratio-of-uniforms hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
HAT_1 = 2 * math.sqrt(2 / math.e)
HAT_2 = 3 - 2 * math.sqrt(3 / math.e)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def uniform(*keys: Column) -> Column:
    """A double inside (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def log_factorial(k: Column) -> Column:
    """ln(k!) for k >= 0: exact sums below 16, Stirling's series above (error under 1e-12)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 16, F.get(table, k.cast("int"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, sample: Column, *keys: Column) -> Column:
    """How many of ``sample`` rows drawn without replacement from good + bad are good (longs)."""
    low, high, pop = F.least(good, bad), F.greatest(good, bad), good + bad
    drawn = F.least(sample, pop - sample)

    def fit(p: Column) -> Column:
        low, high, m, pop = p["low"], p["high"], p["m"], p["pop"]
        share = low / pop
        mode = F.floor((m + 1) * ((low + 1) / (pop + 2)))
        sd = F.sqrt((pop - m) * m * share * (1 - share) / F.greatest(pop - 1, F.lit(1)) + 0.5)
        top = log_factorial(mode) + log_factorial(low - mode) + log_factorial(m - mode) + log_factorial(high - m + mode)
        return F.struct((m * share + 0.5).alias("mid"), (HAT_1 * sd + HAT_2).alias("width"), top.alias("top"), F.least(F.least(m, low) + 1, F.floor(m * share + 0.5 + 16 * sd)).alias("limit"))

    def draw(p: Column, f: Column) -> Column:
        def attempt(z: Column, t: Column) -> Column:
            x, y = uniform(*keys, t, F.lit(0)), uniform(*keys, t, F.lit(1))

            def judge(w: Column) -> Column:
                k = F.floor(w["w"])
                slack = f["top"] - log_factorial(k) - log_factorial(p["low"] - k) - log_factorial(p["m"] - k) - log_factorial(p["high"] - p["m"] + k)
                return F.when((w["w"] >= 0) & (w["w"] < f["limit"]), F.when(2 * F.ln(w["x"]) <= slack, k)).cast("long")

            proposal = _let(x, lambda x_: F.struct(x_.alias("x"), (f["mid"] + f["width"] * (y - 0.5) / x_).alias("w")))
            return F.when(z >= 0, z).otherwise(F.coalesce(_let(proposal, judge), F.lit(-1).cast("long")))

        z = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(-1).cast("long"), attempt)
        # an acceptance is missed with probability below 1e-20; the mean, rounded, is then within range
        return _let(z, lambda v: F.when(v >= 0, v).otherwise(F.floor(p["m"] * p["low"] / p["pop"])))

    params = F.struct(low.alias("low"), high.alias("high"), drawn.alias("m"), pop.alias("pop"))
    of_low = _let(params, lambda p: _let(fit(p), lambda f: draw(p, f)))
    of_good = _let(of_low, lambda z: F.when(good > bad, drawn - z).otherwise(z))
    full = F.when(drawn < sample, good - of_good).otherwise(of_good)
    return F.when((sample <= 0) | (good <= 0), F.lit(0).cast("long")).when(bad <= 0, sample).when(sample >= pop, good).otherwise(full)


def communication_matrix(parts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(part, sends: array of longs) drawn for ``parts`` (part, n); ``sizes`` are the shards' row counts."""
    wanted = F.array(*[F.lit(s).cast("long") for s in sizes])

    def deal(part: Column, lack: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            k = hypergeometric(F.get(lack, j), s["rest"] - F.get(lack, j), s["left"], F.lit(seed), part["part"], j)
            return _let(k, lambda k_: F.struct((s["left"] - k_).alias("left"), (s["rest"] - F.get(lack, j)).alias("rest"), F.concat(s["sends"], F.array(k_)).alias("sends")))

        rest = F.aggregate(lack, F.lit(0).cast("long"), lambda a, b: a + b)
        start = F.struct(part["n"].alias("left"), rest.alias("rest"), F.array().cast("array<bigint>").alias("sends"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), start, one, lambda s: s["sends"])

    def step(s: Column, part: Column) -> Column:
        return _let(deal(part, s["lack"]), lambda sends: F.struct(F.zip_with(s["lack"], sends, lambda a, b: a - b).alias("lack"), F.concat(s["out"], F.array(F.struct(part["part"].alias("part"), sends.alias("sends")))).alias("out")))

    start = F.struct(wanted.alias("lack"), F.array().cast("array<struct<part:int,sends:array<bigint>>>").alias("out"))
    one_row = parts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    return one_row.select(F.inline(F.aggregate("parts", start, step, lambda s: s["out"])))


def exact_shuffle(df: DataFrame, shards: int, seed: int = SEED, max_parts: int = MAX_PARTS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly at random."""
    shard, slot, part, place, first, last, band, before, sent = (fresh_name(c, df.columns) for c in ("shard", "slot", "part", "place", "first_key", "last_key", "band", "before", "sends"))
    rows = df.count()
    parts = min(max_parts, max(MIN_PARTS, -(-rows // ROWS_PER_PART)))
    columns = own_columns(df)
    keyed = df.withColumns({part: F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(parts)).cast("int"), first: F.xxhash64(F.lit(seed + 1), *columns), last: F.xxhash64(F.lit(seed + 2), *columns)})
    counts = keyed.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes = [rows // shards + (j < rows % shards) for j in range(shards)]
    matrix = shared_checkpoint(communication_matrix(counts, sizes, seed))
    placed = keyed.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(first)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("sends", F.lit(1), j), F.lit(0).cast("long"), lambda a, b: a + b))
    routed = placed.join(F.broadcast(matrix.select(F.col("part").alias(part), ends.alias(sent))), part)  # max_parts rows at most
    routed = routed.withColumn(shard, F.size(F.filter(sent, lambda e: e < F.col(place)))).drop(sent, place, part, first)
    routed = shared_checkpoint(routed.withColumn(band, F.floor(F.shiftrightunsigned(F.col(last), 11).cast("double") / float(1 << 53) * parts).cast("int")))
    bands = routed.groupBy(shard, band).agg(F.count(F.lit(1)).alias(before))
    bands = bands.withColumn(before, F.sum(before).over(Window.partitionBy(shard).orderBy(band)) - F.col(before))
    ranked = routed.withColumn(slot, F.row_number().over(Window.partitionBy(shard, band).orderBy(F.shiftrightunsigned(F.col(last), 11), last)))
    return ranked.join(F.broadcast(bands), [shard, band]).withColumn(slot, F.col(slot) - 1 + F.col(before)).select(*columns, shard, slot)  # shards x max_parts rows at most


def shard_documents(spark: SparkSession, df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard of every row of ``df``."""
    text = F.encode(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), "UTF-8")
    narrow = shared_checkpoint(df.select(F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return exact_shuffle(narrow, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
