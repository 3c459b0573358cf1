"""Catalogs, samples, splits and shuffles. Order comes from md5 of a seed and an id, so any engine can replay it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *ids: Column) -> Column:
    """A pseudo-random key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)).cast("binary"))


def last_of(df: DataFrame, key: str, position: str | None) -> DataFrame:
    """A row for each key: of several the last by position, and an error where no position tells."""
    if position is None:
        if twice := [r[key] for r in df.groupBy(key).count().where("count > 1").limit(5).collect()]:
            raise ValueError(f"more than one row of {twice}, and no position")
        return df
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), position).alias("__row"))
    return rows.select("__row.*").drop(position)


def merged_catalog(settings: DataFrame, catalog: DataFrame, key: str = "source_id", position: str | None = None) -> DataFrame:
    """Settings over the catalog's rows of the same id, of several rows of one id the last by position; an id that
    the catalog lacks is an error."""
    settings, catalog = (last_of(x, key, position if position in x.columns else None) for x in (settings, catalog))
    if missing := [r[key] for r in settings.join(catalog, key, "left_anti").limit(5).collect()]:
        raise KeyError(f"not in the catalog: {missing}")
    both = settings.alias("s").join(catalog.alias("c"), key)
    names = [*settings.columns, *(c for c in catalog.columns if c not in settings.columns)]
    value = lambda n: F.coalesce(f"s.{n}", f"c.{n}") if n in settings.columns and n in catalog.columns else F.col(n)
    return both.select(*((F.col(n) if n == key else value(n)).alias(n) for n in names))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of sources in the names' order, each with its source; duplicates stay."""
    parts = [sources[k].withColumn("source", F.lit(k)) for k in sorted(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _before(df: DataFrame, value: str, key: str, parts: int) -> DataFrame:
    """df with __before: the sum of value over rows whose key comes first. Rows are dealt by the key's first
    hexadecimal digits, summed by part, and ordered within parts only."""
    digits = next(d for d in range(1, 9) if 16**d >= parts)
    df = df.withColumn("__part", F.substring(key, 1, digits))
    sums = df.groupBy("__part").agg(F.sum(value).alias("__sum"))
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row a part
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__inside", inside).join(starts, "__part").withColumn("__before", F.col("__start") + F.col("__inside")).drop("__part", "__inside", "__start")


def byte_budget(df: DataFrame, text: str, ids: list[str], target: int, seed: int = 42, min_chars: int = 0, max_chars: int | None = None, separator_bytes: int = 1, parts: int = 4096) -> DataFrame:
    """Records in random order until their bytes reach target, the one that crosses it included: those of
    min_chars at least, cut to max_chars, a separator before each but the first."""
    long = df.where(F.char_length(text) >= min_chars)
    cut = F.left(F.col(text), F.lit(max_chars)) if max_chars else F.col(text)
    long = long.withColumn(text, cut).withColumn("bytes", F.octet_length(text).cast("long"))
    key = F.concat(draw(seed, *map(F.col, ids)), F.lit(":"), F.concat_ws(":", *ids))
    ranked = _before(long.withColumn("__key", key).withColumn("__size", F.col("bytes") + separator_bytes), "__size", "__key", parts)
    # of the sum before a record, one separator is none before the first record
    return ranked.where((F.col("__before") == 0) | (F.col("__before") - separator_bytes < target)).drop("__key", "__size", "__before")


def exact_split(df: DataFrame, ids: list[str], n_validation: int, seed: int = 42, parts: int = 4096) -> DataFrame:
    """df with split: exactly n_validation rows are `val`, the first in random order."""
    key = F.concat(draw(seed, *map(F.col, ids)), F.lit(":"), F.concat_ws(":", *ids))
    ranked = _before(df.withColumn("__key", key).withColumn("__one", F.lit(1)), "__one", "__key", parts)
    return ranked.withColumn("split", F.when(F.col("__before") < n_validation, "val").otherwise("train")).drop("__key", "__one", "__before")


def ranked(df: DataFrame, key: str, name: str, parts: int = 4096) -> DataFrame:
    """df with each row's place (from 0) by a key whose first characters are hexadecimal digits."""
    return _before(df.withColumn("__one", F.lit(1)), "__one", key, parts).withColumnRenamed("__before", name).drop("__one")


def split_sizes(n: int, train_ratio: float) -> tuple[int, int]:
    """Sizes of train and validation, neither empty."""
    if n < 2:
        raise ValueError("a split needs two records")
    train = min(max(int(n * train_ratio + 0.5), 1), n - 1)
    return train, n - train


def validation_size(n: int, configured: int) -> int:
    return min(configured, max(1, n // 20))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """df, if it has a row."""
    if df.isEmpty():
        raise ValueError(f"no {what} is left")
    return df


def evaluation_prefix(df: DataFrame, order: list[str], batches: int, batch: int) -> DataFrame:
    """The rows that an evaluation of so many batches looks at: the first in order (the feature is the limit)."""
    return df.orderBy(*order).limit(batches * batch)


def block_shuffled(df: DataFrame, index: str, block: int, seed: int = 42) -> DataFrame:
    """df with block_key and row_key: ordering by both shuffles blocks, then rows within blocks."""
    number = F.floor(F.col(index) / block).cast("long")
    return df.withColumn("block_key", draw(f"{seed}:block", number)).withColumn("row_key", draw(f"{seed}:row", F.col(index)))


def locate(indices: DataFrame, sizes: DataFrame) -> DataFrame:
    """Global row indices (column index) as source and local index; sizes: source, ordinal, n, a row a source."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select("source", before.alias("start"), (before + F.col("n")).alias("end"))
    if sizes.count() <= 100_000:
        ranges = F.broadcast(ranges)
    return indices.join(ranges, (F.col("index") >= F.col("start")) & (F.col("index") < F.col("end"))).select("index", "source", (F.col("index") - F.col("start")).alias("local_index"))


def with_following(df: DataFrame, value: str, order: list[str], name: str, width: int = 10_000) -> DataFrame:
    """df with the value of the next row in order under name. Rows are looked at in ranges of the first (whole
    number) column of the order; a range's last row takes the first of the next range that has rows."""
    df = df.withColumn("__range", F.floor(F.col(order[0]) / width))
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("__range").orderBy(*order))
    firsts = df.groupBy("__range").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__first"))
    firsts = firsts.select(F.lag("__range").over(Window.orderBy("__range")).alias("__range"), "__first").where("__range IS NOT NULL")
    joined = df.withColumn("__next", inside).join(firsts, "__range", "left")
    return joined.withColumn(name, F.coalesce("__next", "__first")["v"]).drop("__range", "__next", "__first")
