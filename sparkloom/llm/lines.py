"""Line deduplication by a deletion-neighbourhood join.

Lines within one edit (a character replaced, inserted or deleted) are alike:
leaving out one character of one or both makes them equal. So hashed
deletion variants are joined, and a line goes if an earlier one is alike, the
order being doc_id, then line number. Two replaced characters at one place
give a variant of the same place in lines of one length; an inserted one
makes the longer line's variant equal to the whole shorter line. Both are
settled by the earliest line of a key, so no pair of a group is ever listed.

Most lines have no line alike, and their variants need not be made. An edit
falls within one half of a line, so the other half must be shared: lines that
share no half are set aside. The rest are cut into about sqrt(length) parts;
where lines share all but one part, variants are made for that part.

That is for one edit (edits=1). Of no edit, equal lines are grouped by their
md5; of more, a line is cut into edits + 1 parts, one of which must be found in
a line alike, shifted by edits at most, and all pairs that share one are measured.

Defined cases: a null or empty text has no lines; lines shorter than
min_chars (white space at both ends left out) go if an earlier one is equal
and they have exact_chars characters or more, and else always stay (all of
them do where exact_chars is None); lines of any length are compared whole; a
null doc_id comes after all others; rows that share an id (or have none) are
in the order of a hash of their texts, and rows that repeat both are the same
row and keep the same lines, unless row names a column that numbers the rows:
it then stands for the hash, and each row's lines are its own; an empty table
gives no row; other columns stay as they are in drop_lines() and are ignored
in line_report().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, remove, written

MIN_CHARS = 16
#: Keys are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20
BLANK = " \t\n\r\x0b\x0c"
#: Stands for a row number where none is named.
TEXT_HASH = "__line_text_hash"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _least(min_chars: int, exact_chars: int | None) -> int:
    """The length from which lines may go."""
    return min_chars if exact_chars is None else min(min_chars, exact_chars)


def _lines(docs: DataFrame, min_chars: int, row: str | None) -> DataFrame:
    """Lines that may go: at (their place in the order), line, id."""
    ids = ["doc_id", row] if row else ["doc_id"]
    each = docs.select(*ids, F.posexplode(_split(F.col("text"))).alias("no", "line"))
    each = each.select(F.struct(F.col("doc_id").isNull().alias("late"), *ids, "no").alias("at"), F.btrim("line", F.lit(BLANK)).alias("line"))
    return each.where(F.length("line") >= min_chars).select("at", "line", F.unhex(F.md5(F.encode("line", "UTF-8"))).alias("id"))


def _small(df: DataFrame, bytes_each: int) -> DataFrame:
    """df marked for broadcast, if its rows are few enough."""
    return F.broadcast(df) if df.count() * bytes_each <= BROADCAST_BYTES else df


def _halves(line: Column) -> Column:
    """Hashes of the first and last n/2 characters, rounded down and up."""
    n = F.length(line)
    down, up = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    keys = [F.xxhash64(F.lit(0), F.substring(line, F.lit(1), k)) for k in (down, up)] + [F.xxhash64(F.lit(1), F.right(line, k)) for k in (down, up)]
    return F.array_distinct(F.array(*keys))


def _parted(lines: DataFrame) -> DataFrame:
    """A row for each line, kind of pair and part that may differ: key (of all the rest), role, part. Roles: 2
    among lines of one length, 0 the shorter and 1 the longer of two."""
    n = F.length("line")
    kinds = F.array(*(F.struct(F.lit(role).alias("role"), size.alias("size")) for role, size in ((2, n), (0, n), (1, n - 1))))
    rows = lines.select("id", "at", "line", F.explode(kinds).alias("kind")).select("id", "at", "line", "kind.role", "kind.size")
    rows = rows.withColumn("parts", F.ceil(F.sqrt("size")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda k: F.floor(k.cast("long") * F.col("size") / F.col("parts")).cast("int")
    rows = rows.withColumn("start", edge(F.col("k"))).withColumn("after", F.col("size") - edge(F.col("k") + 1))
    rest = F.xxhash64(F.col("role") == 2, "size", "k", F.substring("line", F.lit(1), F.col("start")), F.right("line", F.col("after")))
    return rows.select(rest.alias("key"), "role", "id", "at", F.substring("line", F.col("start") + 1, F.length("line") - F.col("start") - F.col("after")).alias("part"))


def _variants(parted: DataFrame) -> DataFrame:
    """The deletion variants of parts: variant, role, id, at."""
    places = F.when(F.length("part") > 0, F.sequence(F.lit(0), F.length("part") - 1)).otherwise(F.array().cast("array<int>"))
    without = lambda i: F.concat(F.substring("part", F.lit(1), i), F.substring("part", i + 2, F.length("part")))
    at_place = F.transform(places, lambda i: F.xxhash64("key", i, without(i)))
    anywhere = F.transform(places, lambda i: F.xxhash64("key", F.lit(-1), without(i)))
    whole = F.array(F.xxhash64("key", F.lit(-1), "part"))
    made = F.when(F.col("role") == 2, at_place).when(F.col("role") == 1, F.array_distinct(anywhere)).otherwise(whole)
    return parted.select(F.explode(made).alias("variant"), "role", "id", "at")


def _within(a: Column, b: Column, edits: int) -> Column:
    return F.levenshtein(a, b, edits) >= 0


def _pairs_by_part(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of lines that share one of edits + 1 parts of the earlier: id, at, earlier_id."""
    n, around = F.length("line"), F.sequence(F.lit(-edits), F.lit(edits))
    edge = lambda size, k: F.floor(k.cast("long") * size / (edits + 1)).cast("int")
    key = lambda size, k, start: F.xxhash64(size, k, F.substring("line", start + 1, edge(size, k + 1) - edge(size, k))).alias("key")
    each = lines.select("id", "at", "line", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("k"))
    parts = each.select(F.col("id").alias("earlier_id"), F.col("at").alias("earlier_at"), key(n, F.col("k"), edge(n, F.col("k"))))
    others = each.withColumn("size", F.explode(F.filter(F.transform(around, lambda x: n + x), lambda x: x > 0)))
    others = others.withColumn("start", F.explode(F.transform(around, lambda x: edge(F.col("size"), F.col("k")) + x))).where((F.col("start") >= 0) & (F.col("start") <= n))
    others = others.select("id", "at", key(F.col("size"), F.col("k"), F.col("start")))
    return others.join(parts, "key").where(F.col("earlier_at") < F.col("at")).select("id", "at", "earlier_id").distinct()


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, row: str | None = None, exact_chars: int | None = None, edits: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct lines that stay (at: their first place) and those that go though they differ from all before
    (at, id, and earlier: a line alike)."""
    lines = _lines(docs, _least(min_chars, exact_chars), row)
    # lines without halves are settled by equality alone
    halves = F.when(F.length("line") >= min_chars if edits else F.lit(False), _halves(F.col("line"))).otherwise(F.array().cast("array<bigint>"))
    first = lines.groupBy("id").agg(F.min(F.struct("at", halves.alias("halves"))).alias("first"))
    distinct = written(first.select("id", "first.at", "first.halves"), "lines")
    if edits > 1:
        firsts = distinct.where(F.size("halves") > 0).select("id", F.col("at").alias("first_at"))
        texts = written(lines.join(firsts, "id").where(F.col("at") == F.col("first_at")).select("id", "at", "line"), "line-texts")
        return _settled(distinct, texts, _pairs_by_part(texts, edits), edits)
    halves = distinct.select("id", F.explode("halves").alias("key"))
    shared = written(halves.groupBy("key").count().where("count > 1").select("key"), "line-halves")
    some = written(halves.join(_small(shared, 24), "key").select("id").distinct().join(distinct.select("id", "at"), "id"), "line-candidates")
    texts = written(lines.join(_small(some.select("id", F.col("at").alias("first_at")), 64), "id").where(F.col("at") == F.col("first_at")).select("id", "at", "line"), "line-texts")
    parted = _parted(texts)
    roles = parted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("low"), F.max("role").alias("high"))
    met = written(roles.where((F.col("n") > 1) & ((F.col("low") != F.col("high")) | (F.col("low") == 2))).select("key"), "line-parts")
    variants = written(_variants(parted.join(_small(met, 24), "key")), "line-variants")
    other = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "id"))).alias(f"first{role}")
    firsts = variants.groupBy("variant").agg(other(0), other(1), other(2))
    firsts = firsts.where("(first0 IS NOT NULL AND first1 IS NOT NULL) OR first2 IS NOT NULL")
    earlier = F.when(F.col("role") == 2, F.col("first2")).when(F.col("role") == 1, F.col("first0")).otherwise(F.col("first1"))
    pairs = variants.join(firsts, "variant").select("id", "at", earlier.alias("earlier")).where(F.col("earlier.at") < F.col("at"))
    pairs = pairs.select("id", "at", F.col("earlier.id").alias("earlier_id")).distinct()
    settled = _settled(distinct, texts, pairs, edits)
    remove(shared, some, texts, met, variants)
    free(docs.sparkSession)
    return settled


def _settled(distinct: DataFrame, texts: DataFrame, pairs: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """What duplicate_lines() returns, of pairs (id, at, earlier_id) that may be alike."""
    one, two = texts.select("id", "line"), texts.select(F.col("id").alias("earlier_id"), F.col("line").alias("earlier"))
    near = pairs.join(one, "id").join(two, "earlier_id").where(_within(F.col("line"), F.col("earlier"), edits))
    gone = written(near.groupBy("id", "at").agg(F.min("earlier").alias("earlier")), "lines-gone")
    return distinct.join(gone.select("id"), "id", "left_anti").select("at"), gone


def _named(docs: DataFrame, row: str | None) -> tuple[DataFrame, str]:
    """docs with a column that tells rows of one id apart, and its name."""
    return (docs, row) if row else (docs.withColumn(TEXT_HASH, F.xxhash64("text")), TEXT_HASH)


def _kept(docs: DataFrame, min_chars: int, row: str, exact_chars: int | None, edits: int) -> DataFrame:
    """Of rows with lines that stay: __of_id, __of_row, __firsts (the lines' numbers)."""
    stay, _ = duplicate_lines(docs, min_chars, row, exact_chars, edits)
    return stay.groupBy(F.col("at.doc_id").alias("__of_id"), F.col("at")[row].alias("__of_row")).agg(F.sort_array(F.collect_list("at.no")).alias("__firsts"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, edits: int = 1) -> DataFrame:
    """A row per document: doc_id, n_lines, n_long (lines that may go), kept_lines (numbers, from 0, of those
    of them that stay)."""
    docs, row = _named(docs, None)
    lines = F.transform(_split(F.col("text")), lambda x: F.length(F.btrim(x, F.lit(BLANK))))
    counts = docs.select("doc_id", row, F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.size(lines)).otherwise(0).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda n: n >= _least(min_chars, exact_chars))).cast("long").alias("n_long"))
    kept = _kept(docs, min_chars, row, exact_chars, edits)
    joined = counts.join(kept, F.col("doc_id").eqNullSafe(F.col("__of_id")) & (F.col(row) == F.col("__of_row")), "left")
    return joined.select("doc_id", "n_lines", "n_long", F.coalesce("__firsts", F.array().cast("array<int>")).alias("kept_lines"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, row: str | None = None, exact_chars: int | None = None, edits: int = 1) -> DataFrame:
    """docs without the lines that go; a document all of whose lines go has an empty text, and a null text
    stays null."""
    columns, (docs, row) = docs.columns, _named(docs, row)
    kept = _kept(docs, min_chars, row, exact_chars, edits)
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__of_id")) & (docs[row] == F.col("__of_row")), "left")
    stays = lambda line, no: (F.length(F.btrim(line, F.lit(BLANK))) < _least(min_chars, exact_chars)) | F.coalesce(F.array_contains("__firsts", no), F.lit(False))
    text = F.when(docs["text"].isNotNull(), F.array_join(F.filter(_split(docs["text"]), stays), "\n"))
    return joined.withColumn("text", text).select(*columns)
