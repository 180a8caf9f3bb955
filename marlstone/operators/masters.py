"""Master data: matching of source names to ids, suggestions, decisions and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import company_stem, normalize_name
from marlstone.sources import scratch


def known_names(masters: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One id for each normalised name; registered aliases win over main names, then the smaller id."""
    names = masters.select(normalize_name(F.col("name")).alias("norm"), "id", F.lit(1).alias("priority"))
    if aliases is not None:
        names = names.unionByName(aliases.select(normalize_name(F.col("alias")).alias("norm"), F.col("target").alias("id"), F.lit(0).alias("priority")))
    return names.filter("norm <> ''").groupBy("norm").agg(F.min_by("id", F.struct("priority", "id")).alias("id"))


def resolve_exact(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (raw) with the id of the equal normalised name, or null."""
    return names.withColumn("norm", normalize_name(F.col("raw"))).join(known, "norm", "left")


def unmatched(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names without an id, with how many rows use them."""
    return names.withColumn("norm", normalize_name(F.col("raw"))).join(known, "norm", "left_anti").groupBy("raw").agg(F.sum("weight").cast("long").alias("n_rows"))


def candidates(raw: DataFrame, masters: DataFrame, top: int = 3) -> DataFrame:
    """Suggestions (raw, id, score, rank) for unresolved names: an equal stem alone, or else containment and small edits of names with the same first letter.

    Spellings that are equal when normalised are compared once, with the ``top`` smallest ids of each.  Everything meets in equi joins.
    Stems meet stems.  A name that contains another has it among its substrings, of which only those as long as some
    name on the other side are made.  Near names are sought by growing distance: names within d edits share a string
    that d letters at most are dropped for, so for the distances in EDITS the names meet at these.  A name that then has its
    ``top`` suggestions, each better than any name at a greater distance could be, is done; so names that are all alike
    meet their close neighbours only.  The rest meets names of the same first letter, and of a length of six tenths at
    least, in tiles.  Strings made of names are many times the names, which their sizes don't tell Spark: they are never broadcast.
    """
    left = raw.select("raw").distinct().select("raw", normalize_name(F.col("raw")).alias("n"), company_stem(F.col("raw")).alias("stem")).filter("n <> ''")
    right = masters.select("id", normalize_name(F.col("name")).alias("en"), company_stem(F.col("name")).alias("stem")).filter("en <> ''")
    least = lambda df, by: df.select(by, "id").distinct().withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("place") <= top).drop("place")
    by_stem = left.join(least(right, "stem"), "stem").select("raw", "id", F.lit(0.9).alias("score"))
    rest = _written(left.join(right.select("stem").distinct(), "stem", "left_anti").select("raw", "n"))
    owners = _written(least(right, "en"))
    ours, theirs = rest.select("n").distinct(), owners.select("en").distinct()
    our_sizes, their_sizes = _sizes(ours, "n"), _sizes(theirs, "en")
    within = _with_substrings(ours, "n", their_sizes).hint("merge").join(theirs, F.col("piece") == F.col("en")).select("n", "en")
    around = _with_substrings(theirs, "en", our_sizes).hint("merge").join(ours, F.col("piece") == F.col("n")).select("n", "en")
    owned = lambda pairs: _scored(pairs).join(owners, "en").select("n", "id", "score")
    found, open_ = owned(within.unionByName(around)), ours
    for d in EDITS:
        met = _dropped(open_, "n", d, their_sizes).hint("merge").join(_dropped(theirs, "en", d, our_sizes), "key").select("n", "en")
        near = met.filter(F.levenshtein("n", "en", d) >= 0)  # further ones may meet too, but not all of them
        best = found = _written(_best(found.unionByName(owned(near)), top))
        size = F.length("n")
        beyond = F.lit(0.7) * size / (size + d + 1)  # no name at a greater distance scores more
        done = best.groupBy("n").agg(F.count("*").alias("held"), F.min("score").alias("worst")).filter((F.col("held") == top) & (F.col("worst") > F.round(beyond.cast("decimal(12,8)"), 6).cast("double")))
        done = done.select("n").unionByName(open_.filter(beyond < F.lit(0.6 * 0.7 - 1e-9)).select("n"))
        open_ = ours.join(done, "n", "left_anti")  # what is done stays so as distances grow
        if open_.isEmpty():
            break
    else:
        best = _best(best.unionByName(_compared(open_, owners, top)), top)
    every = by_stem.unionByName(rest.join(best, "n").select("raw", "id", "score"))
    rank = F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= top)


#: Distances at which near names are met by what is left when letters are dropped.
EDITS = (2,)
#: Names of one first letter and length that a row of the last comparison holds, and open names that meet them in one task.
TILE, SHARE = 2_000, 20_000


def _written(df: DataFrame) -> DataFrame:
    """df, worked out once and read again until the application ends."""
    path = scratch.folder(df.sparkSession, "names")
    df.write.parquet(path)
    scratch.until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _score(n: Column, en: Column, distance: Column) -> Column:
    """The score of two names that are so many edits apart, or null."""
    ratio = 1 - distance / F.greatest(F.length(n), F.length(en))
    near = (F.left(n, F.lit(1)) == F.left(en, F.lit(1))) & (ratio >= 0.6)
    return F.when(F.contains(en, n) | F.contains(n, en), F.lit(0.75)).when(near, F.round((ratio * 0.7).cast("decimal(12,8)"), 6).cast("double"))


def _scored(pairs: DataFrame) -> DataFrame:
    """n, en and score of pairs that are suggestions, each scored before it moves."""
    return pairs.withColumn("score", _score(F.col("n"), F.col("en"), F.levenshtein("n", "en"))).filter("score IS NOT NULL")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The best of n, id and score for each n, every row once. Ties have one rank, so that rows are few before they move and equal ones go afterwards."""
    rank = F.dense_rank().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank").distinct()


def _compared(open_: DataFrame, owners: DataFrame, top: int) -> DataFrame:
    """n, id and score: the best of every tile of names that an open name is compared with one by one.

    The names of a first letter and length are dealt to tiles, one row each, and the open names to shares; each share meets each tile.
    So pairs are never rows, and a task's work is bounded, though there are as many comparisons as pairs.
    """
    block, first = ["first", "size"], lambda c: F.left(c, F.lit(1)).alias("first")
    size = F.length("n")
    copy = F.row_number().over(Window.partitionBy(*block, "id").orderBy("en")).alias("copy")  # a tile holds one name of an id, so that its best are as many ids
    theirs = owners.select("id", "en", first("en"), F.length("en").alias("size")).select("*", copy)
    ours = open_.select("n", first("n"), F.explode(F.sequence(F.ceil(size * 6 / 10).cast("int"), F.floor(size * 10 / 6).cast("int"))).alias("size"))
    parts = lambda most: F.ceil(F.count("*") / most).cast("int")
    blocks = theirs.groupBy(*block, "copy").agg(parts(TILE).alias("tiles")).join(ours.groupBy(*block).agg(parts(SHARE).alias("shares")), block)
    dealt, all_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = theirs.join(blocks, [*block, "copy"]).withColumn("tile", dealt("en", "tiles")).groupBy(*block, "copy", "shares", "tile").agg(F.collect_list(F.struct("id", "en")).alias("names"))
    shared = ours.join(blocks, block).select("n", *block, "copy", dealt("n", "shares").alias("share"), all_of("tiles").alias("tile"))
    key = [*block, "copy", "tile", "share"]
    spread = shared.repartition(4 * open_.sparkSession.sparkContext.defaultParallelism, *key)  # by comparisons there are few bytes
    met = spread.hint("merge").join(tiles.withColumn("share", all_of("shares")).drop("shares"), key)
    # In a tile all names are as long, so fewer edits are a better score; what is contained has been found before and leads anyway.
    apart = F.transform("names", lambda x: F.struct(F.levenshtein("n", x["en"]).alias("d"), x["id"].alias("id"), x["en"].alias("en")))
    ranked = F.sort_array(F.filter(apart, lambda x: x["d"] * 10 <= F.greatest(size, F.col("size")) * 4))
    return _scored(met.select("n", F.inline(F.slice(ranked, 1, top))).select("n", "en", "id")).select("n", "id", "score")


def _sizes(df: DataFrame, column: str) -> list[int]:
    """The lengths of names. There are no more than letters in a name."""
    return sorted(r[0] for r in df.select(F.length(column)).distinct().collect())


def _dropped(df: DataFrame, column: str, letters: int, other_sizes: list[int]) -> DataFrame:
    """df with key: the hash of the first letter and of each string that is left when up to so many letters are dropped.

    A name that is k letters longer than the other drops k more, or neither is within so many edits; so as many are dropped
    as the lengths of the other side call for.  Names that share a hash by chance are scored like all others.
    """
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    safe = lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array().cast("array<string>"))
    size, none = F.length(column), F.array().cast("array<string>")
    longer = F.transform(F.filter(F.array(*[F.lit(k) for k in other_sizes]).cast("array<int>"), lambda k: F.abs(size - k) <= letters), lambda k: size - k)
    fewest, most = F.greatest(F.lit(0), F.array_min(longer)), F.when(F.size(longer) > 0, F.least(F.lit(letters), letters + F.array_max(longer))).otherwise(-1)
    every, pieces = none, F.array(F.col(column))
    for n in range(letters + 1):
        pieces = pieces if n == 0 else F.array_distinct(F.flatten(F.transform(pieces, safe)))
        every = F.concat(every, F.when((F.lit(n) >= fewest) & (F.lit(n) <= most), pieces).otherwise(none))
    dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism, column)  # a small table is read by a task or two
    return dealt.select(column, F.explode(every).alias("piece")).select(column, F.xxhash64(F.left(column, F.lit(1)), "piece").alias("key"))


def _with_substrings(df: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """df with piece: each substring of a name that is as long as some name of the other side."""
    starts = lambda k: F.when(F.length(column) >= k, F.transform(F.sequence(F.lit(1), F.length(column) - k + 1), lambda i: F.substring(F.col(column), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    pieces = F.flatten(F.array(*[starts(k) for k in sizes])) if sizes else F.array().cast("array<string>")
    return df.withColumn("piece", F.explode(F.array_distinct(pieces)))


def apply_decisions(resolved: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (raw, action merge or create, target) win over the exact match; what has neither is pending."""
    made = resolved.join(decisions, "raw", "left")
    final = F.when(F.col("action") == "merge", F.col("target")).when(F.col("action") == "create", F.concat(F.lit("new_"), "norm")).otherwise(F.col("id"))
    status = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("id").isNotNull(), "matched").otherwise("pending")
    return made.select("raw", final.alias("final_id"), status.alias("status"))


def search(catalog: DataFrame, keyword: str) -> DataFrame:
    """Rows (kind, id, name, aliases) whose name or one of whose aliases holds the keyword, in any case."""
    held = lambda c: F.contains(F.lower(c), F.lit(keyword.lower()))
    return catalog.filter(F.coalesce(held(F.col("name")), F.lit(False)) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(held(a), F.lit(False))))


def alias_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest target of each (kind, normalized), and the one before it."""
    w = Window.partitionBy("kind", "normalized").orderBy("registered_at", "target")
    every = old.unionByName(new).withColumn("previous", F.lag("target").over(w)).withColumn("rank", F.row_number().over(Window.partitionBy("kind", "normalized").orderBy(F.desc("registered_at"), F.desc("target"))))
    return every.filter("rank = 1").drop("rank")
