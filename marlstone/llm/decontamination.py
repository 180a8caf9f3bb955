"""Benchmark decontamination by a prefix-filtered set join.

Every window of WINDOW consecutive item words (the whole item, if shorter) is a
set of shingles.  A text that contains the window contains all of them, so the
join needs just one: each window's prefix is its rarest shingle, by its count in
all documents and the benchmark's windows.  Documents are exploded into shingles,
which meet the prefixes in a broadcast join; a match fixes where the window would
start, and the length of the text and that position rule it out or not; the words
there are then compared one by one.

Prefixes of at most BROADCAST windows are broadcast, and words stay inside one stage
from the scan to the comparison.  More of them are joined by a shuffle of places
(shingle, document, position), and only documents with a candidate are read again.
Either way the documents are scanned once to count and once to find, whatever the
benchmark's size.  All of it is DataFrame functions.

Defined results: a null or wordless text has no words and no hit; an item without
words has no windows; repeated rows and null ids give a row each; items of equal
text are all reported; an empty benchmark leaves every document clean; an empty
table gives an empty result; other columns are ignored, and kept by decontaminate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import documents, stash

WINDOW, SHINGLE = 13, 4
#: Windows whose prefixes are broadcast; with their words some tens of MB.
BROADCAST = 100_000
#: Everything between words: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text with A to Z made small; other capitals stay."""
    plain = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(plain) == F.length(plain)
    small = F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.filter(F.split(small, BETWEEN, -1), lambda w: w != "")


def _token(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _shingles(df: DataFrame, words: str, sizes: list[int], *keep: str, end: bool = False) -> DataFrame:
    """pos and token of each run of as many words as a size says, and rows with a null token where there are too few. end: one row behind the last word has token 0."""
    n = F.size(words)
    shifted = [F.concat(F.col(words), F.array(F.lit(None).cast("string"))).alias("w0"), *(F.slice(words, i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(1, max(sizes)))]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    parts = [F.col(f"z.w{i}") for i in range(max(sizes))]
    tokens = [F.when(parts[size - 1].isNotNull(), _token(parts[:size])) for size in sizes]
    if end:
        tokens[0] = F.when(F.col("pos") == F.size(words), F.lit(0).cast("long")).otherwise(tokens[0])
    return rows.withColumn("token", tokens[0] if len(sizes) == 1 else F.explode(F.array(*tokens))).drop("z")


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """seq and words of each distinct window, and item_id with seq."""
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1))))
    rows = worded.withColumn("at", starts).select("item_id", F.slice("all", F.col("at"), window).alias("words")).withColumn("seq", F.array_join("words", " "))
    rows = stash(rows, "item-windows")
    return rows.select("seq", "words").dropDuplicates(["seq"]), rows.select("item_id", "seq").distinct()


def _prefixes(worded: DataFrame, windows: DataFrame, sizes: list[int], shingle: int, broadcast: bool) -> DataFrame:
    """token, seq, offset and n: the rarest shingle of each window, by its count in documents and windows."""
    of_size = [_shingles(windows.filter(F.least("n", F.lit(shingle)) == size), "words", [size], "seq", "n").filter("token IS NOT NULL") for size in sizes]
    tokens = reduce(DataFrame.unionByName, of_size)
    known = tokens.groupBy("token").agg(F.count("*").alias("own"))
    in_docs = _shingles(worded, "words", sizes).filter("token IS NOT NULL")
    if broadcast:
        in_docs = in_docs.join(F.broadcast(known.select("token")), "token")
    seen = in_docs.groupBy("token").agg(F.count("*").alias("seen"))
    rarity = known.join(seen, "token", "left").select("token", (F.col("own") + F.coalesce("seen", F.lit(0))).alias("often"))
    rarest = tokens.join(rarity, "token").groupBy("seq", "n").agg(F.min(F.struct("often", "token", "pos")).alias("x"))
    return rarest.select(F.col("x.token").alias("token"), "seq", F.col("x.pos").alias("offset"), "n")


def _found(worded: DataFrame, chosen: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """doc_id, print, n_words, start, n and seq of each occurrence of a window, and a row with n 0 and a null seq for each row of worded."""
    begin = F.col("pos") - F.col("offset")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words"))
    holds = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("seq")
    columns = ["doc_id", "print", F.size("words").cast("long").alias("n_words"), "start", "n", "seq"]
    if broadcast:  # the first row behind the last word of each text tells its length: it meets a probe of its own
        probe = chosen.unionByName(worded.sparkSession.createDataFrame([(0, None, 0, 0)], "token long, seq string, offset int, n int"))
        met = _shingles(worded, "words", sizes, "doc_id", "print", "words", end=True).join(F.broadcast(probe), "token").withColumn("start", begin)
        return met.filter((F.col("seq").isNull() & (F.col("pos") == F.size("words"))) | (F.col("seq").isNotNull() & fits & holds)).select(*columns)
    places = _shingles(worded, "words", sizes, "doc_id", "print").filter("token IS NOT NULL")
    met = places.join(chosen, "token").withColumn("start", begin).filter("start >= 0").select(F.col("doc_id").alias("m_doc"), F.col("print").alias("m_print"), "start", "n", "seq").distinct()
    again = worded.join(met, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("print") == F.col("m_print"))).filter(fits & holds).select(*columns)
    return again.unionByName(worded.select("doc_id", "print", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("seq")))


def _judged(docs: DataFrame, items: DataFrame, window: int, shingle: int, part: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, copies (rows that repeat both), n_words, n_hit, item_ids and contaminated."""
    source = documents(docs, id_col, text_col)
    worded = source.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), words_of(F.col("text")).alias("words"))
    distinct, owners = item_windows(items, window)
    windows = stash(distinct.withColumn("n", F.size("words")), "windows")
    broadcast = windows.count() <= BROADCAST
    # Windows shorter than a shingle use one of their own length.
    sizes = sorted((r["size"] for r in windows.select(F.least("n", F.lit(shingle)).alias("size")).distinct().collect()), reverse=True) or [shingle]
    chosen = stash(_prefixes(worded, windows, sizes, shingle, broadcast), "prefixes")
    hits = stash(_found(worded, chosen, sizes, broadcast), "hits")
    place = F.when(F.col("seq").isNotNull(), F.struct("start", "n"))
    covered = F.expr(
        "aggregate(array_sort(collect_set(place)), named_struct('at', 0, 'n', 0L), "
        "(a, x) -> named_struct('at', greatest(a.at, x.start + x.n), 'n', a.n + greatest(0, x.start + x.n - greatest(a.at, x.start))), a -> a.n)"
    )
    counts = hits.withColumn("place", place).groupBy("doc_id", "print").agg(F.count_if(F.col("seq").isNull()).cast("int").alias("copies"), F.max("n_words").alias("n_words"), covered.alias("n_hit"))
    named = hits.filter("seq IS NOT NULL").select("doc_id", "print", "seq").distinct().join(owners, "seq")
    by_doc = named.groupBy(F.col("doc_id").alias("i_doc"), F.col("print").alias("i_print")).agg(F.collect_set("item_id").alias("item_ids"))
    joined = counts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("print") == F.col("i_print")), "left")
    ids = F.coalesce("item_ids", F.array().cast(by_doc.schema["item_ids"].dataType))
    return joined.select("doc_id", "print", "copies", "n_words", "n_hit", ids.alias("item_ids"), ((F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, part: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, n_words, n_hit, item_ids and contaminated of each document.

    contaminated: at least one word in ``part`` lies in an item's window.
    """
    return _judged(docs, items, window, shingle, part, id_col, text_col).withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, part: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    bad = _judged(docs, items, window, shingle, part, id_col, text_col).filter("contaminated").select("doc_id", "print")
    row = docs.select(F.struct(*docs.columns).alias("row"))  # whatever the columns are called, they can't clash
    same = (F.xxhash64(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))) == F.col("print")) & F.col("row")[id_col].cast("long").eqNullSafe(F.col("doc_id"))
    return row.join(bad, same, "left_anti").select("row.*")
