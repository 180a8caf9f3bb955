"""Secrets in text, with linking of credentials that come in parts.

Base kinds are found by pattern and reported at once.  Weak parts (an access
identifier, a token-like word, an endpoint) are everyday text alone: they are
reported only where a part that completes them lies in the same scope, SCOPE
code points around.  Linking is an interval join: positions fall into cells of
that size, a weak part looks into its own cells and the two beside them, and a semi
join keeps it if a completing part is near enough there.  Cells bound what meets,
and no pair is emitted.

All of it is DataFrame functions.  Positions come from the lengths of the text
between matches, summed by a window, so a text with many matches costs no more
per match than one with few.

Defined results: a null text is read as empty and has no spans; repeated rows and
null ids give a row each; an empty table gives an empty result; other columns are
ignored, and kept by redact whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.runtime import documents, stash

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int
    #: Kinds of which one must be near; empty: reported alone.
    completed_by: tuple[str, ...] = ()


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]+", 0, 32),
    Kind("id", r"""(?i)\b(?:access_?(?:key_?)?id|client_?id|account_?id|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, 3, ("assign", "hex", "blob")),
    Kind("blob", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20, ("access", "id")),
    Kind("endpoint", r"""(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[^\s"'<>]+""", 0, 10, ("assign", "hex", "access")),
)
_TEXT = ["doc_id", "print", "copies"]
BASE = tuple(i for i, k in enumerate(KINDS) if not k.completed_by)


def _found(i: int, kind: Kind) -> Column:
    """gap (text before the match), size and whether it is long enough, of each match in order."""
    text, pattern = F.col("text"), F.lit(kind.pattern)
    # Long runs of the class that a single character opens are rare; the test that skips a text asks for them at once.
    test = F.lit(r"[0-9a-f]{32}") if kind.name == "hex" else pattern
    matches = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("v"))
    rows = F.zip_with(
        F.split(text, kind.pattern, -1), matches,
        lambda before, x: F.struct(F.lit(i).alias("kind"), F.length(before).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), (F.length(x["v"]) >= kind.least).alias("ok")),
    )
    return F.when(F.regexp_like(text, test), F.filter(rows, lambda r: r["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,ok:boolean>>"))


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (of the text), copies (rows that repeat both), kind, start and end of each match that is long enough, and a row with null kind for each document."""
    docs = documents(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Each kind's matches are ranked by their place in their own list.
    lists = docs.select("doc_id", F.xxhash64("text").alias("print"), *[_found(i, k).alias(f"k{i}") for i, k in enumerate(KINDS)])
    ranked = [F.transform(f"k{i}", lambda x, at: F.struct(x["kind"].alias("kind"), at.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok"))) for i in range(len(KINDS))]
    rows = lists.select("doc_id", "print", F.explode_outer(F.concat(*ranked)).alias("x")).select("doc_id", "print", "x.*")
    # What rows that repeat both doc_id and text hold is counted once, with how many they are.
    rows = stash(rows, "matches").groupBy("doc_id", "print", "kind", "at", "gap", "size", "ok").agg(F.count("*").cast("int").alias("copies"))
    order = Window.partitionBy("doc_id", "print", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    marker = (F.col("kind").isNull() | (F.col("at") == 0)) & ~F.coalesce("ok", F.lit(False))
    place = (("kind", "int"), ("start", "long"), ("end", "long"))
    return placed.filter("ok").select(*_TEXT, *[c for c, _ in place]).unionByName(placed.filter(marker).select(*_TEXT, *[F.lit(None).cast(t).alias(c) for c, t in place]))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that a completing part is near to."""
    need = {i: [j for j, o in enumerate(KINDS) if o.name in k.completed_by] for i, k in enumerate(KINDS) if k.completed_by}
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    weak = found.filter(F.col("kind").isin(list(need))).withColumn("cell", F.explode(F.sequence(first - 1, last + 1)))
    other = found.filter(F.col("kind").isNotNull()).select(
        F.col("doc_id").alias("o_doc"), F.col("print").alias("o_print"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence(first, last)).alias("o_cell")
    )
    completes = F.lit(False)
    for i, js in need.items():
        completes = completes | ((F.col("kind") == i) & F.col("o_kind").isin(js))
    apart = F.greatest(F.col("start") - F.col("o_end"), F.col("o_start") - F.col("end"))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("print") == F.col("o_print")) & (F.col("cell") == F.col("o_cell"))
    # A part and the text it overlaps are no two parts, and text that is reported alone isn't reported again.
    linked = weak.join(other, same & completes & (apart >= 0) & (apart <= scope), "left_semi").drop("cell").distinct()
    covered = weak.join(other.filter(F.col("o_kind").isin(*BASE)), same & (apart < 0), "left_semi").select(
        F.col("doc_id").alias("c_doc"), F.col("print").alias("c_print"), F.col("kind").alias("c_kind"), F.col("start").alias("c_start")
    )
    itself = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("print") == F.col("c_print")) & (F.col("kind") == F.col("c_kind")) & (F.col("start") == F.col("c_start"))
    return linked.join(covered, itself, "left_anti")


def _spans(df: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """doc_id, print, copies and spans of each text."""
    found = stash(parts(df, id_col, text_col), "parts")
    base = found.filter(F.col("kind").isNull() | F.col("kind").isin(*BASE))
    every = base.unionByName(link(found, scope)).unionByName(found.select(*_TEXT, *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("start", "long"), ("end", "long"))]).distinct())
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return every.groupBy(*_TEXT).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, print and spans (start, kind, end; in code points, end exclusive; sorted) of each document."""
    return _spans(df, id_col, text_col, scope).withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans become one mark. Rows without spans stay as they are."""
    spans = _spans(df, id_col, text_col, scope).filter(F.size("spans") > 0).select("doc_id", "print", "spans")
    row = df.select(F.struct(*df.columns).alias("row"))  # whatever the columns are called, they can't clash
    text = F.col("row")[text_col].cast("string")
    same = (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("print")) & F.col("row")[id_col].cast("long").eqNullSafe(F.col("doc_id"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(
        x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"))
    ).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.col("spans").isNotNull(), done).otherwise(F.col("row")[text_col])
    return row.join(spans, same, "left").select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
