"""Benchmark decontamination: documents that contain a window of a benchmark item.

A window is ten consecutive words of an item, or the whole item if it is shorter. A document holds a
window only if it holds all its words, so the necessary prefix is one token: the window's rarest
word, by how often the benchmark's words stand in all documents. The documents' words are joined
with these tokens; a match fixes where the window would have to begin, bounds of length and position
drop what cannot fit, and what is left is compared word for word. Words that match no token leave
the plan inside the scan's stage, so only hits are shuffled.

Column functions and joins only. The windows are broadcast in slices of at most `slice_windows`,
so the broadcast is bounded however large the benchmark is, and every slice is one more pass over
the documents; an ordinary benchmark has one.

Letters A-Z count as a-z, other letters as they are. Tokens are joined in full lower case, which
finds at least as much, and the comparison is exact.

Defined results: a null or empty text has no words and no hits; an item without words is ignored, a
null item id counts as the empty string; items that share a window are all counted; repeated items
once per id; repeated documents each get their own row; empty tables give no rows or no hits. Other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import own_columns, table

WINDOW = 10
SLICE_WINDOWS = 100_000

# What a word is, before and after A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# No word holds this; it brings each document itself through the join.
SELF = "\x00"


def _words(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows, words joined by spaces, each with its width and the ids of its items."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        _words(_lowered(F.col("text"))).alias("words"),
    ).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - width + 1)
    cut = items.select("item", "words", width.alias("width"), F.explode(starts).alias("at"))
    text = F.array_join(F.slice("words", F.col("at"), F.col("width")), " ")
    return cut.groupBy(text.alias("window"), "width").agg(F.collect_set("item").alias("items"))


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(_words(F.col("text"))).alias("word"))


def with_prefix(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Every window with its rarest word, `token`, in full lower case, and the place of that word
    in it. Ties go to the word that sorts first."""
    placed = windows.withColumn("words", F.split("window", " ")).select(
        "window", "width", "items", F.posexplode("words").alias("offset", "word")
    )
    placed = placed.withColumn("token", F.lower("word"))
    counts = (
        _document_words(docs)
        .select(F.lower("word").alias("token"))
        .join(F.broadcast(placed.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
    ranked = placed.join(counts, "token", "left").groupBy("window", "width")
    return ranked.agg(F.first("items").alias("items"), F.min(rank).alias("rarest")).select(
        "window", "width", "items", "rarest.token", "rarest.offset"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Per document (`doc_id`, `text_hash`): `n_words`, `n_hit` words inside occurring windows, the
    sorted ids of the `items` these windows belong to, and how many rows (`copies`) are the same."""
    windows = item_windows(benchmark, window)
    slices = 1 + windows.count() // slice_windows
    sliced = with_prefix(windows, docs).withColumn(
        "slice", F.pmod(F.xxhash64("window"), F.lit(slices))
    )
    itself = docs.sparkSession.range(1).select(
        F.lit("").alias("window"),
        F.lit(0).alias("width"),
        F.array().cast("array<string>").alias("items"),
        F.lit(SELF).alias("token"),
        F.lit(0).alias("offset"),
        F.lit(0).cast("bigint").alias("slice"),
    )
    sought = sliced.unionByName(itself)
    words = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words")
    )
    each = words.select(
        "doc_id",
        "text_hash",
        "words",
        F.posexplode(F.array_append("words", F.lit(SELF))).alias("at", "word"),
    ).withColumn("token", F.lower("word"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("width") <= F.size("words"))
    # No lambda function here: one in a join's condition would keep the join, and with it the
    # exploded words, out of the generated code.
    there = F.array_join(F.slice("words", start + 1, F.col("width")), " ")
    same = _lowered(there) == F.col("window")
    hits = [
        each.join(F.broadcast(sought.where(F.col("slice") == k).drop("slice")), "token")
        .where((F.col("width") == 0) | (fits & same))
        .select(
            "doc_id",
            "text_hash",
            F.size("words").cast("bigint").alias("n_words"),
            F.when(F.col("width") > 0, F.struct(start.alias("start"), "width")).alias("span"),
            "items",
        )
        for k in range(slices)
    ]
    found = reduce(DataFrame.unionByName, hits)
    grouped = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("span").isNull(), 1)).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("hit")),
        lambda s, span: F.struct(
            F.greatest(s["reach"], span["start"] + span["width"]).alias("reach"),
            (
                s["hit"]
                + F.greatest(
                    F.lit(0),
                    span["start"] + span["width"] - F.greatest(s["reach"], span["start"]),
                )
            ).alias("hit"),
        ),
        lambda s: s["hit"],
    )
    return grouped.select(
        "doc_id", "text_hash", "n_words", hit.alias("n_hit"), "items", "copies"
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@own_columns
def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a word in a benchmark window."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (
        F.xxhash64(docs["text"]) == bad["bad_hash"]
    )
    return docs.join(bad, same, "left_anti")


OP3_SQL = r"""
with items as (
    select coalesce(cast(item_id as varchar), '') as item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
),
places as (
    select item, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p
    from items where len(w) > 0
),
wanted as (
    select distinct item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') as win from places
),
docs as (
    select row_number() over () as rid, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents
),
starts as (
    select rid, w, k, unnest(range(1, len(w) - k + 2)) as p
    from docs, (select distinct k from wanted) as sizes
    where len(w) >= k
),
hits as (
    select rid, s.k, p, item
    from (select rid, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as win
          from starts) as s
    join wanted using (win, k)
),
words_hit as (
    select rid, count(distinct q) as n_hit
    from (select rid, unnest(range(p, p + k)) as q from hits) as x group by rid
),
items_hit as (
    select rid, count(*) as n_items, string_agg(item, ',' order by item) as listed
    from (select distinct rid, item from hits) as y group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
    coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from docs left join words_hit using (rid) left join items_hit using (rid)
"""
