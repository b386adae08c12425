"""N-gram Jaccard join: documents whose sets of word shingles overlap almost wholly, as components.

1. One pass counts the shingles of all texts in a table of fixed size, which orders them from rare to
   common. Two sets above the threshold share one of the first few shingles of each in that order.
2. A second pass makes each text's set, its size, the first few shingles, and a bitmap: a bit for
   the hash of every shingle, four places or more per shingle. Equal sets become one node.
3. A tile is the nodes that share one such shingle. The nodes of a small tile are paired where their
   sizes allow it, at most 32 for each. Large tiles are cut by bands of size, and further into
   blocks, so that a task holds a bounded number of nodes, and only nodes of the same or
   neighbouring bands are compared. In a first round each node passes on a few pairs, the most
   similar ones, and what is paired counts as one for the rest of the tile; that ties large groups
   of near copies together. The second round passes on every pair of different components that is
   left. No pair is left out: what shares no tile, or is of bands further apart, cannot reach the
   threshold.
4. A comparison first counts bits: bits that one bitmap has and the other lacks are shingles the
   other set lacks, which bounds the overlap from above. Only pairs that pass have their texts
   fetched and their sorted sets intersected exactly.

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle are one shingle; repeated rows and copies have equal sets and so are one
component; a null id is never the smallest unless the component has no other; an empty table gives
no rows. Only the id and the text are read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import cut_lineage, give_back, kept, own_columns, table, workspace
from playtrail.llm.components import components
from playtrail.llm.passages import WordPrints, window_prints
from playtrail.llm.sampling import mixed

SHINGLE = 3
PERCENT = 90
TABLE_BITS = 22  # of the table that counts shingles
SEGMENTS = 64
BLOCK_ROWS = 2000  # nodes of a tile that are compared in one task with as many others
TASK_ROWS = 20_000  # rows of tiles that share a task
SMALL_TILE = 32  # nodes of a tile whose pairs may be joined as they are
SMALL_ROWS = 2_000_000  # ids that may be broadcast
TRIES = 4  # pairs that a node of a large tile is given in the first round

def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    prints = kept("word prints", WordPrints)
    lane = prints.lane(prints.numbers(words), 0)
    return np.unique(window_prints(lane, min(size, len(words)), 0))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold, exactly."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(hashes: np.ndarray) -> bytes:
    bits = 64
    while bits < 4 * len(hashes):
        bits *= 2
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(mixed(hashes) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """The bitmap of `words` 64-bit words that the same set would have had."""
    return np.bitwise_or.reduce(np.frombuffer(bits, dtype="<u8").reshape(-1, words), axis=0)


def slack(
    sizes_a: np.ndarray, bits_a: np.ndarray, sizes_b: np.ndarray, bits_b: np.ndarray, percent: int
) -> np.ndarray:
    """How far the bound of overlap is above what the threshold needs, pair by pair; a pair below 0
    is no link. The bitmaps' last axis holds their words, the others broadcast."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    most = np.minimum(sizes_a - only_a, sizes_b - only_b)
    return (100 + percent) * most - percent * (sizes_a + sizes_b)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )


def shingle_classes(texts: DataFrame, size: int) -> np.ndarray:
    """Of every slot of the counting table, the logarithm of its count over all texts. The table is
    the same size for any corpus: it tells apart what is common at that corpus's size."""
    slots = 1 << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counting no further than a byte in one task: it still orders the rare before the common.
        counts = np.zeros(slots, dtype=np.uint8)
        for batch in batches:
            for text in batch.column(0):
                slot = (shingles(text.as_py(), size) >> (64 - TABLE_BITS)).astype("i8")
                counts[slot] = np.maximum(counts[slot], counts[slot] + np.uint8(1))
        pieces = [
            zstandard.ZstdCompressor(level=1).compress(p.tobytes())
            for p in np.split(counts, SEGMENTS)
        ]
        yield pa.RecordBatch.from_pydict({"segment": list(range(SEGMENTS)), "counts": pieces})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(slots // SEGMENTS, dtype=np.int64)
        for piece in rows.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(piece), dtype="u1")
        levels = np.floor(2 * np.log2(total + 1)).astype(np.uint8).tobytes()
        return pa.table({"segment": rows.column("segment")[:1], "levels": pa.array([levels])})

    parts = texts.select("text").mapInArrow(count, "segment bigint, counts binary")
    merged = parts.groupBy("segment").applyInArrow(add, "segment bigint, levels binary")
    found = sorted((r[0], bytes(r[1])) for r in merged.collect())
    return np.frombuffer(b"".join(levels for _, levels in found) or bytes(slots), dtype=np.uint8)


SETS = (
    "doc_id bigint, text_hash bigint, n bigint, fingerprint binary, first array<bigint>, bits binary"
)


def document_sets(texts: DataFrame, classes: np.ndarray, percent: int, size: int) -> DataFrame:
    """Per text: size of its set, fingerprint of the set, its first shingles from rare to common, and
    its bitmap."""
    sent = texts.sparkSession.sparkContext.broadcast(classes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, prints, firsts, bits = [], [], [], []
                for text in batch.column(2):
                    found = shingles(text.as_py(), size)
                    n.append(len(found))
                    prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                    order = np.lexsort((found, levels[(found >> (64 - TABLE_BITS)).astype("i8")]))
                    need = len(found) - -(-percent * len(found) // 100) + 1 if n[-1] else 0
                    firsts.append(found[order[:need]].view(np.int64))
                    bits.append(bitmap(found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(n, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(firsts, pa.list_(pa.int64())),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n", "fingerprint", "first", "bits"],
                )
        give_back()

    return texts.mapInArrow(sets, SETS)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted to be small; otherwise left to an ordinary join."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _may_pass(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (`a`, `b`) that pass the bound of their bitmaps."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    light = nodes.select("node", "n", "bits").join(_bounded(ends), "node", "left_semi")
    sided = (
        pairs.join(light.toDF("a", "n_a", "bits_a"), "a").join(light.toDF("b", "n_b", "bits_b"), "b")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                words = min(len(x), len(y)) // 8
                passed.append(slack(m, folded(x, words), n, folded(y, words), percent) >= 0)
            chosen = pa.array(np.array(passed, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"]
            )
        give_back()

    ordered = sided.select("a", "b", "bits_a", "bits_b", "n_a", "n_b")
    return ordered.mapInArrow(keep, "a bigint, b bigint")


def verified(
    pairs: DataFrame, nodes: DataFrame, texts: DataFrame, path: str, percent: int, size: int
) -> DataFrame:
    """Stored pairs of nodes that are links: by bitmaps first, then by exact intersection."""
    spark = pairs.sparkSession
    _may_pass(pairs, nodes, percent).write.parquet(path)
    likely = spark.read.parquet(path)
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    wanted = nodes.join(_bounded(ends), "node", "left_semi").select(
        "node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")
    )
    same = texts["doc_id"].eqNullSafe(wanted["rep_id"]) & (
        texts["text_hash"] == wanted["rep_hash"]
    )
    found = texts.join(_bounded(wanted), same).select("node", "text").dropDuplicates(["node"])
    sided = likely.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [
                linked(shingles(x.as_py(), size), shingles(y.as_py(), size), percent)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            chosen = pa.array(chosen, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"]
            )
        give_back()

    return sided.select("a", "b", "text_a", "text_b").mapInArrow(keep, "a bigint, b bigint")


def _tile_pairs(rows: pa.Table, percent: int, tries: int | None) -> pa.Table:
    """Pairs of one task's tiles that pass the bound and are of different components. Rows of a
    tile's left block are compared with those of its right block, and with each other where both
    are the same block. With `tries` a row gets no more pairs than that, those of the highest bound,
    each with another component, and what is paired counts as one component from then on."""
    names = ("token", "band", "left", "right", "block", "own", "node", "n", "component")
    c = {name: rows.column(name).to_numpy() for name in names}
    bits = rows.column("bits").to_pylist()
    order = np.lexsort((c["right"], c["left"], c["band"], c["token"]))
    keys = np.column_stack([c[k][order] for k in ("token", "band", "left", "right")])
    cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
    found_a, found_b = [], []
    for tile in np.split(order, cuts):
        left = tile[c["block"][tile] == c["left"][tile[0]]]
        right = tile[c["block"][tile] == c["right"][tile[0]]]
        words = min(len(bits[i]) for i in tile) // 8
        of_right = np.array([folded(bits[i], words) for i in right])
        group = c["component"][tile]
        label = dict(zip(tile.tolist(), range(len(tile))))
        of_left = group[[label[i] for i in left.tolist()]]
        group_right = group[[label[i] for i in right.tolist()]]
        for k, i in enumerate(left):
            ok = group_right != of_left[k]
            # Two rows from the lower band meet in their own tile.
            ok &= c["own"][right] | c["own"][i]
            ok &= 100 * np.minimum(c["n"][right], c["n"][i]) >= percent * np.maximum(
                c["n"][right], c["n"][i]
            )
            some = right[ok]
            if len(some):
                mine = folded(bits[i], words)
                above = slack(c["n"][i], mine, c["n"][some], of_right[ok], percent)
                if tries is not None:
                    best = np.flatnonzero(ok)[np.argsort(-above, kind="stable")]
                    best = best[: (above >= 0).sum()]
                    some = []
                    while len(best) and len(some) < tries:
                        some.append(right[best[0]])
                        old, new = group_right[best[0]], of_left[k]
                        group_right[group_right == old] = new
                        of_left[of_left == old] = new
                        best = best[group_right[best] != new]
                    some = np.array(some, dtype=np.int64)
                else:
                    some = some[above >= 0]
                found_a.append(np.full(len(some), c["node"][i]))
                found_b.append(c["node"][some])
    a = np.concatenate(found_a) if found_a else np.zeros(0, dtype=np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def dealt_tiles(
    tiles: DataFrame, nodes: DataFrame, found: DataFrame, percent: int
) -> DataFrame:
    """The rows of tiles that hold different components, with their blocks and the `task` that
    compares them. Two blocks of a large tile are a task of their own; small tiles share tasks."""
    labelled = tiles.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    mixed_tiles = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("token")
    )
    rows = labelled.join(mixed_tiles, "token", "left_semi")
    # Somewhat wider than the threshold, so rounding never puts a pair two bands apart.
    width = -log(percent / 100 - 0.001) if percent > 1 else 1.0
    rows = rows.withColumn("band", F.floor(F.log("n") / width))
    rows = rows.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {"band": F.col("band") + F.col("up"), "own": F.col("up") == 0}
    )
    heights = rows.groupBy("token", "band").agg(
        F.count("*").alias("height"), F.max("own").alias("any_own")
    )
    rows = rows.join(heights.where("height > 1 and any_own"), ["token", "band"]).drop("any_own")
    blocks = F.ceil(F.col("height") / BLOCK_ROWS).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "own"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns(
        {"left": F.least("block", "other"), "right": F.greatest("block", "other")}
    )
    rows = rows.join(nodes.select("node", "bits"), "node")
    # A node of an uncut tile has two rows, one for each band.
    tasks = 1 + 2 * tiles.count() // TASK_ROWS
    place = F.xxhash64("token", "band", "left", "right")
    shared = F.pmod(place, F.lit(tasks))
    return rows.select(
        F.when(blocks > 1, place).otherwise(shared).alias("task"),
        "token", "band", "left", "right", "block", "own", "node", "n", "component", "bits",
    )


def tile_pairs(
    tiles: DataFrame, nodes: DataFrame, found: DataFrame, percent: int, tries: int | None = None
) -> DataFrame:
    """Pairs of different components that share a tile and pass the bound, all or `tries` a node.
    `tiles` has a row for each node of a tile, `found` the components so far; a node without one is
    a component of its own."""
    dealt = dealt_tiles(tiles, nodes, found, percent)

    def compare(rows: pa.Table) -> pa.Table:
        pairs = _tile_pairs(rows, percent, tries)
        give_back()  # the worker may wait while joins need the memory
        return pairs

    return dealt.groupBy("task").applyInArrow(compare, "a bigint, b bigint").distinct()


def component_members(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Per document: `doc_id`, `text_hash`, `n`, the size of its set, and `component`, a number of
    its component, null for an empty set."""
    spark = docs.sparkSession
    path = workspace(spark, "jaccard")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    texts = _texts(docs)
    sets = stored(document_sets(texts, shingle_classes(texts, size), percent, size), "sets")
    nodes = sets.where("n > 0").groupBy("fingerprint").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        *(F.first(c).alias(c) for c in ("n", "first", "bits")),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tokens = nodes.select(F.explode("first").alias("token"), "node", "n")
    heights = tokens.groupBy("token").agg(F.count("*").alias("height")).where("height > 1")
    tiles = stored(tokens.join(heights, "token"), "tiles")
    # The nodes of a small tile meet by a join: at most SMALL_TILE partners for each.
    few = tiles.where(F.col("height") <= SMALL_TILE).select("token", "node", "n")
    met = few.join(few.toDF("token", "node_", "n_"), "token").where(
        (F.col("node") < F.col("node_"))
        & (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_"))
    )
    pairs = met.select(F.col("node").alias("a"), F.col("node_").alias("b"))
    many = tiles.where(F.col("height") > SMALL_TILE).select("token", "node", "n")
    alone = many.select("node", F.col("node").alias("component")).distinct()
    pairs = pairs.unionByName(tile_pairs(many, nodes, alone, percent, TRIES))
    pairs = stored(pairs.distinct(), "pairs1")
    whole = components(verified(pairs, nodes, texts, f"{path}/likely1", percent, size))
    rest = stored(tile_pairs(many, nodes, whole, percent), "pairs2")
    members = sets.join(nodes.select("fingerprint", "node"), "fingerprint", "left")
    members = members.join(whole, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    if not rest.isEmpty():
        links = verified(rest, nodes, texts, f"{path}/likely2", percent, size)
        # The links between what the first round tied together, if any is left.
        for end in ("a", "b"):
            tied = whole.toDF(end, "tied")
            links = links.join(tied, end, "left").withColumn(end, F.coalesce("tied", end))
            links = links.drop("tied")
        links = stored(links.where("a <> b").distinct(), "links2")
        if not links.isEmpty():
            merged = components(links).toDF("component", "merged")
            members = members.join(merged, "component", "left").withColumn(
                "component", F.coalesce("merged", "component")
            )
    return members.select("doc_id", "text_hash", "n", "component")


def similar_documents(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """Per document: `doc_id`, `text_hash`, `n_shingles` and `component_id`, the smallest id that
    links reach from it, its own included."""
    members = component_members(docs, percent, size)
    least = members.where("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("component_id")
    )
    return members.join(least, "component", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


STAGE_PERCENT, STAGE_SHINGLE = 80, 5


@own_columns
def stage_jaccard_join(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the first by id, nulls last, then by the text's hash; of rows with
    the same id and text, the first by all columns as JSON. So repeated rows and copies with the same or a
    null id leave one row, and another text with the id of a removed row stays. Rows without words
    stay, repeated or not. Five words and a similarity of 0.8, as for all near-duplicate stages."""
    members = component_members(docs, STAGE_PERCENT, STAGE_SHINGLE).where("component is not null")
    rows = members.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = rows.groupBy("component").agg(F.min(place).alias("first"))
    judged = rows.join(firsts, "component").select(
        F.col("doc_id").alias("id_"),
        F.col("text_hash").alias("hash_"),
        (place == F.col("first")).alias("stays"),
        "times",
    )
    judged = cut_lineage(judged.where("not stays or times > 1"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(judged["id_"]) & (
        F.xxhash64(docs["text"]) == judged["hash_"]
    )
    single = docs.join(judged, same, "left_anti")
    repeated = docs.join(judged.where("stays"), same).groupBy("id_", "hash_")
    row = F.struct(*(docs[c] for c in docs.columns))
    # Maps have no order, their texts do.
    return single.unionByName(repeated.agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))


OP9_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
places AS (
    SELECT doc_id, w, least(len(w), 3) AS k, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p
    FROM docs WHERE len(w) > 0
),
shingles AS (SELECT DISTINCT doc_id, k, list_slice(w, p, p + k - 1) AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
),
reach AS (
    SELECT a, b FROM links
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
),
least_of AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
