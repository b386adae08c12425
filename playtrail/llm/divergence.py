"""Divergence of sources: how differently the sources of a language use its common terms.

Three steps over all documents:

1. Document frequencies, exact: each task sums them for the distinct terms of its documents, the
   sums are added by (lang, term), and a language keeps the terms of at least `MIN_DOCS` documents.
2. The kept terms of a language are dealt to shards by a hash, and every shard gets a minimal
   perfect hash that stores its keys. The hashes are broadcast in portions of at most `MAX_KEYS`
   keys, so their size is bounded however many terms are kept; each portion is one more pass.
3. A second pass looks the terms of each document up, verifies them against the stored keys and
   adds their occurrences to dense slots of the (lang, source) group. A task hands its slots on when
   they fill `SLOT_BYTES`; the sums are added by (lang, source, shard, slot), so no group, however
   hot, meets in one task.

The counts of one shard, all sources of its language, are then one small matrix. Whole-number
probabilities, differences of every pair of sources and of each source from its language are
computed there and summed over the shards; each shard offers its best terms, ties included.

A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Defined
results: null text, lang and source count as ''; an empty text has no terms but its group occurs;
repeated rows count again, in document frequencies too; a language without kept terms has value 0
for each pair and no terms; ties in rank go by the bytes of the item; an empty table gives no rows.
Other columns are not read. No conversion to floating point takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrail.llm.common import kept, table, workspace
from playtrail.llm.perfect_hash import PerfectHash, build
from playtrail.llm.tally import counted_batches, tallies

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 10**9
MAX_KEYS = 4_000_000
SHARD_KEYS = 20_000
CELLS = 4_000_000  # counters of one shard's matrix: slots times sources
LIMIT = 250_000  # terms a task counts before it hands its sums on
SLOT_BYTES = 64 << 20
JVM_SEED = 42  # of Spark's xxhash64

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TO_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTERS else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in order."""
    return (text or b"").translate(_TO_TERMS).split()


def _texts(docs: DataFrame) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*named, F.col("text").cast("binary").alias("text"))


def _doc_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        (lang, set(terms(text.as_py())))
        for batch in batches
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"))
    )
    yield from counted_batches(tallies(rows, LIMIT), "lang", "term", pa.binary())


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that stand in at least `min_docs` documents of the language."""
    found = _texts(docs).select("lang", "text")
    partial = found.mapInArrow(_doc_frequencies, "lang string, term binary, n bigint")
    summed = partial.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= min_docs).select("lang", "term")


def _hashed(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per shard: its displacements and its keys in order of their slots."""
    made = build(rows.column("term").to_pylist())
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()], pa.string()),
            "shard": pa.array([key[1].as_py()], pa.int64()),
            "displaced": pa.array([made.displaced.tobytes()], pa.binary()),
            "keys": pa.array([made.keys.tobytes()], pa.binary()),
            "ends": pa.array([made.ends.tobytes()], pa.binary()),
            "n_apart": pa.array([len(made.apart)], pa.int64()),
            "n_keys": pa.array([made.size], pa.int64()),
        }
    )


def _read_hash(displaced: bytes, keys: bytes, ends: bytes, n_apart: int) -> PerfectHash:
    made = PerfectHash(
        np.frombuffer(displaced, dtype=np.int64),
        np.frombuffer(keys, dtype=np.uint8),
        np.frombuffer(ends, dtype=np.int64),
    )
    if n_apart:
        first = made.size - n_apart
        made.apart.update((t, first + i) for i, t in enumerate(made.terms()[first:]))
    return made


class Hashes:
    """The perfect hashes of a portion of shards by language."""

    def __init__(self, rows: list[tuple], shards: dict[str, int]):
        self.shards = shards
        self.by_lang: dict[str, dict[int, PerfectHash]] = {}
        for lang, shard, *parts in rows:
            self.by_lang.setdefault(lang, {})[shard] = _read_hash(*parts)

    def counted(self, lang: str, counter: dict) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Shard, its size, slots and counts of the kept terms among the counted ones."""
        mine = self.by_lang.get(lang)
        if not mine:
            return
        words = list(counter)
        counts = np.fromiter(counter.values(), dtype=np.int64, count=len(words))
        joined = b"".join(xxhash.xxh64_digest(w, JVM_SEED) for w in words)
        shard_of = np.frombuffer(joined, dtype=">i8").astype(np.int64) % self.shards[lang]
        order = np.argsort(shard_of, kind="stable")
        cuts = np.searchsorted(shard_of[order], np.arange(self.shards[lang] + 1))
        for shard, hashed in mine.items():
            own = order[cuts[shard] : cuts[shard + 1]]
            if len(own):
                slots = hashed.slots([words[i] for i in own.tolist()])
                known = slots >= 0
                yield shard, hashed.size, slots[known], counts[own][known]


RECOUNTED = "lang string, source string, shard bigint, slots array<int>, counts array<bigint>"


def _slot_batch(dense: dict) -> pa.RecordBatch:
    found = [(*key, np.flatnonzero(counts), counts) for key, counts in dense.items()]
    lang, source, shard, slots, counts = zip(*found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang, pa.string()),
            pa.array(source, pa.string()),
            pa.array(shard, pa.int64()),
            pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())),
            pa.array([c[s] for s, c in zip(slots, counts)], pa.list_(pa.int64())),
        ],
        names=["lang", "source", "shard", "slots", "counts"],
    )


def _recount(name: str, sent, limit: int, slot_bytes: int):
    """Mapper of texts to the occurrences of kept terms by group, shard and slot."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept(("hashes", name), lambda: Hashes(*sent.value))
        rows = (
            ((lang, source), terms(text.as_py()))
            for batch in batches
            for lang, source, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            )
        )
        dense: dict[tuple, np.ndarray] = {}
        held = 0
        for (lang, source), counter in tallies(rows, limit):
            for shard, size, slots, counts in hashes.counted(lang, counter):
                own = dense.get((lang, source, shard))
                if own is None:
                    own = dense[lang, source, shard] = np.zeros(size, dtype=np.int64)
                    held += own.nbytes
                own[slots] += counts
                if held > slot_bytes:
                    yield _slot_batch(dense)
                    dense, held = {}, 0
        if dense:
            yield _slot_batch(dense)

    return over


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for whole numbers with counts <= total, digit by digit, so
    that no product outgrows 64 bits."""
    found, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // total, rest % total
    return found + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def _compared(top: int, kept_by_lang):
    """Function over one shard: the counts of its slots by source, the keys, and all sources of the
    language with their totals. Gives the pairs' sums and each source's best terms."""

    def over(key: tuple, counted: pa.Table, known: pa.Table) -> pa.Table:
        lang, n_kept = key[0].as_py(), kept_by_lang.value[key[0].as_py()]
        is_group = np.array(known.column("source").is_valid())
        groups = known.filter(pa.array(is_group))
        names, totals = groups.column("source").to_pylist(), np.array(groups.column("n_terms"))
        shard = known.filter(pa.array(~is_group)).slice(0, 1)
        ends = np.frombuffer(shard.column("ends")[0].as_py(), dtype=np.int64)
        counts = np.zeros((len(names), len(ends)), dtype=np.int64)
        number = {name: i for i, name in enumerate(names)}
        row = np.array([number[s] for s in counted.column("source").to_pylist()], dtype=np.int64)
        counts[row, np.array(counted.column("slot"), dtype=np.int64)] = np.array(counted.column("n"))
        p = shares(counts + 2, (totals + 2 * n_kept)[:, None])
        out = []
        for i in range(len(names)):
            value = gaps(p[i], p[i + 1 :]).sum(axis=1).tolist()
            for j, v in zip(range(i + 1, len(names)), value):
                out += [("pair", names[i], names[j], v), ("pair", names[j], names[i], v)]
        q = shares(counts.sum(axis=0) + 2, totals.sum() + 2 * n_kept)
        keys = shard.column("keys")[0].as_py()
        first = np.concatenate([[0], ends[:-1]])
        for i, name in enumerate(names):
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = gaps(p[i][more], q[more])
            if len(value) > top:
                least = np.partition(value, len(value) - top)[len(value) - top]
                more, value = more[value >= least], value[value >= least]
            for slot, v in zip(more.tolist(), value.tolist()):
                out.append(("term", name, keys[first[slot] : ends[slot]].decode("utf-8", "replace"), v))
        part, source, item, value = zip(*out) if out else ([], [], [], [])
        return pa.table(
            {
                "lang": pa.array([lang] * len(out), pa.string()),
                "source": pa.array(source, pa.string()),
                "part": pa.array(part, pa.string()),
                "item": pa.array(item, pa.string()),
                "value": pa.array(value, pa.int64()),
            }
        )

    return over


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    max_keys: int = MAX_KEYS,
    shard_keys: int = SHARD_KEYS,
    limit: int = LIMIT,
    slot_bytes: int = SLOT_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of `docs` (text, lang, source)."""
    spark = docs.sparkSession
    path = workspace(spark, "divergence")
    texts = _texts(docs)
    texts.select("lang", "source").distinct().write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    kept_terms(docs, min_docs).write.parquet(f"{path}/kept")
    kept_rows = spark.read.parquet(f"{path}/kept")

    # One row per language that keeps a term.
    sizes = {
        lang: (n_kept, n_sources)
        for lang, n_kept, n_sources in kept_rows.groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_kept"))
        .join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")), "lang")
        .collect()
    }
    shards = {
        lang: -(-n_kept // max(256, min(shard_keys, CELLS // n_sources)))
        for lang, (n_kept, n_sources) in sizes.items()
    }
    every = groups.select("lang", "source")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = every.join(other, "lang").where(F.col("source") != F.col("item"))
    if sizes:
        found = _compared_shards(
            spark, path, texts, groups, kept_rows, sizes, shards, top, max_keys, limit, slot_bytes
        )
        summed = found.where("part = 'pair'").groupBy("lang", "source", "item")
        pairs = pairs.join(
            summed.agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left"
        )
        best = found.where("part = 'term'")
    else:
        pairs = pairs.withColumn("value", F.lit(None).cast("bigint"))
        best = None
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    result = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    ).withColumn("rank", F.row_number().over(by_value))
    if best is not None:
        ranked = best.select("lang", "source", "part", "item", "value")
        ranked = ranked.withColumn("rank", F.row_number().over(by_value))
        result = result.unionByName(ranked.where(F.col("rank") <= top))
    return result


def _compared_shards(
    spark, path, texts, groups, kept_rows, sizes, shards, top, max_keys, limit, slot_bytes
) -> DataFrame:
    number = F.create_map(*(F.lit(x) for item in shards.items() for x in item))
    (
        kept_rows.withColumn("shard", F.pmod(F.xxhash64("term"), number[F.col("lang")].cast("bigint")))
        .groupBy("lang", "shard")
        .applyInArrow(
            _hashed,
            "lang string, shard bigint, displaced binary, keys binary, ends binary, "
            "n_apart bigint, n_keys bigint",
        )
        .write.parquet(f"{path}/hashes")
    )
    hashes = spark.read.parquet(f"{path}/hashes")
    heights = hashes.select("lang", "shard", "n_keys").orderBy("lang", "shard").collect()
    portions: list[list] = []
    room = 0
    for lang, shard, n_keys in heights:
        if not portions or room < n_keys:
            portions.append([])
            room = max_keys
        portions[-1].append((lang, shard))
        room -= n_keys
    for at, portion in enumerate(portions):
        place = F.struct("lang", "shard")
        low, high = (
            F.struct(F.lit(a).alias("lang"), F.lit(b).cast("bigint").alias("shard"))
            for a, b in (portion[0], portion[-1])
        )
        rows = hashes.where((place >= low) & (place <= high)).drop("n_keys").collect()
        sent = spark.sparkContext.broadcast(
            ([(r[0], r[1], *(bytes(x) for x in r[2:5]), r[5]) for r in rows], shards)
        )
        counted = texts.mapInArrow(_recount(f"{path}/{at}", sent, limit, slot_bytes), RECOUNTED)
        counted.write.parquet(f"{path}/recounted/portion={at}")
        sent.unpersist()
    recounted = spark.read.schema(RECOUNTED).parquet(
        *(f"{path}/recounted/portion={at}" for at in range(len(portions)))
    )
    slots = recounted.select(
        "lang", "source", "shard", F.inline(F.arrays_zip("slots", "counts")).alias("slot", "n")
    )
    summed = slots.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
    summed.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_terms"))
    known = groups.join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n_terms", F.lit(0)).alias("n_terms")
    )
    empty = F.lit(None).cast("binary")
    sides = hashes.select("lang", "shard").join(known, "lang").select(
        "lang", "shard", "source", "n_terms", empty.alias("keys"), empty.alias("ends")
    ).unionByName(
        hashes.select(
            "lang",
            "shard",
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("bigint").alias("n_terms"),
            "keys",
            "ends",
        )
    )
    kept_by_lang = spark.sparkContext.broadcast({lang: n for lang, (n, _) in sizes.items()})
    compared = (
        counts.groupBy("lang", "shard")
        .cogroup(sides.groupBy("lang", "shard"))
        .applyInArrow(
            _compared(top, kept_by_lang),
            "lang string, source string, part string, item string, value bigint",
        )
    )
    compared.write.parquet(f"{path}/compared")
    return spark.read.parquet(f"{path}/compared")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               AS text
    FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (
    SELECT r, lang, source,
           unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
),
kept AS (
    SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM words)
    GROUP BY lang, term HAVING count(*) >= 10
),
width AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
here AS (
    SELECT w.lang, w.source, w.term, count(*) AS n
    FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
),
p AS (
    SELECT c.lang, c.source, c.term, c.n,
           1 + 1000000000::HUGEINT * (c.n + 2)
               // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * w.v)::HUGEINT AS p
    FROM cells c JOIN width w ON c.lang = w.lang
),
whole AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
q AS (
    SELECT x.lang, x.term,
           1 + 1000000000::HUGEINT * (x.n + 2)::HUGEINT
               // (sum(x.n) OVER (PARTITION BY x.lang) + 2 * w.v)::HUGEINT AS q
    FROM whole x JOIN width w ON x.lang = w.lang
),
gap AS (
    SELECT a.lang, a.source, b.source AS item,
           sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gap g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
),
term AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item,
           (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
