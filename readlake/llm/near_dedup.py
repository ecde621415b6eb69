"""MinHash near-dedup with tensored banding.

The set of a document is its distinct 5-word shingles, A-Z folded (a shorter text: the whole sequence). One pass takes, for each
set, two collections of m group keys of two minhashes each; tables are all pairs of a key of the first collection with one of the
second, so that m * m tables of four minhashes cost 4 * m minhash functions, not 4 * m * m. Two sets of similarity s meet in some
table with probability (1 - (1 - s^2)^m)^2: with m = 8, 0.99993 at 0.85; with m = 10, 0.99993 at 0.80.

Equal sets are one class, found by a 128-bit fingerprint with map-side combine; only its smallest doc_id goes on. Links are
verified exactly on full sets. Groups of near copies are not expanded into pairs. In a first round every class meets the smallest doc_id of
its buckets, in a second the class there with the smallest share of shingles of its own, each only if it is of another component
yet; verified links are merged by alternating large and small stars, in Spark, from checkpoint to checkpoint. Classes that still
share buckets with other components, and could have a partner there at all, are joined by exact prefix and position filters over their
shingles, and what comes out is verified. So no link is lost to the rounds, and unlinked near copies do not meet by all pairs.

Defined results: texts without words have an empty set and are linked with nothing. Rows that repeat a doc_id are one document
for linking. A null doc_id is smaller than all others and comes back as null. Empty tables give empty results. Columns besides doc_id
and text pass through keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import common as c

WIDTH, PERCENT, GROUPS, PARITY_WORDS = 5, 85, 8, 8
_NULL = np.iinfo(np.int64).min


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text, each text's in order; and where each text's begin (n + 1 long)."""
    words = c.Words(*c.text_bytes(texts), fold=True)
    hashes, begin = words.hashes(), c.window_starts(words, width)
    found, of = c.rolling(hashes, width)[begin] if len(begin) else np.zeros(0, np.uint64), words.doc()[begin]
    for k in range(1, width):
        short = np.flatnonzero(words.count == k)
        if len(short):
            whole = c.mix(c.rolling(hashes, k)[words.first[short]] + np.uint64(k))
            found, of = np.concatenate([found, whole]), np.concatenate([of, short])
    order = np.argsort(found)
    order = order[np.argsort(of[order], kind="stable")]
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(words.count) + 1))


def signatures(docs: DataFrame, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """doc_id (null as the least long), n_shingles, fa and fb (fingerprint of the set), ka and kb (group keys)."""
    rng = np.random.default_rng(5)
    seeds, odd = rng.integers(0, 1 << 63, 4 * groups, dtype=np.uint64), rng.integers(0, 1 << 63, 4 * groups, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                found, at = shingle_sets(part.column("text"), width)
                size = np.diff(at)
                full, begin = np.flatnonzero(size), at[:-1][size > 0]
                prints, keys = np.zeros((2, len(size)), np.uint64), np.zeros((len(size), 4 * groups), np.uint64)
                if len(full):
                    prints[0, full] = np.add.reduceat(c.mix(found), begin)
                    prints[1, full] = np.add.reduceat(c.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)) ^ found, begin)
                    for k in range(4 * groups):
                        x = (found ^ seeds[k]) * odd[k]
                        x ^= x >> np.uint64(32)
                        keys[full, k] = np.minimum.reduceat(x * c._M3, begin)
                pairs = c.mix(c.mix(keys[:, ::2] + np.uint64(1)) + keys[:, 1::2]).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), groups).cast(pa.list_(pa.int64())) for x in (pairs[:, :groups], pairs[:, groups:])]
                yield pa.record_batch([pa.array(c.ids_of(part.column("doc_id"))), pa.array(size, pa.int64()), *(pa.array(p.view(np.int64)) for p in prints), *lists], ["doc_id", "n_shingles", "fa", "fb", "ka", "kb"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fa long, fb long, ka array<long>, kb array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """id, packed: each text under compression, for the few that take part in verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch):
                data, at = c.text_bytes(part.column("text"))
                raw, pack = data.tobytes(), zstandard.ZstdCompressor(level=3, write_checksum=False).compress
                yield pa.record_batch([pa.array(c.ids_of(part.column("doc_id"))), pa.array([pack(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, packed binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.withColumnsRenamed({"id": "v", "packed": "pv"}), "v").join(texts.withColumnsRenamed({"id": "u", "packed": "pu"}), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in c.slices(batch, 1 << 19, "pv"):
                blobs: dict[bytes, int] = {}
                rows = [[blobs.setdefault(x, len(blobs)) for x in part.column(n).to_pylist()] for n in ("pu", "pv")]
                found, at = shingle_sets(pa.array([unpack(x) for x in blobs], pa.large_binary()).cast(pa.large_string()), width)
                sets = [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                ok = []
                for a, b in zip(*rows, strict=True):
                    small, large = sorted((len(sets[a]), len(sets[b])))
                    if 100 * small < percent * large or not small:
                        ok.append(False)
                        continue
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    ok.append(100 * common >= percent * (small + large - common))
                mask = pa.array(ok)
                yield pa.record_batch([part.column("u").filter(mask), part.column("v").filter(mask)], ["u", "v"])

    return both.select("u", "v", "pu", "pv").mapInArrow(run, "u long, v long")


def _is_stars(edges: DataFrame) -> bool:
    """Every u hangs on one v, and no v hangs on anything."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    return ends.groupBy("id").agg(F.sum("as_u").alias("as_u"), F.sum("as_v").alias("as_v")).where("as_u > 1 OR (as_u > 0 AND as_v > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (u, v): component is the smallest id reachable. Large and small stars take turns."""
    edges = c.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = c.cut(small.where("u != v").distinct())
        del both, least, large, down, small
        c.release(edges.sparkSession)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def classes_and_links(docs: DataFrame, percent: int = PERCENT, groups: int = GROUPS, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; classes (fa, fb, n_shingles, rep, n) of two rows or more; and (id, component) of the representatives with links."""
    sig = c.cut(signatures(docs, groups, width))
    # equal sets have equal group keys
    classes = sig.where("n_shingles > 0").groupBy("fa", "fb", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    own = c.cut(classes)
    classes = own.where("n > 1").drop("ka", "kb")
    pairs = F.array(*(F.xxhash64(F.lit(groups * i + j), F.get("ka", F.lit(i)), F.get("kb", F.lit(j))) for i in range(groups) for j in range(groups)))
    keys = own.select("rep", pairs.alias("keys")).select("rep", F.explode_outer("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    members = c.cut(keys.join(shared.select("key"), "key"))

    ids = members.select(F.col("rep").alias("id")).distinct()
    texts = c.cut(packed_texts(docs).join(ids, "id", "left_semi").distinct())
    del own, pairs, keys, shared
    c.release(docs.sparkSession)
    labels = ids.select("id", F.col("id").alias("component"))
    caps = held = None
    for turn in range(3):
        live = _mixed(members, labels, caps)
        if live.isEmpty():
            break
        if turn == 1:
            held = c.cut(held_shingles(live.select("id").distinct(), texts, width))
            caps = c.cut(partner_caps(held, percent))
            live = _mixed(members, labels, caps)
        if turn < 2:
            rank = F.struct(F.lit(0.0), F.col("id")) if not turn else F.struct(F.col("own"), F.col("id"))
            first = live.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("id"), F.col("component"))).alias("first"))
            met = live.join(first, "key").where(F.col("component") != F.col("first.component"))
            asked = met.groupBy(F.col("id").alias("v")).agg(F.min("first").alias("first")).select(F.col("first.id").alias("u"), "v")
            del first, met
        else:
            asked = prefix_pairs(live, held, percent)
        found = c.cut(verified(asked, texts, percent, width))
        if not found.isEmpty():
            labels = _merged(labels, found)
        del live, asked, found
        c.release(docs.sparkSession)
    return sig, classes, labels


def held_shingles(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, h, k): the shingles of these sets, and how many of these sets have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in c.slices(batch, 1 << 20, "packed"):
                found, at = shingle_sets(pa.array([unpack(x) for x in part.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string()), width)
                yield pa.record_batch([pa.array(np.repeat(part.column("id").to_numpy(), np.diff(at))), pa.array(found.view(np.int64))], ["id", "h"])

    rows = texts.join(ids, "id", "left_semi").mapInArrow(run, "id long, h long")
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("k")), "h")


def partner_caps(held: DataFrame, percent: int) -> DataFrame:
    """(id, n, alone, cap, own, parity): the size of each set, how many of its shingles no other set has (and their share), the greatest size
    that a partner can have, and a bitmap of whether an odd number of its shingles fall on each bit. If g shingles are shared at all,
    a link asks for percent * (n + size) <= (100 + percent) * g."""
    word, bit = F.pmod(F.shiftrightunsigned("h", 6), F.lit(PARITY_WORDS)), F.expr("shiftleft(1L, cast(h & 63 AS int))")
    parity = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"parity_{i}") for i in range(PARITY_WORDS)]
    sizes = held.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("alone"), *parity)
    cap = F.floor((F.col("n") - F.col("alone")) * (100 + percent) / percent).cast("long") - F.col("n")
    return sizes.select("id", "n", "alone", cap.alias("cap"), (F.col("alone") / F.col("n")).alias("own"), F.array(*(f"parity_{i}" for i in range(PARITY_WORDS))).alias("parity"))


def prefix_pairs(live: DataFrame, held: DataFrame, percent: int, seen: int = 16) -> DataFrame:
    """(u, v): all pairs of different components among these sets that can be linked, by exact prefix and position filters.

    Order the shingles of each set by how few sets have them. Linked sets meet in their prefixes: a set of n whose partners have at least
    m needs an overlap of percent * (n + m) / (100 + percent), so one shingle of the first n - overlap + 1 is shared. A pair also
    goes unless the places at which it meets leave room for the overlap and the bits in which the bitmaps differ, of which there are no more
    than shingles that only one of both has, leave it linked. A pair meets at its first common shingle only, as far as the
    first `seen` shingles of both tell: long near copies share hundreds. Near copies with edits of their own, in whatever number,
    have prefixes full of these edits and never meet; buckets would bring all of them together.
    """
    least = live.groupBy("key").agg(F.min("n").alias("m"))
    about = live.join(least, "key").groupBy("id").agg(F.min("m").alias("m"), F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("component").alias("component"), F.first("parity").alias("parity"))
    m = F.greatest(F.col("m"), F.ceil(F.col("n") * percent / 100).cast("long"))
    prefix = F.col("n") - F.ceil(percent * (F.col("n") + m) / (100 + percent)).cast("int") + 1 - F.col("alone")
    about = about.select("id", "n", "alone", "component", "parity", prefix.cast("int").alias("prefix")).where("prefix > 0")
    kept = held.where("k > 1").join(about.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("order"))
    rows = kept.join(about, "id").select("id", "n", "component", "parity", F.slice("order.h", 1, seen).alias("head"), F.posexplode_outer(F.slice("order", F.lit(1), F.col("prefix"))).alias("at", "token"), "alone")
    before = F.slice("head", F.lit(1), F.least("at", F.lit(seen))).alias("before")
    rows = c.cut(rows.where("token IS NOT NULL").select(F.col("token.h").alias("h"), "id", "n", "component", "parity", (F.col("n") - F.col("alone") - F.col("at")).alias("room"), before))
    other = rows.select("h", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"), F.col("room").alias("room_u"), F.col("before").alias("before_u"), F.col("parity").alias("parity_u"))
    fits = (100 + percent) * F.least("room", "room_u") >= percent * (F.col("n") + F.col("nu"))
    apart = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity_u", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    close, first = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("nu")), ~F.arrays_overlap("before", "before_u")
    return rows.join(other, "h").where((F.col("u") < F.col("id")) & (F.col("cu") != F.col("component")) & fits & close & first).select("u", F.col("id").alias("v")).distinct()


def _mixed(members: DataFrame, labels: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """key, id, component of the buckets that hold more than one component; with caps, of sets that can have a partner in the bucket."""
    rows = members.join(labels, members["rep"] == labels["id"]).select("key", "id", "component")
    if caps is not None:
        rows = rows.join(caps, "id")
        ends = rows.groupBy("key").agg(F.min("n").alias("least"), F.max("cap").alias("most"))
        rows = rows.join(ends, "key").where("cap >= least AND n <= most").drop("least", "most")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return c.cut(rows.join(mixed, "key"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after the links in found, merged between components."""
    up = found.join(labels.withColumnsRenamed({"id": "u", "component": "a"}), "u").join(labels.withColumnsRenamed({"id": "v", "component": "b"}), "v")
    moved = components(up.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return c.cut(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sig, classes, labels = classes_and_links(docs, percent, groups, width)
    rows = c.join_counted(sig.select("doc_id", "n_shingles", "fa", "fb"), classes, ["fa", "fb", "n_shingles"], "n", ["rep"], F.xxhash64("doc_id"))
    rows = rows.withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    back = lambda x: F.when(x != F.lit(int(_NULL)), x)
    component = F.coalesce("component", "rep")
    return rows.select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT, groups: int = GROUPS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all their columns."""
    gone = near_duplicates(docs, percent, groups).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(c.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * shared >= 85 * (m.n + n.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
