"""The seam between reads and refinement: a scorer turns (read_id, label, seq) into embedding, strength, u_epi, u_ale.

The default has no model: evidence of a place is pseudo-counts of the cluster's bases there, the embedding is the frequency of k-mers. It is
not numerically equal to a trained network, and nothing downstream depends on where the columns come from.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import vector as v
from readlake.functions.sequence import BASES
from readlake.session import keep

PIECE, BROADCAST_PIECES, KNOWN = 256, 1024, 1 + len(BASES)


class Scorer(Protocol):
    def __call__(self, reads: DataFrame) -> DataFrame: ...


def kmers(k: int) -> list[str]:
    """All words of k bases, in order."""
    return [a + b for a in kmers(k - 1) for b in BASES] if k else [""]


def kmer_counts(reads: DataFrame, k: int = 3) -> DataFrame:
    """(read_id, kmer, n)"""
    at = F.when(F.length("seq") >= k, F.sequence(F.lit(1), F.length("seq") - k + 1))
    rows = reads.select("read_id", F.explode_outer(F.transform(at, lambda i: F.substr("seq", i, F.lit(k)))).alias("kmer")).where("kmer IS NOT NULL")
    return rows.groupBy("read_id", "kmer").agg(F.count("*").alias("n"))


def _occurrences(seq: Column, word: str) -> Column:
    """How often a word of bases is in seq, overlaps included. One that can't overlap itself is counted by what its removal takes away."""
    if any(word[:b] == word[-b:] for b in range(1, len(word))):
        return F.regexp_count(seq, F.lit(f"{word[0]}(?={word[1:]})"))
    return (F.length(seq) - F.length(F.replace(seq, F.lit(word)))) / len(word)


def kmer_embedding(seq: Column, k: int = 2) -> Column:
    """Unit vector of k-mer frequencies; zero for shorter sequences."""
    known = F.coalesce(seq, F.lit(""))
    return v.unit(F.array(*(_occurrences(known, w).cast("double") for w in kmers(k))))


def _pieces(reads: DataFrame) -> DataFrame:
    """(read_id, label, piece, seq): sequences cut after every PIECE letters; most reads have one piece."""
    numbers = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int")))
    cut = reads.select("read_id", "label", "seq", F.explode(numbers).alias("piece"))
    return cut.select("read_id", "label", "piece", F.substr("seq", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("seq"))


def _profiles(reads: DataFrame) -> DataFrame:
    """(label, piece, s, e, a): strength and uncertainties of what a read may have at each place of a piece: no base, A, C, G, T, place by place."""
    places = reads.select("label", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    counts = places.groupBy("label", "pos").agg(F.count("*").alias("n"), *(F.count_if(F.col("base") == b).alias(b) for b in BASES))
    each_base = counts.select("label", "pos", "n", F.posexplode(F.array(F.lit(0).cast("long"), *BASES)).alias("known", "own"))
    against = (F.col("n") - F.col("own")) / (len(BASES) - 1) + 1
    alpha = F.array((F.col("own") + 1).cast("double"), *[against] * (len(BASES) - 1))
    at = (F.col("pos") % PIECE * KNOWN + F.col("known")).alias("at")
    scored = each_base.select("label", F.floor(F.col("pos") / PIECE).cast("int").alias("piece"), at, v.total(alpha).alias("s"), v.epistemic(alpha).alias("e"), v.aleatoric(alpha).alias("a"))
    # a piece has every place up to its longest read's end, so that the order of places is their index; PIECE * KNOWN entries at most
    whole = scored.groupBy("label", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "s", "e", "a"))).alias("p"))
    return whole.select("label", "piece", *(F.col(f"p.{c}").alias(c) for c in "sea"))


def default_scorer(reads: DataFrame, k: int = 2) -> DataFrame:
    """reads with embedding, strength, u_epi, u_ale, each read by its own bases.

    At a place of its cluster a read has evidence for its base from every read there that has it, and evidence against from the others, shared by the other
    bases: a base that most reads have is sure, one that few have is not. Letters other than A, C, G, T have no evidence for them.
    Counts per (label, place, base) come by aggregation with map-side combine; a read without bases scores as one place without evidence.
    Reads meet the profiles of their clusters in whole pieces and are cut into places after that, so that no read's places are shuffled; what is
    shuffled are counts of a task's clusters. Sums of a piece follow its places: copies in a cluster score alike. Profiles are kept and counted: few travel to the reads.
    """
    profiles = keep(_profiles(reads))
    few = profiles.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES
    met = _pieces(reads).join(F.broadcast(profiles) if few else profiles, ["label", "piece"])
    places = met.select("read_id", "s", "e", "a", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    at = F.col("pos") * KNOWN + F.instr(F.lit(BASES), F.col("base"))
    each = places.select("read_id", *(F.get(c, at).alias(c) for c in "sea")).groupBy("read_id").agg(F.avg("s").alias("strength"), F.avg("e").alias("u_epi"), F.avg("a").alias("u_ale"))
    none = F.array(*[F.lit(1.0)] * len(BASES))
    rows = reads.withColumn("embedding", kmer_embedding(F.col("seq"), k)).join(each, "read_id", "left")
    return rows.withColumns({"strength": F.coalesce("strength", v.total(none)), "u_epi": F.coalesce("u_epi", v.epistemic(none)), "u_ale": F.coalesce("u_ale", v.aleatoric(none))})
