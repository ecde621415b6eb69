"""Clustering quality from the contingency table (pred, truth, n). One aggregation over the reads feeds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """(pred, truth, n) of rows where both are known."""
    known = rows.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    return known.groupBy(F.col(pred).alias("pred"), F.col(truth).alias("truth")).agg(F.count("*").alias("n"))


def majorities(table: DataFrame) -> DataFrame:
    """(pred, truth, best, size): the commonest truth of each cluster, ties to the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("truth").alias("truth")))
    return table.groupBy("pred").agg(best.alias("b"), F.sum("n").alias("size")).select("pred", F.col("b.truth").alias("truth"), (-F.col("b.m")).alias("best"), "size")


def purity(table: DataFrame) -> DataFrame:
    return majorities(table).agg((F.sum("best") / F.sum("size")).alias("purity"))


def purity_macro(table: DataFrame) -> DataFrame:
    return majorities(table).agg(F.avg(F.col("best") / F.col("size")).alias("purity_macro"))


def micro_accuracy(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """Share of reads whose truth is the majority of their cluster, counted read by read."""
    won = majorities(contingency(rows, pred, truth)).select(F.col("pred").alias(pred), F.col("truth").alias("won"))
    known = rows.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    return known.join(won, pred).agg(F.avg((F.col(truth) == F.col("won")).cast("double")).alias("micro_accuracy"))


def recovery_rate(table: DataFrame, all_truths: DataFrame | None = None) -> DataFrame:
    """Distinct majority truths over distinct truths: those of the table, or all of a truth file (column truth)."""
    found = majorities(table).agg(F.count_distinct("truth").alias("found"))
    there = (table if all_truths is None else all_truths).agg(F.count_distinct("truth").alias("there"))
    return found.crossJoin(there).select((F.col("found") / F.col("there")).alias("recovery_rate"))  # one row each


def recall_at_cluster(table: DataFrame) -> DataFrame:
    """Mean over truths of the share of its reads that lie in clusters with that majority."""
    right = table.join(majorities(table).select("pred", F.col("truth").alias("won")), "pred")
    each = right.groupBy("truth").agg((F.sum(F.when(F.col("truth") == F.col("won"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    return each.agg(F.avg("r").alias("recall_at_cluster"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _sides(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.groupBy("pred").agg(F.sum("n").alias("a")), table.groupBy("truth").agg(F.sum("n").alias("b"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """(X - A B / T) / ((A + B) / 2 - A B / T); 1 where the denominator is 0."""
    rows, columns = _sides(table)
    x = table.agg(F.sum(_pairs(F.col("n"))).alias("x"), _pairs(F.sum("n")).alias("t"))
    all_ = x.crossJoin(rows.agg(F.sum(_pairs(F.col("a"))).alias("a"))).crossJoin(columns.agg(F.sum(_pairs(F.col("b"))).alias("b")))  # one row each
    expected = F.when(F.col("t") > 0, F.col("a") * F.col("b") / F.when(F.col("t") > 0, F.col("t"))).otherwise(0.0)
    below = (F.col("a") + F.col("b")) / 2 - expected
    return all_.select(F.when(below == 0, 1.0).otherwise((F.col("x") - expected) / F.when(below != 0, below)).alias("ari"))


def normalised_information(table: DataFrame) -> DataFrame:
    """MI over the mean of both entropies, natural logarithm; 1 if both entropies are 0."""
    rows, columns = _sides(table)
    whole = table.agg(F.sum("n").cast("double").alias("t"))
    h = lambda df, x, name: df.crossJoin(whole).agg((-F.sum(F.col(x) / F.col("t") * F.ln(F.col(x) / F.col("t")))).alias(name))
    joined = table.join(rows, "pred").join(columns, "truth").crossJoin(whole)
    mi = joined.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    all_ = mi.crossJoin(h(rows, "a", "ha")).crossJoin(h(columns, "b", "hb"))  # one row each
    mean = (F.col("ha") + F.col("hb")) / 2
    return all_.select(F.when(mean == 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / F.when(mean != 0, mean)).alias("nmi"))


def by_size(table: DataFrame, sizes: DataFrame, cuts: tuple[int, ...] = (1, 5, 50)) -> DataFrame:
    """(stratum, n_clusters, n_reads, purity) by the initial size of clusters (pred, initial)."""
    joined = majorities(table).join(sizes, "pred")
    stratum = F.lit(f">{cuts[-1]}")
    for cut in reversed(cuts):
        stratum = F.when(F.col("initial") <= cut, f"<={cut}").otherwise(stratum)
    return joined.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_reads"), (F.sum("best") / F.sum("size")).alias("purity"))


def bundle(table: DataFrame) -> DataFrame:
    """All metrics in one row."""
    counts = table.agg(F.count_distinct("pred").alias("n_pred_clusters"), F.count_distinct("truth").alias("n_gt_clusters"), F.sum("n").alias("n_evaluated_reads"))
    micro = purity(table).select(F.col("purity").alias("micro_accuracy"))
    out = counts
    for part in (purity(table), micro, recovery_rate(table), recall_at_cluster(table), adjusted_rand(table), normalised_information(table)):
        out = out.crossJoin(part)  # one row each
    return out


def tagged(rows: DataFrame, cluster: str, tag: str, founder: str, min_size: int = 1) -> DataFrame:
    """Accuracy, coverage and redundancy when reads carry true tags; the tag that counts is the founder's (the least `founder`)."""
    each = rows.groupBy(cluster, tag).agg(F.count("*").alias("n"), F.min(founder).alias("f"))
    each = each.groupBy(cluster).agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.min_by(tag, "f").alias("own"))
    big = each.where(F.col("size") > min_size).agg(F.sum("size").alias("n_reads"), F.sum(F.col("size") - F.col("most")).alias("n_errors"), F.count("*").alias("n_clusters"), F.count_distinct("own").alias("n_tags"))
    there = rows.agg(F.count_distinct(tag).alias("n_true"))
    out = big.crossJoin(there)  # one row each
    return out.select("n_reads", "n_errors", "n_clusters", "n_tags", ((F.col("n_reads") - F.col("n_errors")) / F.col("n_reads")).alias("accuracy"), (F.col("n_tags") / F.col("n_true")).alias("coverage"), ((F.col("n_clusters") - F.col("n_true")) / F.col("n_true")).alias("redundancy"))


def change_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of reads (read_id, label) with a label on both sides whose label changed."""
    both = before.select("read_id", F.col("label").alias("old")).join(after.select("read_id", F.col("label").alias("new")), "read_id").where("old >= 0 AND new >= 0")
    return both.agg(F.avg((F.col("old") != F.col("new")).cast("double")).alias("label_change_rate"))


def finite(x: Column) -> Column:
    """The number, or 0 where it is null, not a number or infinite."""
    x = x.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def finite_history(values: Column) -> Column:
    """A history of numbers, each finite; [0.0] where there is none."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.transform(values, finite)).otherwise(F.array(F.lit(0.0)))


def round_summary(state: DataFrame, refined: DataFrame, records: DataFrame, delta: DataFrame, number: int) -> DataFrame:
    """One row for a round's log: reads, reads kept safe, reassigned and dirty, clusters, mean strength, mean share of confident reads, radius."""
    status = lambda *names: F.count_if(F.col("status").isin(*names))
    moves = refined.agg(F.count("*").alias("total_reads"), status("safe").alias("zone1_safe"), status("moved", "confirmed").alias("zone2_reassigned"), status("dirty").alias("zone3_dirty"))
    shares = records.where("num_reads > 0").agg(F.avg(F.col("num_high_conf") / F.col("num_reads")).alias("avg_hc_ratio"))
    out = moves.crossJoin(records.agg(F.count("*").alias("final_clusters"))).crossJoin(state.agg(F.avg("strength").alias("avg_strength"))).crossJoin(shares).crossJoin(delta)  # one row each
    return out.select(F.lit(number).alias("round"), "total_reads", "zone1_safe", "zone2_reassigned", "zone3_dirty", "final_clusters", "avg_strength", F.coalesce("avg_hc_ratio", F.lit(0.0)).alias("avg_hc_ratio"), "delta")


def report(row: DataFrame) -> DataFrame:
    """(value): a text line `name: number` for each column of one row."""
    return row.select(F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in row.columns))).alias("value"))
