"""Clustering from the command line, and settings by the names that configuration files use.

    python -m readlake.plans.command -I reads.txt -L 152 -O found --stat

Reads are `id seq` lines, FASTA or FASTQ, by the ending of the path. With --align cores are corrected and looked up again, which is done in batch;
else clustering keeps the order of the ids in each prefix.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators import cluster, metrics
from readlake.operators.cluster import ClusterConfig
from readlake.session import keep, session
from readlake.sources import sinks, text

#: Fixed names of configuration files, with their fixed defaults.
DEFAULTS = {
    "read_len": 152, "end_tree_len": 15, "other_tree_len": 15, "other_tree_nums": 2, "thd_tree_loc": 40, "four_tree_loc": 40, "Vertical_drift": 2,
    "Horizontal_drift": 3, "tree_threshold": 10, "now_clust_threshold": 8, "tag_nums": 1, "processes_nums": 0, "Cluster_size_threshold": 1,
    "h_index_nums": 0, "e_index_nums": 0, "read_len_min": 0, "align_fuc": False, "mmr_mode": False, "Virtual_mode": True, "fast_mode": True,
    "tag_mode": False, "Statistical_model": False, "same_tree_len": True, "now_align_alg": False,
}
#: Spark reads and spills as it needs to, so that the modes that trade memory for speed make no difference.
WITHOUT_EFFECT = {"fast_mode"}
MISSING = 5  # bases that a read may lack if read_len_min is 0


@dataclass(frozen=True)
class Settings:
    """tags: how many true tags there are, if known; tagged: read ids are true tags; align: correct cores, all_reads: by reads of any length too."""

    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    align: bool = False
    all_reads: bool = False
    tagged: bool = True
    statistics: bool = False
    tags: int | None = None
    source: str | None = None
    output: str | None = None


def settings_of(named: Mapping[str, object]) -> Settings:
    """From names of a configuration file; values may be text. Names that are unknown are an error."""
    if unknown := set(named) - set(DEFAULTS) - {"input_path", "output_file"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    s = DEFAULTS | {k: _typed(v, DEFAULTS.get(k)) for k, v in named.items()}
    low = s["mmr_mode"]
    config = ClusterConfig(
        length=s["read_len"], depth=s["end_tree_len"], inner_depth=s["end_tree_len"] if s["same_tree_len"] and "other_tree_len" not in named else s["other_tree_len"],
        inner_slots=s["other_tree_nums"], inner_head=s["thd_tree_loc"], inner_tail=s["four_tree_loc"], drift=s["Vertical_drift"],
        near=min(s["Horizontal_drift"], s["tree_threshold"]), far=min(s["now_clust_threshold"], s["tree_threshold"]), head_skip=s["h_index_nums"], tail_skip=s["e_index_nums"],
        min_slack=s["read_len"] - s["read_len_min"] if s["read_len_min"] else MISSING, prefix=s["processes_nums"], least=s["Cluster_size_threshold"] + 1 if s["Virtual_mode"] and not low else 1,
    )
    return Settings(config, s["align_fuc"] and not low, s["now_align_alg"], s["Virtual_mode"] and not low, s["Statistical_model"] and not low, s["tag_nums"] if s["tag_mode"] else None, named.get("input_path"), named.get("output_file"))


def _typed(value: object, like: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).lower() == "true"
    return int(value) if isinstance(like, int) else value


def flags(argv: list[str]) -> Settings:
    """From command line flags, over those of a configuration file (-C), if any."""
    parser = argparse.ArgumentParser(description="cluster reads by their anchors", argument_default=argparse.SUPPRESS)
    for flag, name, help_ in (
        ("-I", "input_path", "reads"), ("-L", "read_len", "length of a read"), ("-D", "end_tree_len", "length of anchors"), ("-V", "Vertical_drift", "places that inner anchors move"),
        ("-H", "Horizontal_drift", "differences that do not join any more"), ("-T", "tag_nums", "number of true tags"), ("-P", "processes_nums", "bases of the prefix that tells partitions apart"),
        ("-O", "output_file", "folder of assignments"), ("-C", "config", "JSON with remarks"),
    ):
        parser.add_argument(flag, dest=name, help=help_)
    for flag, name, value in (("--align", "align_fuc", True), ("--no-fast", "fast_mode", False), ("--no-tag", "Virtual_mode", False), ("--stat", "Statistical_model", True), ("--low", "mmr_mode", True)):
        parser.add_argument(flag, dest=name, action="store_const", const=value)
    found = vars(parser.parse_args(argv))
    named = {}
    if path := found.pop("config", None):
        with open(path) as f:
            named = json.loads("".join(x for x in f if not x.strip().startswith("//")))
    if "tag_nums" in found:
        found["tag_mode"] = True
    return settings_of(named | found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """read_id (a number in order of the file), name, seq."""
    if path.endswith((".fasta", ".fa", ".fastq", ".fq")):
        rows = (text.read_fasta if path.endswith(("a",)) else text.read_fastq)(spark, path)
        return rows.select(F.xxhash64("name").alias("read_id"), "name", "seq")
    return text.read_tagged(spark, path).select(F.col("line_no").alias("read_id"), F.col("tag").alias("name"), "seq")


def run(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Assignments (read_id, name, cluster_id, founder) and one row of numbers: n_reads, n_clusters, and, where names are tags, accuracy, and, where their number is known, coverage and redundancy."""
    reads = keep(read(spark, settings.source))
    if settings.align:
        found, _ = cluster.cluster_corrected(reads, settings.cluster, slots="abcd"[: 2 + settings.cluster.inner_slots], whole_only=not settings.all_reads)
        found = cluster.large(found, settings.cluster.least)
    else:
        found = cluster.online(reads, settings.cluster).where("cluster_id IS NOT NULL").select("read_id", "cluster_id")
    names = reads.select("read_id", "name")
    found = keep(found.join(names, "read_id").join(names.toDF("cluster_id", "founder"), "cluster_id").select("read_id", "name", "cluster_id", "founder"))
    columns = [F.count("*").alias("n_reads"), F.count_distinct("cluster_id").alias("n_clusters")]
    if settings.tags:
        columns += [(F.count_distinct("founder") / settings.tags).alias("coverage"), ((F.count_distinct("cluster_id") - settings.tags) / settings.tags).alias("redundancy")]
    numbers = found.agg(*columns)
    if settings.tagged:
        numbers = numbers.crossJoin(metrics.purity(metrics.contingency(found.select("cluster_id", "name"), "cluster_id", "name")).toDF("accuracy"))  # one row each
    return found, numbers


def main(argv: list[str] | None = None) -> None:
    import sys

    settings = flags(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.getActiveSession() or session()
    found, numbers = run(spark, settings)
    if settings.output:
        sinks.write_assignments(found.where("read_id <> cluster_id").select(F.col("name").alias("read_id"), F.col("founder").alias("cluster_id")), settings.output)
    for r in metrics.report(numbers).collect():  # a line for each number
        print(r["value"])


if __name__ == "__main__":
    main()
