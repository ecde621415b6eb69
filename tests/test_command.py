"""Settings by the names of configuration files, flags, and runs over files."""

import pytest
from test_stream_clusters import noisy

from readlake.plans import command
from readlake.sources import text


def test_names_and_flags(tmp_path):
    c = command.settings_of({"read_len": "117", "read_len_min": 100, "end_tree_len": 12, "other_tree_nums": 1, "Vertical_drift": 4, "Cluster_size_threshold": 3, "h_index_nums": 5, "e_index_nums": "6", "tree_threshold": 6, "thd_tree_loc": 30, "tag_mode": "true", "tag_nums": 9}).cluster
    assert (c.length, c.min_slack, c.depth, c.inner, c.inner_slots, c.drift, c.least, c.head_skip, c.tail_skip, c.far, c.inner_head) == (117, 17, 12, 12, 1, 4, 4, 5, 6, 6, 30)
    assert command.settings_of({"other_tree_len": 10}).cluster.inner == 10
    assert set(command.DEFAULTS) >= {"Statistical_model", "now_align_alg", "same_tree_len"} and len(command.DEFAULTS) == 24
    with pytest.raises(ValueError, match="unknown"):
        command.settings_of({"read_length": 3})
    (tmp_path / "c.json").write_text('{\n// a remark\n"read_len": 100, "Horizontal_drift": 2\n}')
    s = command.flags(["-C", str(tmp_path / "c.json"), "-I", "x.txt", "-H", "4", "-T", "7", "-P", "2", "--align", "--stat", "--no-tag"])
    assert (s.cluster.length, s.cluster.near, s.cluster.prefix, s.tags, s.align, s.statistics, s.tagged, s.source) == (100, 4, 2, 7, True, True, False, "x.txt")
    low = command.flags(["--low", "--align"])
    assert not low.align and not low.tagged and low.cluster.least == 1


@pytest.mark.parametrize("more", [[], ["--align"]])
def test_run_over_files(spark, tmp_path, capsys, more):
    rows = noisy(120, refs=4, seed=11, rate=0.01)
    path = tmp_path / "reads.txt"
    path.write_text("".join(f"r{i} {s}\n" for i, s in rows) + "broken\n")
    command.main(["-I", str(path), "-L", "150", "-O", str(tmp_path / "out"), "-T", "4", *more])
    said = dict(x.split(": ") for x in capsys.readouterr().out.strip().split("\n"))
    assert int(said["n_reads"]) > 100 and int(said["n_clusters"]) >= 4 and "accuracy" in said and float(said["redundancy"]) >= 0
    pairs = text.read_assignments(spark, str(tmp_path / "out"))
    assert pairs.count() > 90 and pairs.where("read_id = cluster_id").count() == 0
    (tmp_path / "reads.fasta").write_text("".join(f">r{i}\n{s}\n" for i, s in rows))
    assert command.read(spark, str(tmp_path / "reads.fasta")).count() == 120
