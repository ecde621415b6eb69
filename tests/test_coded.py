"""Anchors are coded for some reads at a time, and founders of before go into the tables as they come."""

import random

from readlake.operators.cluster import ClusterConfig, OnlineClusters


def test_coded_in_parts_as_at_once(monkeypatch):
    rng = random.Random(5)
    cores = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(60)]
    seqs = ["".join(x if rng.random() > 0.03 else rng.choice("ACGT") for x in rng.choice(cores)) for _ in range(900)]
    ids, cfg = [*range(900)], ClusterConfig()
    want = OnlineClusters(cfg).place_all(ids, seqs)
    sizes, codes = [], ClusterConfig.codes
    monkeypatch.setattr(OnlineClusters, "CODED", 70)
    monkeypatch.setattr(ClusterConfig, "codes", lambda self, seqs: sizes.append(len(seqs)) or codes(self, seqs))
    assert OnlineClusters(cfg).place_all(ids, seqs) == want
    state = OnlineClusters(cfg)
    first = state.place_all(ids[:500], seqs[:500])
    again = OnlineClusters(cfg)
    again.restore((i, seqs[i]) for i, (_, status) in zip(ids, first, strict=False) if status == "founder")
    assert first + again.place_all(ids[500:], seqs[500:]) == want
    assert max(sizes) == 70
