"""Approximate matching: predictions against references, blocked anchor joins, recovery and coverage."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.sequence import edit_identity, hamming, identity
from readlake.operators.voting import numbered
from readlake.session import keep


BROADCAST_ROWS = 20_000


def near_lengths(pred: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """Pairs (pred_id, pred_seq, gt_id, gt_seq) whose lengths differ by `most` at most: an equi-join on buckets of length, then the filter.

    The bucket is most + 1 wide and only the predictions are repeated, for the buckets beside theirs; no pair comes twice. Reads of one
    length share a bucket, so the references are broadcast where they are counted and few, and predictions stay where they are; where
    they are many, each reference goes to one of `salts` parts of its bucket and the predictions to all of them.
    """
    wide, salts = most + 1, 16
    if truth.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        p = pred.withColumn("bucket", F.floor(F.length("pred_seq") / wide).cast("int"))
        t = truth.withColumn("bucket", F.explode(F.array(*(F.floor(F.length("gt_seq") / wide).cast("int") + k for k in (-1, 0, 1)))))
        return p.join(F.broadcast(t), "bucket").where(F.abs(F.length("pred_seq") - F.length("gt_seq")) <= most).drop("bucket")
    p = pred.withColumn("bucket", F.explode(F.array(*(F.floor(F.length("pred_seq") / wide).cast("int") + k for k in (-1, 0, 1))))).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    t = truth.withColumns({"bucket": F.floor(F.length("gt_seq") / wide).cast("int"), "salt": F.pmod(F.xxhash64("gt_id"), F.lit(salts)).cast("int")})
    return p.join(t, ["bucket", "salt"]).where(F.abs(F.length("pred_seq") - F.length("gt_seq")) <= most).drop("bucket", "salt")


TILE_ROWS, TASK_PAIRS = 4096, 8_000_000


def group_pairs(rows: DataFrame, group: str, id_: str, level: Column, levels: int, tile: int = TILE_ROWS, most: int = TASK_PAIRS) -> DataFrame:
    """(group, x_..., y_...): all pairs of rows of one group, x with the lesser id.

    The rows in order of group and id are cut into runs of `tile` rows, and these by level (0 to levels - 1, a class of what the pairs are
    weighed by). Two such blocks of a group meet as one tile: a task holds `tile` rows of a side at most, and has about `most` pairs.
    Tiles of one greater level share tasks, and pairs come row by row, so that files hold equal ids and like weights together.
    """
    ranked = numbered(rows.withColumn("_key", F.struct(group, id_)), "_key").withColumns({"_run": F.floor((F.col("line_no") - 1) / tile), "_level": level.cast("int")})
    ranked = ranked.drop("_key", "line_no", "chunk_id")
    blocks = keep(ranked.groupBy(group, "_run", "_level").agg(F.count("*").alias("_n")))
    side = lambda df, s: df.select(group, *(F.col(c).alias(f"{s}_{c.lstrip('_')}") for c in df.columns if c != group))
    tiles = side(blocks, "x").join(side(blocks, "y"), group).where("x_run <= y_run").withColumn("top", F.greatest("x_level", "y_level"))
    pairs = {r["top"]: r["n"] for r in tiles.groupBy("top").agg(F.sum(F.col("x_n") * F.col("y_n")).alias("n")).collect()}  # a row for each level
    keys = [group, "x_run", "x_level", "y_run", "y_level"]

    def met(top: int) -> DataFrame:
        of = tiles.where(F.col("top") == top).select(*keys)
        dealt = lambda s: side(ranked, s).join(of, [group, f"{s}_run", f"{s}_level"]).repartition(pairs.get(top, 0) // most + 1, *keys)
        return dealt("x").hint("merge").join(dealt("y"), keys).where(F.col(f"x_{id_}") < F.col(f"y_{id_}")).drop(*keys[1:])

    return reduce(DataFrame.unionByName, map(met, range(levels)))


def best_match(pairs: DataFrame, score: Column, by: str = "pred_id") -> DataFrame:
    """(by, other, score): the best partner of each id; ties to the least partner."""
    other = "gt_id" if by == "pred_id" else "pred_id"
    best = pairs.select(by, other, F.round(score, 9).alias("s")).groupBy(by).agg(F.min(F.struct((-F.col("s")).alias("m"), other)).alias("b"))
    return best.select(by, F.col(f"b.{other}").alias(other), (-F.col("b.m")).alias("score"))


BLOCK_BASES, RADII = 12, (2, 6)


def _index(rows: DataFrame, bases: int, shifting: bool) -> DataFrame:
    """(other_id, at, key) of windows of rows (id, seq): all windows if matches may shift, else those at multiples of `bases`."""
    last = F.length("seq") - bases
    step = F.lit(1 if shifting else bases)
    at = F.when(last >= 0, F.sequence(F.lit(0), last, step))
    return rows.select(F.col("id").alias("other_id"), "seq", F.explode(at).alias("at")).select("other_id", "at", F.xxhash64(F.substr("seq", F.col("at") + 1, F.lit(bases))).alias("key"))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast, where it is counted and has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _like_lengths(others: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Those of others whose length differs by `most` at most from that of some row."""
    sizes = rows.select(F.length("seq").alias("size")).distinct().select(F.explode(F.sequence(F.col("size") - most, F.col("size") + most)).alias("size")).distinct()
    return others.join(_few(keep(sizes)), F.length("seq") == F.col("size"), "left_semi")


def _blocks(rows: DataFrame, bases: int, errors: int = 0) -> DataFrame:
    """id, begin, key of the blocks of rows that have more than `errors` of them."""
    blocks = rows.where(F.length("seq") >= bases * (errors + 1)).select("id", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / bases).cast("int") - 1)).alias("i"))
    return blocks.select("id", (F.col("i") * bases).alias("begin"), F.xxhash64(F.substr("seq", F.col("i") * bases + 1, F.lit(bases))).alias("key"))


def _asked(index: DataFrame, rows: DataFrame, bases: int) -> DataFrame:
    """What the index has under keys that rows may ask for; where these are few, the other windows are never shuffled."""
    return index.join(_few(keep(_blocks(rows, bases).select("key").distinct())), "key", "left_semi")


def near_candidates(rows: DataFrame, index: DataFrame, often: DataFrame, errors: int, bases: int, shifting: bool) -> DataFrame:
    """(id, other_id), each pair once, with all pairs of at most `errors` errors among them. rows: id, seq.

    A sequence is cut into blocks; of any errors + 1 of them one is whole in the other sequence, where it has moved by `errors`
    places at most, or not at all. The blocks that the index has least often (often: key, n) are asked for, so that ends
    which all sequences share make no candidates. Rows of fewer blocks have no candidates.
    """
    blocks = _blocks(rows, bases, errors).join(often, "key", "left").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "begin")))
    asked = blocks.where((F.col("place") <= errors + 1) & F.col("n").isNotNull()).select("id", "begin", "key")
    moved = F.abs(F.col("at") - F.col("begin"))
    return asked.join(index, "key").where(moved <= (errors if shifting else 0)).select("id", "other_id").distinct()


def _best_by_radius(rows: DataFrame, others: DataFrame, score: Column, wrong: Column, most: int, whole: float, shifting: bool) -> tuple[DataFrame, DataFrame]:
    """(id, other, score) of the rows whose best partner is known, and the rows that are left. rows, others: id, seq.

    Equal sequences first; then pairs of few errors, at growing radii. A row is done when no partner beyond the radius can be as
    good: with more than r errors the score is under 1 - r / (length + most), for lengths that differ by `most` at most.
    score and wrong (the errors) are over seq and other_seq; `whole` is the score of equal sequences.
    """
    same = rows.join(others.select(F.col("id").alias("other"), "seq"), "seq").groupBy("id").agg(F.min("other").alias("other")).withColumn("score", F.lit(whole))
    done = [same]
    rest = keep(rows.join(same.select("id"), "id", "left_anti"))
    if not rest.limit(1).count():
        return same, rest
    index = keep(_asked(_index(_like_lengths(others, rest, most), BLOCK_BASES, shifting), rest, BLOCK_BASES))
    often = keep(index.groupBy("key").agg(F.count("*").alias("n")))
    for radius in RADII:
        met = near_candidates(rest, index, often, radius, BLOCK_BASES, shifting)
        pairs = met.join(rest, "id").join(others.select(F.col("id").alias("other_id"), F.col("seq").alias("other_seq")), "other_id")
        pairs = pairs.where((F.abs(F.length("seq") - F.length("other_seq")) <= most) & (wrong <= radius))
        best = pairs.select("id", F.length("seq").alias("size"), "other_id", F.round(score, 9).alias("s")).groupBy("id").agg(F.max("size").alias("size"), F.min(F.struct((-F.col("s")).alias("m"), "other_id")).alias("b"))
        sure = keep(best.where(-F.col("b.m") > F.round(whole * (1 - (radius + 1) / (F.col("size") + most)), 9)).select("id", F.col("b.other_id").alias("other"), (-F.col("b.m")).alias("score")))
        done.append(sure)
        rest = keep(rest.join(sure.select("id"), "id", "left_anti"))
        if not rest.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done), rest


def best_by_identity(pred: DataFrame, truth: DataFrame, most: int = 10) -> DataFrame:
    """For each prediction, the reference of the most equal bases. What has none within few errors is compared base by base with all of like length."""
    pred, truth = keep(pred), keep(truth)  # read at each radius
    rows, others = pred.select(F.col("pred_id").alias("id"), F.col("pred_seq").alias("seq")), truth.select(F.col("gt_id").alias("id"), F.col("gt_seq").alias("seq"))
    same = identity(F.col("seq"), F.col("other_seq"))
    longer = F.greatest(F.length("seq"), F.length("other_seq"))
    found, rest = _best_by_radius(rows, others, same, F.round((1 - same) * longer), most, 1.0, False)
    far = best_match(near_lengths(rest.toDF("pred_id", "pred_seq"), truth, most), identity(F.col("pred_seq"), F.col("gt_seq")))
    return found.toDF("pred_id", "gt_id", "score").unionByName(far)


def best_by_edit(pred: DataFrame, truth: DataFrame, most: int = 20) -> DataFrame:
    """For each reference, the prediction with the best edit identity. What has none within few edits is compared with all of like length."""
    pred, truth = keep(pred), keep(truth)  # read at each radius
    rows, others = truth.select(F.col("gt_id").alias("id"), F.col("gt_seq").alias("seq")), pred.select(F.col("pred_id").alias("id"), F.col("pred_seq").alias("seq"))
    found, rest = _best_by_radius(rows, others, edit_identity(F.col("seq"), F.col("other_seq")), F.levenshtein("seq", "other_seq"), most, 100.0, True)
    far = best_match(near_lengths(pred, rest.toDF("gt_id", "gt_seq"), most), edit_identity(F.col("pred_seq"), F.col("gt_seq")), "gt_id")
    return found.toDF("gt_id", "pred_id", "score").unionByName(far)


def recovered(pred: DataFrame, truth: DataFrame, most: int = 5, perfect: float = 0.999) -> DataFrame:
    """gt_id of references that some prediction matches. Where that allows no base to differ, equal sequences are joined; few differing bases are looked up."""
    longest = truth.agg(F.max(F.length("gt_seq"))).first()[0] or 0
    errors = math.ceil((1 - perfect) * (longest + most) - 1e-9) - 1  # identity above perfect has fewer
    if errors <= 0:
        return truth.join(pred.select(F.col("pred_seq").alias("gt_seq")).distinct(), "gt_seq", "left_semi").where(F.length("gt_seq") > 0).select("gt_id").distinct()
    alike = identity(F.col("pred_seq"), F.col("gt_seq")) > perfect
    if errors > max(RADII):
        return near_lengths(pred, truth, most).where(alike).select("gt_id").distinct()
    fits = F.length("gt_seq") >= BLOCK_BASES * (errors + 1)
    rows = truth.where(fits).select(F.col("gt_id").alias("id"), F.col("gt_seq").alias("seq"))
    index = keep(_index(pred.select(F.col("pred_id").alias("id"), F.col("pred_seq").alias("seq")), BLOCK_BASES, False))
    met = near_candidates(rows, index, index.groupBy("key").agg(F.count("*").alias("n")), errors, BLOCK_BASES, False).toDF("gt_id", "pred_id")
    near = met.join(truth, "gt_id").join(pred, "pred_id").where(F.abs(F.length("pred_seq") - F.length("gt_seq")) <= most).where(alike).select("gt_id")
    return near.unionByName(near_lengths(pred, truth.where(~fits), most).where(alike).select("gt_id")).distinct()


def strict_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """n_pred, n_gt, n_perfect, n_recovered, precision, recall: error-free predictions, and references found."""
    p = pred.join(truth.select(F.col("gt_seq").alias("pred_seq")).distinct(), "pred_seq", "left_semi").agg(F.count("*").alias("n_perfect"))
    r = truth.join(pred.select(F.col("pred_seq").alias("gt_seq")).distinct(), "gt_seq", "left_semi").agg(F.count("*").alias("n_recovered"))
    out = pred.agg(F.count("*").alias("n_pred")).crossJoin(truth.agg(F.count("*").alias("n_gt"))).crossJoin(p).crossJoin(r)  # one row each
    return out.select("*", (F.col("n_perfect") / F.col("n_pred")).alias("precision"), (F.col("n_recovered") / F.col("n_gt")).alias("recall"))


def missing(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return truth.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def coverage(absent: DataFrame, reads: DataFrame, key: str, low: int = 5) -> DataFrame:
    """(key, n_reads, low): how many reads each missing reference has."""
    n = reads.join(absent, key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return absent.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_reads")).withColumn("low", F.col("n_reads") < low)


ODD = "7"


class _Keys:
    """Anchors of one depth as numbers of three bits a base, and the keys under which anchors meet that differ in `most` places at most.

    Pigeonhole: of `parts` parts of an anchor at least parts - most are intact, so joining on every choice of so many parts loses no
    pair, with keys of parts - most parts, not of one: candidates stay near the number of pairs. A key is one number: the bases of the
    choice, and the choice above them. Letters other than A, C, G, T and N share a digit; such anchors carry their text too, which decides.
    Anchors too long for a number are texts, and their keys hashes.
    """

    def __init__(self, most: int, depth: int, parts: int):
        if parts <= most:
            raise ValueError("more parts than differences are needed")
        self.depth = depth
        self.cuts = [depth * i // parts for i in range(parts + 1)]
        self.choices = [*combinations(range(parts), parts - most)]
        self.coded = 3 * depth + len(self.choices).bit_length() < 64
        mask = lambda a, b: ((1 << (3 * (b - a))) - 1) << (3 * (depth - b))
        self.masks = [sum(mask(self.cuts[i], self.cuts[i + 1]) for i in some) for some in self.choices]

    def columns(self, anchor: Column) -> tuple[Column, Column]:
        """code and text; one of them may be null."""
        if not self.coded:
            return F.lit(None).cast("long"), anchor
        odd = anchor.rlike("[^ACGTN]")
        digits = F.translate(F.when(odd, F.regexp_replace(anchor, "[^ACGTN]", ODD)).otherwise(anchor), "ACGTN", "01234")
        return F.conv(digits, 8, 10).cast("long"), F.when(odd, anchor)

    def _part(self, text: Column, i: int) -> Column:
        return F.substring(text, self.cuts[i] + 1, self.cuts[i + 1] - self.cuts[i])

    def keys(self, code: Column, text: Column) -> Column:
        """array<struct<choice, key>>"""
        one = lambda k, some: code.bitwiseAND(F.lit(self.masks[k])).bitwiseOR(F.lit(k << (3 * self.depth))) if self.coded else F.xxhash64(F.lit(k), *(self._part(text, i) for i in some))
        return F.array(*(F.struct(F.lit(k).cast("byte").alias("choice"), one(k, some).alias("key")) for k, some in enumerate(self.choices)))

    def _text(self, code: Column, text: Column) -> Column:
        return F.coalesce(text, F.translate(F.lpad(F.conv(code, 10, 8), self.depth, "0"), "01234", "ACGTN"))

    def distance(self, code: Column, text: Column, code2: Column, text2: Column) -> Column:
        """How many bases differ."""
        if not self.coded:
            return hamming(text, text2)
        x = code.bitwiseXOR(code2)
        low = sum(1 << (3 * i) for i in range(self.depth))
        bits = F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(low)))
        return F.when(text.isNull() & text2.isNull(), bits).otherwise(hamming(self._text(code, text), self._text(code2, text2)))

    def first(self, code: Column, text: Column, code2: Column, text2: Column) -> Column:
        """The first choice under which two anchors meet."""
        same = lambda k, some: code.bitwiseXOR(code2).bitwiseAND(F.lit(self.masks[k])) == 0 if self.coded else reduce(and_, (self._part(text, i) == self._part(text2, i) for i in some))
        return F.coalesce(*(F.when(same(k, some), F.lit(k).cast("byte")) for k, some in enumerate(self.choices)))


def _keyed(rows: DataFrame, keys: _Keys, *keep: str) -> DataFrame:
    """keep, code, text, choice, key of rows with code and text: a row for each key."""
    return rows.select(*keep, "code", "text", F.explode(keys.keys(F.col("code"), F.col("text"))).alias("k")).select(*keep, "code", "text", "k.choice", "k.key")


def candidates(probes: DataFrame, index: DataFrame, keys: _Keys, earlier: bool = True) -> DataFrame:
    """left_id, right_id, distance of probes (id, code, text) and entries of the index (id, code, text), earlier ones or all others, that share a key, each pair once."""
    right = _keyed(probes.withColumnRenamed("id", "right_id"), keys, "right_id")
    left = _keyed(index, keys, "id").select(F.col("id").alias("left_id"), F.col("code").alias("left_code"), F.col("text").alias("left_text"), "choice", "key")
    met = left.join(right, ["choice", "key"]).where(F.col("left_id") < F.col("right_id") if earlier else F.col("left_id") != F.col("right_id"))
    both = [F.col(n) for n in ("left_code", "left_text", "code", "text")]
    return met.where(F.col("choice") == keys.first(*both)).select("left_id", "right_id", keys.distance(*both).cast("int").alias("distance"))


def _anchors(reads: DataFrame, keys: _Keys, begin: Column) -> DataFrame:
    """read_id, anchor of the reads that the window lies in; begin: 1-based."""
    inside = (begin >= 1) & (begin + keys.depth - 1 <= F.length("seq"))
    return reads.where(inside).select("read_id", F.substr("seq", begin.cast("int"), F.lit(keys.depth)).alias("anchor"))


def _moved_anchors(reads: DataFrame, keys: _Keys, begins: list[int]) -> DataFrame:
    """read_id, anchor of all the windows that lie in a read, each anchor of it once: a read is one row until then."""
    inside = lambda b: F.when((F.lit(b) >= 1) & (F.length("seq") >= b + keys.depth - 1), F.substr("seq", F.lit(b), F.lit(keys.depth)))
    return reads.select("read_id", F.explode(F.array_distinct(F.array_compact(F.array(*map(inside, begins))))).alias("anchor"))


def _distinct(anchors: DataFrame, keys: _Keys) -> DataFrame:
    """anchor, id, code, text: distinct anchors, each with its least read."""
    code, text = keys.columns(F.col("anchor"))
    return anchors.groupBy("anchor").agg(F.min("read_id").alias("id")).withColumns({"code": code, "text": text})


def _end_pairs(reads: DataFrame, keys: _Keys, most: int, begin: Column) -> DataFrame:
    """(left_id, right_id, distance) by the anchors of one place. Equal anchors are joined once: the pairs are of distinct anchors, each with its least read_id, plus every read with its anchor's least.

    The anchors are read three times, so they are kept, without the reads that they come from."""
    anchors = keep(_anchors(reads, keys, begin))
    each = _distinct(anchors, keys)
    between = candidates(each, each, keys).where(F.col("distance") <= most)
    inside = anchors.join(each, "anchor").where("read_id <> id").select(F.col("id").alias("left_id"), F.col("read_id").alias("right_id"), F.lit(0).alias("distance"))
    return between.unionByName(inside)


def anchor_pairs(reads: DataFrame, most: int = 2, depth: int = 15, parts: int = 5) -> DataFrame:
    """(left_id, right_id, distance): reads whose head anchors differ in `most` places at most."""
    return _end_pairs(reads, _Keys(most, depth, parts), most, F.lit(1))


def slot_pairs(reads: DataFrame, cfg, slots: str = "abcd") -> DataFrame:
    """(left_id, right_id, slot, distance): earlier reads that a read may join, by the first kind of slot that has any. cfg: a ClusterConfig.

    Head (slot 0), tail (1) and inner anchors (2) are tried in turn, each only for the reads that are left. The inner anchors of a read
    move over the drifts; those of earlier reads stand still. Reads that are left are kept after each turn.
    """
    most, pairs = cfg.near - 1, []
    if most < 0:
        raise ValueError("near must be 1 at least")
    reads = rest = keep(reads.select("read_id", "seq"))
    ends, inner = _Keys(most, cfg.depth, cfg.near + 2), _Keys(most, cfg.inner, cfg.near + 2)
    begins = {"a": F.lit(cfg.head_skip + 1), "b": F.length("seq") - cfg.tail_skip - cfg.depth + 1}
    for number, slot in enumerate("ab"):
        if slot in slots:
            # the anchors that are met are those of all reads
            found = _end_pairs(reads, ends, most, begins[slot]) if not pairs else _end_pairs(reads, ends, most, begins[slot]).join(rest.select(F.col("read_id").alias("right_id")), "right_id", "left_semi")
            found = found.select("left_id", "right_id", F.lit(number).alias("slot"), "distance")
            if slots[-1] == slot:
                return reduce(DataFrame.unionByName, [*pairs, found])
            found = keep(found)
            pairs.append(found)
            rest = keep(rest.join(found.select(F.col("right_id").alias("read_id")).distinct(), "read_id", "left_anti"))
    for slot in "cd":
        if slot in slots and slot in cfg.inner_names:
            still = _distinct(_anchors(reads, inner, F.lit(cfg.begin(slot) + 1)), inner)
            code, text = inner.columns(F.col("anchor"))
            moved = _moved_anchors(rest, inner, [cfg.begin(slot, move) + 1 for move in cfg.moves])
            probes = moved.select(F.col("read_id").alias("id"), code.alias("code"), text.alias("text"))
            near = candidates(probes, still, inner).where(F.col("distance") <= most)
            pairs.append(near.select("left_id", "right_id", F.lit(2).alias("slot"), "distance"))
    return reduce(DataFrame.unionByName, pairs)


def near_cores(reads: DataFrame, cores: DataFrame, cfg) -> DataFrame:
    """(read_id, cluster_id): of the cores (cluster_id, core) whose head anchor is near a read's, the nearest, then the least. cfg: a ClusterConfig."""
    keys = _Keys(cfg.near - 1, cfg.depth, cfg.near + 2)
    code, text = keys.columns(F.col("anchor"))
    of = lambda df: _anchors(df, keys, F.lit(cfg.head_skip + 1)).select(F.col("read_id").alias("id"), code.alias("code"), text.alias("text"))
    met = candidates(of(reads), of(cores.select(F.col("cluster_id").alias("read_id"), F.col("core").alias("seq"))), keys, earlier=False).where(F.col("distance") < cfg.near)
    return met.groupBy(F.col("right_id").alias("read_id")).agg(F.min(F.struct("distance", "left_id")).alias("b")).select("read_id", F.col("b.left_id").alias("cluster_id"))


def chosen(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, cluster_id): each read joins by the least slot, there (inner slots) with the fewest differences, and the least read_id; else itself."""
    order = F.struct("slot", F.when(F.col("slot") == 2, F.col("distance")).otherwise(0).alias("distance"), "left_id")
    best = pairs.groupBy(F.col("right_id").alias("read_id")).agg(F.min(order).alias("b"))
    return reads.select("read_id").join(best, "read_id", "left").select("read_id", F.coalesce("b.left_id", "read_id").alias("cluster_id"))


def founders(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, cluster_id): each read joins its least direct neighbour, itself included; not transitive, free of order."""
    near = pairs.groupBy(F.col("right_id").alias("read_id")).agg(F.min("left_id").alias("founder"))
    return reads.select("read_id").join(near, "read_id", "left").select("read_id", F.coalesce("founder", "read_id").alias("cluster_id"))


def anchor_state(events: DataFrame) -> DataFrame:
    """(anchor, cluster): what an index of anchors holds after events (anchor, cluster, at) in order of `at`: the last one of an anchor decides, and one without cluster deletes it."""
    return events.groupBy("anchor").agg(F.max_by("cluster", "at").alias("cluster")).where("cluster IS NOT NULL")


def look_up(probes: DataFrame, state: DataFrame) -> DataFrame:
    """The probes (anchor, ...) with the cluster of their anchor, null where the index has none."""
    return probes.join(state, "anchor", "left")


def identity_summary(scores: DataFrame, score: str = "score", perfect: float = 0.99) -> DataFrame:
    """n, mean_identity, n_perfect (above `perfect`)."""
    return scores.agg(F.count("*").alias("n"), F.avg(score).alias("mean_identity"), F.count_if(F.col(score) > perfect).alias("n_perfect"))
