"""Column functions over base sequences. All are built-in expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def bases_of(text: Column) -> Column:
    """The letters A, C, G, T of a text, in order, in upper case."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def n_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("[Nn]"))


def admitted(seq: Column, length: int, slack: int = 5) -> Column:
    """At least length - slack bases, none of them N."""
    return (F.length(seq) >= length - slack) & ~seq.contains("N")


def payload(seq: Column, anchor: str, size: int, skip: int = 0, pad: bool = False) -> Column:
    """The bases after the first anchor, `size` at most. Without an anchor: the read without its first `skip` bases, if longer."""
    at = F.locate(anchor, seq)
    cut = F.when(at > 0, F.substr(seq, at + len(anchor), F.lit(size))).when(F.length(seq) > skip, F.substr(seq, F.lit(skip + 1), F.lit(size))).otherwise(F.substr(seq, F.lit(1), F.lit(size)))
    return F.rpad(cut, size, "N") if pad else cut


def payload_all(seq: Column, anchor: str, skip: int = 25) -> Column:
    """All bases after the first anchor; without one, the read without its first `skip` bases, if longer."""
    at = F.locate(anchor, seq)
    return F.when(at > 0, F.substr(seq, at + len(anchor))).when(F.length(seq) > skip, F.substr(seq, F.lit(skip + 1))).otherwise(seq)


def trimmed_reference(seq: Column, off: int = 25, longer_than: int = 50) -> Column:
    """A reference without `off` bases at both ends, if it is long enough."""
    return F.when(F.length(seq) > longer_than, F.substr(seq, F.lit(off + 1), F.length(seq) - 2 * off)).otherwise(seq)


def model_window(seq: Column, anchor: str, lead: int = 11, size: int = 150) -> Column:
    """A window that begins `lead` bases before the first anchor (or at the start), padded with N."""
    at = F.locate(anchor, seq)
    begin = F.when(at > 0, F.greatest(F.lit(0), at - 1 - lead)).otherwise(F.lit(0))
    return F.rpad(F.substr(seq, begin + 1, F.lit(size)), size, "N")


def identity(a: Column, b: Column) -> Column:
    """Equal bases at equal places over the longer length; 0 for an empty sequence."""
    both = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), both), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    return F.when(both > 0, same / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def edit_identity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, times 100."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, (1 - F.levenshtein(a, b) / longer) * 100).otherwise(0.0)


def mismatches(a: Column, b: Column) -> Column:
    """array<struct<pos, base>>: 0-based places where two sequences of one length differ, with b's base."""
    places = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(F.length(a) == 0, F.array().cast("array<struct<pos: int, base: string>>")).otherwise(
        F.transform(places, lambda i: F.struct((i - 1).cast("int").alias("pos"), F.substr(b, i, F.lit(1)).alias("base")))
    )


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))


def slot(seq: Column, which: str, length: int, depth: int = 15, drift: Column | None = None) -> Column:
    """Anchor slices of a read: head, tail, and two inner ones that a drift moves."""
    move = F.lit(0) if drift is None else drift
    begin = {"a": F.lit(1), "b": F.length(seq) - depth + 1, "c": 41 - move, "d": F.lit(length - 2 - 40 + 1) - move}[which]
    return F.substr(seq, begin, F.lit(depth))


def one_hot(seq: Column) -> Column:
    """array<int> of base indices (N and unknown letters count as A)."""
    return F.transform(F.split(F.translate(F.regexp_replace(seq, "[^ACGT]", "A"), "ACGT", "0123"), ""), lambda x: x.cast("int"))


def from_indices(indices: Column) -> Column:
    return F.array_join(F.transform(indices, lambda i: F.substr(F.lit(BASES), i + 1, F.lit(1))), "")


def pairs_in(line: Column) -> Column:
    """array<struct<follower, founder>> of the pairs ('f', 'c') in a line of an assignment list."""
    part = lambda n: F.regexp_extract_all(line, F.lit(r"\('?([^',()\s]+)'?,\s*'?([^',()\s]+)'?\)"), F.lit(n))
    return F.transform(F.arrays_zip(part(1).alias("follower"), part(2).alias("founder")), lambda x: F.struct(x["follower"].alias("follower"), x["founder"].alias("founder")))


def header_fields(header: Column) -> dict[str, Column]:
    """What a consensus header says: cluster_id, num_reads, num_high_conf, avg_strength."""
    part = lambda pattern: F.nullif(F.regexp_extract(header, pattern, 1), F.lit(""))
    return {
        "cluster_id": part(r"cluster_(\d+)").cast("int"),
        "num_reads": part(r"reads(\d+)").cast("int"),
        "num_high_conf": part(r"highconf(\d+)").cast("int"),
        "avg_strength": part(r"strength([0-9.]+)").cast("double"),
    }
