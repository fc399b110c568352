"""Problem 2: one survivor for each group of records of the same sequenced fragment.

Groups are the connected components of two agreements, equal read name and equal unclipped 5' position.  Inside a group the values
of the four fields reference, start, cigar and quality are fused by Bayesian voting with copy detection:

* a source's accuracy is the mean posterior of the values that it claims, over all groups;
* two sources depend on each other if they share values that are held to be false more often than independent sources would; in a
  field of a group a source is compared with every source before it, on all their values there: with the ``NEAR`` before it and the
  last before it that claims the same value by a window (``_compared``), with the others, which only fields of more than ``NEAR + 1``
  sources have, block by block (``_further``); the work is quadratic in the sources of such a field, as the pairs are;
* a claim counts only with the probability that it was not copied from the likeliest origin among all sources before it that claim
  the same value.

The survivor is the record with the most present fields, the largest quality sum, the latest arrival and the smallest id, in this
order; among records that are still equal (ids needn't be unique) the one whose values have the highest posterior.  Null names and
positions link nothing, a null flag counts as 0, a null arrival as the earliest.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.operators.components import connected_components
from helixlake.runtime import stored

SECONDARY = 0x900
#: Prior of a source's accuracy, of dependence between two sources, and the share of values that a copier copies.
ACCURACY, DEPENDENCE, COPIED = 0.8, 0.1, 0.8
#: Number of false values that a field may take.
FALSE_VALUES = 10
#: Sources before a source, in each field of a group, that a window compares it with whatever they claim; blocks compare it with the rest.
NEAR = 8
#: Sources of a block; a pair of blocks is compared by one task.
BLOCK = 256
FIELDS = ("reference", "start_pos", "cigar", "quality_score")


def canonical_reference(ref: Column) -> Column:
    """``chr5`` for ``5``, ``CHR5`` or `` Chr5 ``; null for null, ``*`` and empty names."""
    low = F.lower(F.trim(ref))
    core = F.when(F.startswith(low, F.lit("chr")), F.substring(low, 4, 1 << 30)).otherwise(low)
    return F.when(~core.isin("", "*"), F.concat(F.lit("chr"), core))


def fragment_name(name: Column) -> Column:
    """The read name without ``/1``, ``#CCAAGT/1`` or `` 1:N:0:ACGT`` after it; null if nothing is left."""
    plain = F.trim(name)
    bare = F.when(plain.rlike(r"[#/\s]"), F.regexp_replace(plain, r"(?:#[A-Za-z0-9+_-]*)?(?:/[0-9])?(?:\s.*)?$", "")).otherwise(plain)
    return F.when(bare != "", bare)


def five_prime(start: Column, cigar: Column, reverse: Column) -> Column:
    """Unclipped 5' position; ``cigar`` must be present."""
    number = lambda text: F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))
    clips = lambda pattern: number(F.regexp_extract(cigar, pattern, 1)) + number(F.regexp_extract(cigar, pattern, 2))
    clipped = F.contains(cigar, F.lit("S")) | F.contains(cigar, F.lit("H"))
    lead = F.when(clipped, clips(r"^(?:(\d+)H)?(?:(\d+)S)?")).otherwise(0)
    trail = F.when(clipped, clips(r"[^\dHS](?:(\d+)S)?(?:(\d+)H)?$")).otherwise(0)
    plain = F.substring_index(cigar, "M", 1).try_cast("bigint")
    blocks = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + number(x))
    span = F.when((F.length(cigar) == F.length(F.substring_index(cigar, "M", 1)) + 1) & plain.isNotNull(), plain).otherwise(blocks)
    return F.when(reverse, start + span - 1 + trail).otherwise(start - lead)


def keyed(reads: DataFrame, source: str = "file_id") -> DataFrame:
    """Primary records with their link keys (empty: none), the survivor order and the values that vote.  Records without keys are left out."""
    flag = F.coalesce(F.col("flag"), F.lit(0))
    quality = F.col("quality_score")
    plain = reads.where(flag.bitwiseAND(SECONDARY) == 0).select(
        "read_id",
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        fragment_name(F.col("name")).alias("name"),
        flag.alias("flag"),
        canonical_reference(F.col("reference")).alias("reference"),
        "start_pos",
        F.when(~F.col("cigar").isin("*", ""), F.col("cigar")).alias("cigar"),
        F.when(F.size(quality) > 0, F.xxhash64(quality)).alias("quality_score"),
        F.coalesce(F.aggregate(quality, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"),
    )
    reverse = F.col("flag").bitwiseAND(0x10) != 0
    present = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    place = F.concat_ws(":", "reference", F.when(reverse, "-").otherwise("+"), five_prime(F.col("start_pos"), F.col("cigar"), reverse).cast("string"))
    placed = F.col("reference").isNotNull() & F.col("start_pos").isNotNull() & F.col("cigar").isNotNull()
    return plain.select(
        "read_id", "source", "reference", "start_pos", "cigar", "quality_score", "total", "at", present.alias("present"),
        F.when(F.col("name").isNull(), "").otherwise(F.concat_ws("|", "name", F.col("flag").bitwiseAND(0xC0).cast("string"))).alias("nk"),
        F.when(placed, place).otherwise("").alias("pk"),
    ).where("nk <> '' OR pk <> ''")


def groups(records: DataFrame) -> DataFrame:
    """``(nk, pk, size, grp, label)`` for each pair of keys of ``keyed`` records whose group has two records or more; ``grp`` is a number, ``label`` a key.

    Copies are pre-aggregated to pairs of keys first.  A name with one position hangs on that position; only names that join
    several positions become edges of the component search.
    """
    pairs = stored(records.groupBy("nk", "pk").agg(F.count(F.lit(1)).alias("n")))
    placed = pairs.where("pk <> ''")
    by_name = placed.where("nk <> ''").groupBy("nk").agg(F.min("pk").alias("lo"), F.max("pk").alias("hi"))
    edges = placed.join(by_name.where("lo <> hi").select("nk", "lo"), "nk").select(F.col("lo").alias("a"), F.col("pk").alias("b"))
    roots = connected_components(edges).withColumnRenamed("node", "at_pk")
    unplaced = pairs.where("pk = ''").join(by_name.select("nk", F.col("lo").alias("at_pk")), "nk", "left").select("nk", "pk", "n", "at_pk")
    linked = (
        placed.withColumn("at_pk", F.col("pk"))
        .unionByName(unplaced)
        .join(roots, "at_pk", "left")
        .select("nk", "pk", "n", F.coalesce("root", "at_pk", F.concat(F.lit("name:"), F.col("nk"))).alias("grp"))
    )
    sizes = linked.groupBy(F.col("grp").alias("label")).agg(F.sum("n").alias("size")).where("size >= 2")
    sizes = stored(sizes.withColumn("grp", F.monotonically_increasing_id()))
    return linked.withColumnRenamed("grp", "label").join(sizes, "label").select("nk", "pk", "size", "grp", "label")


def _code(field: str) -> Column:
    """A value as a number that is told apart inside a field of a group: itself, or a hash of 64 bits."""
    return F.col(field) if field == "quality_score" else F.col(field).cast("bigint") if field == "start_pos" else F.when(F.col(field).isNotNull(), F.xxhash64(field))


def _vote(claims: DataFrame, accuracy: DataFrame | None, dependence: DataFrame | None) -> DataFrame:
    """Posterior ``p``, and its logarithm, of every (grp, field, value) under the given accuracies; ``dependence``: ``dep`` of the claims that have a source before them."""
    a = F.coalesce(F.col("accuracy"), F.lit(ACCURACY)) if accuracy is not None else F.lit(ACCURACY)
    weight = F.log(FALSE_VALUES * a / (1 - a))
    x = claims
    if dependence is not None:
        x = claims.where("before IS NULL").select("grp", "field", "value", "source", F.lit(0.0).alias("dep")).unionByName(dependence)
        weight = weight * (1 - COPIED * F.col("dep"))
    if accuracy is not None:
        x = x.join(accuracy, "source", "left")
    score = x.groupBy("grp", "field", "value").agg(F.sum(weight).alias("score"))
    score = stored(score)
    # Relative to the field's largest score: scores grow with the number of sources and exp has no such range.
    score = score.join(score.groupBy("grp", "field").agg(F.max(F.struct("score", "value")).alias("top")), ["grp", "field"])
    score = score.select("grp", "field", "value", (F.col("score") - F.col("top.score")).alias("below"), (F.col("value") == F.col("top.value")).alias("held"))
    total = score.groupBy("grp", "field").agg(F.log(F.sum(F.exp("below"))).alias("all"))
    score = score.join(total, ["grp", "field"]).withColumn("log_p", F.col("below") - F.col("all"))
    return score.select("grp", "field", "value", F.exp("log_p").alias("p"), "log_p", "held")


def _slots(votes: DataFrame) -> DataFrame:
    """``(grp, field, source, n, values, last, at, near)``: a source's claims, the last sources before it that claim one of them, its place in the field and its neighbours.

    Values of a single source are only counted, so that a row is small where every record has a value of its own.
    """
    slots = votes.groupBy("grp", "field", "source").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("claimants") > 1, F.col("value"))).alias("values"), F.collect_set("before").alias("last")
    )
    order = Window.partitionBy("grp", "field").orderBy("source")
    return stored(slots.withColumn("at", F.row_number().over(order)).withColumn("near", F.collect_list(F.struct("source", "values")).over(order.rowsBetween(-NEAR, -1))))


def _pairs(x: DataFrame) -> DataFrame:
    shared = F.array_intersect("values", "theirs")
    return x.select("grp", "field", "source", "before", shared.alias("shared"), (F.col("n") - F.size(shared)).alias("differ"))


def _compared(votes: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """``(grp, field, source, before, shared, differ)``: compared sources, the values that both claim and the number of those that only ``source`` does."""
    slots = _slots(votes) if slots is None else slots
    near = slots.select("grp", "field", "source", "n", "values", F.explode("near").alias("b")).select("grp", "field", "source", "n", "values", F.col("b.source").alias("before"), F.col("b.values").alias("theirs"))
    # Only slots of more sources than NEAR have neighbours by value that are further away.
    mine = slots.where(F.col("at") > NEAR + 1).select("grp", "field", "source", "n", "values", "at", F.explode("last").alias("before"))
    theirs = slots.select("grp", "field", F.col("source").alias("before"), F.col("values").alias("theirs"), F.col("at").alias("their_at"))
    far = mine.join(theirs, ["grp", "field", "before"]).where(F.col("at") - F.col("their_at") > NEAR).select(near.columns)
    return _pairs(near.unionByName(far))


def _further(slots: DataFrame) -> DataFrame:
    """All pairs of sources of a field that ``_compared`` leaves out, with its columns.  Pairs of blocks are spread over the tasks."""
    wide = slots.where(F.col("at") == NEAR + 2).select("grp", "field")
    blocks = slots.join(wide, ["grp", "field"], "left_semi").withColumn("block", F.floor((F.col("at") - 1) / BLOCK).cast("int")).groupBy("grp", "field", "block")
    mine = blocks.agg(F.collect_list(F.struct("source", "n", "values", "last", "at")).alias("mine"))
    theirs = blocks.agg(F.collect_list(F.struct("source", "values", "at")).alias("theirs")).withColumnRenamed("block", "their_block")
    both = mine.join(theirs, ["grp", "field"]).where("their_block <= block").repartition("grp", "field", "block", "their_block")
    rows = both.select("grp", "field", F.explode("mine").alias("a"), "theirs").select("grp", "field", "a", F.explode("theirs").alias("b"))
    rows = rows.where((F.col("a.at") - F.col("b.at") > NEAR) & ~F.array_contains("a.last", F.col("b.source")))
    return _pairs(rows.select("grp", "field", "a.source", "a.n", "a.values", F.col("b.source").alias("before"), F.col("b.values").alias("theirs")))


def fuse(reads: DataFrame, source: str = "file_id", rounds: int = 2) -> DataFrame:
    """One row per group of two or more records.

    Columns: ``grp``, ``size``, ``read_id`` of the survivor, and of each field the value of maximal posterior with its posterior
    (``<field>``, ``<field>_p``; quality scores as the id of a record that has them, ``quality_from``).  A field absent in all
    records is null with posterior null.
    """
    records = stored(keyed(reads, source))
    members = stored(records.join(groups(records), ["nk", "pk"]).drop("nk", "pk"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("tinyint").alias("field"), _code(f).alias("value")) for k, f in enumerate(FIELDS)]))
    claims = members.select("read_id", "grp", "source", pairs.alias("c")).select("read_id", "grp", "source", "c.*").where("value IS NOT NULL")
    same = Window.partitionBy("grp", "field", "value")
    votes = claims.select("grp", "field", "value", "source").distinct()
    votes = stored(votes.withColumn("before", F.lag("source").over(same.orderBy("source"))).withColumn("claimants", F.count(F.lit(1)).over(same)))
    slots = _slots(votes)
    compared = stored(_compared(votes, slots).unionByName(_further(slots)))
    shared = compared.select("grp", "field", "source", "before", F.explode("shared").alias("value"))
    differ = stored(compared.groupBy("source", "before").agg(F.sum("differ").alias("differ")))
    posterior = stored(_vote(votes, None, None))
    for _ in range(rounds):
        judged = votes.join(posterior, ["grp", "field", "value"])
        accuracy = judged.groupBy("source").agg(((F.sum("p") + 2 * ACCURACY) / (F.count("p") + 2)).alias("mean")).select("source", F.least(F.greatest("mean", F.lit(0.05)), F.lit(0.99)).alias("accuracy"))
        accuracy = stored(accuracy)
        gain = lambda p: F.log((COPIED + (1 - COPIED) * p) / p)
        counted = shared.join(posterior, ["grp", "field", "value"]).groupBy("source", "before").agg(F.sum(F.col("held").cast("long")).alias("n_true"), F.sum((~F.col("held")).cast("long")).alias("n_false"))
        both = differ.join(counted, ["source", "before"], "left").join(accuracy, "source").join(accuracy.select(F.col("source").alias("before"), F.col("accuracy").alias("other")), "before")
        a, b = F.col("accuracy"), F.col("other")
        # A shared false value says much, as independent sources rarely err alike; a shared true one says little, the less the better both are.
        same = F.coalesce("n_true", F.lit(0)) * gain(a * b) + F.coalesce("n_false", F.lit(0)) * gain((1 - a) * (1 - b) / FALSE_VALUES)
        odds = same + F.col("differ") * F.log(F.lit(1 - COPIED)) + F.log(F.lit(DEPENDENCE / (1 - DEPENDENCE)))
        dependence = both.select("source", "before", (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))).alias("dep"))
        dependence = shared.join(stored(dependence), ["source", "before"]).groupBy("grp", "field", "value", "source").agg(F.max("dep").alias("dep"))
        posterior = stored(_vote(votes, accuracy, dependence))
    agreed = claims.join(posterior.select("grp", "field", "value", "log_p"), ["grp", "field", "value"]).groupBy("read_id", "grp").agg(F.sum("log_p").alias("agreement"))
    top = posterior.where("held").groupBy("grp").agg(
        *[F.max(F.when(F.col("field") == k, F.col("value"))).alias(f"{f}_v") for k, f in enumerate(FIELDS)],
        *[F.max(F.when(F.col("field") == k, F.col("p"))).alias(f"{f}_p") for k, f in enumerate(FIELDS)],
    )
    rank = F.struct("present", "total", "at", (-F.col("read_id")).alias("first"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"))
    held = lambda f, x: F.when(_code(f) == F.col(f"{f}_v"), F.col(x))
    return (
        members.join(agreed, ["read_id", "grp"], "left")
        .join(top, "grp", "left")
        .withColumn("rank", rank)
        .groupBy("grp")
        .agg(
            F.max("label").alias("label"), F.max("size").alias("size"), F.max_by("read_id", "rank").alias("read_id"),
            F.max(held("reference", "reference")).alias("reference"), F.max("reference_p").alias("reference_p"),
            F.max("start_pos_v").alias("start_pos"), F.max("start_pos_p").alias("start_pos_p"),
            F.max(held("cigar", "cigar")).alias("cigar"), F.max("cigar_p").alias("cigar_p"),
            F.min(held("quality_score", "read_id")).alias("quality_from"), F.max("quality_score_p").alias("quality_p"),
        )
        .select(F.col("label").alias("grp"), "size", "read_id", "reference", "reference_p", "start_pos", "start_pos_p", "cigar", "cigar_p", "quality_from", "quality_p")
    )
