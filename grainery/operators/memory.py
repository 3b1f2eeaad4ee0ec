"""Entities found by name, and observations that supersede one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainery import schemas
from grainery.functions import text as X
from grainery.operators.store import first_error, number, positions, split_rejects

GRAM = 3
#: Counts of grams that a task holds: half a megabyte.
BUCKETS = 1 << 16
#: More than a string has places; a count and a place share one number.
WIDE = 1 << 31


def names(entities: DataFrame) -> DataFrame:
    """entity_id, name: every lower-case name under which an entity is known."""
    every = F.concat(F.array("name", "full_name", "relation"), F.split(F.coalesce("aliases", F.lit("")), ","))
    each = entities.select(F.col("id").alias("entity_id"), F.explode(F.transform(every, lambda n: F.lower(X.strip(n)))).alias("name"))
    return each.filter("name IS NOT NULL AND name <> ''").distinct()


def _grams(c: str, size: int) -> Column:
    """The distinct substrings of a length."""
    each = F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(F.col(c), i, F.lit(size)))
    return F.when(F.length(c) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _rows_like(grams: DataFrame) -> Column:
    """Of a gram: how many rows of `grams` lie in its bucket, so at least as many as have it, and none if no row of the bucket does.

    One row of BUCKETS numbers, whatever the size of the tables: a subquery's value, not a table to broadcast.
    """
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS))
    each = grams.select(bucket.alias("id")).union(grams.sparkSession.range(BUCKETS)).groupBy("id").agg((F.count("*") - 1).alias("n"))
    return F.get(each.agg(F.sort_array(F.collect_list(F.struct("id", "n")))["n"]).scalar(), bucket.cast("int"))


def _contained(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:  # noqa: E741
    """The pairs in which a long string holds a short one.

    A long string that holds a short one holds all its grams, so the short one is looked up under the gram of it
    that the fewest long strings have (as `_rows_like` tells), if each is had by any; of the long strings' grams, only those
    that some short one is looked up under are dealt out. Spark takes exploded rows for no larger than the rows before
    them, so it must not choose to broadcast them.
    """
    look = long.withColumn("gram", F.explode(F.concat(*(_grams(l, size) for size in range(1, GRAM + 1)))))
    keys = short.withColumn("__at", F.explode(F.sequence(F.lit(1), F.greatest(F.length(s) - GRAM + 1, F.lit(1)))))
    keys = keys.withColumn("gram", F.substr(F.col(s), F.col("__at"), F.lit(GRAM)))
    least = keys.groupBy(*short.columns).agg(F.min(F.least(_rows_like(look), F.lit(WIDE)) * WIDE + F.col("__at")).alias("__least"))
    rarest = least.filter(F.col("__least") > WIDE).select(*short.columns, F.substr(F.col(s), (F.col("__least") % WIDE).cast("int"), F.lit(GRAM)).alias("gram"))
    met = look.filter(_rows_like(rarest) > 0)
    return rarest.hint("merge").join(met, "gram").filter(F.contains(F.col(l), F.col(s))).select("__needle", "entity_id")


def resolve(entities: DataFrame, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """needle, entity_id: entities with a name that contains the needle, or is contained in it; blank ones match nothing."""
    left = needles.select(F.col(needle).alias("__needle"), F.lower(X.strip(needle)).alias("n")).filter("n IS NOT NULL AND n <> ''").distinct()
    right = names(entities)
    return _contained(left, "n", right, "name").union(_contained(right, "name", left, "n")).distinct().withColumnRenamed("__needle", needle)


def create_entities(batch: DataFrame, entities: DataFrame, order: str = "position") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, duplicates (with the first entity that their name resolves to), and rejects.

    A row is held against the table, and against the names of earlier rows of the batch that the table does not know.
    """
    error = first_error((X.blank("name"), "empty name"), (~F.coalesce(F.col("kind").isin(*schemas.ENTITY_KINDS), F.lit(False)), "unknown kind"))
    good, rejects = split_rejects(batch, error)
    known = resolve(entities, good, "name").groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    seen = good.join(known, "name", "left")
    own = seen.filter("entity_id IS NULL").select(F.col(order).alias("id"), "name", F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("aliases"))
    earlier = resolve(own, good, "name").join(good.select("name", F.col(order).alias("__at")), "name").filter("entity_id < __at").select(F.col("__at").alias(order)).distinct()
    fresh = seen.filter("entity_id IS NULL").drop("entity_id").join(earlier, order, "left_anti")
    repeats = seen.filter("entity_id IS NULL").join(earlier, order, "left_semi").unionByName(seen.filter("entity_id IS NOT NULL"))
    added = number(fresh.withColumn("aliases", X.join_aliases("aliases")), entities, [order]).drop(order)
    return schemas.migrate(added, "entities").select(*schemas.ENTITIES.fieldNames()), repeats.select(order, "name", "entity_id", F.lit(True).alias("duplicate")), rejects


def list_entities(entities: DataFrame, kind: str | None = None) -> DataFrame:
    rows = entities if kind is None else entities.filter(F.col("kind") == kind)
    return rows.withColumnRenamed("id", "entity_id").orderBy("entity_id")


def get_entity(entities: DataFrame, entity_id: int) -> DataFrame:
    return entities.filter(F.col("id") == entity_id).withColumnRenamed("id", "entity_id")


def observation_error() -> Column:
    """An observation is an attribute with a value, or a body."""
    return first_error((~X.blank("attribute") & X.blank("value"), "an attribute needs a value"), (X.blank("attribute") & X.blank("body"), "neither attribute nor body"))


def fold_log(log: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations with their state, and rejects, of a log in id order.

    log: id, op (`write`, `replace` or `supersede`), entity_id, attribute, value, body,
    source, observed_at, target. A row is superseded by any later replace of its
    entity and attribute, or by a supersede of its id. The last replace of each
    key comes from a partial aggregation, so a hot key is no hot task.
    """
    facts = log.filter("op <> 'supersede'")
    good, rejects = split_rejects(facts, observation_error())
    if entities is not None:
        rejects = rejects.unionByName(good.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").withColumn("error", F.lit("no such entity")).withColumn("ok", F.lit(False)).select(*rejects.columns))
        good = good.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    last = good.filter("op = 'replace'").groupBy("entity_id", "attribute").agg(F.max("id").alias("__last"))
    gone = log.filter("op = 'supersede'").select(F.col("target").alias("id")).distinct().withColumn("__gone", F.lit(True))
    state = good.join(last, ["entity_id", "attribute"], "left").join(gone, "id", "left")
    superseded = F.coalesce(F.col("__last") > F.col("id"), F.lit(False)) | F.coalesce("__gone", F.lit(False))
    kept = ["id", "entity_id", *(X.filled(c).alias(c) for c in ("attribute", "value", "body", "source")), "observed_at", superseded.alias("superseded")]
    return state.select(*kept), rejects


def retired(log: DataFrame) -> DataFrame:
    """For each replace, how many active rows it retired: those of its key since the replace before it.

    Rows get their positions in the order of key and id; a hot key spans several partitions, each of which
    knows the replaces inside it, and one row for each key and partition tells the next ones of the last replace.
    """
    key = ["entity_id", "attribute"]
    facts = positions(log.filter("op <> 'supersede'").select(*key, "id", "op"), [*key, "id"])
    at = F.when(F.col("op") == "replace", F.col("__position"))
    earlier = Window.unboundedPreceding, -1
    inside = facts.withColumn("__last", F.max(at).over(Window.partitionBy("__part", *key).orderBy("__position").rowsBetween(*earlier)))
    parts = facts.groupBy("__part", *key).agg(F.max(at).alias("__last"), F.min("__position").alias("__first"))
    over = Window.partitionBy(*key).orderBy("__part")
    parts = parts.select("__part", *(F.col(c).alias(f"__{c}") for c in key), F.max("__last").over(over.rowsBetween(*earlier)).alias("__carried"), F.min("__first").over(over).alias("__first"))
    replaces = inside.filter("op = 'replace'").withColumnRenamed("__part", "__p")
    joined = replaces.join(parts, (F.col("__p") == F.col("__part")) & F.col("entity_id").eqNullSafe(F.col("__entity_id")) & F.col("attribute").eqNullSafe(F.col("__attribute")))
    return joined.select("id", *key, (F.col("__position") - F.coalesce("__last", "__carried", "__first")).cast("bigint").alias("retired"))


def get_observations(observations: DataFrame, entity_id: int, attribute: str | None = None, include_superseded: bool = False) -> DataFrame:
    """An entity's observations, newest first, ties to the greater id."""
    rows = observations.filter(F.col("entity_id") == entity_id)
    rows = rows if attribute is None else rows.filter(F.col("attribute") == attribute)
    rows = rows if include_superseded else rows.filter(~F.col("superseded"))
    return rows.orderBy(F.desc("observed_at"), F.desc("id"))


def supersede_errors(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that cannot be superseded: unknown, or superseded before."""
    active = observations.filter(~F.col("superseded")).select("id")
    return ids.join(active, "id", "left_anti").withColumn("error", F.lit("no active observation"))


def write_observations(observations: DataFrame, path: str) -> None:
    """Parquet sorted by entity and attribute: an exact lookup reads the row groups whose least and greatest values hold the key."""
    observations.repartitionByRange("entity_id", "attribute").sortWithinPartitions("entity_id", "attribute", "superseded").write.parquet(path)
