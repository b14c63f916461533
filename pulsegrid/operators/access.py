"""Audit of topic access against an access list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.topics import match_topic_levels

EVERYONE = "$all"
SUBJECT = ["username", "clientid", "action", "topic"]
HOLE = "*"
SALTS = 256


def acl_audit(log: DataFrame, access: DataFrame) -> DataFrame:
    """Add ``allowed`` to rows of ``username, clientid, action, topic``.

    ``access`` has ``username, permission, topic`` and may have ``action`` (allow or deny; missing
    or NULL is allow) and ``id``. Permission is publish, subscribe or all; the topic filter may hold
    ``+``, ``#``, ``%u`` (user name) and ``%c`` (client id); rows for ``$all`` hold for everyone. The
    fitting row of the lowest ``id`` decides; of equal or missing ids, a deny. What no row fits is
    denied, and so is what has no action or topic; a missing user or client only fits ``$all`` rows
    that do not name it.

    Equal accesses are decided once. Filters are found by equality of their literal levels, so an
    access meets only the filters that agree with it in all of these, never the whole list.
    """
    asked = log.select(*SUBJECT).distinct().where("action IS NOT NULL AND topic IS NOT NULL")
    rules = _rules(access)
    met = _keyed(asked, rules).join(rules, ["_who", "_action", "_levels", "_open", "_holes", "_literal"])
    placeholders = {"%u": F.col("username"), "%c": F.col("clientid")}
    fits = match_topic_levels(F.col("topic"), F.col("_filter"), placeholders)
    decided = met.where(fits).groupBy(*SUBJECT).agg(F.min(F.struct("_id", "_allow"))["_allow"].alias("_allow"))
    renamed = decided.withColumnsRenamed({c: f"_{c}_" for c in SUBJECT})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in SUBJECT]
    return log.join(renamed, same, "left").select(
        *log.columns, F.coalesce(F.col("_allow") == 1, F.lit(False)).alias("allowed")
    )


def _rules(access: DataFrame) -> DataFrame:
    """One row per filter and action, with the shape of the filter.

    The shape is the number of levels before a final ``#``, whether there is one, and which levels
    are no literals; ``_literal`` is the filter with a hole in their place.
    """
    verdict = F.col("action") if "action" in access.columns else F.lit("allow")
    number = F.col("id") if "id" in access.columns else F.lit(0)
    levels = F.split("topic", "/", -1)
    ended = F.element_at(levels, -1) == "#"
    fixed = F.when(ended, F.slice(levels, 1, F.size(levels) - 1)).otherwise(levels)

    def literal(level: Column) -> Column:
        return (level != "+") & ~F.contains(level, F.lit("%u")) & ~F.contains(level, F.lit("%c"))

    named = access.where("username IS NOT NULL AND topic IS NOT NULL")
    general = named.where(F.col("permission") == "all")
    both = [general.withColumn("permission", F.lit(p)) for p in ("publish", "subscribe")]
    return (
        named.where(F.col("permission") != "all")
        .unionByName(both[0])
        .unionByName(both[1])
        .select(
            F.col("username").alias("_who"),
            F.col("permission").alias("_action"),
            F.col("topic").alias("_filter"),
            number.alias("_id"),
            (F.coalesce(F.lower(verdict), F.lit("allow")) == "allow").cast("int").alias("_allow"),
            fixed.alias("_fixed"),
            ended.alias("_open"),
        )
        .select(
            "*",
            F.size("_fixed").alias("_levels"),
            F.transform("_fixed", lambda x: ~literal(x)).alias("_holes"),
            F.array_join(F.transform("_fixed", lambda x: F.when(literal(x), x).otherwise(HOLE)), "/").alias("_literal"),
        )
        .drop("_fixed")
        .distinct()
    )


def _keyed(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Accesses with the keys under which fitting filters lie, one row per shape in the list.

    Lengths take a handful of values, so the few shapes are copied to ``SALTS`` places and the accesses
    spread over these; no length is one task's work.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    shapes = rules.select("_levels", "_open", "_holes").distinct().select("*", every)
    depth = F.size(F.split("topic", "/", -1))
    closed = F.array(F.struct(depth.alias("_levels"), F.lit(False).alias("_open")))
    opened = F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("_levels"), F.lit(True).alias("_open")))
    who = F.array_distinct(F.array_compact(F.array("username", F.lit(EVERYONE))))
    salt = F.pmod(F.xxhash64(*SUBJECT), F.lit(SALTS)).cast("int").alias("_salt")
    lengths = asked.select(*SUBJECT, salt, F.explode(F.concat(closed, opened)).alias("_length"))
    lengths = lengths.select(*SUBJECT, "_salt", "_length._levels", "_length._open")
    shaped = lengths.join(shapes, ["_levels", "_open", "_salt"]).drop("_salt")
    head = F.slice(F.split("topic", "/", -1), F.lit(1), F.col("_levels"))
    masked = F.zip_with(head, "_holes", lambda x, hole: F.when(hole, F.lit(HOLE)).otherwise(x))
    keyed = shaped.withColumns({"_literal": F.array_join(masked, "/"), "_action": F.col("action"), "_whos": who})
    return keyed.select("*", F.explode("_whos").alias("_who")).drop("_whos")
