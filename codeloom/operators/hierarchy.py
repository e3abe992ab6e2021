"""Method look-up along class hierarchies, level by level from the top; every class above a class as a fixpoint of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import freed, new_folder, written
from .traverse import reachable


def direct_bases(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """(class, base, nth): the bases of each class that are classes of the table, numbered from 0 as written.

    The order is that of the relationships' places in the source; those without a place come last, by id. A
    base that is named twice counts where it is named first, and a class is no base of itself.
    """
    classes = symbols.where("type = 'class'").select("id").distinct()
    at = F.struct(F.coalesce(F.get("evidence", F.lit(0)).getField("start_line"), F.lit(2147483647)), F.coalesce(F.get("evidence", F.lit(0)).getField("start_col"), F.lit(2147483647)), F.col("target_id"))
    held = relationships.where("rel_type = 'INHERITS' and source_id <> target_id").select(F.col("source_id").alias("class"), F.col("target_id").alias("base"), at.alias("at"))
    held = held.join(classes.select(F.col("id").alias("base")), "base", "left_semi").join(classes.select(F.col("id").alias("class")), "class", "left_semi")
    firsts = held.groupBy("class", "base").agg(F.min("at").alias("at"))
    ordered = firsts.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("at", "base"))).alias("bases"))  # the bases of one class statement
    return ordered.select("class", F.posexplode("bases").alias("nth", "b")).select("class", F.col("b.base").alias("base"), "nth")


def ancestors(bases: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(class, ancestor, path): every class above each class (or each of ``of``), with the least way up, as the numbers of bases from below.

    Semi-naive: a round joins the ways found or bettered last with the direct bases, and keeps those to new
    ancestors, or less than the known way. A way meets no class twice, so cycles end. Nothing inherits from nothing:
    an empty table gives an empty table.
    """
    e = written(bases.select(F.col("class").alias("at"), F.col("base").alias("next"), "nth"), "bases")
    met = e.where(F.col("at") != F.col("next"))
    first = met if of is None else met.join(of.select(F.col("class").alias("at")).distinct(), "at", "left_semi")
    delta = written(first.select(F.col("at").alias("class"), F.col("next").alias("ancestor"), F.array("nth").alias("path"), F.array("at", "next").alias("via")), "ways")
    known = delta
    while not delta.isEmpty():
        onward = delta.withColumnRenamed("ancestor", "at").join(e, "at").where(~F.array_contains("via", F.col("next")))
        ways = onward.select("class", F.col("next").alias("ancestor"), F.array_append("path", F.col("nth")).alias("path"), F.array_append("via", F.col("next")).alias("via"))
        best = ways.groupBy("class", "ancestor").agg(F.min_by(F.struct("path", "via"), "path").alias("w")).select("class", "ancestor", "w.path", "w.via")
        old = known.select("class", "ancestor", F.col("path").alias("old"))
        delta = written(best.join(old, ["class", "ancestor"], "left").where("old is null or path < old").drop("old"), "ways")
        kept = known.join(delta.select("class", "ancestor"), ["class", "ancestor"], "left_anti")
        known = written(kept.select(*delta.columns).union(delta), "ancestors")
    return known.select("class", "ancestor", "path")


def find_methods(asked: DataFrame, above: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, name, own, id): the method that each asked (class, name, own) means.

    With ``own`` the class itself is looked into first, else only what is above it, as ``super()`` does. A
    definition hides those in all classes above its own; of the ones left that on the least way up counts, so bases go
    from left to right and a diamond's joint base comes last. ``methods`` are (class, name, id). Asked methods
    that no class has are left out.
    """
    starts = asked.distinct()
    here = starts.where("own").select("class", "name", "own", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("path"))
    up = starts.join(above, "class").select("class", "name", "own", "ancestor", "path")
    defined = methods.groupBy(F.col("class").alias("ancestor"), "name").agg(F.max("id").alias("id"))
    found = written(here.union(up).join(defined, ["ancestor", "name"]), "definitions")
    hiding = found.select("class", "name", "own", F.col("ancestor").alias("lower")).join(above.select(F.col("class").alias("lower"), "ancestor"), "lower")
    left = found.join(hiding.select("class", "name", "own", "ancestor").distinct(), ["class", "name", "own", "ancestor"], "left_anti")
    return left.groupBy("class", "name", "own").agg(F.min_by("id", "path").alias("id"))


def look_up(asked: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """What ``find_methods`` gives, from (class, base, nth), without every class above every class.

    Classes are taken from the top, those whose bases are done in one round. A class and a name keep the definers that
    are not hidden, in order of the least way up, and the definers above those; both follow from those of the bases
    alone: of the bases' definers, first base first, those above another one go. So a class costs what
    its own bases found, and a round is a join with them. Classes on or below a cycle have no such
    order; only calls on them go by ``ancestors`` and ``find_methods``.
    """
    spark = bases.sparkSession
    with freed(spark):
        starts = written(asked.select("class", "name", "own").distinct(), "asked")
        defined = written(methods.groupBy("class", "name").agg(F.max("id").alias("id")), "defined")
        held = written(bases.where(F.col("class") != F.col("base")).select("class", "base", "nth"), "bases")
        ends = held.select("class").union(held.select("base")).distinct()
        numbers = written(ends.select("class", F.monotonically_increasing_id().alias("k")), "class-numbers")
        numbered = held.join(numbers, "class").select("k", "base", "nth").join(numbers.select(F.col("class").alias("base"), F.col("k").alias("b")), "base")
        left, levels, cyclic = written(numbered.select("k", "b", "nth"), "bases-left"), [], None
        n = left.count()
        while n:
            waiting = left.select("k").distinct()
            later = left.join(waiting.withColumnRenamed("k", "b"), "b", "left_semi").select("k").distinct().withColumn("later", F.lit(True))
            marked = written(left.join(later, "k", "left"), "bases-left")
            left = marked.where("later").select("k", "b", "nth")
            m = left.count()
            if m == n:
                cyclic = left.select("k").distinct()
                break
            levels.append(marked.where("later is null").select("k", "b", "nth"))
            n = m
        known_levels = [x.select("k", F.lit(i + 1).alias("level")) for i, x in enumerate(levels)] + ([] if cyclic is None else [cyclic.withColumn("level", F.lit(-1))])
        owned = defined.join(numbers, "class").select("k", "name")
        if known_levels:
            owned = owned.join(reduce(DataFrame.union, known_levels).distinct(), "k", "left")
        else:
            owned = owned.withColumn("level", F.lit(None).cast("int"))
        owned = written(owned.fillna(0, ["level"]), "owned")
        nobody, folder = F.array().cast("array<bigint>"), new_folder(spark, "definers")
        top = owned.where("level = 0").select("k", "name", F.lit(None).cast("bigint").alias("first"), F.array("k").alias("seen"), nobody.alias("above"))
        known = written(top, "definers", f"{folder}/level=0")
        for level, now in enumerate(levels, 1):
            met = now.join(known.select(F.col("k").alias("b"), "name", "seen", "above"), "b").select("k", "name", "nth", "seen", "above")
            mine = owned.where(F.col("level") == level).select("k", "name", F.lit(-1).alias("nth"), nobody.alias("seen"), nobody.alias("above"))
            of = met.union(mine).groupBy("k", "name").agg(F.array_sort(F.collect_list(F.struct("nth", "seen", "above"))).alias("of"))  # the bases of one class
            hidden = F.array_distinct(F.flatten("of.above"))
            of = of.select("k", "name", (F.col("of")[0]["nth"] < 0).alias("own"), F.array_except(F.flatten("of.seen"), hidden).alias("seen"), hidden.alias("above"))
            own, first = F.col("own"), F.get("seen", F.lit(0)).alias("first")
            of = of.select("k", "name", first, F.when(own, F.array("k")).otherwise(F.col("seen")).alias("seen"), F.when(own, F.concat("seen", "above")).otherwise(F.col("above")).alias("above"))
            written(of, "definers", f"{folder}/level={level}")
            known = spark.read.schema(known.schema).parquet(folder)
        firsts = known.select("k", "name", "first").where("first is not null")
        firsts = firsts.join(numbers, "k").join(numbers.select(F.col("k").alias("first"), F.col("class").alias("at")), "first").select("class", "name", "at")
        inherited = firsts.join(defined.withColumnRenamed("class", "at"), ["at", "name"]).select("class", "name", F.col("id").alias("up"))
        plain = starts if cyclic is None else starts.join(cyclic.join(numbers, "k"), "class", "left_anti")
        found = plain.join(defined, ["class", "name"], "left").join(inherited, ["class", "name"], "left")
        found = found.select("class", "name", "own", F.when(F.col("own"), F.coalesce("id", "up")).otherwise(F.col("up")).alias("id")).where("id is not null")
        if cyclic is None:
            return found
        odd = written(cyclic.join(numbers, "k").select("class"), "cyclic")
        upward = reachable(held.select(F.col("class").alias("source_id"), F.col("base").alias("target_id")), odd).select(F.col("id").alias("class"))
        return found.union(find_methods(starts.join(odd, "class", "left_semi"), ancestors(held, upward), methods))


def receivers(relationships: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(source_id, target_id, class, name, own): open calls of methods whose receiver's class is known from the relations.

    Receivers: ``self`` and ``cls``, ``super()``, a class named in the call or imported (``Base.run``, ``pkg.Base.run``), and an
    instance made in the call (``Base().run``) where the same caller's call of the class is resolved.
    """
    calls = relationships.where("rel_type = 'CALLS' and (target_id like 'unresolved:%' or target_id like 'module:%')").select("source_id", "target_id").distinct()
    text = F.regexp_replace("target_id", "^(unresolved|module):", "")
    split = calls.select("source_id", "target_id", F.regexp_extract(text, r"^(.*)\.([^.()]+)$", 1).alias("on"), F.regexp_extract(text, r"^(.*)\.([^.()]+)$", 2).alias("name"))
    split = written(split.where("on <> '' and name <> ''"), "open-calls")
    owner = symbols.where("type = 'method' and parent_id is not null").select(F.col("id").alias("source_id"), F.col("parent_id").alias("class")).distinct()
    columns = ["source_id", "target_id", "class", "name"]
    inside = split.where("on in ('self', 'cls', 'super()')").join(owner, "source_id").select(*columns, (F.col("on") != "super()").alias("own"))
    classes = symbols.where("type = 'class'").select("id", "repo", "file_path", F.element_at(F.split("id", ":"), -1).alias("qualified")).distinct()
    named = split.where("target_id like 'module:%'").join(modules.select(F.col("key").alias("on"), F.col("id").alias("class")), "on").join(classes.select(F.col("id").alias("class")), "class", "left_semi").select(*columns, F.lit(True))
    at = symbols.select(F.col("id").alias("source_id"), "repo", "file_path").distinct()
    local = split.where("target_id like 'unresolved:%'").join(at, "source_id").join(classes.select("repo", "file_path", F.col("qualified").alias("on"), F.col("id").alias("class")), ["repo", "file_path", "on"]).select(*columns, F.lit(True))
    made = relationships.where("rel_type = 'CALLS'").select("source_id", F.concat(F.element_at("metadata", "callee_name"), F.lit("()")).alias("on"), F.col("target_id").alias("class")).join(classes.select(F.col("id").alias("class")), "class", "left_semi").distinct()
    instance = split.where("target_id like 'unresolved:%' and on like '%()'").join(made, ["source_id", "on"]).select(*columns, F.lit(True))
    return inside.union(named).union(local).union(instance).groupBy("source_id", "target_id", "name").agg(F.min(F.struct("class", "own")).alias("r")).select("source_id", "target_id", "r.class", "name", "r.own")
