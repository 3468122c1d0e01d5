"""Problem 4: splits that keep linked records together.

Records name entities (here papers); records that share one, directly or through
others, form a component. The component table (entity, component) is persisted
(:func:`advance` reads the last version below a folder and writes the next) and
extended: new links between entities are merged into it by pointer jumping,
so a new batch costs what it adds. Components that already have a split keep it,
new ones fill what each split lacks, and a component whose parts were in
different splits before is quarantined.

Scale: rows are reduced to distinct entities and distinct links before anything
iterates; an entity in a third of all rows is one row there. Each round halves
the depth of the pointer forest and is cut by a checkpoint; one side of every join
there has unique keys and rows of two ids, so a hub or a giant component is split by
the skew handling of adaptive execution, or never shuffled where the other side is
small enough to broadcast.

Defined results: a record that names no entity is a component of its own; null
and blank paths name nothing; rows without an id are left out; rows delivered
twice are one record; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.scale import cut, empty_like, salted_join, shared_folder

# Fixed value: an arXiv number, old or new style.
ARXIV_NUMBER = r"(\d{4}\.\d{4,9}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})"
ENTITY_SCHEMA = "entity string, component string"
SPLIT_SCHEMA = "component string, split string, n_records bigint"
#: A component with more than one record in LARGE of all is placed one by one; there are at most LARGE of them.
LARGE = 1000
BUCKETS = 4096


def arxiv_numbers(paths: Column) -> Column:
    """Distinct arXiv numbers named in an array of paths, whatever folder, file kind, version, case or page is written."""
    each = F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.regexp_extract_all(F.lower(F.coalesce(p, F.lit(""))), F.lit(ARXIV_NUMBER), F.lit(1)))
    return F.array_distinct(F.flatten(each))


def records(*parts: DataFrame) -> DataFrame:
    """(id, entities array<string>): one row per id; each part has columns id and paths array<string>."""
    out = None
    for p in parts:
        q = p.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), arxiv_numbers(F.col("paths")).alias("entities"))
        out = q if out is None else out.unionByName(q)
    return out


def components(recs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(entity, component, previous): the component of every entity named in ``recs`` or in ``known``.

    ``known`` is an earlier result (entity, component). The component is the
    smallest entity in it; ``previous`` is the entity's component before.
    """
    spark = recs.sparkSession
    if known is None:
        known = empty_like(spark, ENTITY_SCHEMA)
    known = known.select("entity", "component")
    links = (
        recs.where(F.size("entities") > 1)
        .select(F.explode(F.slice("entities", 2, F.size("entities"))).alias("b"), F.col("entities")[0].alias("a"))
        .distinct()
    )
    named = recs.select(F.explode("entities").alias("entity")).distinct()
    start = known.unionByName(named.join(known, "entity", "left_anti").withColumn("component", F.col("entity")))
    start = cut(start, loop=True)

    # Links between components as they stand, then pointers from root to root.
    to = start.select(F.col("entity"), F.col("component"))
    edges = (
        links.join(to.select(F.col("entity").alias("a"), F.col("component").alias("u")), "a")
        .join(to.select(F.col("entity").alias("b"), F.col("component").alias("v")), "b")
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = cut(edges, loop=True)
    merged = empty_like(spark, "node string, root string")
    if not edges.isEmpty():
        merged = _pointer_jump(edges)
    return (
        start.join(merged, start["component"] == merged["node"], "left")
        .select("entity", F.coalesce("root", "component").alias("component"), F.col("component").alias("previous"))
    )


def _pointer_jump(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each node of ``edges``.

    Each round every root hooks onto the smallest root next to its tree, and
    every node then jumps to its pointer's pointer until all trees are stars.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    p = cut(nodes.withColumn("root", F.col("node")), loop=True)
    while True:
        a = p.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = p.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = cut(edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), edges, loop=True)
        if edges.isEmpty():
            return p
        hook = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
        hook = cut(hook, loop=True)
        while True:  # jump over the hooked roots: at most log(depth) times
            h2 = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            nxt = cut(hook.join(h2, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), loop=True)
            moved = not nxt.where("moved").isEmpty()
            hook = nxt.select("node", "to")
            if not moved:
                break
        p = cut(p.join(hook.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), p, loop=True)


def groups(recs: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(id, component, group_id): group_id is the smallest id of the linked group; ``comp`` is the component table where it is there already."""
    if comp is None:
        comp = cut(components(recs).select("entity", "component"), loop=True)
    first = recs.withColumn("entity", F.try_element_at("entities", F.lit(1))).select("id", "entity")
    some = first.where("entity is not null")
    smallest = some.groupBy("entity").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    per = comp.join(smallest, "entity")
    by_component = per.groupBy("component").agg(F.min("least_id").alias("group_id"))
    lookup = per.select("entity", "component", "n").join(by_component, "component").select("entity", "component", "group_id", "n")
    linked = salted_join(some, lookup, "entity", "n", F.col("id")).select("id", "component", "group_id")
    return linked.unionByName(first.where("entity is null").select("id", F.concat(F.lit("id:"), "id").alias("component"), F.col("id").alias("group_id"))).distinct()


def found(*parts: DataFrame) -> DataFrame:
    """(task_id, group_id): one row per record."""
    return groups(cut(records(*parts))).select(F.col("id").alias("task_id"), "group_id").groupBy("task_id").agg(F.min("group_id").alias("group_id"))


def assign_splits(recs: DataFrame, targets: DataFrame, known: DataFrame | None = None, known_splits: DataFrame | None = None, known_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assign every component to a split; returns (component table, split table).

    Component table: (entity, component), to be passed as ``known`` next time.
    Split table: (component, split, n_records, state), to be passed as
    ``known_splits``; state is kept, new or quarantined (parts came from
    different splits; split is then null). ``n_records`` counts the records of
    all batches. Records of ``recs`` whose id is in ``known_ids`` (column id), or
    that name nothing and are a known component, were counted before.
    ``targets`` is (split_name, target_share), a handful of rows.

    New components larger than 1/LARGE of all records are placed one by one into
    the split that lacks most; all others are cut into BUCKETS ranges of their
    hash and ranges go to splits by what is still lacking, so only bounded
    tables reach the driver.
    """
    spark = recs.sparkSession
    recs = cut(recs)  # read once
    comp = cut(components(recs, known), loop=True)
    table = comp.select("entity", "component")
    g = cut(groups(recs, table).select("id", "component"))
    old = empty_like(spark, SPLIT_SCHEMA) if known_splits is None else known_splits.select("component", "split", "n_records")
    fresh = g.groupBy("id").agg(F.min("component").alias("component"))
    if known_ids is not None:
        fresh = fresh.join(known_ids.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
    alone = F.concat(F.lit("id:"), "id")
    if known_splits is not None:  # records that named nothing before were counted and keep their split, also where they name something now
        fresh = fresh.withColumn("alone", alone).join(old.select(F.col("component").alias("alone")), "alone", "left_anti").drop("alone")
    sizes = fresh.groupBy("component").agg(F.count("*").alias("n_fresh"))
    named = g.where(F.col("component") != alone).select(alone.alias("previous"), F.col("component").alias("now"))
    renamed = comp.select(F.col("previous"), F.col("component").alias("now")).unionByName(named).distinct()
    moved = (
        old.join(renamed, old["component"] == renamed["previous"], "left")
        .select(F.coalesce("now", old["component"]).alias("component"), "split", "n_records")
        .groupBy("component")
        .agg(F.sum("n_records").alias("n_before"), F.min("split").alias("lo"), F.max("split").alias("hi"), F.count_if(F.col("split").isNull()).alias("q"))
    )
    state = cut(
        sizes.join(moved, "component", "full")
        .withColumn("n_records", F.coalesce("n_before", F.lit(0)) + F.coalesce("n_fresh", F.lit(0)))
        .withColumn("state", F.when(F.col("lo").isNull() & F.coalesce(F.col("q") == 0, F.lit(True)), "new").when((F.col("q") > 0) | (F.col("lo") != F.col("hi")), "quarantined").otherwise("kept"))
        .withColumn("split", F.when(F.col("state") == "kept", F.col("lo")))
        .select("component", "split", "n_records", "state")
    )
    goal = {r["split_name"]: float(r["target_share"]) for r in targets.where("split_name is not null and target_share > 0").collect()}
    have = {r["split"]: r["n"] for r in state.where("state = 'kept'").groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    new = state.where("state = 'new'")
    total = sum(have.values()) + (new.agg(F.sum("n_records")).first()[0] or 0)
    whole = sum(goal.values()) or 1.0
    lack = {s: share / whole * total - have.get(s, 0) for s, share in sorted(goal.items())}
    if not lack:
        return table, state
    big_rows = new.where(F.col("n_records") * LARGE > F.lit(total)).orderBy(F.desc("n_records"), "component").collect()
    placed = []
    for r in big_rows:
        s = max(lack, key=lambda k: (lack[k], k))
        lack[s] -= r["n_records"]
        placed.append((r["component"], s))
    bucket = F.pmod(F.xxhash64("component", F.lit(11)), F.lit(BUCKETS)).cast("int")
    small = new.where(F.col("n_records") * LARGE <= F.lit(total)).withColumn("b", bucket)
    ranges = []
    for r in small.groupBy("b").agg(F.sum("n_records").alias("n")).orderBy(F.desc("n"), "b").collect():
        s = max(lack, key=lambda k: (lack[k], k))
        lack[s] -= r["n"]
        ranges.append((r["b"], s))
    by_name = spark.createDataFrame(placed, "component string, s string")
    by_bucket = spark.createDataFrame(ranges, "b int, s string")
    done = (
        state.withColumn("b", bucket)
        .join(F.broadcast(by_name.withColumnRenamed("s", "s1")), "component", "left")
        .join(F.broadcast(by_bucket.withColumnRenamed("s", "s2")), "b", "left")
        .withColumn("split", F.when(F.col("state") == "new", F.coalesce("s1", "s2")).otherwise(F.col("split")))
        .select("component", "split", "n_records", "state")
    )
    return table, done


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below ``path`` that were written to the end."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/ids/_SUCCESS")))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(component table, split table, ids) of the last whole version below ``path``, or None before the first."""
    have = _versions(spark, path)
    return tuple(spark.read.parquet(f"{path}/v{have[-1]}/{x}") for x in ("components", "splits", "ids")) if have else None


def advance(recs: DataFrame, targets: DataFrame, path: str) -> None:
    """Merge a batch of records into the persisted tables below ``path``: reads the last version and writes the next.

    A version counts once its last table is whole, so a lost run leaves the one before.
    """
    spark = recs.sparkSession
    known = load(spark, path)
    table, splits, seen = known or (None, None, None)
    comp, done = assign_splits(recs, targets, table, splits, seen)
    ids = recs.select("id").distinct() if seen is None else recs.select("id").union(seen.select("id")).distinct()
    root = f"{path}/v{(_versions(spark, path) or [0])[-1] + 1}"
    comp.write.mode("overwrite").parquet(f"{root}/components")
    done.write.mode("overwrite").parquet(f"{root}/splits")
    ids.write.mode("overwrite").parquet(f"{root}/ids")


def batch_splits(batches: list[DataFrame], targets: DataFrame, path: str | None = None) -> DataFrame:
    """(id, component, split): the split of every record, where the batches arrive one after another; the tables persist below ``path``."""
    spark = targets.sparkSession
    path = path or f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    seen = None
    for recs in batches:
        recs = cut(recs)
        advance(recs, targets, path)
        seen = recs if seen is None else seen.unionByName(recs)
    table, splits, _ = load(spark, path)
    g = groups(seen, table).groupBy("id").agg(F.max(F.struct(~F.startswith("component", F.lit("id:")), "component")).alias("c")).select("id", "c.component")
    lookup = splits.select("component", "split", F.col("n_records").alias("n"))
    return salted_join(g, lookup, "component", "n", F.col("id")).select("id", "component", "split")


def batch_states(batches: list[DataFrame], targets: DataFrame) -> DataFrame:
    """(state, n_components, n_records) after the last batch; kept and quarantined components count together as old."""
    spark = targets.sparkSession
    path = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    for recs in batches:
        advance(recs, targets, path)
    state = F.when(F.col("state") == "new", "new").otherwise("old")
    return load(spark, path)[1].groupBy(state.alias("state")).agg(F.count("*").alias("n_components"), F.sum("n_records").alias("n_records"))


def record_splits(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, component, split): the split of every record, with a fresh component table."""
    recs = cut(recs)
    table, splits = assign_splits(recs, targets)
    lookup = splits.select("component", "split", F.col("n_records").alias("n"))
    return salted_join(groups(recs, table).select("id", "component"), lookup, "component", "n", F.col("id")).select("id", "component", "split")


def balance(recs: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(split, off_target, torn): whether a split's share misses its target by more than ``tolerance``, and how many linked groups lie in more than one split."""
    recs = cut(recs)
    placed = cut(record_splits(recs, targets))
    n = placed.groupBy("split").agg(F.count("*").alias("n"))
    torn = placed.join(groups(recs).select("id", "group_id"), "id").groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) / placed.agg(F.count("*")).scalar()
    return targets.select(F.col("split_name").alias("split"), "target_share").join(n, "split", "left").select("split", (F.abs(share - F.col("target_share")) > tolerance).alias("off_target"), torn.scalar().alias("torn"))
