"""Splits that keep related records together, batch after batch.

Records are related when they share an entity (a protein, a cluster, a lab), directly or through others. The state is a
persisted table of components, with the records and entities that point to them (State: a folder of written versions).
A new batch
1. links each of its records to the least record that holds the same entity, and to the groups that its entities and
   its record id are in already; hubs are combined by a partial aggregate, so an entity with a third of all rows is one
   row by then;
2. is resolved by hooking and pointer jumping over records and group ids. A group is named by its least record; where
   groups meet, the pointers of their components are moved to the common one;
3. keeps the split of existing components; a component that is new fills the split that lacks most; records that join
   components of different splits are quarantined (no split) instead of leaking from one split to another, while the
   components keep their splits. Quarantined are the records that hold entities of two splits themselves, and those that
   still join two splits through new entities when these are taken out; all others of the group are placed.

Components that hold more than ``large`` of all records (a parameter, one in a thousand) are placed one by one, largest
first, into the split that lacks most (there are fewer than 1 / large of them); smaller ones are spread by a hash of
their id in proportion to what is lacking, and so miss the proportions by chance, the less the more there are. Both are
the same on every run.

Edge cases: placeholders for nothing and nulls are no entity; case and outer blanks are ignored; rows of one record
id are one record with all their entities, and a record that comes again in a later batch is counted once (it keeps its
component unless it now joins two splits: then it is quarantined); a record without entities is a component of its own;
records with a null id are left out; empty batches leave the state as it is; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.functions.scalars import is_placeholder, squeezed
from fjordmill.operators.components import roots
from fjordmill.session import Workspace, side_by_side

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
TABLES = {
    "records": "record long, component string, batch int",
    "entities": "entity string, component string, batch int",
    "components": "component string, grp long, split string, size long",
}
#: Versions after which the records and entities of all batches are written as one table again.
COMPACT = 16


def holdings(records: DataFrame, record: str, entities: list[str]) -> DataFrame:
    """(record, entity): one row per record and entity it holds; the entity is named with its column."""
    each = F.explode(F.array(*(F.when(~is_placeholder(F.col(e).cast("string")), F.concat(F.lit(e + ":"), squeezed(F.col(e).cast("string")))) for e in entities))).alias("entity")
    return records.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("record"), each).where("entity is not null").distinct()


class State:
    """The persisted component table, in a folder that all machines share.

    Each batch is a version: v<N>/components (all of them), v<N>/records and v<N>/entities (those of the batch; the latest
    row of a key holds), then v<N>/complete. A version without ``complete`` is what an interrupted batch left: it is
    ignored and written anew, so a restart between or within batches gives the same splits.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.base = 0, 1
        fs = self._fs()
        if fs.exists(self._p("")):
            names = [s.getPath().getName() for s in fs.listStatus(self._p(""))]
            done = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._p(f"{n}/complete")))
            self.version = done[-1] if done else 0
            self.base = max([v for v in done if fs.exists(self._p(f"v{v}/base"))], default=1)

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._p("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name])
        if not self.version:
            return self.spark.createDataFrame([], TABLES[name])
        if name == "components":
            return reader.parquet(f"{self.path}/v{self.version}/components")
        rows = reader.parquet(*(f"{self.path}/v{v}/{name}" for v in range(self.base, self.version + 1)))
        if self.base == self.version:
            return rows
        key = TABLES[name].split()[0]
        return rows.groupBy(key).agg(F.max_by("component", "batch").alias("component"), F.max("batch").alias("batch"))

    def assignments(self) -> DataFrame:
        """(record, component, group_key, split, quarantined) of every record of all batches."""
        rows = self.table("records").join(self.table("components"), "component")
        return rows.select("record", "component", F.col("grp").alias("group_key"), "split", F.col("split").isNull().alias("quarantined"))

    def write(self, components: DataFrame, records: DataFrame, entities: DataFrame) -> None:
        """One more version; it counts once all of it is written."""
        v, fs = self.version + 1, self._fs()
        fs.delete(self._p(f"v{v}"), True)
        parts = {"components": components, "records": records, "entities": entities}
        side_by_side([lambda n=n, df=df: df.write.parquet(f"{self.path}/v{v}/{n}") for n, df in parts.items()])
        fs.create(self._p(f"v{v}/complete")).close()
        self.version = v
        if v - self.base >= COMPACT:
            self.compact()

    def compact(self) -> None:
        """Write the latest records and entities as a version that needs none before it."""
        v, fs = self.version + 1, self._fs()
        fs.delete(self._p(f"v{v}"), True)
        for name in TABLES:
            self.table(name).write.parquet(f"{self.path}/v{v}/{name}")
        fs.create(self._p(f"v{v}/base")).close()
        fs.create(self._p(f"v{v}/complete")).close()
        self.version = self.base = v


def _lacking(sizes: dict[str, int], total: int, shares: dict[str, float]) -> dict[str, float]:
    return {s: share * total - sizes.get(s, 0) for s, share in shares.items()}


def place(components: DataFrame, total_new: int, held: dict[str, int], shares: dict[str, float], large: float = 0.001) -> DataFrame:
    """(component, n, split) for new components (component string, n long) of that many records in all, given the sizes
    that the splits have."""
    total = total_new + sum(held.values())
    limit = max(1, int(total * large))
    big = components.where(F.col("n") > limit).orderBy(F.desc("n"), "component").collect()  # fewer than 1 / large
    sizes, chosen = dict(held), []
    for r in big:
        lack = _lacking(sizes, total, shares)
        split = max(lack, key=lambda s: (lack[s], s))
        sizes[split] = sizes.get(split, 0) + r.n
        chosen.append((r.component, r.n, split))
    lack = {s: max(0.0, v) for s, v in _lacking(sizes, total, shares).items()}
    whole = sum(lack.values()) or 1.0
    at, pick = 0.0, F.lit(max(shares, key=shares.get))
    point = F.pmod(F.xxhash64("component"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    bounds = []
    for s in sorted(shares, key=shares.get):
        at += lack[s] / whole
        bounds.append((at, s))
    for top, s in reversed(bounds):
        pick = F.when(point < top, s).otherwise(pick)
    named = components.sparkSession.createDataFrame(chosen, "component string, n long, split string")
    return named.unionByName(components.where(F.col("n") <= limit).select("component", "n", pick.alias("split")))


def _one_split(splits: Column) -> Column:
    return F.when(F.size(splits) == 1, splits[0])


def update(state: State, batch: DataFrame, *, record: str, entities: list[str], shares: dict[str, float] | None = None, work: Workspace | None = None) -> DataFrame:
    """Bring a batch into the state. Returns (record, component, group_key, split, quarantined) of the batch's records."""
    shares = shares or SPLITS
    work = work or Workspace(batch.sparkSession, "splits")
    turn = F.lit(state.version + 1)
    named = lambda kind, r: F.concat(F.lit(kind), F.col(r), F.lit("."), turn)  # noqa: E731  a new component: its least record and batch
    comps = state.table("components")
    held = work.put(holdings(batch, record, entities), "holdings")
    every = batch.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("record")).distinct()
    # what the state knows of the batch's entities and records; a component without a split is quarantined
    by_entity = held.groupBy("entity").agg(F.min("record").alias("least")).join(state.table("entities").select("entity", "component"), "entity", "left").join(comps, "component", "left")
    by_record = every.join(state.table("records").select("record", "component"), "record", "left").join(comps, "component", "left")
    by_entity, by_record = work.put_all(by_entity=by_entity.select("entity", "least", "component", "grp", "split"), by_record=by_record.select("record", "component", "grp", "split"))
    hold = held.join(by_entity, "entity")
    edges = hold.select(F.col("record").alias("a"), F.col("least").alias("b")).unionByName(by_entity.where("grp is not null").select(F.col("least").alias("a"), F.col("grp").alias("b")))
    edges = edges.unionByName(by_record.select(F.col("record").alias("a"), F.coalesce("grp", "record").alias("b")))
    found = roots(edges, work, "splits")
    # the placed components that each record touches by itself
    touch = hold.where("split is not null").select("record", "component", "split").unionByName(by_record.where("split is not null").select("record", "component", "split"))
    own = touch.groupBy("record").agg(F.collect_set("split").alias("splits"), F.min("component").alias("touched"))  # at most one row per split and record
    rows = by_record.select("record", F.col("component").alias("old"), F.col("split").alias("old_split")).join(found.select(F.col("node").alias("record"), "root"), "record").join(own, "record", "left")
    rows = rows.withColumn("splits", F.coalesce("splits", F.expr("array()")))
    whole = rows.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_set("splits"))).alias("all"), F.min("touched").alias("first"), F.min("record").alias("least"))
    rows = work.put(rows.join(whole, "root"), "whole")
    # groups whose components have one split, or none yet: all of the group goes there
    calm = rows.where(F.size("all") <= 1).select("record", "root", "old", "old_split", _one_split(F.col("all")).alias("split"), F.coalesce("first", named("c", "least")).alias("component"))
    torn = rows.where(F.size("all") > 1)
    decided = calm
    if not torn.isEmpty():
        astride = torn.where(F.size("splits") > 1)
        rest = torn.where(F.size("splits") <= 1)
        # without the records that stand astride: joined through entities that have no split yet
        loose = hold.where("split is null").join(rest.select("record"), "record", "left_semi").select("record", "entity")
        links = loose.join(loose.groupBy("entity").agg(F.min("record").alias("b")), "entity").select(F.col("record").alias("a"), "b").unionByName(rest.select(F.col("record").alias("a"), F.col("record").alias("b")))
        part = rest.join(roots(links, work, "parts").select(F.col("node").alias("record"), F.col("root").alias("part")), "record")
        each = part.groupBy("part").agg(F.array_distinct(F.flatten(F.collect_set("splits"))).alias("parts"), F.min("touched").alias("start"), F.min("record").alias("lead"))
        part = work.put(part.join(each, "part"), "part")
        lost = astride.select("record", "root", "old", "old_split").unionByName(part.where(F.size("parts") > 1).select("record", "root", "old", "old_split"))
        lost = lost.join(lost.groupBy("root").agg(F.min("record").alias("q")), "root").select("record", "root", "old", "old_split", F.lit(None).cast("string").alias("split"), named("q", "q").alias("component"))
        kept = part.where(F.size("parts") <= 1).select("record", "root", "old", "old_split", _one_split(F.col("parts")).alias("split"), F.coalesce("start", named("c", "lead")).alias("component"))
        decided = calm.unionByName(kept).unionByName(lost)
    # a record that is placed already stays in its component, unless it is quarantined now
    stays = (F.col("old_split") == F.col("split")) & ~F.col("component").startswith("q")
    decided = work.put(decided.select("record", "root", "old", F.when(stays, F.col("old")).otherwise(F.col("component")).alias("component"), "split"), "decided")
    is_new = F.col("split").isNull() & F.col("component").startswith("c")
    grown = decided.where("split is not null and not (component <=> old)").groupBy("split").agg(F.count("*").alias("n"))
    new_rows = decided.where(is_new).agg(F.count("*").alias("n")).select(F.lit("").alias("split"), "n")
    sizes: dict[str, int] = {"": 0}
    for r in comps.where("split is not null").groupBy("split").agg(F.sum("size").alias("n")).unionByName(grown).unionByName(new_rows).collect():  # two rows per split
        sizes[r.split] = sizes.get(r.split, 0) + r.n
    fresh = place(decided.where(is_new).groupBy("component").agg(F.count("*").alias("n")), sizes.pop(""), sizes, shares)
    decided = work.put(decided.join(fresh.select("component", F.col("split").alias("new_split")), "component", "left").select("record", "root", "old", "component", F.coalesce("split", "new_split").alias("split")), "decided")
    # pointers: the groups that met, and the components that grew, shrank or are new
    moved = found.join(by_entity.select(F.col("grp").alias("node")).unionByName(by_record.select(F.col("grp").alias("node"))).where("node is not null").distinct(), "node").select(F.col("node").alias("grp"), "root")
    more = decided.where("not (component <=> old)").groupBy("component").agg(F.count("*").alias("d"), F.min("split").alias("s"), F.min("root").alias("r"))
    less = decided.where("old is not null and component <> old").groupBy(F.col("old").alias("component")).agg((-F.count("*")).alias("d"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("r"))
    delta = more.unionByName(less).groupBy("component").agg(F.sum("d").alias("d"), F.min("s").alias("s"), F.min("r").alias("r"))
    new = comps.join(moved, "grp", "left").select("component", F.coalesce("root", "grp").alias("grp"), "split", "size").join(delta, "component", "full_outer")
    new = new.select("component", F.coalesce("grp", "r").alias("grp"), F.coalesce("split", "s").alias("split"), (F.coalesce("size", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("long").alias("size"))
    # an entity points to the placed component of its records; to a quarantined one only while there is none
    best = held.join(decided.select("record", "component", "split"), "record").groupBy("entity").agg(F.coalesce(F.min(F.when(F.col("split").isNotNull(), F.col("component"))), F.min("component")).alias("now"))
    told = by_entity.join(best, "entity").where("split is null").select("entity", F.col("now").alias("component"), turn.alias("batch"))
    state.write(new, decided.select("record", "component", turn.alias("batch")), told)
    return decided.select("record", "component", F.col("root").alias("group_key"), "split", F.col("split").isNull().alias("quarantined"))


def shared(grouped: DataFrame) -> DataFrame:
    """(record, group_key) of the groups of two or more records."""
    sizes = grouped.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1")
    return grouped.join(sizes.select("group_key"), "group_key", "left_semi")
