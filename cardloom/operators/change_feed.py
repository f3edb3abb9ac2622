"""A feed of inserts, updates and deletes, applied in the right order to a merge-on-read table.

What counts. Of the rows with one idempotency key only the first to arrive is considered. A change counts if its expected revision
is the record's revision at that point and the record exists (for an add: does not exist); among several that could, the first to
arrive. Every change that counts raises the revision by one. A supersede also starts its new record at revision 1. So a record's
history is a chain: at revision r at most two changes matter, the first add and the first other change that expect r. Which of them
count depends on the states before, and each step is a function of {absent, present}; functions compose, so the chain is evaluated in
blocks of BLOCK revisions, and blocks of blocks, with no task that holds all changes of one record. Changes that expect a revision
not yet reached wait and are considered again with the next batch; the result does not depend on how the feed is cut into batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.session import delete_path, scratch_path, written
from cardloom.sources.delete_vectors import COMPACT_AT, DeleteVectorTable, RevisionConflict

BLOCK = 256
OPS = ("add", "update", "supersede", "archive", "delete", "promote")
_FIELDS = ("tenant", "owner", "mount", "summary", "content", "bucket", "importance", "source", "archived", "archive_reason", "superseded_by")
_ABSENT, _PRESENT, _STOP = 0, 1, 2


def tidy(feed: DataFrame) -> DataFrame:
    """The feed with op_, record_, revision_ and key_ in one spelling.

    A null or blank op is an add; spelling of ops by letter case, blanks, '-' or ' ' does not matter. expected_revision is the first
    run of digits; null or blank is 0; text without digits expects no revision that can be. A row without idempotency key stands for
    itself. A row without record, a no_op or an unknown op never counts.
    """
    op = F.regexp_replace(F.lower(F.trim("op")), r"[\s-]+", "_")
    op = F.when(op.isNull() | (op == ""), "add").otherwise(op)
    record = F.when(op == "add", F.col("card.id")).when(op == "supersede", F.coalesce(F.get("target_ids", F.lit(0)), F.col("record_id"))).otherwise(F.col("record_id"))
    text = F.trim("expected_revision")
    revision = F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(F.regexp_extract(text, r"(\d{1,18})", 1).try_cast("long"))
    key = F.coalesce(F.col("idempotency_key"), F.concat(F.lit("feed_seq:"), F.col("feed_seq").cast("string")))
    return feed.withColumns({"op_": op, "record_": record, "revision_": revision, "key_": key})


def _steps(best: DataFrame, start: DataFrame) -> DataFrame:
    """Which steps of each record's chain are taken.

    best: record_, at_ (revision less the record's first), add_, other_ (structs or null), removes_. start: record_, state_.
    Returns record_, at_, state_ (the state in which the step is met) for the steps that are taken.
    """
    leaf = best.select(
        "record_",
        "at_",
        F.when(F.col("add_").isNotNull() | F.col("startable_"), _PRESENT).otherwise(_STOP).alias("absent_"),
        F.when(F.col("other_").isNull(), _STOP).when(F.col("removes_"), _ABSENT).otherwise(_PRESENT).alias("present_"),
    )
    levels: list[DataFrame] = []
    top = leaf
    while True:
        grouped = top.groupBy("record_", F.floor(F.col("at_") / BLOCK).cast("long").alias("block_")).agg(
            F.array_sort(F.collect_list(F.struct("at_", "absent_", "present_"))).alias("parts_")
        )
        grouped = written(grouped, "chain")
        levels.append(grouped)
        if not grouped.filter("block_ > 0").limit(1).count():
            break

        def walk(first: int) -> Column:
            begin = F.struct(F.lit(first).alias("s"), (F.col("block_") * BLOCK).alias("n"))

            def step(acc: Column, part: Column) -> Column:
                to = F.when(acc["s"] == _ABSENT, part["absent_"]).when(acc["s"] == _PRESENT, part["present_"]).otherwise(_STOP)
                to = F.when(part["at_"] == acc["n"], to).otherwise(_STOP)
                return F.struct(to.alias("s"), (acc["n"] + 1).alias("n"))

            full = lambda acc: F.when(acc["n"] == (F.col("block_") + 1) * BLOCK, acc["s"]).otherwise(_STOP)
            return F.aggregate("parts_", begin, step, full)

        top = grouped.select("record_", F.col("block_").alias("at_"), walk(_ABSENT).alias("absent_"), walk(_PRESENT).alias("present_"))
    entering = start.select("record_", F.lit(0).cast("long").alias("block_"), "state_")
    for grouped in reversed(levels):
        begin = F.struct(F.col("state_").alias("s"), (F.col("block_") * BLOCK).alias("n"), F.expr("cast(array() as array<struct<at_:bigint,state_:int>>)").alias("met"))

        def step(acc: Column, part: Column) -> Column:
            here = F.when(part["at_"] == acc["n"], acc["s"]).otherwise(_STOP)
            to = F.when(here == _ABSENT, part["absent_"]).when(here == _PRESENT, part["present_"]).otherwise(_STOP)
            met = F.when(here == _STOP, acc["met"]).otherwise(F.concat(acc["met"], F.array(F.struct(part["at_"].alias("at_"), here.cast("int").alias("state_")))))
            return F.struct(to.cast("int").alias("s"), (acc["n"] + 1).alias("n"), met.alias("met"))

        met = F.aggregate("parts_", begin, step, lambda acc: acc["met"])
        inner = grouped.join(entering, ["record_", "block_"]).select("record_", F.inline(met))
        entering = inner.select("record_", F.col("at_").alias("block_"), "state_")
    taken = entering.select("record_", F.col("block_").alias("at_"), "state_").join(leaf, ["record_", "at_"])
    return taken.filter(F.when(F.col("state_") == _ABSENT, F.col("absent_")).otherwise(F.col("present_")) != _STOP).select("record_", "at_", "state_")


def _reached(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The records (record_) that a path of `edges` (from_, to_) joins to one of `roots`. Chains are halved in every round; the round that reaches
    nothing new is the last, for then no edge leads on from what is reached."""
    live = written(edges.join(roots.select(F.col("record_").alias("from_")), "from_", "left_semi").select(F.col("to_").alias("record_")).distinct(), "reached")
    rest = edges.join(roots.select(F.col("record_").alias("from_")), "from_", "left_anti").join(live.select(F.col("record_").alias("to_")), "to_", "left_anti")
    rest = written(rest.distinct(), "waiting")
    while not rest.isEmpty():
        more = written(rest.join(live.select(F.col("record_").alias("from_")), "from_", "left_semi").select(F.col("to_").alias("record_")).distinct(), "more")
        if more.isEmpty():
            break
        live = written(live.unionAll(more), "reached")
        rest = rest.join(live.select(F.col("record_").alias("to_")), "to_", "left_anti")
        rest = written(_jump(rest, live).distinct(), "waiting")
    return live


def _jump(rest: DataFrame, live: DataFrame) -> DataFrame:
    """Replace the start of each edge by that start's only predecessor, where it has one; a start that is reached stays."""
    at = live.select(F.col("record_").alias("from_"), F.lit(True).alias("live_"))
    df = rest.join(at, "from_", "left")
    above = rest.groupBy(F.col("to_").alias("from_")).agg(F.min("from_").alias("up_"), F.count("*").alias("n_"))
    df = df.join(above, "from_", "left").filter(F.col("live_").isNotNull() | F.col("n_").isNotNull())
    jumped = F.when(F.col("live_").isNull() & (F.col("n_") == 1), F.col("up_")).otherwise(F.col("from_"))
    return df.select(jumped.alias("from_"), "to_").filter("from_ <> to_")


class RecordTable:
    """The records of a change feed as they stand, with receipts of all keys seen and the changes that still wait."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "records")
        self.images = DeleteVectorTable(spark, f"{self.path}/images", "record_", ["revision_", "deleted_"])

    def _parts(self, extra: dict, name: str) -> DataFrame | None:
        dirs = extra.get(name, [])
        return self.spark.read.parquet(*dirs) if dirs else None

    def records(self) -> DataFrame:
        """One row per record that exists: its id, fields, revision and the key of the last change that counted for it."""
        live = self.images.live()
        if live is None:
            raise ValueError("no batch was applied yet")
        return live.filter(~F.col("deleted_")).drop("file_", "pos_", "deleted_").withColumnsRenamed(
            {"record_": "record_id", "revision_": "revision", "key_": "idempotency_key", "written_at_": "updated_at"}
        )

    def apply(self, feed: DataFrame, note: dict | None = None, base: dict | None = None) -> int:
        """Apply one batch (columns of the feed; any others are ignored); returns the new version. A repeated batch changes nothing.

        Of two writers on one version the second fails with RevisionConflict and leaves nothing behind that is read: every file has a name
        of its own, and counts only once the manifest names it. `base` is the manifest that the batch was judged on (the newest, if none is
        given); `note` is kept in the new one. All decisions are made on narrow rows; a change's card and fields are fetched once it counts.
        """
        base = base or self.images.manifest()
        narrow = tidy(feed).select("feed_seq", "key_", "op_", "record_", "revision_", F.when(F.col("op_") == "supersede", F.col("card.id")).alias("new_"))
        first = narrow.groupBy("key_").agg(F.min_by(F.struct("feed_seq", "op_", "record_", "revision_", "new_"), "feed_seq").alias("row_")).select("key_", "row_.*")
        seen = self._parts(base["extra"], "receipts")
        if seen is not None:
            first = first.join(seen, "key_", "left_anti")
        tag = f"{base['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        receipts = f"{self.path}/receipts/{tag}"
        first.write.parquet(receipts)
        first = self.spark.read.schema(first.schema).parquet(receipts)
        payload = ["feed_seq", "key_", "op_", "tenant", "owner", "mount", "card", "changes", "to_mount", "reason", "written_at"]
        said = tidy(feed).select(*payload, "record_", "revision_")
        waiting = self._parts(base["extra"], "waiting")
        small = first.filter(F.col("op_").isin(*OPS) & F.col("record_").isNotNull() & F.col("revision_").isNotNull()).drop("key_")
        if waiting is not None:
            waiting = waiting.select(*payload, "record_", "revision_")
            said = said.unionByName(waiting)
            small = small.unionByName(waiting.select("feed_seq", "op_", "record_", "revision_", F.when(F.col("op_") == "supersede", F.col("card.id")).alias("new_")))

        # Where the records stand: from the index alone.
        touched = small.select("record_").unionAll(small.select(F.col("new_").alias("record_")).filter("record_ is not null")).distinct()
        current = self.images.lookup(touched, base)
        if current is None:
            current = self.spark.createDataFrame([], "record_ string, revision_ bigint, deleted_ boolean, file_ string, pos_ bigint")
        current = written(current, "current")
        now = current.select("record_", F.col("revision_").alias("from_"), (~F.col("deleted_")).alias("exists_"))

        # At most two changes for each record and revision, found with partial aggregation.
        is_add = F.col("op_") == "add"
        best = small.groupBy("record_", "revision_").agg(
            F.min(F.when(is_add, F.col("feed_seq"))).alias("add_"), F.min(F.when(~is_add, F.struct("feed_seq", "op_", "new_"))).alias("other_")
        )
        # Records that a supersede may start: they have no add of their own at revision 0, or may be started earlier than by it.
        offers = small.filter("new_ is not null").select(F.col("new_").alias("record_")).distinct()
        offers = offers.join(now, "record_", "left_anti").withColumns({"startable_": F.lit(True), "revision_": F.lit(0).cast("long")})
        best = best.join(offers, ["record_", "revision_"], "full").withColumn("startable_", F.coalesce("startable_", F.lit(False)))
        # A record with many changes is many rows on the left, one on the right: adaptive execution splits such a partition of the join.
        best = best.join(now, "record_", "left")
        best = best.withColumns({"from_": F.coalesce("from_", F.lit(0).cast("long")), "exists_": F.coalesce("exists_", F.lit(False))})
        best = best.withColumns({"at_": F.col("revision_") - F.col("from_"), "removes_": F.coalesce(F.col("other_.op_") == "delete", F.lit(False))}).filter("at_ >= 0")
        best = written(best, "best")
        start = best.filter("at_ = 0").select("record_", F.when(F.col("exists_"), _PRESENT).otherwise(_ABSENT).alias("state_"))
        taken = written(_steps(best, start).join(best, ["record_", "at_"]), "taken")

        # A record that only a supersede can start is there if the supersede counts, and so on upwards.
        edge = F.col("other_.op_") == "supersede"
        links = taken.filter((F.col("state_") == _PRESENT) & edge & F.col("other_.new_").isNotNull())
        links = links.select(F.col("record_").alias("from_"), F.col("other_.new_").alias("to_"), F.col("other_.feed_seq").alias("feed_seq"))
        own = best.filter("(add_ is not null and revision_ = 0) or from_ > 0 or exists_").select("record_").distinct()
        orphan = best.filter("startable_ and add_ is null").select("record_").distinct()
        dependent = links.join(orphan.select(F.col("record_").alias("to_")), "to_", "left_semi")
        reached = _reached(own, dependent.select("from_", "to_"))
        there = own.unionAll(reached).distinct()

        counted = taken.join(there, "record_", "left_semi")
        begun = links.join(there.select(F.col("record_").alias("from_")), "from_", "left_semi")
        begun = begun.join(now.select(F.col("record_").alias("to_")), "to_", "left_anti").groupBy(F.col("to_").alias("record_")).agg(F.min("feed_seq").alias("begun_"))
        counted = counted.join(begun.withColumn("at_", F.lit(0).cast("long")), ["record_", "at_"], "left")
        adds = F.least(F.col("add_"), F.when(F.col("startable_"), F.col("begun_")))
        counted = counted.select(
            "record_",
            F.when(F.col("state_") == _ABSENT, adds).otherwise(F.col("other_.feed_seq")).alias("feed_seq"),
            (F.col("revision_") + 1).alias("new_revision_"),
            ((F.col("state_") == _ABSENT) & F.coalesce(adds == F.col("begun_"), F.lit(False))).alias("starts_"),
            (F.col("state_") == _ABSENT).alias("fresh_"),
        )
        counted = written(counted, "counted")
        tips = counted.groupBy("record_").agg(F.max("new_revision_").alias("reached_"))
        left = small.join(counted.filter(~F.col("starts_")).select("feed_seq"), "feed_seq", "left_anti")
        left = left.join(tips, "record_", "left").join(now, "record_", "left")
        left = left.filter(F.col("revision_") >= F.coalesce("reached_", "from_", F.lit(0).cast("long")))

        # The wide rows move once: those that count and those that wait. A supersede of a waiting chain may do both.
        at = F.struct("record_", "new_revision_", "fresh_")
        wanted = counted.select("feed_seq", at.alias("at_")).unionByName(left.select("feed_seq", F.lit(None).cast(counted.select(at.alias("a")).schema[0].dataType).alias("at_")))
        chosen = said.join(wanted.hint("shuffle_hash"), "feed_seq").withColumn("waits_", F.col("at_").isNull())
        place = f"{self.path}/waiting/{tag}"
        chosen.write.partitionBy("waits_").parquet(place)
        chosen = self.spark.read.schema(chosen.schema).parquet(place)
        changes = chosen.filter("not waits_").drop("record_", "revision_", "waits_").select("*", "at_.*").drop("at_")
        images = self._fold(changes, current, base)
        old = current.join(counted.select("record_"), "record_", "left_semi").select("file_", "pos_")
        waits = [f"{place}/waits_=true"] if self._exists(f"{place}/waits_=true") else []
        extra = {**base["extra"], "receipts": [*base["extra"].get("receipts", []), receipts], "waiting": waits, **(note or {})}
        version = self.images.commit(images, old, base, extra)
        delete_path(self.spark, f"{place}/waits_=false")
        return self._compact(version)

    def _exists(self, path: str) -> bool:
        return self.images._fs.exists(self.images._at(path))

    def _compact(self, version: int) -> int:
        """Merge what grows with the number of batches: receipts, index and bitmaps."""
        extra = self.images.manifest(version)["extra"]
        if len(extra["receipts"]) < COMPACT_AT:
            return version
        merged = f"{self.path}/receipts/{version:012d}-{uuid.uuid4().hex[:8]}"
        self._parts(extra, "receipts").select("key_").write.parquet(merged)
        try:
            return self.images.compact({**extra, "receipts": [merged]})
        except RevisionConflict:  # another writer went on: it or its successor merges
            return version

    def _fold(self, changes: DataFrame, current: DataFrame, base: dict) -> DataFrame:
        """One new image per changed record: the last value set of each field, else that of the old image."""
        op, fresh = F.col("op_"), F.col("fresh_")
        text = lambda k: F.col("card")[k]
        has = lambda k: (op == "update") & F.coalesce(F.map_contains_key("changes", F.lit(k)), F.lit(False))
        changed = lambda k: F.try_element_at("changes", F.lit(k))
        retired = fresh | op.isin("archive", "supersede")
        sets: list[tuple[Column, dict[str, Column]]] = [  # fields that are set together, and when
            (fresh, {"tenant": F.col("tenant"), "owner": F.col("owner"), "source": text("source")}),
            (fresh | (op == "promote"), {"mount": F.when(fresh, F.col("mount")).otherwise(F.col("to_mount"))}),
            (fresh | has("importance"), {"importance": F.when(fresh, text("importance")).otherwise(changed("importance").try_cast("double"))}),
            (retired, {"archived": ~fresh, "archive_reason": F.when(~fresh, F.col("reason"))}),
            (fresh | (op == "supersede"), {"superseded_by": F.when(~fresh, text("id"))}),
            *((fresh | has(k), {k: F.when(fresh, text(k)).otherwise(changed(k))}) for k in ("summary", "content", "bucket")),
        ]
        place = {k: f"set{n}" for n, (_, values) in enumerate(sets) for k in values}
        last = [
            F.max_by(F.when(when, F.struct(*[v.alias(k) for k, v in values.items()])), F.when(when, F.col("new_revision_"))).alias(f"set{n}") for n, (when, values) in enumerate(sets)
        ]
        tip = F.max_by(F.struct(F.col("new_revision_").alias("revision_"), "key_", "written_at", (~fresh & (op == "delete")).alias("deleted_")), "new_revision_").alias("tip_")
        folded = changes.groupBy("record_").agg(tip, *last)
        if base["data"]:
            places = current.join(folded.select("record_"), "record_", "left_semi")
            old = self.images.images_at(places, base).select("record_", F.struct(*_FIELDS).alias("old_"))
            folded = folded.join(old, "record_", "left")
            pick = {k: F.when(F.col(place[k]).isNotNull(), F.col(place[k])[k]).otherwise(F.col(f"old_.{k}")) for k in _FIELDS}
        else:
            pick = {k: F.col(place[k])[k] for k in _FIELDS}
        return folded.select(
            "record_", *[c.alias(k) for k, c in pick.items()], F.col("tip_.revision_").alias("revision_"), F.col("tip_.key_").alias("key_"), F.col("tip_.written_at").alias("written_at_"), F.col("tip_.deleted_").alias("deleted_")
        )


def replay(feed: DataFrame, batches: int = 3, path: str | None = None) -> RecordTable:
    """Apply a whole feed in `batches` parts by arrival, as they would have come."""
    table = RecordTable(feed.sparkSession, path)
    low, high = feed.agg(F.min("feed_seq"), F.max("feed_seq")).first()
    if low is None:
        low, high, batches = 0, 0, 1
    span = (high - low + 1) / batches
    for k in range(batches):
        table.apply(feed.filter((F.col("feed_seq") >= int(low + k * span)) & (F.col("feed_seq") < (int(low + (k + 1) * span) if k + 1 < batches else high + 1))))
        feed.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of a batch stay until the driver collects what refers to them
    return table

