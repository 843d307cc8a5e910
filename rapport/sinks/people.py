"""People who became one: merges kept beside the archive, and every table read through them.

No row is rewritten. A merge adds (old, new) pairs under a version of its own; ``labels`` says, for every id that was ever
merged away, who its keeper is now. A new merge meets the labels that are there: its pairs are taken between the keepers
of their two sides, so only the people they touch are brought together, and only labels that point to a keeper who lost
that place are written anew. Reading a table re-points its people by the labels.

Merges in one version are one step (``resolve_merges``); versions follow each other in time: "1 into 5" after "1 into 2"
means that whoever 1 is by then, 2, goes into 5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.operators import buckets as B
from rapport.operators import resolution as R
from rapport.operators.ranking import first_per_group
from rapport.session import at_most, cut_lineage
from rapport.sinks.tables import Archive, slot_of

#: Columns with a person, and columns with a list of people, by table.
PERSON = {name: ["person_id"] for name in ("aliases", "identities", "messages", "emails", "notes", "voice", "events", "memories", "daily")}
PERSON["suggestions"] = ["person_a_id", "person_b_id"]
MEMBERS = {"calendar": "person_ids"}
#: Sums kept per person: read through the labels like all tables, but nothing of its own that a merge moves.
SUMS = ("activity", "topic_days")
#: People whom a change touches up to this many are broadcast: some forty megabytes.
BROADCAST_PEOPLE = 400_000


def extend_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, person_id) of everybody whose keeper becomes another by new pairs (old_id, new_id).

    Reads the labels once by id and once by keeper; it follows no link that is already in them.
    """
    keeper = labels.select("id", F.col("person_id").alias("_keeper"))

    def now(df: DataFrame, column: str) -> DataFrame:
        found = df.join(keeper.withColumnRenamed("id", column), column, "left")
        return found.withColumn(column, F.coalesce("_keeper", column)).drop("_keeper")

    pairs = now(now(edges.select("old_id", "new_id"), "old_id"), "new_id").where("old_id <> new_id").distinct()
    step = cut_lineage(R.resolve_merges(cut_lineage(pairs)))
    followers = labels.join(step.withColumnRenamed("old_id", "person_id"), "person_id").select("id", F.col("new_id").alias("person_id"))
    return step.select(F.col("old_id").alias("id"), F.col("new_id").alias("person_id")).unionByName(followers)


def moved_rows(tables: dict[str, DataFrame], changed: DataFrame) -> DataFrame:
    """(name, moved): rows of each table that a change of labels gives to somebody else.

    Ids are counted in the columns as stored; a row with several people counts once. Rows are counted per person before
    they meet the change; of rows with several people only those travel that it touches, once, when the people it touches
    in a table are few enough (checked) to go to the rows.
    """
    ids = changed.select(F.col("id").alias("_person")).distinct()

    def count(name: str, rows: DataFrame) -> DataFrame:
        columns = PERSON.get(name, [])
        if len(columns) == 1:
            hits = rows.groupBy(F.col(columns[0]).alias("_person")).agg(F.count("*").alias("_rows")).join(ids, "_person", "left_semi")
            moved = F.coalesce(F.sum("_rows"), F.lit(0))
        else:
            people = F.col(MEMBERS[name]) if name in MEMBERS else F.array(*columns)
            members = rows.select("id", F.explode(people).alias("_person"))
            touched = cut_lineage(members.select("_person").distinct().join(ids, "_person", "left_semi"))
            touched = F.broadcast(touched) if at_most(touched, BROADCAST_PEOPLE) else touched
            hits = members.join(touched, "_person", "left_semi").select("id").distinct()
            moved = F.count("*")
        return hits.agg(moved.alias("moved")).select(F.lit(name).alias("name"), "moved")

    return reduce(DataFrame.unionByName, [count(name, rows) for name, rows in tables.items()])


def labels(archive: Archive, before: int | None = None) -> DataFrame:
    return archive.latest("labels", ["id"], before)


def repointed(name: str, rows: DataFrame, merges: DataFrame, key: str = "id") -> DataFrame:
    """A table's rows with everybody merged away replaced by their keeper."""
    if name == "people":
        return R.surviving_people(rows, merges)
    if name in MEMBERS:
        return R.repoint_array(rows, merges, key, MEMBERS[name]).select(*rows.columns)
    for column in ["person_id"] if name in SUMS else PERSON.get(name, []):
        rows = R.repoint(rows, merges, column).drop("moved").select(*rows.columns)
    if name in ("identities", "aliases"):
        return rows.distinct()
    if name == "suggestions":                   # two people who became one need no suggestion
        return rows.where("NOT coalesce(person_a_id = person_b_id, false)")
    return rows


def current(archive: Archive, name: str, before: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A table as it reads today. ``before`` leaves out later import batches, never merges; ``rows`` are some of its rows."""
    rows = archive.read(name, before) if rows is None else rows
    if not archive.has("labels"):               # nobody was merged yet
        accepted = archive.has("decisions") and name == "aliases"
        return rows.unionByName(R.accepted_aliases(decided(archive))).distinct() if accepted else rows
    merges = labels(archive).select(F.col("id").alias("old_id"), F.col("person_id").alias("new_id"))
    rows = repointed(name, rows, merges)
    if name == "aliases":                       # what keepers took over, and names accepted by the user
        gained = R.gained_aliases(archive.read("people", before), merges)
        accepted = repointed(name, R.accepted_aliases(decided(archive)), merges)
        return rows.unionByName(gained).unionByName(accepted).distinct()
    return rows


def decided(archive: Archive) -> DataFrame:
    """All suggestions as they were made, with the last decision of each."""
    return R.decide_suggestions(archive.read("suggestions"), archive.latest("decisions", ["id"]))


def open_suggestions(archive: Archive) -> DataFrame:
    """Suggestions that still wait for a decision, between today's people."""
    merges = labels(archive).select(F.col("id").alias("old_id"), F.col("person_id").alias("new_id"))
    return repointed("suggestions", decided(archive).where("status = 'pending'"), merges)


def profiles(archive: Archive) -> DataFrame:
    """Today's profile of everybody: the last import batch or merge that wrote it, of people who are still there."""
    imported = archive.rows("profiles").withColumns({"after": F.col("batch"), "batch": F.lit(-1).cast("bigint")})
    both = imported.unionByName(archive.rows("merged_profiles").select(*imported.columns))
    last = first_per_group(both, ["person_id"], ["after", "batch"], desc=True).drop("after", "batch")
    return last.join(labels(archive).select(F.col("id").alias("person_id")), "person_id", "left_anti")


def kept_profiles(archive: Archive, touched: DataFrame, as_of) -> DataFrame:
    """Profiles of the touched people, from their buckets.

    Read are the parts of the buckets in which the touched people lie, under all ids that they ever had, the ledger and
    the memories of the days in which a window begins or ends, and the calendar from ``as_of`` on. The slots come to the
    driver: at most ``SLOTS`` numbers.
    """
    ids = touched.select("person_id").distinct()
    names = ids.select(F.col("person_id").alias("id"))
    if archive.has("labels"):
        names = names.unionByName(labels(archive).join(ids, "person_id", "left_semi").select("id"))
    slots = [r.slot for r in names.select(slot_of(F.col("id")).alias("slot")).distinct().collect()]

    def mine(name: str, rows: DataFrame) -> DataFrame:
        return current(archive, name, rows=rows).join(ids, "person_id", "left_semi")

    def edge(name: str) -> DataFrame:
        return mine(name, reduce(DataFrame.unionByName, [archive.window(name, *day) for day in B.edge_days(as_of)]))

    ahead = current(archive, "calendar", rows=archive.since("calendar", as_of)).select(
        "id", "title", "starts_at", F.explode("person_ids").alias("person_id")).join(ids, "person_id", "left_semi")
    def buckets(name: str) -> DataFrame:
        if archive.has(name):
            return mine(name, archive.of_slots(name, slots))
        table, added = {"activity": ("events", B.activity_buckets), "topic_days": ("memories", B.topic_buckets)}[name]
        return added(mine(table, archive.read(table)))         # no import has written buckets yet

    return B.bucket_profiles(
        current(archive, "people").join(ids, "person_id", "left_semi"),
        *(buckets(name) for name in SUMS), edge("events"), edge("memories"),
        ahead.withColumn("person_ids", F.array("person_id")).drop("person_id"), as_of)


def merge(archive: Archive, edges: DataFrame, version: int, as_of) -> DataFrame:
    """Merge people (old_id into new_id) and hand back what moved: (name, moved) per table.

    Everything is written under ``version``, labels before what follows from them; a merge that broke off is run again
    under its number and overwrites itself. Pairs that already are one person move nothing.
    """
    edges = archive.write("merges", edges, version)
    changed = archive.write("labels", extend_labels(labels(archive, before=version), edges), version)
    tables = {name: archive.read(name) for name in (*PERSON, *MEMBERS)}
    moves = archive.write("moves", moved_rows(tables, changed), version)
    fresh = kept_profiles(archive, changed, as_of)
    archive.write("merged_profiles", fresh.withColumn("after", F.lit(archive.last_batch("jobs"))), version)
    return moves


def decide(archive: Archive, decisions: DataFrame, version: int, as_of) -> DataFrame:
    """Take up the user's decisions (id, merge): they are stored, and accepted duplicates are merged."""
    own = archive.write("decisions", decisions, version)
    accepted = R.accepted_merges(R.decide_suggestions(archive.read("suggestions").join(own, "id", "left_semi"), own))
    return merge(archive, accepted, version, as_of)
