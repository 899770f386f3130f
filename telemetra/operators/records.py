"""The store of demonstrations, tasks and teachers: lookups, incremental work lists, and changes that give new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .summaries import first_wins, later_wins, numbered


def convertible(recordings: DataFrame, demos: DataFrame, on: str, again: bool = False) -> DataFrame:
    """Recordings whose demo (the first row for its path) is a success or unknown, and not converted yet unless `again`."""
    known = first_wins(demos, [on], ["id"]).select(on, "status", "converted")
    out = recordings.join(known, on, "left").where(F.coalesce("status", F.lit("unknown")).isin("success", "unknown"))
    return (out if again else out.where(~F.coalesce("converted", F.lit(False)))).drop("status", "converted")


def to_do(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `wanted` that are not done."""
    return wanted.join(done, on, "left_anti")


def changed(now: DataFrame, checked: DataFrame, on: str, stamp: str, version: int) -> DataFrame:
    """Rows of `now` that were never checked, or with another stamp or version of the rules."""
    same = checked.where(F.col("version") == version).select(on, stamp)
    return now.join(same, [on, stamp], "left_anti")


def present(results: DataFrame, episodes: DataFrame, on: list[str]) -> DataFrame:
    """Results whose episode is still there."""
    return results.join(episodes, on, "left_semi")


def labelled(results: DataFrame, demos: DataFrame, teachers: DataFrame, on: str) -> DataFrame:
    """Results with the label and teacher of their demo, the last row for its path; `no DB row` and ? where there is none."""
    last = later_wins(demos, [on], ["id"]).select(on, F.col("status").alias("label"), "teacher_id", F.lit(True).alias("_row"))
    out = results.join(last, on, "left").join(teachers.select("teacher_id", F.col("name").alias("_name")), "teacher_id", "left")
    label = F.when(F.col("_row"), F.col("label")).otherwise("no DB row")
    return out.select(*results.columns, label.alias("label"), F.when(F.col("_row"), F.coalesce("_name", F.lit("?"))).alias("teacher"))


def duplicates(demos: DataFrame, on: Column, name: str) -> DataFrame:
    """(name, n, statuses): how many rows there are for each key, and their statuses in order."""
    return demos.groupBy(on.alias(name)).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))


def last_parts(path: Column, n: int = 2) -> Column:
    """The last parts of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -n)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """A page of rows in order, from 0; a number past the last page gives the last one."""
    last = F.greatest(F.floor((F.count("*") - 1) / size), F.lit(0))
    at = min(max(number, 0), rows.agg(last.alias("n")).first().n)
    return rows.orderBy(*order).offset(at * size).limit(size)


def episode_numbers(rows: DataFrame, task: str, order: str) -> DataFrame:
    """Rows with episode, their place among their task's as four digits from 0000."""
    at = F.row_number().over(Window.partitionBy(task).orderBy(order)) - 1
    return rows.withColumn("episode", F.lpad(at.cast("string"), 4, "0"))


def next_episode(rows: DataFrame, task: str, number: str, complete: str) -> DataFrame:
    """(task, next): one after the highest number, gaps or not, or that number itself if its recording is incomplete."""
    last = rows.groupBy(task).agg(F.max_by(F.struct(number, complete), number).alias("l"))
    at = F.when(F.coalesce(F.col(f"l.{complete}"), F.lit(False)), F.col(f"l.{number}") + 1).otherwise(F.col(f"l.{number}"))
    return last.select(task, F.lpad(at.cast("string"), 4, "0").alias("next"))


def split_index(frames: DataFrame, task: str, episode: str) -> DataFrame:
    """(task, n_seqs, n_frames, files): frames of each episode, as a map in order of episodes."""
    per = frames.groupBy(task, episode).agg(F.count("*").alias("n"))
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(episode).cast("string").alias("episode"), "n"))))
    return per.groupBy(task).agg(F.count("*").alias("n_seqs"), F.sum("n").alias("n_frames"), files.alias("files"))


def canonical(json: Column) -> Column:
    """A JSON object of plain values with its keys in order, so that equal ones are equal texts."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def inserted_once(store: DataFrame, new: DataFrame, content: Column) -> DataFrame:
    """The store with those new rows whose content it doesn't hold; of new rows with the same content the first by id."""
    fresh = first_wins(new.withColumn("_c", content), ["_c"], ["id"]).join(store.select(content.alias("_c")), "_c", "left_anti")
    return store.unionByName(fresh.select(store.columns))


def inserted(store: DataFrame, new: DataFrame, unique: list[str] | None = None, **defaults: Column) -> DataFrame:
    """The store with new rows, numbered on after its highest id; names that it already has are left out."""
    if unique:
        new = first_wins(new, unique, [new.columns[0]]).join(store, unique, "left_anti")
    for name, value in defaults.items():
        new = new.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = numbered(new, [c for c in new.columns if c != "id"])
    return store.unionByName(new.crossJoin(top).withColumn("id", F.col("_top") + F.col("_k") + 1).select(store.columns))


def updated(store: DataFrame, patch: DataFrame, at: Column) -> DataFrame:
    """The store with the patch's columns (id and those to change; null: leave) applied, and updated_at of the changed rows."""
    names = [c for c in patch.columns if c != "id"]
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit"))
    out = store.join(p, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names})
    return out.withColumn("updated_at", F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))).select(store.columns)


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids, "id", "left_anti")


def cascaded(demos: DataFrame, results: DataFrame, files: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What deleting the episodes `gone` (raw_path) leaves and takes: new versions of tables, never changed in place.

    demos: (id, raw_path, converted_path, ...), results: (raw_path, ...), files: (path, ...). An episode takes its rows, the files in its folder and
    those in the folder of its converted copy. Gives demos, results and files as they then are, `removed` (path) to be deleted,
    `backup`, the demos as they were, and `unknown` (raw_path): episodes that have neither a row nor a file, for which nothing is done.
    """
    # Half of a store may go, so no side of a join is broadcast: tables that look small on disk would come to lie in the driver, several at once.
    by_sorting = lambda df: df.hint("merge")
    gone = by_sorting(written(gone.select("raw_path").where("raw_path is not null").distinct(), "gone"))
    theirs = demos.join(gone, "raw_path", "left_semi")
    raw = gone.select("raw_path", F.col("raw_path").alias("folder"))
    folders = raw.unionByName(theirs.where("converted_path is not null").select("raw_path", F.col("converted_path").alias("folder"))).distinct()
    # a file meets the folders above it, of which a path has few
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = written(files.select("path", F.explode(above).alias("folder")).join(by_sorting(folders), "folder"), "met")
    removed = written(met.select("path").distinct(), "removed")
    known = theirs.select("raw_path").unionByName(met.where("folder = raw_path").select("raw_path"))
    return {
        "demos": demos.join(gone, "raw_path", "left_anti").select(demos.columns),
        "results": results.join(gone, "raw_path", "left_anti").select(results.columns),
        "files": files.join(by_sorting(removed), "path", "left_anti").select(files.columns),
        "removed": removed,
        "backup": demos,
        "unknown": gone.join(by_sorting(known), "raw_path", "left_anti"),
    }


def tracking_states(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """(by, hand, state): the last state of each hand (r, l) that a headset's report tells; lines without a type or a state say nothing."""
    hand = F.regexp_extract(line, r"Type:\s+(Right|Left)", 1)
    state = F.regexp_extract(line, r"TrackingStatus:\s+([A-Z_]+)", 1)
    told = lines.select(by, order, F.when(hand == "Right", "r").when(hand == "Left", "l").alias("hand"), F.nullif(state, F.lit("")).alias("state"))
    return told.where("hand is not null and state is not null").groupBy(by, "hand").agg(F.max_by("state", order).alias("state"))


def relabelled(store: DataFrame, ids: DataFrame, column: str, value: Column, at: Column) -> DataFrame:
    """The store with one column of the chosen rows set."""
    return updated(store, ids.select("id").distinct().withColumn(column, value), at)


def camera_entry(json: Column) -> Column:
    """(type, serial, role, crop, resolution) of a camera's entry, a bare serial number or an object; crops not of four numbers are null."""
    said = F.from_json(json, "struct<type:string,serial:string,role:string,crop:array<int>,resolution:array<int>>")
    bare = json.rlike(r"^\s*\d+\s*$")
    kind = F.when(bare, "zed").otherwise(F.lower(F.coalesce(said["type"], F.lit("zed"))))
    return F.struct(
        kind.alias("type"),
        F.when(bare, F.trim(json)).otherwise(said["serial"]).alias("serial"),
        said["role"].alias("role"),
        F.when(F.size(said["crop"]) == 4, said["crop"]).alias("crop"),
        F.when(kind == "realsense", F.coalesce(said["resolution"], F.array(F.lit(640), F.lit(480)))).alias("resolution"),
    )


def renamed_keys(columns: Column, names: dict[str, str]) -> Column:
    """A map with the keys of `names` renamed and the others as they are."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(columns, lambda k, _: F.coalesce(F.try_element_at(known, k), k))


def dimension_names(size: int, arm: list[str]) -> list[str]:
    """Names of a vector's places: one arm's, both arms' or numbers."""
    if size == len(arm):
        return [f"l_{x}" for x in arm]
    if size == 2 * len(arm):
        return [f"{side}_{x}" for side in "lr" for x in arm]
    return [f"dim_{k}" for k in range(size)]


def arm_columns(action: Column, side: str, start: int) -> list[Column]:
    """Place, rotation and gripper of one arm in a vector of 13 numbers an arm; null where the vector is shorter."""
    some = lambda k, n: F.when(F.size(action) >= start + 13, F.slice(action, start + k + 1, n))
    return [some(0, 3).alias(f"{side}_xyz"), F.slice(some(3, 9), 1, 6).alias(f"{side}_rot6d"), some(12, 1)[0].alias(f"{side}_hand")]


def by_kind(action: Column) -> Column:
    """A vector grouped by arm (place, rotation, gripper each) as one grouped by kind."""
    return F.concat(*[F.slice(action, start + k + 1, n) for k, n in ((0, 3), (3, 9), (12, 1)) for start in (0, 13)])


def valid_name(name: Column) -> Column:
    """Whether a task's name is letters, digits and _ alone."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_]+$"), F.lit(False))


def first_unfinished(subtasks: Column, done: Column) -> Column:
    """The first subtask that isn't done, or an empty text."""
    left = F.filter(F.arrays_zip(subtasks.alias("s"), done.alias("d")), lambda x: ~x["d"])
    return F.coalesce(F.try_element_at(left, F.lit(1))["s"], F.lit(""))


def after_latency(actions: Column, latency: Column, period: float) -> Column:
    """Actions without those whose time has passed, all of them at most."""
    late = F.least(F.floor(latency / period).cast("int"), F.size(actions))
    return F.slice(actions, late + 1, F.size(actions))


#: The buttons that each hand's controller tells by name when pressed.
PRESSED = {"R": ("A", "B", "RThU", "RJ", "RG", "RTr"), "L": ("X", "Y", "LThU", "LJ", "LG", "LTr")}


def tracking_line(line: Column) -> Column:
    """(poses, buttons, pressed) of a line `l:<16 numbers>|r:<16 numbers>&<buttons>`.

    Poses of 16 numbers by hand, buttons with their numbers, and which buttons are pressed of the hands that are named;
    all empty for a line without one &, and parts that can't be read are left out.
    """
    halves = F.split(line, "&")
    good = F.size(halves) == 2
    entry = lambda p, key, value: F.struct(key.alias("key"), _numbers(value).alias("value"))
    hands = F.transform(F.filter(F.split(halves[0], r"\|"), lambda p: F.contains(p, F.lit(":"))), lambda p: entry(p, F.substring_index(p, ":", 1), F.regexp_replace(p, r"^[^:]*:", "")))
    hands = F.filter(hands, lambda h: (F.size(h["value"]) == 16) & F.forall(h["value"], lambda x: x.isNotNull()))
    said = F.split(halves[1], ",")
    told = F.transform(F.filter(said, lambda b: F.size(F.split(b, " ")) >= 2), lambda b: entry(b, F.substring_index(b, " ", 1), F.regexp_replace(b, r"^[^ ]* ", "")))
    told = F.filter(told, lambda b: F.forall(b["value"], lambda x: x.isNotNull()))
    named = [F.struct(F.lit(k).alias("key"), F.array_contains(said, k).alias("value"), F.array_contains(said, hand).alias("on")) for hand, keys in PRESSED.items() for k in keys]
    pressed = F.transform(F.filter(F.array(*named), lambda e: e["on"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    none = lambda kind: F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{kind}>>"))
    return F.struct(
        F.when(good, F.map_from_entries(hands)).otherwise(none("array<double>")).alias("poses"),
        F.when(good, F.map_from_entries(told)).otherwise(none("array<double>")).alias("buttons"),
        F.when(good, F.map_from_entries(pressed)).otherwise(none("boolean")).alias("pressed"),
    )


def _numbers(text: Column) -> Column:
    """The numbers of a text, null for what isn't one."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
