"""Joins, statistics and searches over item catalogs and tag dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions import tags as tg


def tag_counts(items: DataFrame) -> DataFrame:
    """tag, n (repeats in an item count) and first_seen: the smallest (item_id, place)."""
    each = items.select("item_id", F.posexplode("tags").alias("place", "tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("item_id", "place")).alias("first_seen"))


def numbered(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """rows with their number from 1 on in an order over all of them, which must be total.

    Range partitions are sorted, each by itself, and offset by the rows of those before it,
    so that no task has all rows. The sorted rows are written to the shared folder once:
    both the counts and the numbers are read from there.
    """
    sorted_ = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sorted_ = sorted_.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_in") + 1).drop("_at", "_part", "_in", "_before")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the folder that the session's executors share, and read again."""
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core that rows are dealt out to.
TASKS = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, dealt out by keys that differ. A small file is one task as it is read, however many
    cores there are; before a step that costs far more than to move its rows, deal them out."""
    session = rows.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS * session.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


#: A key with over 1/HOT of the rows is hot, so there are HOT hot keys at most.
HOT = 1000


def looked_up(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a key once; how: inner or left.

    Rows of hot keys meet their row of right by a broadcast of HOT rows at most, so that no
    task gets a hub's rows; the others are shuffled. left is read three times: store it first.
    """
    total = left.count()
    hot = F.broadcast(left.groupBy(key).count().where(F.col("count") * HOT > total).select(key, F.lit(True).alias("_hot")))
    marked = left.join(hot, key, "left")
    few = F.broadcast(right.join(hot.drop("_hot"), key, "left_semi"))
    return marked.where("_hot").drop("_hot").join(few, key, how).unionByName(marked.where("_hot IS NULL").drop("_hot").join(right, key, how))


def ranked_tags(counts: DataFrame, by: str = "count", descending: bool | None = None) -> DataFrame:
    """Tags with their rank by count, name or length; equal ones by first appearance.

    Unless told, counts and lengths descend, and names ascend.
    """
    key = {"count": F.col("n"), "name": F.lower("tag"), "length": F.length("tag")}[by]
    down = by != "name" if descending is None else descending
    return numbered(counts, [key.desc() if down else key.asc(), F.col("first_seen").asc()])


def restored(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """items whose name is in snapshot (name, tags) get its tags."""
    snap = snapshot.select("name", F.col("tags").alias("_snap"))
    return items.join(snap, "name", "left").withColumn("tags", F.coalesce("_snap", "tags")).drop("_snap")


def partly_restored(items: DataFrame, snapshot: DataFrame, wanted: list[str]) -> DataFrame:
    """items with the wanted tags of their snapshot appended that they lack; what repeats
    in the snapshot is appended each time."""
    snap = snapshot.select("name", F.col("tags").alias("_snap"))
    lacking = F.filter("_snap", lambda t: t.isin(wanted) & ~F.array_contains(F.col("tags"), t))
    return items.join(snap, "name", "left").withColumn("tags", F.concat("tags", F.coalesce(lacking, F.array().cast("array<string>")))).drop("_snap")


def with_class_names(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """labels (class_id, ...) with name; an unknown class is class_<id>. classes is a small
    dimension, which Spark broadcasts by its own size check."""
    return labels.join(classes.select("class_id", "name"), "class_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))


def remapped(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """detections (class_id, class_name) with the id of the first class of that name,
    whatever its case; without one they keep their own."""
    first = classes.groupBy(F.lower("name").alias("_key")).agg(F.min("class_id").alias("_mine"))
    found = detections.withColumn("_key", F.lower("class_name")).join(first, "_key", "left")
    return found.withColumn("class_id", F.coalesce("_mine", "class_id")).drop("_key", "_mine")


def with_categories(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tags (tag) with the category of the entry of that display name, else of that name."""
    by_display = dictionary.groupBy(F.lower("display_name").alias("_d")).agg(F.min_by("category", "load_seq").alias("_c1"))
    by_name = dictionary.groupBy(F.lower("name").alias("_n")).agg(F.min_by("category", "load_seq").alias("_c2"))
    low = tags.withColumn("_d", F.lower("tag")).withColumn("_n", F.replace("_d", F.lit(" "), F.lit("_")))
    return low.join(by_display, "_d", "left").join(by_name, "_n", "left").withColumn("category", F.coalesce("_c1", "_c2")).drop("_d", "_n", "_c1", "_c2")


def search(dictionary: DataFrame, text: str, on_item: list[str], in_session: list[str], limit: int = 50) -> DataFrame:
    """What a dictionary has for a text: of the first 3 * limit entries, in load order, that
    hold it in their display name or an alias, the best `limit` with their rank."""
    low, name = text.lower(), F.lower("display_name")
    hit = F.contains(name, F.lit(low)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(low)))
    some = dictionary.where(hit).orderBy("load_seq").limit(3 * limit)
    order = [F.desc(name == low), F.desc(F.startswith(name, F.lit(low))), F.desc(F.col("display_name").isin(on_item)), F.desc(F.col("display_name").isin(in_session)), F.desc("post_count"), F.asc("load_seq")]
    return some.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") <= limit)


def absent(session: DataFrame, results: DataFrame) -> DataFrame:
    """session (tag) without what the results (display_name) have."""
    return session.join(results.select(F.col("display_name").alias("tag")), "tag", "left_anti")


def top_tags(scores: Column, least: float, excluded: list[str], most: int) -> Column:
    """Of an array of (tag, p): those of `least` and more, not excluded, best first."""
    good = F.filter(scores, lambda s: (s.p >= least) & ~s.tag.isin(excluded))
    ordered = F.array_sort(F.transform(good, lambda s, i: F.struct((-s.p).alias("k"), i.alias("i"), s.tag.alias("tag"))))
    return F.transform(F.slice(ordered, 1, most), lambda s: s.tag)


def best_tags(scores: DataFrame, least: float, excluded: list[str], most: int) -> DataFrame:
    """scores (item, k, tag, p), a row a tag -> item, tags: those of `least` and more, not
    excluded, best first, then by k. What is too low or too many is left out before rows meet."""
    good = scores.where((F.col("p") >= least) & ~F.col("tag").isin(excluded))
    by = W.partitionBy("item").orderBy(F.desc("p"), F.asc("k"))
    top = good.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most)
    return top.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "tag"))), lambda x: x.tag).alias("tags"))


def split_train(items: DataFrame, id_column: str, percent: int = 80, seed: int = 0) -> DataFrame:
    """items with split: about percent of 100 are train, by a hash of the id and the seed.

    Each row is told by itself, so the split needs no order over all rows and stays the
    same when rows are added.
    """
    draw = F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary")) % 100
    return items.withColumn("split", F.when(draw < percent, F.lit("train")).otherwise(F.lit("valid")))


def split_exactly(items: DataFrame, id_column: str, percent: int = 80, seed: int = 0, fallback: bool = True) -> DataFrame:
    """items, once for each split they are in: the first floor(percent * n / 100) in an order drawn from
    the seed are train, the rest valid.

    fallback: one item at least is train, and where that leaves none for valid, the first
    train item is in both. Ids must differ; the order is the same on every run.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    rows = numbered(items.withColumn("_draw", drawn), [F.asc("_draw"), F.asc(id_column)], "_place").drop("_draw")
    n = rows.agg(F.count("*")).first()[0]
    train = max(1, n * percent // 100) if fallback else n * percent // 100
    split = F.when(F.col("_place") <= train, F.array(F.lit("train"))).otherwise(F.array(F.lit("valid")))
    if fallback and train >= n:
        split = F.when(F.col("_place") == 1, F.array(F.lit("train"), F.lit("valid"))).otherwise(split)
    return rows.withColumn("split", F.explode(split)).drop("_place")


def class_list(labels: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """class_0 to class_<largest id>, dense; or, where there are lines (line, seq) of a file of
    classes, the non-blank ones in their order, whatever the labels."""
    if named is not None:
        good = named.select(tg.strip(F.col("line")).alias("name"), "seq").where("name != ''")
        by_file = good.select((F.row_number().over(W.orderBy("seq")) - 1).alias("class_id"), "name")  # as many rows as a user names classes
        if not by_file.isEmpty():
            return by_file
    return labels.agg(F.max("class_id").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("class_id")).withColumn("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))


def with_new_class(classes: DataFrame, name: str, colors: list[str], kind: str = "bbox") -> DataFrame:
    """classes (class_id, name, color, kind) with one more: its id is how many there were, and
    colours go round."""
    one = classes.agg(F.count("*").cast("int").alias("class_id"))
    return classes.unionByName(one.select("class_id", F.lit(name).alias("name"), F.element_at(F.array(*map(F.lit, colors)), F.col("class_id") % len(colors) + 1).alias("color"), F.lit(kind).alias("kind")))


def class_lines(classes: DataFrame) -> DataFrame:
    """class_id and line: name|color|kind, as a list of classes is kept."""
    return classes.select("class_id", F.concat_ws("|", "name", "color", "kind").alias("line"))


def classes_of_lines(lines: DataFrame) -> DataFrame:
    """lines (seq, line) as class_id (the place), name, color, kind; lines without exactly three
    parts are left out, and any kind but polygon is bbox."""
    parts = F.split("line", "[|]")
    kind = F.when(F.get("p", F.lit(2)) == "polygon", F.lit("polygon")).otherwise(F.lit("bbox"))
    rows = lines.withColumn("p", parts).where(F.size("p") == 3)
    return rows.select(F.col("seq").cast("int").alias("class_id"), F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("color"), kind.alias("kind"))


def without_label(labels: Column, place: Column) -> Column:
    """An array of labels without the one at a place from 0 on."""
    return F.filter(labels, lambda _, i: i != place)


def with_label(labels: Column, place: Column, new: Column) -> Column:
    """An array of labels with another one at a place from 0 on."""
    return F.transform(labels, lambda t, i: F.when(i == place, new).otherwise(t))


def label_summary(labels: Column, name) -> Column:
    """A line a label: its place from 1 on, the class's name by name(class_id), and its kind."""
    kind = lambda t: F.when(F.coalesce(F.size(t["polygon"]) >= 3, F.lit(False)), F.lit("polygon")).when(t["bbox"].isNotNull(), F.lit("bbox")).otherwise(F.lit("empty"))
    return F.array_join(F.transform(labels, lambda t, i: F.concat((i + 1).cast("string"), F.lit(": "), name(t["class_id"]), F.lit(" ("), kind(t), F.lit(")"))), "\n")


def without_class(labels: DataFrame, gone: int) -> DataFrame:
    """labels without a class; higher ids move down by one."""
    return labels.where(F.col("class_id") != gone).withColumn("class_id", F.when(F.col("class_id") > gone, F.col("class_id") - 1).otherwise(F.col("class_id")))


def change_counts(items: DataFrame, changed: Column) -> DataFrame:
    """How many items an edit changes, and how many tags it takes away on balance."""
    return items.agg(F.count_if(F.col("tags") != changed).alias("items"), F.sum((F.size("tags") - F.size(changed)).cast("long")).alias("tags_less"))


def fingerprint(files: DataFrame) -> DataFrame:
    """group, fingerprint: sha1 over its files' lines (key|mtime|size) in order of seq.

    A digest of all is taken of the lines in order, whatever their number: a group is sorted in
    one partition and read through, and never is one row.
    """
    line = F.concat_ws("|", "key", "mtime", "size")
    ordered = files.select(F.col("group").cast("string").alias("group"), "seq", line.alias("line")).repartition("group").sortWithinPartitions("group", "seq", "line")

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, digest = None, None
        row = lambda: pa.RecordBatch.from_pydict({"group": pa.array([now[0]], pa.string()), "fingerprint": pa.array([digest.hexdigest()])})
        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != (group,):
                    if now:
                        yield row()
                    now, digest = (group,), hashlib.sha1(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
        if now:
            yield row()

    return ordered.select("group", "line").mapInArrow(run, "group string, fingerprint string")


def latest(edits: DataFrame) -> DataFrame:
    """edits (item_id, seq, state) -> the last state of each item, and how many it had."""
    return edits.groupBy("item_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("edits"))


def undone(edits: DataFrame, batch: Column) -> DataFrame:
    """edits (item_id, seq, batch_id, before) after undoing a batch: the items whose last edit
    is of that batch, with the tags from before it."""
    last = edits.groupBy("item_id").agg(F.max_by(F.struct("batch_id", "before"), "seq").alias("e"))
    return last.where(F.col("e.batch_id") == batch).select("item_id", F.col("e.before").alias("tags"))


#: A step of an edit log: what it is, the batch of an edit, and an item's state after an edit.
STEP = "kind string, batch_id long, state array<string>"


def after_step(state: str | None, back: list, forth: list, kind: str, new: str | None, depth: int) -> tuple[str | None, list, list]:
    """An item's state, and what undo and redo go to, after one step of its log."""
    if kind == "edit":
        return new, (back if state is None else [*back, state])[-depth:], []
    if kind == "undo" and back:
        return back[-1], back[:-1], [*forth, state]
    if kind == "redo" and forth:
        return forth[-1], [*back, state][-depth:], forth[:-1]
    return state, back, forth


def replayed(steps: DataFrame, depth: int = 50) -> DataFrame:
    """steps (item_id, seq, kind, batch_id, state) -> item_id, state, undos, redos.

    kind: `edit` (a new state, or the first), `undo`, `redo`. An item keeps `depth` states to go
    back to; a new edit clears what was undone; undo and redo with nothing to go to change
    nothing. A batch undone is an undo step for each item whose last edit is of it. An item's steps
    are sorted in one partition and folded one after the other, with state of bounded size.
    """
    ordered = steps.select(F.col("item_id").cast("string").alias("item_id"), "seq", "kind", F.to_json(F.struct("state")).alias("state"), F.col("state").isNull().alias("none"))
    ordered = ordered.repartition("item_id").sortWithinPartitions("item_id", "seq")

    def run(batches):
        import pyarrow as pa

        now, log = None, (None, [], [])
        row = lambda: pa.RecordBatch.from_pydict({"item_id": pa.array([now[0]], pa.string()), "state": pa.array([log[0]], pa.string()), "undos": pa.array([len(log[1])]), "redos": pa.array([len(log[2])])})
        for batch in batches:
            for item, kind, new in zip(*(batch.column(c).to_pylist() for c in ("item_id", "kind", "state"))):
                if now != (item,):
                    if now:
                        yield row()
                    now, log = (item,), (None, [], [])
                log = after_step(*log, kind, new, depth)
        if now:
            yield row()

    found = ordered.mapInArrow(run, "item_id string, state string, undos long, redos long")
    kind = steps.schema["item_id"].dataType
    return found.select(F.col("item_id").cast(kind).alias("item_id"), F.from_json("state", "state array<string>")["state"].alias("state"), "undos", "redos")


def unique_names(files: DataFrame) -> DataFrame:
    """files (stem, pos) with name: the stem, or if a file before it in the order of pos has
    that, the first of 1_<stem>, 2_<stem> ... that none has."""
    from tagloom.operators.naming import named_in_order

    k_th = lambda k: F.when(k == 0, F.col("stem")).otherwise(F.concat(k.cast("string"), F.lit("_"), F.col("stem")))

    def read(name: Column) -> Column:
        number = F.regexp_extract(name, "^([1-9][0-9]*)_", 1).try_cast("long")
        plain = F.array(F.struct(name.alias("stem"), F.lit(0).cast("long").alias("k")))
        rest = F.struct(F.regexp_replace(name, "^[1-9][0-9]*_", "").alias("stem"), number.alias("k"))
        return F.when(number.isNotNull(), F.concat(plain, F.array(rest))).otherwise(plain)

    return named_in_order(files, ["stem"], "pos", k_th, read)


def pulled(items: DataFrame, prompts: DataFrame, mode: str = "after") -> DataFrame:
    """items with the tags of their prompts (item_id, prompt) merged in, and whether that
    changed them."""
    found = items.join(prompts, "item_id", "left")
    new = F.coalesce(tg.split_prompt(F.col("prompt")), F.array().cast("array<string>"))
    merged = tg.merge_prompt(F.col("tags"), new, mode)
    return found.withColumn("changed", merged != F.col("tags")).withColumn("tags", merged).drop("prompt")


def source_labels(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) with the shortest <root's name>/<path below it> among the roots (seq, root)
    that contain them. A path meets only its own ancestors: it is exploded into them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.select("path", F.explode(above).alias("root"))
    label = F.concat(F.regexp_extract("root", "([^/]+)$", 1), F.expr("substring(path, length(root) + 1)"))
    found = each.join(roots, "root").groupBy("path").agg(F.min_by(label, F.struct(F.length(label), F.col("seq"))).alias("label"))
    return files.join(found, "path", "left")


def score_text(score: Column, original: Column) -> Column:
    """original, a percentage with one decimal from 99 on, or a whole one."""
    exact = F.concat(F.format_string("%.1f", F.floor(score * 1000 + 0.5) / F.lit(10.0)), F.lit("%"))
    return F.when(original, F.lit("original")).when(score >= 0.99, exact).otherwise(F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%")))


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (key, stamp) that the cache has not, or with another stamp."""
    return files.join(cache.select("key", "stamp"), ["key", "stamp"], "left_anti")


def export_manifest(items: DataFrame) -> DataFrame:
    """items (path, tags) -> source, destination, text, and whether destinations collide."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = items.select(F.col("path").alias("source"), name.alias("destination"), F.array_join("tags", ", ").alias("text"))
    return rows.withColumn("collides", F.count("*").over(W.partitionBy("destination")) > 1)


def reformatted(text: Column) -> Column:
    """Tag files of one tag a line, with underscores, as a caption."""
    return F.replace(F.array_join(tg.split_caption(text, "\n"), ", "), F.lit("_"), F.lit(" "))


def metadata_filter(metadata: Column, width_least: int | None = None, height_most: int | None = None, words: str | None = None, format: str | None = None) -> Column:
    """Bounds of size, part of the prompts, and format; without metadata none of them holds."""
    terms = [F.lit(True)]
    if width_least is not None:
        terms.append(metadata["width"] >= width_least)
    if height_most is not None:
        terms.append(metadata["height"] <= height_most)
    if words is not None:
        terms.append(F.contains(F.lower(F.concat_ws("\n", metadata["positive"], metadata["negative"])), F.lit(words.lower())))
    if format is not None:
        terms.append(F.lower(metadata["format"]) == format.lower())
    out = terms[0]
    for term in terms[1:]:
        out = out & F.coalesce(term, F.lit(False))
    return out


def settings_rows(items: DataFrame) -> DataFrame:
    """items (item_id, settings, width, height) -> key and value rows, the resolution first."""
    size = F.when(F.col("width").isNotNull(), F.array(F.struct(F.lit("Resolution").alias("key"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("value"))))
    rows = F.concat(F.coalesce(size, F.array().cast("array<struct<key:string,value:string>>")), F.map_entries("settings"))
    return items.select("item_id", F.posexplode(rows).alias("place", "r")).select("item_id", "place", "r.key", "r.value")


def copied_captions(items: DataFrame) -> DataFrame:
    """group, captions: a line an item, in order of item_id.

    The feature is one text a group, for a clipboard, so that a group's lines meet in a row.
    """
    lines = items.select("group", "item_id", F.array_join("tags", ", ").alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("item_id", "line")))
    return lines.groupBy("group").agg(F.array_join(F.transform(rows, lambda x: x.line), "\n").alias("captions"))


def copied(items: DataFrame, value: Column, separator: str = "\n") -> DataFrame:
    """One text of a value (a name, a path, a prompt) of the items, in order of item_id; blank
    values are left out. The feature is one text, for a clipboard."""
    rows = items.select("item_id", value.alias("v")).where(F.coalesce(tg.strip(F.col("v")), F.lit("")) != "")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "v"))), lambda x: x.v), separator).alias("text"))


def pasted(tags: Column, text: Column) -> Column:
    """Tags with those of a copied text appended; only commas separate them."""
    return F.concat(tags, tg.split_caption(text, ","))


def completions(session: DataFrame, text: str, used: list[str], limit: int | None = 50) -> DataFrame:
    """session (tag) tags that hold a text, those in use first, then by lower case: what is
    offered without a dictionary (limit 50), or beside its results (no limit)."""
    hit = F.contains(F.lower("tag"), F.lit(text.strip().lower()))
    order = [F.asc(~F.col("tag").isin(used)), F.asc(F.lower("tag")), F.asc("tag")]
    rows = session.select("tag").distinct().where(hit).withColumn("used", F.col("tag").isin(used))
    return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)


def with_sidecars(items: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".txt", "-masklabel.png")) -> DataFrame:
    """items (path) with an array of the sidecar files (path) that are there, in order of suffixes."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    wanted = items.select("path", F.posexplode(F.array(*(F.concat(stem, F.lit(s)) for s in suffixes))).alias("_i", "_side"))
    there = wanted.join(files.select(F.col("path").alias("_side")).distinct(), "_side")
    sides = there.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_side"))), lambda x: x["_side"]).alias("sidecars"))
    return items.join(sides, "path", "left").withColumn("sidecars", F.coalesce("sidecars", F.array().cast("array<string>")))


def file_plan(items: DataFrame, action: str, folder: str | None = None, root: str | None = None) -> DataFrame:
    """What a copy, move or removal (`trash`) of items (path, sidecars) does to files: action,
    source, destination, and whether the item stays in a catalog of `root`.

    A copy, or a move to below the root, keeps the item; a move elsewhere or a removal drops it.
    """
    files = items.select("path", F.explode(F.concat(F.array("path"), "sidecars")).alias("source"))
    name = F.regexp_extract("source", "([^/]+)$", 1)
    to = F.concat(F.lit((folder or "").rstrip("/") + "/"), name) if action != "trash" else F.lit(None).cast("string")
    stays = action == "copy" or (action == "move" and root is not None and f"{folder}/".startswith(root.rstrip("/") + "/"))
    return files.select(F.lit(action).alias("action"), "source", to.alias("destination"), F.lit(stays).alias("stays"))


def at_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """items (path) at some paths (path), however these are written: with or without a scheme,
    with either slash, in any case. An item that is asked for twice is there once."""
    key = lambda df: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(df["path"], "^file:(//)?", ""), r"\\", "/"), "/+", "/"))
    return items.withColumn("_key", key(items)).join(paths.select(key(paths).alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def without_items(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (item_id) of items, labels or edits without those of deleted items (item_id): they
    are keyed by id, so what is left needs no new keys."""
    return rows.join(gone.select("item_id").distinct(), "item_id", "left_anti")


def current_paths(items: DataFrame, versions: DataFrame) -> DataFrame:
    """items (item_id, path) with the path of their last version (item_id, seq, modified) that has one."""
    last = versions.where("modified IS NOT NULL").groupBy("item_id").agg(F.max_by("modified", "seq").alias("modified"))
    return items.join(last, "item_id", "left").withColumn("current", F.coalesce("modified", "path"))


def restored_versions(versions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """versions (item_id, seq, modified) after all items, or those wanted (item_id), go back to
    their base: only the first version of these stays."""
    first = versions.groupBy("item_id").agg(F.min("seq").alias("_base"))
    if wanted is not None:
        first = first.join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    return versions.join(first, "item_id", "left").where("_base IS NULL OR seq = _base").drop("_base")


def with_source(sources: DataFrame, path: str, original: bool = False) -> DataFrame:
    """sources (seq, path, original), a user's short list, with one more; a path that is there is
    not added, and one source at most is the original: the last one that was made so."""
    mine = F.lit(path)
    kept = sources.withColumn("original", (F.lit(original) & (F.col("path") == mine)) | (~F.lit(original) & F.col("original")))
    new = sources.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("seq"), F.coalesce(F.bool_or(F.col("path") == mine), F.lit(False)).alias("_there")).where("NOT _there")
    return kept.unionByName(new.select(F.col("seq").cast(sources.schema["seq"].dataType).alias("seq"), mine.alias("path"), F.lit(original).alias("original")))


def refreshed(cache: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """cache (key, stamp, ...) with the fresh rows in place of those of their keys, and without
    the keys that are gone."""
    keys = fresh.select("key") if gone is None else fresh.select("key").union(gone.select("key"))
    return cache.join(keys.distinct(), "key", "left_anti").unionByName(fresh)


def masked_manifest(items: DataFrame, include_unlabeled: bool = False) -> DataFrame:
    """items (path, labels) -> source, mask: where the mask of each is put; those without labels
    only if told."""
    rows = items if include_unlabeled else items.where(F.size("labels") > 0)
    return rows.select(F.col("path").alias("source"), F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("-mask.png")).alias("mask"))


def label_format(classes: DataFrame) -> str:
    """segmentation if any class (kind), of the few that a user names, is a polygon, else detection."""
    return "segmentation" if classes.agg(F.coalesce(F.bool_or(F.col("kind") == "polygon"), F.lit(False))).first()[0] else "detection"


def number_in_range(text: str, low: float, high: float, whole: bool = True) -> float:
    """A parameter as typed, within its bounds; an error says what is wrong with it."""
    try:
        value = int(text) if whole else float(text)
    except ValueError:
        raise ValueError(f"{text!r} is not a number") from None
    if not low <= value <= high:
        raise ValueError(f"{text} is not from {low} to {high}")
    return value


def cached_pairs(pairs: DataFrame, bits: int) -> DataFrame:
    """Pairs measured at a wider tolerance, at a narrower one: no pair is compared again."""
    return pairs.where(F.col("bits") <= bits)
