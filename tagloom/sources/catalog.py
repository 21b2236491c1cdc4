"""Item catalogs over the tables, and readers and writers of the formats around them."""

from __future__ import annotations

import io
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tagloom.functions import geometry, tags
from tagloom.operators.catalog import numbered, stored
from tagloom.sources import images

#: Suffixes of image files.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, name, tags (short, of few kinds), width."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.concat(F.split("p_name", " "), F.array("p_brand", "p_type")).alias("tags"), F.col("p_size").alias("width"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, name (a path), tags (long, of many kinds)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("name"), tags.split_caption(F.col("text"), ",").alias("tags"))


#: What a use of a listing leaves out: masks beside images, any file with -mask in its name, or nothing.
SKIPPED = {"masks": r"(?i)-masklabel\.png$", "any mask": r"(?i)-mask[^/]*$", "nothing": None}


def path_key(path: Column) -> Column:
    """A path as a key: without the scheme, with forward slashes, no doubled ones, and in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^file:(//)?", ""), r"\\", "/"), "/+", "/"))


def scan_images(spark: SparkSession, *roots: str, skip: str = "masks", originals: tuple[str, ...] = ()) -> DataFrame:
    """path, relative_path, size, mtime, is_original, root, width, height of image files below
    the roots, each file once, in order of the lower-case relative path.

    Roots may nest; a file keeps the first root that has it, and is an original if any of its
    roots is among `originals`. relative_path is null if no file is in a folder below its root.
    Files are listed without being read, by the image suffixes alone; then width and height
    are read from each file's head, and are 0 where that tells none.
    """
    suffixes = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGES)
    found = None
    for seq, root in enumerate(roots):
        files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{{{suffixes}}}").load(root)
        below = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^\\Q" + root.rstrip("/").removeprefix("file://").removeprefix("file:") + "\\E/", "")
        files = files.select("path", below.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(seq).alias("root"), F.lit(root in originals).alias("is_original"))
        found = files if found is None else found.unionByName(files)
    if SKIPPED[skip]:
        found = found.where(~F.col("path").rlike(SKIPPED[skip]))
    first = F.min_by(F.struct("path", "relative_path", "size", "mtime", "root"), "root").alias("f")
    once = found.groupBy(path_key(F.col("path")).alias("key")).agg(first, F.bool_or("is_original").alias("is_original")).select("f.*", "is_original")
    nested = once.agg(F.coalesce(F.bool_or(F.contains("relative_path", F.lit("/"))), F.lit(False)).alias("_nested"))
    contents = None
    if not all(map(images.known, roots)):
        contents = reduce(DataFrame.union, (spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{{{suffixes}}}").load(root).select("path", "content") for root in roots)).dropDuplicates(["path"])
    rows = image_sizes(once, contents).crossJoin(F.broadcast(nested)).orderBy(F.lower("relative_path"), "path")
    return rows.select("path", F.when(F.col("_nested"), F.col("relative_path")).alias("relative_path"), "size", "mtime", "is_original", "root", "width", "height")


def image_sizes(files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """files (path, ...) with width and height, 0 where a file tells none or cannot be read.

    Tasks open the files, and read and skip what stands before the size: some bytes of each.
    Paths are local or mounted ones, or in a store that pyarrow.fs opens by their scheme; for
    others contents (path, content) are what Spark reads there.
    """
    read = contents is not None
    if read:
        files = files.join(contents, "path", "left")
    schema = T.StructType([*files.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = []
            if read:
                sizes = [images.size_of(io.BytesIO(c or b"")) for c in batch.column("content").to_pylist()]
            for path in batch.column("path").to_pylist() if not read else ():
                try:
                    with images.opened(path) as file:
                        sizes.append(images.size_of(file))
                except (OSError, ValueError):
                    sizes.append((0, 0))
            width, height = (pa.array(x, pa.int32()) for x in (zip(*sizes) if sizes else ((), ())))
            yield pa.RecordBatch.from_arrays([*batch.columns, width, height], names=schema.names)

    return files.mapInArrow(run, schema).drop("content")


def png_texts(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, texts: a map of the text chunks of PNG files, empty for others.

    Plain, compressed and international chunks; of a key that repeats the last counts.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            maps = [list(dict(_text_chunks(c or b"")).items()) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(maps, kind)], names=["path", "texts"])

    return files.select("path", "content").mapInArrow(run, "path string, texts map<string,string>")


def _text_chunks(data: bytes):
    """(key, text) of each text chunk; a damaged file gives those before the damage."""
    import zlib

    at = 8 if data[:8] == b"\x89PNG\r\n\x1a\n" else len(data)
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        key, zero, rest = body.partition(b"\0")
        try:
            if kind == b"tEXt" and zero:
                yield key.decode("latin-1"), rest.decode("latin-1")
            elif kind == b"zTXt" and zero:
                yield key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")
            elif kind == b"iTXt" and zero:
                text = rest[2:].split(b"\0", 2)[2]  # after the language and the translated key
                yield key.decode("latin-1"), (zlib.decompress(text) if rest[0] else text).decode()
        except (zlib.error, UnicodeDecodeError, IndexError):
            continue


def read_captions(spark: SparkSession, path: str, separator: str = ", ") -> DataFrame:
    """stem, path and tags of caption files, one row a file; Spark lists no empty files, so an
    item without a row here has no tags."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.txt", recursiveFileLookup="true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), tags.split_caption(F.decode("content", "UTF-8"), separator).alias("tags"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """stem and label of each line of label files that can be read as one."""
    lines = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return lines.select(stem.alias("stem"), geometry.parse_yolo(F.col("value")).alias("label")).where("label IS NOT NULL")


def write_files(rows: DataFrame, path: str) -> None:
    """rows (name, text): a text file of that name each below path; names are not escaped.

    Tasks write to a folder of their own beside the others', and their rows, with the places of
    the files, to a table, which Spark commits; so attempts that failed or were run twice
    leave nothing in it. Only when all is written, a second job moves the files that are in
    the table to their names. If the first job fails, nothing is at path; the second one
    may be run again. path is local or mounted on all executors, or in a store that pyarrow.fs
    opens by its scheme.
    """
    import uuid

    store = images.store
    staging = f"{path.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def put(batches):
        import posixpath

        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, folder = store(staging)
        own = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        fs.create_dir(own, recursive=False)  # a task that outlives its job finds no folder to write to
        n = 0
        for batch in batches:
            places = []
            for text in batch.column("text").to_pylist():
                places.append(posixpath.join(own, str(n)))
                with fs.open_output_stream(places[-1]) as out:
                    out.write((text or "").encode())
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(places, pa.string())], names=["name", "place"])

    def move(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow.fs import FileType

        fs, folder = store(path)
        made = set()
        for batch in batches:
            for name, place in zip(batch.column("name").to_pylist(), batch.column("place").to_pylist()):
                target = posixpath.join(folder, name)
                if posixpath.dirname(target) not in made:
                    made.add(posixpath.dirname(target))
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                if fs.get_file_info(place).type != FileType.NotFound:  # else this is a second attempt
                    fs.move(place, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows])})

    fs, folder = store(staging)
    fs.create_dir(folder, recursive=True)
    try:
        written = stored(rows.select("name", "text").mapInArrow(put, "name string, place string"), "files")
        written.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        for left in reversed(range(10)):
            try:
                fs.delete_dir(folder)
                break
            except FileNotFoundError:
                break
            except OSError:  # a task still wrote a file
                if not left:
                    raise
                time.sleep(0.2)


def write_captions(items: DataFrame, path: str, separator: str = ", ") -> None:
    """items (name, tags): a caption file each, beside the image: <name without suffix>.txt."""
    name = F.concat(F.regexp_replace("name", r"\.[^./]*$", ""), F.lit(".txt"))
    write_files(items.select(name.alias("name"), tags.join_caption(F.col("tags"), separator).alias("text")), path)


def write_labels(items: DataFrame, path: str, form: str | None = None) -> None:
    """items (name, labels): a label file each, of each label's own form, or all of one form."""
    name = F.concat(F.regexp_replace("name", r"\.[^./]*$", ""), F.lit(".txt"))
    write_files(items.select(name.alias("name"), geometry.label_lines(F.col("labels"), form).alias("text")), path)


def export_dataset(items: DataFrame, classes: DataFrame, path: str, form: str, include_unlabeled: bool = False) -> DataFrame:
    """Writes labels/<stem>.txt of items (path, labels) and classes.txt of classes (class_id, name)
    below path, and gives the images to copy: source, destination.

    form: of all labels, as operators.catalog.label_format tells it from the classes.
    """
    rows = items if include_unlabeled else items.where(F.size("labels") > 0)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    write_labels(rows.select(F.concat(F.lit("labels/"), name).alias("name"), "labels"), path, form)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("class_id", "name"))), lambda c: F.concat(c["name"], F.lit("\n")))  # as many as a user names classes
    write_files(classes.agg(F.array_join(lines, "").alias("text")).withColumn("name", F.lit("classes.txt")), path)
    return rows.select(F.col("path").alias("source"), F.concat(F.lit(path.rstrip("/") + "/images/"), name).alias("destination"))


def cached_embeddings(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, size, mtime) beside their embedding in the cache (key, embedding), and those
    that have none yet. An embedding with a number that is not finite counts as none."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = cache.where(finite).dropDuplicates(["key"])
    keyed = files.withColumn("key", F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string")))
    return keyed.join(good, "key"), keyed.join(good, "key", "left_anti")


def _dictionary(rows: DataFrame, display) -> DataFrame:
    return rows.where(tags.strip(F.col("name")) != "").withColumn("display_name", display)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A tag dictionary in Parquet: name, display_name, category, post_count, aliases; columns
    that are missing have defaults, blank names are left out."""
    rows = spark.read.parquet(path)
    have = set(rows.columns)
    get = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    aliases = tags.split_caption(get("aliases", F.lit("")), ",")
    rows = rows.select("name", get("category", F.lit(0)).cast("int").alias("category"), get("post_count", F.lit(0)).cast("long").alias("post_count"), aliases.alias("aliases"))
    return _dictionary(rows, F.replace("name", F.lit("_"), F.lit(" ")))


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from CSV without a header; bad numbers are 0."""
    schema = "name string, category string, post_count string, aliases string"
    rows = spark.read.schema(schema).csv(path).where(F.col("post_count").isNotNull())
    number = lambda c, kind: F.coalesce(F.col(c).try_cast(kind), F.lit(0)).cast(kind).alias(c)
    rows = rows.select("name", number("category", "int"), number("post_count", "long"), tags.split_caption(F.coalesce("aliases", F.lit("")), ",").alias("aliases"))
    return _dictionary(rows, F.replace("name", F.lit("_"), F.lit(" ")))


def with_custom(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """A dictionary with a user's own tags, lines (seq, value): of category 0 and never used, and
    only where no entry has that display name; of equal lines the first counts."""
    name = tags.strip(F.col("value"))
    own = lines.select(name.alias("name"), F.col("seq").alias("_seq")).where("name != ''").withColumn("display_name", F.replace("name", F.lit("_"), F.lit(" ")))
    own = own.groupBy(F.lower("display_name").alias("_key")).agg(F.min_by(F.struct("name", "display_name"), "_seq").alias("o"), F.min("_seq").alias("_seq"))
    new = own.join(rows.select(F.lower("display_name").alias("_key")).distinct(), "_key", "left_anti")
    after = rows.agg(F.coalesce(F.max("load_seq") + 1, F.lit(0)).alias("_after"))
    new = new.crossJoin(F.broadcast(after)).select("o.*", F.lit(0).alias("category"), F.lit(0).cast("long").alias("post_count"), F.array().cast("array<string>").alias("aliases"), (F.col("_after") + F.col("_seq")).alias("load_seq"))
    return rows.unionByName(new)


def dictionary_folder(spark: SparkSession, folder: str, custom: str = "custom_tags.txt") -> DataFrame:
    """All dictionaries in Parquet of a folder, in order of file name, then a user's own tags.

    load_seq grows in the order of loading: by file, then by row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    names = sorted(r.path for r in files.select("path").collect())  # one a dictionary
    rows = None
    for k, path in enumerate(names):
        one = dictionary(spark, path).withColumns({"_file": F.lit(k), "_row": F.monotonically_increasing_id()})
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        rows = spark.createDataFrame([], "name string, category int, post_count long, aliases array<string>, display_name string, load_seq long")
    else:
        rows = numbered(rows, [F.asc("_file"), F.asc("_row")], "load_seq").withColumn("load_seq", F.col("load_seq").cast("long") - 1)
    own = spark.read.text(folder, pathGlobFilter=custom).withColumn("seq", F.monotonically_increasing_id())
    return with_custom(rows.select("name", "display_name", "category", "post_count", "aliases", "load_seq"), own)


def first_by_name(rows: DataFrame, order: str, last: bool = False) -> DataFrame:
    """Of each display name, whatever its case, the first (or last) row."""
    by = W.partitionBy(F.lower("display_name")).orderBy(F.col(order).desc() if last else F.col(order).asc())
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def download_filter(rows: DataFrame, least: int) -> DataFrame:
    """What is kept of a downloaded dictionary, most used first."""
    return rows.select("name", "category", "post_count").where(F.col("post_count") >= least).orderBy(F.desc("post_count"))


SNAPSHOT = T.StructType([T.StructField("image_name", T.StringType()), T.StructField("captions", T.StringType())])


def write_snapshot(items: DataFrame, path: str) -> None:
    rows = items.select(F.col("name").alias("image_name"), tags.join_caption(F.col("tags")).alias("captions"))
    rows.write.csv(path, header=True, escape='"')


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """name and tags; of a name that repeats in a file the last line counts."""
    rows = spark.read.schema(SNAPSHOT).csv(path, header=True, escape='"', multiLine=True).withColumn("_seq", F.monotonically_increasing_id())
    last = rows.groupBy(F.col("image_name").alias("name")).agg(F.max_by("captions", "_seq").alias("captions"))
    return last.select("name", tags.split_caption(F.coalesce("captions", F.lit(""))).alias("tags"))


def write_dataset(items: DataFrame, path: str) -> None:
    """A training set's text files as one folder a split: name and text, partitioned."""
    items.select("split", "name", "text").write.partitionBy("split").json(path)
