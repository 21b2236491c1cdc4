"""Per-item models as Arrow-batched functions; an item's failure is a row, not the job's.

A model is a factory: called once a Python worker, it returns a function from a list of
values to a list of results, so that what it loads is shared by all batches of a worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parsed

from tagloom.functions import tags

_models: dict[str, tuple[Callable, str]] = {}
_extras: dict[str, dict] = {}


def register(name: str, result: str, wants_mask: bool = False, replaces: bool = False):
    """Names a model factory and the type of its results in DDL.

    wants_mask: it modifies images where a mask says, and items without one are left out.
    replaces: what it says of an item takes the place of its tags.
    """

    def put(factory: Callable) -> Callable:
        _models[name] = (factory, result)
        _extras[name] = {"wants_mask": wants_mask, "replaces": replaces}
        return factory

    return put


def names() -> list[str]:
    return sorted(_models)


def _during(factory: Callable, answered: Callable, batches: Iterator) -> Iterator:
    """What a new model answers to batches; one that has `finalize` or `unload` is told that the
    task is over."""
    model = factory()
    try:
        yield from answered(model, batches)
    finally:
        for end in ("finalize", "unload"):
            getattr(model, end, lambda: None)()


def _answers(model: Callable, values: list) -> tuple[list, list]:
    """A model's results and errors; where it fails on all values, it is asked for each."""
    try:
        return list(model(values)), [None] * len(values)
    except Exception:
        results, errors = [], []
    for value in values:
        try:
            results += model([value])
            errors.append(None)
        except Exception as error:
            results.append(None)
            errors.append(f"{type(error).__name__}: {error}")
    return results, errors


def apply(items: DataFrame, name: str, column: str, into: str = "result") -> DataFrame:
    """items with the model's result on a column, and the error where it has none.

    A batch that fails is tried again value by value, so that one bad item costs only its
    own result. Null values go to the model like any other.
    """
    factory, result = _models[name]
    kind: DataType = parsed(result)
    schema = StructType([*items.schema.fields, StructField(into, kind), StructField(f"{into}_error", StringType())])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _during(factory, answered, batches)

    def answered(model, batches):
        for batch in batches:
            results, errors = _answers(model, batch.column(column).to_pylist())
            arrays = [*batch.columns, pa.array(results, arrow), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, into, f"{into}_error"])

    return items.mapInArrow(run, schema)


def column(name: str) -> Callable:
    """A model as a function of one Column, whose values are structs of its result and its error.

    It goes by Arrow batches, as apply does, and fits where a plan takes an expression.
    """
    factory, result = _models[name]
    kind, arrow = parsed(f"struct<result:{result},error:string>"), to_arrow_type(parsed(result))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _during(factory, answered, batches)

    def answered(model, batches):
        for batch in batches:
            results, errors = _answers(model, batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(results, arrow), pa.array(errors, pa.string())], ["result", "error"])

    return F.arrow_udf(run, kind)


def to_sql(spark: SparkSession, prefix: str = "") -> dict[str, str]:
    """Makes every named model a function of SQL; the functions' names, by the models'.

    What is no letter, digit or _ in a model's name is _ in its function's. A name that Spark has for a
    function of its own gets _model, as it would hide that from the session. Two models with one
    function's name are an error, before any is made. A model's rows, if its result is an array, come
    by LATERAL VIEW explode.
    """
    taken = {r.function.lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    found = {name: prefix + re.sub(r"\W", "_", name, flags=re.ASCII) for name in names()}
    found = {name: f"{function}_model" if function.lower() in taken else function for name, function in found.items()}
    twice = [n for n, of in Counter(f.lower() for f in found.values()).items() if of > 1]
    if twice:
        raise ValueError(f"several models would be {twice[0]}")
    for name, function in found.items():
        spark.udf.register(function, column(name))
    return found


def merged_labels(items: DataFrame, found: str, labels: str = "labels") -> DataFrame:
    """items with what a detector found appended to their labels."""
    return items.withColumn(labels, F.concat(labels, F.coalesce(F.col(found), F.slice(labels, 1, 0))))


def captioned(items: DataFrame, name: str, column: str, mode: str = "after") -> DataFrame:
    """items (tags) with a captioner's tags, an array, merged in before, after or instead of the
    old; one that replaces does so in any mode. Items that it fails on keep theirs."""
    found = apply(items, name, column, "_new")
    merged = tags.merge(F.col("tags"), F.col("_new"), "overwrite" if _extras[name]["replaces"] else mode)
    return found.withColumn("tags", F.coalesce(F.when(F.col("_new_error").isNull(), merged), F.col("tags"))).withColumnRenamed("_new_error", "error").drop("_new")


def modified(items: DataFrame, name: str, image: str = "image", mask: str = "mask") -> DataFrame:
    """items with what a modification gives for a struct (image, mask), as `modified`, and its
    error. One that wants a mask leaves out items without; one that doesn't gets none."""
    wants = _extras[name]["wants_mask"]
    rows = items.where(F.col(mask).isNotNull()) if wants else items
    given = F.struct(F.col(image).alias("image"), (F.col(mask) if wants else F.lit(None).cast(items.schema[mask].dataType)).alias("mask"))
    return apply(rows.withColumn("_given", given), name, "_given", "modified").drop("_given")


def generated(items: DataFrame, name: str, column: str, cache: DataFrame) -> DataFrame:
    """items (path) with the path of what a generator makes of them, or the cache (key, generated) has of
    their name already; only the others are made."""
    keyed = items.withColumn("key", tags.cache_name(F.col("path")))
    have = keyed.join(cache.select("key", "generated"), "key")
    new = apply(keyed.join(cache.select("key"), "key", "left_anti"), name, column, "generated")
    return have.withColumn("generated_error", F.lit(None).cast("string")).unionByName(new)


# --- jobs by name ------------------------------------------------------------------------

KINDS: dict[str, Callable[[str], object]] = {"string": str, "number": float, "boolean": lambda v: str(v).lower() in ("true", "1", "yes"), "path": str}
_jobs: dict[str, tuple[Callable, dict]] = {}
_available: dict[str, Callable[[], bool]] = {}


def job(name: str, parameters: list[dict], available: Callable[[], bool] = lambda: True):
    """Names a job, a function from a session and parameters to a DataFrame.

    parameters: name, label, type (one of KINDS) and default of each.
    """
    for p in parameters:
        if not {"name", "label", "type", "default"} <= p.keys() or p["type"] not in KINDS:
            raise ValueError(f"{name}: {p} lacks a key, or has an unknown type")

    def put(run: Callable) -> Callable:
        _jobs[name] = (run, {p["name"]: p for p in parameters})
        _available[name] = available
        return run

    return put


def jobs() -> list[str]:
    """The names of the jobs that can run here."""
    return sorted(n for n in _jobs if _available[n]())


def run_job(spark, name: str, **given) -> DataFrame:
    """A job's result; parameters that are not given have their defaults. Spark's own
    spark.addTag and interruptTag cancel it."""
    run, known = _jobs[name]
    unknown = given.keys() - known.keys()
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)[0]}")
    return run(spark, **{n: KINDS[p["type"]](given.get(n, p["default"])) for n, p in known.items()})


def discovered(package: str) -> list[str]:
    """Imports the modules of a package, which name their models and jobs as they load; those
    that begin with _ or fail to import are left out, and the names of the latter returned."""
    import importlib
    import logging
    import pkgutil

    failed = []
    for found in pkgutil.iter_modules(importlib.import_module(package).__path__):
        if found.name.startswith("_"):
            continue
        try:
            importlib.import_module(f"{package}.{found.name}")
        except Exception as error:  # noqa: BLE001 - whatever a plug-in raises
            logging.getLogger(__name__).warning("%s left out: %s", found.name, error)
            failed.append(found.name)
    return failed
