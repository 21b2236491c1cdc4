"""Filter expressions on small items, with what each must select."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import filters
from tagloom.functions import tags as tg

ITEMS = [(1, "a/cat_01.png", ["cat", "long hair", "Solo"], [0]), (2, "a/dog_02.png", ["dog", "solo", "solo"], [0, 1]), (3, "b/sun-set.png", ["sun", "shadow"], []), (4, "b/or.png", [], [7]), (5, "b/cat dog.png", ["cat", "dog", "1girl (x)"], [1, 1])]
ALL = {1, 2, 3, 4, 5}
CAPTIONS = {
    "cat": {1, 5},
    "tag:SOLO": {1, 2},
    "tag:cat and not tag:dog": {1},
    "tag:cat or tag:sun": {1, 3, 5},
    "tags:>=3": {1, 2, 5},
    "tags:0": set(),
    'r:"^sun$"': {3},
    "tag:l*r": {1},
    "name:*dog*": {2, 5},
    "-tag:solo": {3, 4, 5},
    "not not tag:sun": {3},
    'tag:"1girl (x)"': {5},
    "or tag:sun": ALL,
    '"or"': ALL,
    "() tag:sun": ALL,
    "tag:sun ) tag:dog": {3},
    "not or tag:sun": {3},
    "-(tag:sun)": {3},
    "": ALL,
    "  ": ALL,
    "(tag:cat or tag:sun) -tag:dog": {1, 3},
    "((tag:cat": {1, 5},
    "path:b/*": {3, 4, 5},
    "r:[": set(),
    r'r:"(?P<x>l)(?P=x)?ong\Z"': set(),
    r'r:"(?P<x>o)l(?P=x)\Z"': {1, 2},
    "'long hair'": {1},
    'tag:"long hair': {1},
    "and and tag:sun and": {3},
    "tag:": set(),
}
LABELS = {
    "class:dog": {1, 2},
    "class:d*": {1, 2},
    "class:class_7": {4},
    "class:cat class:dog": {2},
    "labels:>1": {2, 5},
    "labels:=0": {3},
    "labels:0": set(),
    "not class:cat or labels:=0": {1, 3, 4},
    "not not class:dog": {3, 4, 5},
    "": ALL,
    "or or": ALL,
    "not or class:dog": {1, 2},
    "not -class:dog": {3, 4, 5},
    "(dog)": set(),
    "name:cat": {1, 5},
}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "id long, name string, tags array<string>, ids array<int>")


def selected(items, column):
    return {r.id for r in items.where(column).collect()}


@pytest.mark.parametrize("text", CAPTIONS)
def test_captions(items, text):
    assert selected(items, filters.captions(text, F.col("name"), F.col("tags"))) == CAPTIONS[text]


@pytest.mark.parametrize("text", LABELS)
def test_labels(items, text):
    assert selected(items, filters.labelled(text, F.col("name"), F.col("ids"), {0: "dog", 1: "cat"})) == LABELS[text]


def test_nulls_are_no_match_and_their_negation_is(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "x", [None, "a"])], "id long, name string, tags array<string>")
    for text, expected in {"a": {2}, "-a": {1}, "tags:=0": {1}, "not tags:>5": {1, 2}, "r:b or name:x": {2}}.items():
        assert selected(rows, filters.captions(text, F.col("name"), F.col("tags"))) == expected, text


def test_one_pushed_condition(items):
    """An expression is one filter of the scan's stage, without Python."""
    plan = items.where(filters.captions("tag:cat or not (r:x tags:>2)", F.col("name"), F.col("tags")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Filter") == 1 and "Python" not in plan and "Exchange" not in plan


def test_terms_and_narrowing(items):
    assert [filters.tag_term(t) for t in ("solo", "long hair", '1girl (x) "y"', "it's")] == ["tag:solo", 'tag:"long hair"', 'tag:"1girl (x) y"', 'tag:"it\'s"']
    assert filters.narrowed("", ["a", "b c"]) == 'tag:a and tag:"b c"'
    assert filters.narrowed("tag:a or x", ["b"]) == "(tag:a or x) and tag:b"
    assert filters.narrowed("tag:a and sort", ["a", "b"]) == "tag:a and sort and tag:b"
    assert filters.narrowed('tag:"b c"', ["b c"]) == 'tag:"b c"'
    for tags in (t for _, _, t, _ in ITEMS):
        for tag in tags:
            text = filters.narrowed("", [tag])
            assert selected(items, filters.captions(text, F.col("name"), F.col("tags"))) == {i for i, _, t, _ in ITEMS if tag.lower() in map(str.lower, t)}


def test_patterns_that_only_one_engine_knows_change_nothing(spark):
    rows = spark.createDataFrame([(["ab", "cd"],)], "tags array<string>")
    for bad in ("(", "(?a)x", "[[:alpha:]", r"\Qab"):
        assert rows.select(tg.replace(F.col("tags"), bad, "x", regex=True)).first()[0] in (["ab", "cd"], ["x", "x"]), bad
    assert rows.select(tg.replace(F.col("tags"), r"(?P<l>a)b", r"\g<l>$1\1", regex=True)).first()[0] == ["a$1a", "cd"]
