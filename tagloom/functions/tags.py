"""Columns over ordered tag arrays: splitting, editing, ordering, predicates.

Tags keep their order and may repeat; a null array stays null. All are higher-order
functions, so they run inside the scan's stage and need no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words of a generation prompt that separate tags like commas.
PROMPT_KEYWORDS = ("AND", "BREAK", "ADDBASE", "ADDCOMM", "ADDCOL", "ADDROW")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once, though a lambda inside may use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without any white space at both ends (trim takes blanks alone)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def split_caption(text: Column, separator: str = ", ") -> Column:
    """The stripped, non-empty parts of a caption between the stripped separator."""
    mark = separator.strip() or separator
    parts = F.split(text, "\\Q" + mark + "\\E")
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def join_caption(tags: Column, separator: str = ", ") -> Column:
    return F.array_join(tags, separator)


def split_prompt(text: Column) -> Column:
    """Tags of a prompt: <lora:...> stands alone, and keywords separate like commas."""
    alone = F.regexp_replace(text, r"(<lora:[^>]*>)", ",$1,")
    return split_caption(F.regexp_replace(alone, rf"\b({'|'.join(PROMPT_KEYWORDS)})\b", ","), ",")


def key(tag: Column) -> Column:
    return F.lower(strip(tag))


def rename(tags: Column, old: str, new: str) -> Column:
    return F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t))


def java_regex(pattern: str, flags: str = "(?i)") -> str | None:
    """A Python pattern as one for Spark, None if either refuses it.

    Named groups and the end of text are written differently; what else only one of both
    knows counts as a bad pattern, so that none fails a job.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    out = flags + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace(r"\Z", r"\z")
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.range(1).select(F.rlike(F.lit(""), F.lit(out))).collect()  # a constant: Spark compiles it on the driver
    except Exception:  # noqa: BLE001 - the engine's own error for a pattern that it refuses
        return None
    return out


def replace(tags: Column, find: str, by: str, whole: bool = False, regex: bool = False) -> Column:
    """Find and replace; a regex has precedence over whole tags, and a bad one changes
    nothing. In its replacement \\1 and \\g<name> stand for groups. Tags left blank are removed."""
    if regex:
        pattern = java_regex(find, "")
        if pattern is None:
            return tags
        into = re.sub(r"\\(?:g<(\w+)>|(\d))", lambda m: "${" + m[1] + "}" if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), by.replace("$", r"\$"))
        changed = F.transform(tags, lambda t: F.regexp_replace(t, pattern, into))
    elif whole:
        changed = rename(tags, find, by)
    else:
        changed = F.transform(tags, lambda t: F.replace(t, F.lit(find), F.lit(by)))
    return remove_empty(changed)


def remove_empty(tags: Column) -> Column:
    return F.filter(tags, lambda t: strip(t) != "")


def delete(tags: Column, gone: list[str]) -> Column:
    """Without any of these tags; what stays may still repeat."""
    return F.filter(tags, lambda t: ~t.isin(gone))


def dedupe(tags: Column) -> Column:
    """The first spelling of each tag, without regard to case and outer white space.

    Tags are sorted by key and place, so that equal ones stand side by side, and the first
    of each are sorted back: work grows with n log n.
    """
    marked = F.array_sort(F.transform(tags, lambda t, i: F.struct(key(t).alias("k"), i.alias("i"), t.alias("t"))))
    firsts = let(marked, lambda s: F.filter(s, lambda e, j: (j == 0) | ~e.k.eqNullSafe(F.get(s, j - 1).k)))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e.i.alias("i"), e.t.alias("t")))), lambda e: e.t)


def append(tags: Column, new: list[str]) -> Column:
    return F.concat(tags, F.array(*map(F.lit, new)))


def append_absent(tags: Column, new: Column) -> Column:
    """With those of `new` that tags lacks, each once."""
    return F.concat(tags, F.array_except(new, tags))


def insert(tags: Column, tag: str, first: bool = False) -> Column:
    one = F.array(F.lit(tag))
    return F.concat(one, tags) if first else F.concat(tags, one)


def _rest(tags: Column, keep_first: bool, order) -> Column:
    if not keep_first:
        return order(tags)
    return F.when(F.size(tags) > 1, F.concat(F.slice(tags, 1, 1), order(F.slice(tags, F.lit(2), F.greatest(F.size(tags) - 1, F.lit(0)))))).otherwise(tags)


def order_alphabetically(tags: Column, keep_first: bool = False) -> Column:
    """By lower case; equal ones stay in order."""

    def order(a: Column) -> Column:
        return F.transform(F.array_sort(F.transform(a, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t")))), lambda s: s.t)

    return _rest(tags, keep_first, order)


def order_by_count(tags: Column, counts: Column) -> Column:
    """Most frequent first by a parallel array of counts; equal ones stay in order."""
    marked = F.transform(F.arrays_zip(tags.alias("t"), counts.alias("n")), lambda s, i: F.struct((-s["n"]).alias("k"), i.alias("i"), s["t"].alias("t")))
    return F.transform(F.array_sort(marked), lambda s: s.t)


def reverse(tags: Column, keep_first: bool = False) -> Column:
    return _rest(tags, keep_first, F.reverse)


def shuffled(tags: Column, keep_first: bool = False, seed: int = 0) -> Column:
    """In an order drawn from the seed and the tags, the same on every run."""

    def order(a: Column) -> Column:
        drawn = F.transform(a, lambda t, i: F.struct(F.xxhash64(F.lit(seed), t, i).alias("k"), i.alias("i"), t.alias("t")))
        return F.transform(F.array_sort(drawn), lambda s: s.t)

    return _rest(tags, keep_first, order)


def committed(tags: Column, text: Column, separator: str = ", ") -> Column:
    """The tags of a caption as it was typed, and whether they differ from the old: only
    then is there anything to write."""
    new = split_caption(text, separator)
    return F.struct(new.alias("tags"), (new != tags).alias("changed"))


def to_front(tags: Column, wanted: list[str]) -> Column:
    """The wanted tags that are there first, each once and in the order wanted."""
    want = F.array(*map(F.lit, wanted))
    return F.concat(F.filter(want, lambda w: F.array_contains(tags, w)), delete(tags, wanted))


def matching_to_front(tags: Column, pattern: str) -> Column:
    """All tags that match, in their order, then the rest."""
    hit = lambda t: t.rlike(f"(?i){pattern}")
    return F.concat(F.filter(tags, hit), F.filter(tags, lambda t: ~hit(t)))


def merge(tags: Column, new: Column, mode: str = "after") -> Column:
    """New tags before, after, or instead of the old."""
    return {"before": F.concat(new, tags), "after": F.concat(tags, new), "overwrite": new}[mode]


def merge_prompt(tags: Column, new: Column, mode: str = "after", skip_present: bool = True) -> Column:
    """New tags once each whatever their case, without those present unless overwriting."""
    once = dedupe(new)
    if skip_present and mode != "overwrite":
        present = F.transform(tags, key)
        once = F.filter(once, lambda t: ~F.array_contains(present, key(t)))
    return merge(tags, once, mode)


def strip_reasoning(text: Column) -> Column:
    """Without <think> parts; after a lone closing mark what follows the last one."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)^.*</think>", ""))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def compact_count(n: Column) -> Column:
    """1.2M, 3k, or nothing for 0."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.floor(n / 100_000) / F.lit(10.0))).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).when(n > 0, n.cast("string")).otherwise(F.lit(""))


def folder_name(text: Column, longest: int = 60) -> Column:
    """A safe folder name: other characters than word characters and - become single _."""
    safe = F.regexp_replace(F.lower(strip(text)), r"(?U)[^\w\-]+", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(safe, "_+", "_"), "^_+|_+$", ""), 1, longest)


def cache_name(path: Column) -> Column:
    """A relative path as the name of one PNG file: without its suffix, unsafe characters _."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), r"(?U)[^\w\-.]+", "_"), F.lit(".png"))


def unescaped(separator: str) -> str:
    """A separator as typed, where \\n and \\t stand for line end and tab; a bad escape is
    left as it is, and nothing stands for a comma and a blank."""
    try:
        return separator.encode().decode("unicode_escape") or ", "
    except UnicodeDecodeError:
        return separator


def short_key(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 12)


# --- predicates ------------------------------------------------------------------------


def glob(pattern: str) -> str:
    """A whole-string, case-insensitive regex for *, ? and [...]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() and c not in " _" else c
        i += 1
    return rf"(?is)\A{out}\z"


def has_wildcard(term: str) -> bool:
    return "*" in term or "?" in term


def text_matches(name: Column, tags: Column, term: str) -> Column:
    """The term is part of the name or of any tag, whatever its case."""
    low = F.lit(term.lower())
    return F.contains(F.lower(name), low) | F.exists(tags, lambda t: F.contains(F.lower(t), low))


def tag_is(tags: Column, term: str) -> Column:
    """Some tag equals the term, or matches it if it has wildcards, whatever its case."""
    if has_wildcard(term):
        return F.exists(tags, lambda t: t.rlike(glob(term)))
    return F.exists(tags, lambda t: key(t) == term.lower())


def name_is(name: Column, term: str) -> Column:
    return name.rlike(glob(term)) if has_wildcard(term) else F.contains(F.lower(name), F.lit(term.lower()))


def regex_matches(name: Column, tags: Column, pattern: str) -> Column:
    """The pattern is found in the name or a tag; a bad one is a term of its own."""
    good = java_regex(pattern)
    if good is None:
        return text_matches(name, tags, f"r:{pattern}")
    return name.rlike(good) | F.exists(tags, lambda t: t.rlike(good))


def highlighted(tags: Column, hit) -> Column:
    """Each tag with whether hit(tag) holds."""
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), hit(t).alias("hit")))
