"""Filter expressions as text, each compiled to one boolean Column.

Terms that stand side by side must all hold; `or`, `not`, `-term` and, but for label filters,
parentheses combine them, and quotes keep blanks and parentheses inside a term. A term is
`key:value` or plain text; an unknown key, or a value that its key can't read, makes it
plain text. Terms are never null, so that a negated one holds where there is nothing to
look at. An expression without any term accepts every row.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import tags as tg

Term = Callable[[str], Column]

COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_NUMBER = re.compile(r"(==?|!=|<=?|>=?)(\d+)")
_SIZE = re.compile(r"(\d+)\s*x\s*(\d+)", re.IGNORECASE)
FLAGS = {"yes": True, "true": True, "1": True, "no": False, "false": False, "0": False}


def tokens(text: str, parentheses: bool = True) -> list[str]:
    """The terms and keywords of an expression; only a blank separates them. A quote that is
    not closed reaches to the end."""
    plain = " \"'()" if parentheses else " \"'"
    out, glue = [], False
    for piece in re.findall(rf"\"[^\"]*\"?|'[^']*'?|[()]|[^{re.escape(plain)}]+| +" if parentheses else rf"\"[^\"]*\"?|'[^']*'?|[^{re.escape(plain)}]+| +", text):
        if piece[0] == " " or parentheses and piece in ("(", ")"):
            out += [piece] if piece[0] != " " else []
            glue = False
            continue
        inner = piece.replace(piece[0], "") if piece[0] in "\"'" else piece
        if glue:
            out[-1] += inner
        elif inner:
            out.append(inner)
            glue = True
    return out


@dataclass
class _Level:
    """What has been read since a parenthesis was opened: operands of `or`, of `and`, and how
    many `not`s wait for their operand (None: none). An operand that is missing shuts the
    row of `and`s: only `or`, or the parenthesis' end, goes on from there."""

    either: list[Column] = field(default_factory=list)
    every: list[Column] = field(default_factory=list)
    nots: int | None = None
    shut: bool = False

    def take(self, operand: Column | None) -> None:
        if operand is None:
            self.shut = True
        else:
            self.every.append(~operand if (self.nots or 0) % 2 else operand)
        self.nots = None

    def next_row(self) -> None:
        if self.every:
            self.either.append(reduce(operator.and_, self.every))
        self.every, self.shut = [], False

    def value(self) -> Column | None:
        self.next_row()
        return reduce(operator.or_, self.either) if self.either else None


def _signed(word: str, term: Term) -> Column:
    return ~term(word[1:]) if word.startswith("-") and len(word) > 1 else term(word)


def compiled(text: str, term: Term) -> Column:
    """The nested grammar: `or` binds least, then terms side by side, then `not`.

    One pass over the words with a stack of open parentheses. Right after `not`, keywords
    and a closing parenthesis are terms. A closing parenthesis too many ends the expression,
    and so does an `or` that nothing stands before; inside parentheses these end the
    parenthesis. `not not` cancels out.
    """
    stack, words = [_Level()], tokens(text.strip(" \t\n\r\f\v"))

    def close() -> None:
        inner = stack.pop().value()
        stack[-1].take(inner)

    at = 0
    while at < len(words):
        level, word, low = stack[-1], words[at], words[at].lower()
        if level.nots is None:
            stray = low == "or" and not (level.either or level.every)
            if word == ")" or stray or level.shut and low != "or":
                if len(stack) == 1:
                    break
                close()
                at += word == ")"  # any other word is read again, one level up
                continue
            if low in ("or", "and"):
                if low == "or":
                    level.next_row()
                at += 1
                continue
        at += 1
        if low == "not":
            level.nots = (level.nots or 0) + 1
        elif word == "(":
            stack.append(_Level())
        else:
            level.take(_signed(word, term))
    while len(stack) > 1:
        close()
    found = stack[0].value()
    return F.lit(True) if found is None else found


def compiled_flat(text: str, term: Term) -> Column:
    """The flat grammar: groups between `or`s, without parentheses; `not not` still negates."""
    groups, negate = [[]], False
    for word in tokens(text.strip(" \t\n\r\f\v"), parentheses=False):
        low = word.lower()
        if low == "or":
            groups += [[]] if groups[-1] else []
        if low in ("or", "not"):
            negate = low == "not"
        elif low != "and":
            found = _signed(word, term)
            # One dash after a `not` is one negation, not two.
            groups[-1].append(~found if negate and not (word.startswith("-") and len(word) > 1) else found)
            negate = False
    found = [reduce(operator.and_, g) for g in groups if g]
    return reduce(operator.or_, found) if found else F.lit(True)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _compared(value: Column, text: str) -> Column | None:
    found = _NUMBER.fullmatch(text)
    return COMPARE[found[1]](value, int(found[2])) if found else None


def _split(word: str) -> tuple[str, str]:
    key, colon, value = word.partition(":")
    return (key.lower(), value) if colon else ("", word)


def captions(text: str, name: Column, tags: Column, path: Column | None = None) -> Column:
    """Filters of captioned items: tag:, r:, name:, path:, tags:>3, or text in name or tags."""
    return compiled(text, _caption_term(name, tags, name if path is None else path))


def _caption_term(name: Column, tags: Column, path: Column, texts: tuple[Column, ...] = (), plain_tags: Column | None = None) -> Term:
    """texts: what plain terms and regexes look at beside name and tags, the last one by both."""

    def term(word: str) -> Column:
        key, value = _split(word)
        if key == "tag":
            return _holds(tg.tag_is(tags, value))
        if key == "r":
            pattern = tg.java_regex(value)
            if pattern is not None:
                more = [t.rlike(pattern) for t in texts[-1:]]
                return reduce(operator.or_, map(_holds, [name.rlike(pattern), F.exists(tags, lambda t: t.rlike(pattern)), *more]))
        if key in ("name", "path"):
            return _holds(tg.name_is(name if key == "name" else path, value))
        count = _compared(F.greatest(F.size(tags), F.lit(0)), value) if key == "tags" else None
        if count is not None:
            return _holds(count)
        low = F.lit(word.lower())
        return reduce(operator.or_, map(_holds, [tg.text_matches(name, tags if plain_tags is None else plain_tags, word), *(F.contains(F.lower(t), low) for t in texts)]))

    return term


def generated(text: str, name: Column, tags: Column, metadata: Column, width: Column, height: Column, raw: Column, path: Column | None = None) -> Column:
    """Filters of generated items: beside those of captions 512x768 or size:, w:, h:, meta:
    and format:. Tags are the metadata's where there is one; format: with nothing behind it
    holds where there is none."""
    mine = F.when(metadata.isNotNull(), metadata["tags"]).otherwise(tags)
    base = _caption_term(name, mine, name if path is None else path, (metadata["positive"], metadata["negative"], raw), tags)

    def term(word: str) -> Column:
        key, value = _split(word)
        size = _SIZE.fullmatch(word) or (_SIZE.fullmatch(value) if key in ("size", "wxh") else None)
        if size:
            return _holds((width == int(size[1])) & (height == int(size[2])))
        side = {"w": width, "width": width, "h": height, "height": height}.get(key)
        found = _compared(side, value) if side is not None else None
        if found is not None:
            return _holds(found)
        if key == "meta":
            return _holds(metadata.isNotNull() & F.contains(F.lower(raw), F.lit(value.lower())))
        if key == "format":
            return F.when(metadata.isNull(), F.lit(value == "")).otherwise(_holds(metadata["format"] == value.lower()))
        return base(word)

    return compiled(text, term)


def duplicates(text: str, name: Column, tags: Column, marked: Column, original: Column, score: Column, path: Column | None = None) -> Column:
    """Filters of duplicates: beside those of captions marked:, original: and score:>=90."""
    base = _caption_term(name, tags, name if path is None else path)

    def term(word: str) -> Column:
        key, value = _split(word)
        if key in ("marked", "original") and value.lower() in FLAGS:
            return _holds((marked if key == "marked" else original) == FLAGS[value.lower()])
        found = _compared(F.bround(score * 100, 0), value) if key == "score" else None
        return base(word) if found is None else _holds(found)

    return compiled(text, term)


def labelled(text: str, name: Column, class_ids: Column, class_names: dict[int, str]) -> Column:
    """Filters of labelled items: class:, name:, labels:>1, or text in the name.

    class_ids: an array of each label's class; a class without a name is class_<id>. The
    classes are a small dimension, as a user names them by hand.
    """
    known = F.create_map(*(F.lit(x) for pair in class_names.items() for x in pair)) if class_names else None
    plain = lambda c: F.concat(F.lit("class_"), c.cast("string"))
    named = F.transform(class_ids, lambda c: plain(c) if known is None else F.coalesce(F.element_at(known, c.cast("int")), plain(c)))

    def term(word: str) -> Column:
        key, value = _split(word)
        if key == "class":
            hit = (lambda n: n.rlike(tg.glob(value))) if tg.has_wildcard(value) else (lambda n: F.lower(n) == value.lower())
            return _holds(F.exists(named, hit))
        if key == "name":
            return _holds(tg.name_is(name, value))
        found = _compared(F.greatest(F.size(class_ids), F.lit(0)), value) if key in ("label", "labels") else None
        return _holds(F.contains(F.lower(name), F.lit(word.lower()))) if found is None else _holds(found)

    return compiled_flat(text, term)


# --- building expressions ----------------------------------------------------------------


#: What a tag may not have to be written without quotes; a term in quotes has none of its own.
_QUOTED = frozenset(" ()'\"")


def tag_term(tag: str) -> str:
    """A tag as a term of an expression."""
    bare = tag.replace('"', "")
    return f"tag:{tag}" if _QUOTED.isdisjoint(tag) else f'tag:"{bare}"'


def narrowed(current: str, wanted: list[str]) -> str:
    """An expression that asks for the wanted tags as well, but for those that it has a term for.

    The expression is read into its terms, so that an `or` inside quotes, as a part of a
    term, is none, and a tag is found however it is quoted.
    """
    words = tokens(current)
    asked = {_split(w)[1] for w in words if _split(w)[0] == "tag"}
    terms = [tag_term(t) for t in wanted if t.replace('"', "") not in asked]
    before = current.strip()
    if terms and before:
        alternatives = any(w.lower() == "or" for w in words)
        terms.insert(0, f"({before})" if alternatives else before)
    return " and ".join(terms) if terms else before


def highlights(text: str, tag: Column) -> Column:
    """Whether a tag is hit by any of the expression's terms on tags, negated ones too."""
    hits, bare = [F.lit(False)], tg.strip(tag)
    for word in tokens(text.strip()):
        if word in ("(", ")") or word.lower() in ("or", "and", "not"):
            continue
        key, value = _split(word.removeprefix("-") if len(word) > 1 else word)
        if key == "tag" and value:
            hits.append(bare.rlike(tg.glob(value)) if tg.has_wildcard(value) else F.lower(bare) == value.lower())
        elif key == "r" and value and tg.java_regex(value) is not None:
            hits.append(bare.rlike(tg.java_regex(value)))
        elif not key and ":" not in word:
            hits.append(F.contains(F.lower(bare), F.lit(value.lower())))
    return reduce(operator.or_, map(_holds, hits))
