"""User regular expressions: from the JavaScript dialect to Java's, and captures by group number.

Java's group names refuse ``_``, its ``\\b`` and ``$`` see other boundaries, its ``\\s`` lacks the no-break spaces, its ``.``
refuses U+0085 and its ``(?i)`` folds ASCII alone. A pattern is rewritten once, on the driver; executors run plain Java patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\s\x0B   -     　﻿"
_WORD = "A-Za-z0-9_"
_ANY = r"[^\n\r\u2028\u2029]"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_EDGE = rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
#: Between the groups of one match. Texts that have it are matched group by group.
MARK = "\u0001"


class BadPattern(ValueError):
    """A pattern that can't be compiled, or that Java can't express."""


@dataclass(frozen=True)
class Pattern:
    java: str
    #: name -> (group of the value, group that is empty where the named one took no part; 0: it always does).
    groups: tuple[tuple[str, int, int], ...]
    count: int


@dataclass
class _Open:
    """An open parenthesis: its place in the output, what it is, and the optional parenthesis around it."""

    kind: str  # "named", "plain" (captures), "bare" ``(?:`` or "look"
    name: str = ""
    at: int = 0
    parent: _Open | None = None
    maybe: bool = False  # quantified so that it may be left out, or with alternatives
    capture: bool = False


def rewrite(source: str, ignore_case: bool = False, sentinels: bool = False) -> Pattern:
    """Translate a JavaScript pattern. With sentinels, a non-capturing parenthesis that may be left out and has a named
    group in it is made to capture: if it is empty, the named group took no part. (Java leaves no other trace of that in a
    replacement. A named group that is itself optional, or an alternative, took no part if it is empty.)"""
    out: list[str | _Open] = []
    i, in_class, stack, opens = 0, False, [], []
    root = _Open("bare")
    while i < len(source):
        c = source[i]
        if c == "\\":
            if i + 1 >= len(source):
                raise BadPattern("pattern ends with a backslash")
            d = source[i + 1]
            if d == "k" or d.isdigit() and d != "0":
                raise BadPattern("back references are not supported")
            if d == "s":
                out.append(_SPACES if in_class else f"[{_SPACES}]")
            elif d == "S":
                if in_class:
                    raise BadPattern(r"\S inside a class is not supported")
                out.append(f"[^{_SPACES}]")
            elif d in "bB" and not in_class:
                out.append(_EDGE if d == "b" else _NO_EDGE)
            else:
                out.append("/" if d == "/" else c + d)
            i += 2
            continue
        i += 1
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(_ANY)
        elif c == "|":
            top = stack[-1] if stack else root
            top.maybe = True
            out.append(c)
        elif c == "(":
            rest = source[i:]
            if m := re.match(r"\?<([A-Za-z_$][\w$]*)>", rest):
                item, i = _Open("named", m[1]), i + len(m[0])
            elif rest.startswith("?:"):
                item, i = _Open("bare"), i + 2
            elif rest.startswith("?"):
                item = _Open("look")
            else:
                item = _Open("plain")
            item.parent = stack[-1] if stack else None
            item.capture = item.kind in ("named", "plain")
            stack.append(item)
            opens.append(item)
            out.append(item)
        elif c == ")":
            if not stack:
                raise BadPattern("unmatched )")
            item = stack.pop()
            item.maybe |= bool(re.match(r"[?*]|\{0", source[i:]))
            out.append(c)
        else:
            out.append(c)
    if in_class or stack:
        raise BadPattern("unclosed parenthesis or character class")
    outer: dict[int, _Open | None] = {}
    for item in opens:
        if item.kind == "named":
            up = item.parent
            while up is not None and not (up.maybe and up.kind != "look"):
                up = up.parent
            if sentinels and up is not None and up.kind == "bare" and not item.maybe:
                up.capture = True
            outer[id(item)] = item if item.maybe or root.maybe else up
    number, numbers = 0, {}
    for item in opens:
        if item.capture:
            number += 1
            numbers[id(item)] = number
    body = "".join(x if isinstance(x, str) else "(" if x.capture else "(?:" if x.kind == "bare" else "(" for x in out)
    groups = []
    for item in opens:
        if item.kind == "named":
            up = outer[id(item)]
            mine = numbers[id(item)]
            # In an alternative that may be another's turn, only the group itself tells.
            alone = up is not None and (up is item or not up.capture or _has_alternatives(up, out))
            groups.append((item.name, mine, 0 if up is None else mine if alone else numbers[id(up)]))
    java = ("(?iu)" if ignore_case else "") + body
    try:
        re.compile(java.replace(r"\z", r"\Z").replace("(?iu)", "(?i)"))
    except re.error as e:
        raise BadPattern(f"{source}: {e}") from e
    return Pattern(java, tuple(groups), number)


def _has_alternatives(item: _Open, out: list[str | _Open]) -> bool:
    """Whether a parenthesis has a ``|`` of its own."""
    depth = 0
    for x in out[next(i for i, y in enumerate(out) if y is item) + 1 :]:
        if isinstance(x, _Open):
            depth += 1
        elif x == ")":
            if depth == 0:
                return False
            depth -= 1
        elif x == "|" and depth == 0:
            return True
    return False


def bind(c: Column, f) -> Column:
    """f of a column that is computed once, however often f names it: the variable of a one-element transform."""
    return F.transform(F.array(c), f)[0]


def match_groups(text: Column, java: str, count: int) -> Column:
    """The groups 1..count of the first match of a pattern as an array (a group that took no part is ``''``), null if
    there is no match. The pattern runs once, however many groups are used."""
    flags = re.match(r"\(\?[a-z]+\)", java)
    head = flags[0] if flags else ""
    whole = rf"{head}^[\s\S]*?(?:{java[len(head):]})[\s\S]*\z"
    marked = F.regexp_replace(text, F.lit(whole), F.lit(MARK + MARK.join(f"${i}" for i in range(1, count + 1)) + MARK))
    at_once = bind(marked, lambda m: F.when(m.startswith(MARK), F.slice(F.split(m, MARK), 2, count)))
    each = F.when(text.rlike(java), F.array(*[F.regexp_extract(text, java, i) for i in range(1, count + 1)]))
    return F.when(text.contains(MARK), each).otherwise(at_once)
