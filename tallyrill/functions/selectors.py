"""CSS selectors compiled to tests of element nodes, matched from right to left.

Steps: ``tag``, ``*``, ``.class``, ``#id``, ``[name]``, ``[name=value]`` with ``= ~= |= ^= $= *=`` (quoted or not),
``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child(an+b)``, ``:nth-last-child(an+b)`` and ``:not(step)``.  Steps are
joined by descent (a space), child (``>``), next sibling (``+``) and later sibling (``~``); commas are alternatives.

A node has ``tag``, ``attrs``, ``parent`` and ``children``, of which those that are texts are no elements.  What a node answers to a
step is kept with the node, so a page costs at most its nodes times the steps, times the depth for descent.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import NamedTuple

Test = Callable[[object], bool]

_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_PART = re.compile(
    rf"(?P<tag>{_NAME}|\*)|\.(?P<cls>{_NAME})|#(?P<id>{_NAME})"
    rf"|\[\s*(?P<name>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<q1>[^\"]*)\"|'(?P<q2>[^']*)'|(?P<bare>{_NAME}))\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child|only-child|nth-child|nth-last-child|not)(?P<paren>\()?",
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?)\s*", re.I)


class Step(NamedTuple):
    relation: str  # to the step before: " ", ">", "+" or "~"; "" for the first
    test: Test


def elements(node) -> list:
    """The element children of a node."""
    found = node.__dict__.get("elements")
    if found is None or len(found[0]) != len(node.children):
        found = node.__dict__["elements"] = (tuple(node.children), [c for c in node.children if not isinstance(c, str)])
        for i, c in enumerate(found[1]):
            c.place = i
    return found[1]


def _place(node) -> tuple[int, int]:
    """A node's place among its parent's elements, from either end, from 1."""
    among = elements(node.parent) if node.parent is not None else [node]
    at = node.place if node.parent is not None else 0
    return at + 1, len(among) - at


def _nth(text: str) -> Callable[[int], bool]:
    m = _NTH.fullmatch(text)
    if not m or not text.strip():
        raise ValueError(f"nth-child({text}) is not supported")
    if m["word"]:
        a, b = 2, 1 if m["word"].lower() == "odd" else 0
    else:
        a = 0 if m["a"] is None else int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
        b = int((m["b"] or "0").replace(" ", ""))
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _attribute(name: str, op: str | None, value: str) -> Test:
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: bool(value) and value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
    }
    fits, key = tests[op], name.lower()
    return lambda n: key in n.attrs and fits(n.attrs[key])


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _closing(text: str, at: int) -> int:
    depth, quote = 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    raise ValueError(f"selector {text!r} has an open bracket")


def _compound(text: str, at: int) -> tuple[Test, int]:
    """The test of one step and where it ends."""
    tests: list[Test] = []
    start = at
    while m := _PART.match(text, at):
        if m["tag"]:
            if at != start:
                break
            tests.append((lambda n: True) if m["tag"] == "*" else functools.partial(lambda tag, n: n.tag == tag, _plain(m["tag"]).lower()))
        elif m["cls"]:
            tests.append(functools.partial(lambda name, n: name in n.attrs.get("class", "").split(), _plain(m["cls"])))
        elif m["id"]:
            tests.append(functools.partial(lambda name, n: n.attrs.get("id") == name, _plain(m["id"])))
        elif m["name"]:
            tests.append(_attribute(_plain(m["name"]), m["op"], next((v for v in (m["q1"], m["q2"], m["bare"]) if v is not None), "")))
        elif m["pseudo"] == "not":
            end = _closing(text, m.end()) if m["paren"] else -1
            inner = text[m.end() : end].strip()
            test, stop = _compound(inner, 0)
            if stop != len(inner):
                raise ValueError(f"selector {text!r} is not supported")
            tests.append(functools.partial(lambda t, n: not t(n), test))
            at = end + 1
            continue
        elif m["pseudo"].startswith("nth"):
            end = _closing(text, m.end()) if m["paren"] else -1
            tests.append(functools.partial(lambda fits, k, n: fits(_place(n)[k]), _nth(text[m.end() : end]), int(m["pseudo"] == "nth-last-child")))
            at = end + 1
            continue
        else:
            tests.append(functools.partial(lambda ends, n: all(_place(n)[k] == 1 for k in ends), {"first-child": (0,), "last-child": (1,), "only-child": (0, 1)}[m["pseudo"]]))
        at = m.end()
    if at == start:
        raise ValueError(f"selector {text!r} is not supported")
    return lambda n: all(t(n) for t in tests), at


def _steps(text: str, at: int) -> tuple[list[Step], int]:
    """One alternative, and the place of the comma or the end after it."""
    steps: list[Step] = []
    relation = ""
    while True:
        test, at = _compound(text, at)
        steps.append(Step(relation, test))
        m = re.compile(r"\s*([>+~])\s*|\s+(?=[^\s,])").match(text, at)
        if not m:
            return steps, at
        relation, at = m[1] or " ", m.end()


@functools.lru_cache(maxsize=256)
def compiled(selector: str) -> Test:
    """A test of nodes; ``ValueError`` where the selector is not understood."""
    text, at, ways = selector.strip(), 0, []
    while True:
        steps, at = _steps(text, at)
        ways.append(steps)
        m = re.compile(r"\s*,\s*").match(text, at)
        if at == len(text):
            break
        if not m:
            raise ValueError(f"selector {selector!r} is not supported")
        at = m.end()

    def holds(node, way: int, i: int) -> bool:
        kept = node.__dict__.setdefault("answers", {})
        key = (selector, way, i)
        if key not in kept:
            kept[key] = ways[way][i].test(node) and (i == 0 or any(holds(n, way, i - 1) for n in before(node, ways[way][i].relation)))
        return kept[key]

    def before(node, relation: str):
        """Nodes that the step before may be, the nearest first."""
        up = node.parent
        if relation in "> ":
            while up is not None and up.parent is not None:  # the root is no element
                yield up
                up = None if relation == ">" else up.parent
        elif up is not None:
            among = elements(up)
            yield from (among[i] for i in range(node.place - 1, -1 if relation == "~" else max(-1, node.place - 2), -1))

    return lambda node: any(holds(node, w, len(steps) - 1) for w, steps in enumerate(ways))
