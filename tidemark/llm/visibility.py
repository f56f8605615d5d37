"""Which elements of a page are shown: style sheets, the cascade and inheritance, for the few properties that matter.

A style sheet is read with its comments, nested at-rules (media for a screen of SCREEN pixels, supports and layers
apply, others are skipped) and selectors of compounds (tag, *, #id, .class, [attribute]) joined by white space, >, +
and ~. A selector with a pseudo-class matches nothing, so it never hides. Of the declarations of a property that
reach an element, important ones win, then inline ones, then the more specific, then the later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Width in pixels that media queries are asked for.
SCREEN = 1280
PROPERTIES = frozenset(("display", "visibility", "content-visibility", "white-space"))

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_FEATURE = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*([\d.]+)\s*(px|r?em)\s*\)")
_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<q1>[^\"]*)\"|'(?P<q2>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def media_matches(query: str) -> bool:
    """Whether a list of media queries holds on a screen; unknown features do not."""
    return not query.strip() or any(map(_one_matches, query.lower().split(",")))


def _one_matches(query: str) -> bool:
    words = query.split()
    negated = words[:1] == ["not"]
    if negated or words[:1] == ["only"]:
        words = words[1:]
    rest = " ".join(words)
    ok = True
    for part in rest.split(" and "):
        part = part.strip()
        if part.startswith("("):
            if m := _FEATURE.fullmatch(part):
                pixels = float(m[2]) * (1 if m[3] == "px" else 16)
                ok &= pixels <= SCREEN if m[1] == "min" else SCREEN <= pixels
            else:
                ok &= part in ("(orientation:landscape)", "(orientation: landscape)", "(color)", "(hover)", "(hover: hover)")
        else:
            ok &= part in ("all", "screen")
    return ok != negated


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet that apply on a screen, in order."""
    css = _COMMENT.sub(" ", css).replace("<!--", " ").replace("-->", " ")
    # (start, stop) of what is still to be read, the next on top
    stack = [(0, len(css))]
    while stack:
        at, end = stack.pop()
        while at < end:
            brace, semicolon = css.find("{", at, end), css.find(";", at, end)
            head = css[at : brace if brace >= 0 else end].strip()
            if head.startswith("@") and 0 <= semicolon and (brace < 0 or semicolon < brace):
                at = semicolon + 1  # @import and the like
                continue
            if brace < 0:
                break
            close = _closing(css, brace, end)
            if not head.startswith("@"):
                yield head, css[brace + 1 : close]
                at = close + 1
                continue
            name, _, query = head[1:].partition(" ") if " " in head else (head[1:].split("(")[0], "", head[head.find("(") :])
            name = name.lower()
            at = close + 1
            if name == "media" and media_matches(query) or name in ("supports", "layer"):
                stack.append((at, end))
                at, end = brace + 1, close


def _closing(css: str, brace: int, end: int) -> int:
    """Where the block that opens at brace ends."""
    depth = 0
    for m in _BRACES.finditer(css, brace, end):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return end


_BRACES = re.compile(r"[{}]")


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """{property: (value, important)} of the properties that matter; the last one counts, important ones first."""
    out: dict[str, tuple[str, bool]] = {}
    for part in _COMMENT.sub(" ", text).split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in PROPERTIES:
            value = value.strip().lower()
            important = bool(re.search(r"!\s*important\Z", value))
            value = re.sub(r"\s*!\s*important\Z", "", value)
            if important or not out.get(name, ("", False))[1]:
                out[name] = value, important
    return out


def compound(text: str) -> list[tuple[str, str, str, str]] | None:
    """The simple selectors (kind, name, operator, value) of a compound; None if one is not known."""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m["tag"] and at:
            return None
        if m["tag"]:
            out.append(("tag", m["tag"].lower(), "", ""))
        elif m["id"]:
            out.append(("id", m["id"], "", ""))
        elif m["cls"]:
            out.append(("class", m["cls"], "", ""))
        else:
            out.append(("attr", m["attr"].lower(), m["op"] or "", m["q1"] or m["q2"] or m["bare"] or ""))
        at = m.end()
    return out or None


def selector(text: str) -> list[tuple[str, list]] | None:
    """A selector from its right end: (combinator to the left, compound); None if it is not known."""
    parts, at, text = [], 0, text.strip()
    # white space inside brackets does not part compounds
    for m in _COMBINATOR.finditer(text):
        if text.count("[", at, m.start()) > text.count("]", at, m.start()):
            continue
        parts.append((text[at : m.start()], m[1] or " "))
        at = m.end()
    parts.append((text[at:], ""))
    out, before = [], ""
    for body, after in parts:
        if (c := compound(body)) is None:
            return None
        out.append((before, c))
        before = after
    return out[::-1]


def fits(node, simple: list[tuple[str, str, str, str]]) -> bool:
    for kind, name, op, value in simple:
        if kind == "tag":
            if name not in ("*", node.tag):
                return False
        elif kind == "id":
            if node.attrs.get("id") != name:
                return False
        elif kind == "class":
            if name not in node.attrs.get("class", "").split():
                return False
        else:
            have = node.attrs.get(name)
            if have is None or not (
                not op
                or op == "=" and have == value
                or op == "~=" and value in have.split()
                or op == "|=" and (have == value or have.startswith(value + "-"))
                or bool(value) and (op == "^=" and have.startswith(value) or op == "$=" and have.endswith(value) or op == "*=" and value in have)
            ):
                return False
    return True


def matches(node, parts: list[tuple[str, list]], k: int = 0) -> bool:
    """Whether a selector, from its k-th part leftwards, matches a node with parent and elder (sibling before)."""
    if node is None or not fits(node, parts[k][1]):
        return False
    if k + 1 == len(parts):
        return True
    how = parts[k][0]
    if how == ">":
        return matches(node.parent, parts, k + 1)
    if how == "+":
        return matches(node.elder, parts, k + 1)
    step = (lambda x: x.parent) if how == " " else (lambda x: x.elder)
    other = step(node)
    while other is not None:
        if matches(other, parts, k + 1):
            return True
        other = step(other)
    return False


class Cascade:
    """The style sheets of a page, by what the right end of a selector asks for."""

    def __init__(self, sheets: list[str]):
        self.by: dict[tuple[str, str], list[tuple]] = {}
        order = 0
        for css in sheets:
            for selectors, body in rules(css):
                if not (said := declarations(body)):
                    continue
                for text in _split(selectors):
                    if parts := selector(text):
                        order += 1
                        simple = [x for _, c in parts for x in c]
                        weight = (sum(x[0] == "id" for x in simple), sum(x[0] in ("class", "attr") for x in simple), sum(x[0] == "tag" and x[1] != "*" for x in simple))
                        key = max(((x[0], x[1]) for x in parts[0][1] if x[0] in ("id", "class", "tag") and x[1] != "*"), key=lambda x: ("tag", "class", "id").index(x[0]), default=("", ""))
                        self.by.setdefault(key, []).append((weight, order, parts, said))

    def style(self, node) -> dict[str, str]:
        """The values that author style gives a node."""
        inline = declarations(node.attrs["style"]) if "style" in node.attrs else {}
        if not self.by:
            return {p: v for p, (v, _) in inline.items()}
        best: dict[str, tuple] = {p: ((important, (1 << 30, 0, 0), 0), v) for p, (v, important) in inline.items()}
        keys = [("", ""), ("tag", node.tag)]
        if node.attrs:
            keys += [("class", c) for c in set(node.attrs.get("class", "").split())] + [("id", node.attrs.get("id", ""))]
        for key in keys:
            for weight, order, parts, said in self.by.get(key, ()):
                if matches(node, parts):
                    for p, (v, important) in said.items():
                        rank = (important, weight, order)
                        if p not in best or rank > best[p][0]:
                            best[p] = rank, v
        return {p: v for p, (_, v) in best.items()}


def _split(selectors: str) -> list[str]:
    """Selectors of a list, by commas outside brackets and parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(selectors):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth <= 0:
            out.append(selectors[at:i])
            at = i + 1
    return [*out, selectors[at:]]
