"""HTML extraction by layout-aware rendering.

A scanner that only goes forward gives tags and text; the tree builder adds what HTML lets authors omit (a block closes an open
paragraph, an item the one before it, a cell its neighbour, an end tag all it encloses; the first content ends the head; void elements
have no content). An unfinished tag at the end of a page is dropped, as browsers do, and elements deeper than ``DEEPEST`` stand beside
one another instead of within.

Visibility: no element of the head, no scripts, styles, templates or form controls' hidden values, no content that stands in for an
object, frame, canvas, sound or film, no definitions and descriptions of drawings and formulas, nothing under ``aria-hidden=true`` or
``hidden``, nor under what ``display:none`` applies to; text is left out where the inherited ``visibility`` is hidden, and comes back where
it is set to visible below. Inline styles and the page's style sheets count, the latter in order of importance, specificity and place,
for selectors of tags, classes, ids and attributes, also joined, below one another (blank, ``>``) or in lists; selectors with
pseudo-classes or other combinators, and rules for other media or for some screens only, hide nothing. A string that a style sheet does
not finish ends with its line. What inputs show as their value is text; it and the text of images stand apart from their neighbours.

All other text is emitted: blocks on lines of their own, paragraphs and headings set off by an empty line, list items with
marks and indents, preformatted text as it stands. Table cells stand in columns: cells up to ``WIDE`` characters are padded to the longest of
those in their column, longer ones are not cut and pad nothing, and a cell over several columns or rows keeps the others in theirs as
long as that takes at most ``WIDEST`` blanks. Indents stop growing at ``WIDE``. So a rendering is at most a few times as long as its page.

Null and empty html give an empty text. Very long pages are rendered whole, one at a time. Repeated page_ids each give a row; an empty
table gives none. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import plain

#: A tag from its name on; quotes count behind an equals sign only. Atomic, so nothing is looked at twice.
_TAG = re.compile(r"([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>")
DEEPEST, WIDE, WIDEST = 512, 48, 96
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_CSS_SKIP = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
#: A string ends at its quote or, unfinished, with the line; either way the next one starts behind it.
_CSS_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?", re.S)
_DECLARED = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*\Z", re.I)
_PART = re.compile(r"([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|(\*)")

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul xmp".split())
#: What may stand in the head; anything else ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
#: Parts of drawings (svg) and formulas (math) that are not drawn.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
#: An opening tag closes these open elements, looked for up to the scope's elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: Types of inputs that do not show their value as text.
VALUELESS = frozenset("hidden checkbox radio file image password color range".split())
SCOPE = frozenset("table td th caption html template button object".split())
#: How far the end tag of a table or of a part of one reaches.
PARTS = {"table": frozenset({"template"})} | dict.fromkeys("tr td th thead tbody tfoot caption".split(), frozenset({"table", "template"}))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(self.attrs):
            out.setdefault(k.lower(), unescape(a or b or c))
        return out


def build(html: str) -> tuple[Node, list[str]]:
    """(tree, style sheets)."""
    root = Node("html")
    stack, sheets, at, n = [root], [], 0, len(html)
    count: Counter[str] = Counter()  # open elements by tag

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
                end_head()
            stack[-1].kids.append(unescape(s) if "&" in s else s)

    def end_head() -> None:
        if stack[-1].tag == "head":
            count[stack.pop().tag] -= 1

    def close(tags, scope) -> bool:
        if any(count[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    count.subtract(x.tag for x in stack[i:])
                    del stack[i:]
                    return True
                if stack[i].tag in scope:
                    break
        return False

    while at < n:
        i = html.find("<", at)
        if i < 0:
            text(html[at:])
            break
        ends = html.startswith("/", i + 1)
        c = html[i + 1 + ends : i + 2 + ends]
        if not c.isascii() or not c.isalpha():
            if ends and c or c and c in "!?":  # a comment, or what counts as one
                text(html[at:i])
                z = html.find("-->", i + 4) + 2 if html.startswith("<!--", i) and not html.startswith("<!-->", i) else html.find(">", i + 2)
                at = z + 1 if z > 1 else n
            else:
                text(html[at : i + 1])
                at = i + 1
            continue
        text(html[at:i])
        m = _TAG.match(html, i + 1 + ends)
        if m is None:
            break
        at = m.end()
        tag = m[1].lower()
        attrs = m[2]
        if ends:
            if tag == "p" and not count["p"]:
                stack[-1].kids.append(Node("p"))
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag not in ("html", "body"):
                close({tag}, PARTS.get(tag, SCOPE) - {tag})
            continue
        if tag in ("html", "body"):
            if tag == "body":
                end_head()
            if attrs.strip():
                root.attrs += " " + attrs
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            tags, scope = IMPLIED[tag]
            while close(tags, scope):
                pass
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit():
            count[stack.pop().tag] -= 1
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        foreign = count["svg"] > 0 or count["math"] > 0
        if foreign and tag in UNDRAWN:
            node.attrs += " hidden"
        if attrs.endswith("/") and (foreign or tag in ("svg", "math", "path", "g", "use")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            body = html[at : end.start() if end else n]
            if tag == "style" and for_screen(node.get().get("media", "")):
                sheets.append(body)
            elif tag == "xmp":
                node.kids.append(body)
            elif tag == "textarea":
                node.kids.append(unescape(body))
            at = html.find(">", end.start()) + 1 or n if end else n
        elif tag not in VOID:
            if len(stack) >= DEEPEST:
                stack[-2].kids.append(stack[-1].kids.pop())
                count[stack.pop().tag] -= 1
            stack.append(node)
            count[tag] += 1
    return root, sheets


def for_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen; features (widths, colours) hold on some screens only."""
    for q in media.lower().split(","):
        w = q.split()
        if not w and not media.strip() or w in (["all"], ["screen"], ["only", "screen"], ["only", "all"]):
            return True
        if len(w) > 1 and w[0] == "not" and w[1] not in ("all", "screen") and re.fullmatch(r"[\w-]+", w[1]):
            return True
    return False


def applies(rule: str) -> bool:
    """Whether the rules in the block of an at-rule count for every screen."""
    name = re.match(r"@[\w-]*", rule)[0]
    rest = rule[len(name) :]
    return name == "@layer" or name == "@media" and for_screen(rest) or name == "@supports" and not rest.lstrip().startswith("not")


class Rule:
    """What a selector says about display or visibility. ``steps``: from the element upwards, (parts, whether directly above)."""

    __slots__ = ("steps", "value", "rank")

    def __init__(self, steps, value, rank):
        self.steps, self.value, self.rank = steps, value, rank


def key_of(parts) -> tuple[str, str]:
    """The part of a compound selector that fits the fewest elements: an id, a class, an attribute, a tag."""
    k, name, _ = max(parts, key=lambda part: "*_[.#".find(part[0] or "_"))
    return k, name


def keys_of(tag: str, a: dict[str, str], classes) -> list[tuple[str, str]]:
    """All that ``key_of`` may give for a selector that fits the element."""
    return [("", tag), ("*", ""), *((".", c) for c in classes), *(("[", n) for n in a)] + ([("#", a["id"])] if "id" in a else [])


class Rules:
    """The rules of a page: property -> key of what they apply to -> key of what that must stand in (None: anything) -> best first.

    An element looks only at rules whose two keys are its own and one of an open element's, and stops at the first that holds.
    Elements that no selector can tell apart, with their ancestors, are judged once.
    """

    def __init__(self, best: dict):
        self.found: dict[str, dict] = {}
        self.outer: set = set()
        self.values: dict[str, set] = {}
        self.parts: set = set()
        for (steps, name), (rank, value) in best.items():
            own, outer = key_of(steps[0][0]), key_of(steps[1][0]) if len(steps) > 1 else None
            outer = None if outer == ("*", "") else outer
            self.outer.add(outer)
            self.found.setdefault(name, {}).setdefault(own, {}).setdefault(outer, []).append(Rule(steps, value, rank))
            for parts, _ in steps:
                for k, n, v in parts:
                    self.parts.add((k, n))
                    if k == "[":
                        self.values.setdefault(n, set()).add(v)
        for groups in self.found.values():
            for by_outer in groups.values():
                for some in by_outer.values():
                    some.sort(key=lambda r: r.rank, reverse=True)
        self.paths: dict[tuple, int] = {}
        self.said: list[dict[str, tuple]] = []

    def __bool__(self) -> bool:
        return bool(self.found)

    def path(self, upper: int, tag: str, a: dict[str, str], classes, keys: list) -> tuple[int, bool]:
        """(number of what selectors can see of an element and its ancestors, whether it is new)."""
        seen = (upper, frozenset((*k, a[k[1]] if k[0] == "[" and a[k[1]] in self.values[k[1]] else None) for k in keys if k in self.parts))
        new = seen not in self.paths
        return self.paths.setdefault(seen, len(self.paths)), new

    def judge(self, above: list, keys: list, opened: Counter) -> dict[str, tuple]:
        """property -> (rank, value) that wins for the last of ``above``; ``opened``: keys of the elements above it."""
        out: dict[str, tuple] = {}
        for name, groups in self.found.items():
            for key in keys:
                by_outer = groups.get(key, {})
                for outer in [None, *opened] if len(opened) < len(by_outer) else by_outer:
                    if outer is None or opened[outer]:
                        for r in by_outer.get(outer, ()):
                            if name in out and r.rank < out[name][0]:
                                break
                            if holds(r, above):
                                out[name] = (r.rank, r.value)
                                break
        return out


def compound(text: str) -> list[tuple[str, str, str | None]] | None:
    """Parts (kind, name, value) of a compound selector, or None if there are others."""
    out, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m[2] and not m[1] and at:
            return None
        out.append(("*", "", None) if m[5] else ("[", m[3].lower(), m[4]) if m[3] else (m[1], m[2] if m[1] else m[2].lower(), None))
        at = m.end()
    return out or None


def selector(text: str) -> tuple | None:
    steps, direct = [], False
    for word in text.replace(">", " > ").split():
        if word == ">":
            if not steps or direct:
                return None
            direct = True
        elif (parts := compound(word)) is None:
            return None
        else:
            steps.append((parts, direct))
            direct = False
    if direct or not steps:
        return None
    return tuple((tuple(parts), direct) for parts, direct in reversed(steps))


def style_rules(sheets: list[str]) -> Rules:
    best: dict[tuple, tuple] = {}  # (steps, property) -> (rank, value)
    place = 0
    for s in sheets:
        s = _BLANKS.sub(" ", _CSS_STRING.sub(lambda m: m[0] if len(m[0]) < 40 and not re.search("[{};]", m[0]) else '""', _CSS_SKIP.sub(" ", s)))
        # open blocks: (selectors, declarations by property) of a rule, True of an at-rule that counts, False of all others
        stack: list = []
        at = other = 0  # other: open blocks that are no at-rules that count
        for m in re.finditer(r"[{};]", s + "}" * s.count("{")):
            before, at = s[at : m.start()].strip(), m.end()
            if m[0] == "{":
                stack.append((applies(before.lower()) if before[:1] == "@" else (before, {})) if not other else False)
                other += stack[-1] is not True
                continue
            if stack and isinstance(stack[-1], tuple) and (x := _DECLARED.match(before)):
                last = stack[-1][1].get(x[1].lower())
                if not last or x[3] or not last[0]:  # of a rule's declarations of a property one counts
                    stack[-1][1][x[1].lower()] = (bool(x[3]), x[2].lower())
            if m[0] == "}" and stack:
                top = stack.pop()
                other -= top is not True
                if isinstance(top, tuple) and top[1]:
                    for y in top[0].split(","):
                        if steps := selector(y.strip()):
                            place += 1
                            kinds = Counter(k for parts, _ in steps for k, _, _ in parts)
                            steps = tuple((tuple(dict.fromkeys(parts)), direct) for parts, direct in steps)
                            for name, (important, value) in top[1].items():
                                rank = (important, 0, kinds["#"], kinds["."] + kinds["["], kinds[""], place)
                                if (steps, name) not in best or rank > best[steps, name][0]:
                                    best[steps, name] = (rank, value)
    return Rules(best)


def fits(parts, tag: str, a: dict[str, str], classes) -> bool:
    for k, name, value in parts:
        if k == "" and name != tag or k == "." and name not in classes or k == "#" and name != a.get("id"):
            return False
        if k == "[" and (name not in a or value is not None and a[name] != value):
            return False
    return True


def holds(rule: Rule, above: list) -> bool:
    """Whether the rule fits the last of ``above``, elements from the root on as (tag, attributes, classes)."""
    if len(rule.steps) > len(above) or not fits(rule.steps[0][0], *above[-1]):
        return False
    # of ancestors that fit, the lowest is tried first; a step that must be directly above goes back to the next choice
    todo = [(1, len(above) - 2, rule.steps[0][1])]
    tried = set()
    while todo:
        step, i, direct = todo.pop()
        if step == len(rule.steps):
            return True
        while i >= 0 and (step, i, direct) not in tried:
            tried.add((step, i, direct))
            parts, up = rule.steps[step]
            if fits(parts, *above[i]):
                todo += [(step, i - 1, False)] if not direct else []
                todo.append((step + 1, i - 1, up))
                break
            if direct:
                break
            i -= 1
    return False


def declared(a: dict[str, str], said: dict[str, tuple]) -> tuple[str | None, str | None]:
    """(display, visibility) that win for an element, of what the style sheets say and its own style."""
    best = dict(said)
    if "style" in a:
        for k, d in enumerate(_CSS_SKIP.sub(" ", a["style"]).split(";")):
            if x := _DECLARED.match(d.strip()):
                rank = (bool(x[3]), 1, 0, 0, 0, k)
                if x[1].lower() not in best or rank > best[x[1].lower()][0]:
                    best[x[1].lower()] = (rank, x[2].lower())
    return best.get("display", (0, None))[1], best.get("visibility", (0, None))[1]


def prune(root: Node, rules: Rules) -> None:
    """Take out of the tree what is not seen."""
    above: list = []
    paths: list[tuple[int, list]] = [(-1, [])]  # (number of the path, keys that rules ask ancestors for)
    opened: Counter = Counter()
    todo: list = [(root, True)]
    while todo:
        node, seen = todo.pop()
        if node is None:
            above.pop()
            if rules:
                for k in paths.pop()[1]:
                    opened[k] -= 1
                    if not opened[k]:
                        del opened[k]
            continue
        a = node.get() if node.attrs else {}
        above.append((node.tag, a, frozenset(a.get("class", "").split())))
        todo.append((None, True))
        said: dict[str, tuple] = {}
        if rules:
            keys = keys_of(*above[-1])
            number, new = rules.path(paths[-1][0], *above[-1], keys)
            if new:
                rules.said.append(rules.judge(above, keys, opened))
            said = rules.said[number]
            asked = [k for k in keys if k in rules.outer]
            paths.append((number, asked))
            opened.update(asked)
        display, visibility = declared(a, said) if said or "style" in a else (None, None)
        if display == "none" or "hidden" in a and display is None or a.get("aria-hidden", "").lower() == "true" or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag in UNSEEN:
            node.kids = []
            node.tag = "#gone"
            continue
        if visibility is not None:
            seen = visibility not in ("hidden", "collapse") and (visibility != "inherit" or seen)
        if not seen:
            node.kids = [k for k in node.kids if isinstance(k, Node)]
            if node.tag in ("img", "input", "hr"):
                node.tag = "#gone"
        todo += [(k, seen) for k in reversed(node.kids) if isinstance(k, Node)]


class Page:
    """Lines under construction: collapses blanks, keeps at most one empty line between blocks."""

    def __init__(self):
        self.lines, self.line, self.gap, self.mark, self.indent = [], [], False, "", ""

    def word(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(True)
                self.line.append(x)
            return
        s = _BLANKS.sub(" ", s)
        if s == " " and not self.line:
            return
        if self.line and self.line[-1].endswith(" ") and s.startswith(" "):
            s = s[1:]
        if not self.line:
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def end(self, pre: bool = False) -> None:
        s = "".join(self.line)
        s = s.rstrip(" \t") if not pre else s
        self.line = []
        if s or pre:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.indent + self.mark + s if s else "")
            if self.mark:
                self.deeper(len(self.mark))
                self.mark = ""

    def deeper(self, n: int) -> None:
        if len(self.indent) < WIDE:
            self.indent += " " * n

    def space(self) -> None:
        self.end()
        self.gap = True

    def whole(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def span(cell: Node, name: str) -> int:
    got = cell.get().get(name, "1") if cell.attrs else "1"
    return min(max(int(got), 1), 1000) if got.isascii() and got.isdigit() and len(got) < 9 else 1


def table_lines(node: Node) -> list[str]:
    rows, caption, todo = [], [], [node]
    while todo:
        x = todo.pop()
        for k in reversed(x.kids):
            if isinstance(k, Node) and k.tag in ("thead", "tbody", "tfoot", "tr", "caption", "colgroup"):
                todo.append(k)
        if x.tag == "caption":
            caption += render(x).split("\n")
        elif x is node or x.tag in ("thead", "tbody", "tfoot", "tr"):
            cells = [k for k in x.kids if isinstance(k, Node) and k.tag in ("td", "th")]
            loose = [k for k in x.kids if (k.strip() if isinstance(k, str) else k.tag not in ("thead", "tbody", "tfoot", "tr", "caption", "colgroup", "col", "td", "th", "#gone"))]
            if loose:  # text where a table has no place for it comes before
                other = Node("div")
                other.kids = loose
                caption += [y for y in render(other).split("\n") if y]
            if cells:
                rows.append([(render(c).split("\n"), span(c, "colspan"), span(c, "rowspan")) for c in cells])
    # columns: cells over several rows keep their columns in the rows below
    width: dict[int, int] = {}
    down: list[tuple[int, int, int]] = []  # (first column, behind the last, rows to come)
    placed = []
    for r in rows:
        at, out, ahead = 0, [], sorted(down)
        down = [(a, z, n - 1) for a, z, n in down if n > 1]
        for text, wide, high in r:
            while ahead and ahead[0][0] <= at:
                at = max(at, ahead.pop(0)[1])
            out.append((at, at + wide, text))
            if wide == 1:
                width[at] = max([width.get(at, 0), *(len(y) for y in text if len(y) <= WIDE)])
            if high > 1 and len(down) < WIDEST:
                down.append((at, at + wide, high - 1))
            at += wide
        placed.append(out)
    columns = sorted(width)
    starts = [0]
    for c in columns:
        starts.append(starts[-1] + width[c] + 2)

    def room(a: int, z: int) -> int:
        """Characters from the start of column a to that of column z."""
        n = starts[bisect_left(columns, z)] - starts[bisect_left(columns, a)]
        return n if n <= WIDEST else 2 * (n > 0)

    out = caption
    for r in placed:
        for k in range(max(len(text) for _, _, text in r)):
            line, at = [], 0
            for a, z, text in r:
                own = text[k] if k < len(text) else ""
                line.append(" " * room(at, a))
                line.append(own + " " * max(room(a, z) - len(own), 2))
                at = z
            out.append("".join(line).rstrip())
    return out


def render(root: Node) -> str:
    page = Page()
    # entries: text, or (node, None) on the way in, or (None, what to do on the way out)
    todo: list = [*reversed(root.kids)]
    pre, lists = 0, []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            page.word(x, pre > 0)
            continue
        if callable(x):
            x()
            continue
        tag = x.tag
        if tag == "#gone":
            continue
        if tag == "br":
            page.end(True)
            continue
        if tag == "hr":
            page.space()
            continue
        if tag == "img":
            alt = x.get().get("alt", "")
            if alt.strip():
                page.word(f" {alt} ", False)
            continue
        if tag == "input":
            a = x.get()
            if a.get("type", "text").lower() not in VALUELESS and a.get("value"):
                page.word(f" {a['value']} ", False)
            continue
        if tag == "table":
            page.space()
            for line in table_lines(x):
                page.line = [line]
                page.end(True)
            page.space()
            continue
        if tag not in BLOCK:
            todo += [" ", *reversed(x.kids), " "] if tag == "text" else reversed(x.kids)  # labels of a drawing stand apart
            continue
        page.space() if tag in SPACED and not (tag in ("ul", "ol") and lists) else page.end()
        before = page.indent

        def leave(tag=tag, before=before):
            nonlocal pre
            page.space() if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1) else page.end()
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            pre -= tag in ("pre", "xmp")
            page.indent, page.mark = before, ""

        if tag in ("ul", "ol", "menu", "dir"):
            first = x.get().get("start", "1") if tag == "ol" else "1"
            lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
        elif tag == "li":
            if lists and lists[-1][0] == "ol":
                page.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.mark = "- "
        elif tag in ("dd", "blockquote"):
            page.deeper(2)
        pre += tag in ("pre", "xmp")
        todo.append(leave)
        todo += reversed(x.kids)
    return page.whole()


def extract(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = build(html)
    prune(root, style_rules(sheets))
    return render(root)


def html_render(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars of every row of ``pages`` (page_id, html)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                out = [extract(x) for x in c.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column("page_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "text", "n_chars"])

    return plain(pages, "page_id", "html").mapInArrow(rows, "page_id long, text string, n_chars long")
