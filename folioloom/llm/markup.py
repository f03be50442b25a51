"""Problem 4: markup residue in block contents.

Every content is parsed into marked-up spans and, where it holds elements, into an element tree.
The hashes of the element subtrees (tag, attributes, text with digits masked) are counted per site
in Spark; subtrees that recur in many filings of a site are that site's template and are deleted.
What is left is converted to clean text that keeps structure: headings start with ``# ``, list
items with ``- ``, quotes with ``> ``; table cells are separated by tabs, one row a line; code is
indented by four spaces; formulas stay as TeX between dollar signs.

Defined results: a null content stays null and has no markup; an empty content stays empty;
repeated rows each give their result; a null source or document_id counts for no site.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sources.durable import written

#: Filings of a site in which a subtree must recur to count as the site's template, and its least text.
RECURRING_DOCUMENTS = 5
RECURRING_LETTERS = 10
#: Template hashes that may travel with a scan (8 bytes each); more are joined by an exchange.
BROADCAST_ROWS = 1_000_000

# fixed values: element names
_TAGS = (
    "a abbr article aside b blockquote body br button caption center cite code col colgroup dd del div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li "
    "link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()
# fixed values: elements without content
_VOID = frozenset("br hr img input link meta col".split())

_NAMES = "|".join(sorted(_TAGS, key=len, reverse=True))
_MARK = re.compile(rf"<!--|<(/?)({_NAMES})((?:\s[^<>]*)?)/?>|<!doctype[^<>]*>", re.I)
_ESCAPED = re.compile(rf"&(?:lt|#60|#x3c);(/?(?:{_NAMES})(?:\s(?:(?!&(?:lt|gt|#60|#62|#x3c|#x3e);)[^<>])*)?/?)&(?:gt|#62|#x3e);", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_MD_HEADING = re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M)
_MD_STRONG = re.compile(r"(?<!\*)(\*{2,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)|(?<![\w_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])|~~(?=\S)([^~\n]+?)~~", re.S)
_MD_STRONG_END = re.compile(r"(?<=[^\s*])\*{2,3}(?!\*)|(?<=[^\s_])__(?![\w_])|~~")
# emphasis ends in a sign or stays inside a sentence; a star after a word is a footnote's
_MD_EMPHASIS = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\w\s*]|(?:[^*\n.;:!?]|[.;:!?](?=\S))*[^*\s])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+\"[^\"]*\")?\)|^ {0,3}\[[^\]\n]+\]:\s*\S+", re.M)
_MD_QUOTE = re.compile(r"^ {0,3}>[ \t]*(?=[^\W\d])", re.M)
_MD_FENCE = re.compile(r"^ {0,3}(```+|~~~+)([^\n`]*)\n(.*?)(?:^ {0,3}\1|\Z)", re.M | re.S)
_MD_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_MD_TABLE = re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*(?:\n[^\n]*\|[^\n]*)*", re.M)

_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
_WIKI_QUOTES = re.compile(r"(?<!')('{2,5})(?=[^\s'])([^\n]+?)(?<=[^\s'])\1(?!')")
_WIKI_QUOTES_END = re.compile(r"(?<=[^\s'])'{2,5}(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*(\S[^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)

_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\\S*|\\\\\w+\\\S*")
_TEX_MATH = re.compile(r"\$\$(.+?)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<!\\)\$(?!\s?\d[\d.,]*(?:\s|[^\W\d]))(?=[^$\n]*[\\^_{])([^$\n]+?)(?<!\\)\$(?!\d)", re.S)
_TEX_MATH_END = re.compile(r"\$|\\\)|\\\]")
_TEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?")
_TEX_COMMAND = re.compile(r"\\([A-Za-z]{2,})(\*?)(?=[^A-Za-z]|$)")
_TEX_ESCAPE = re.compile(r"\\([%$&#_{}])")


def _masked(text: str) -> str:
    """``text`` without file paths, whose backslashes are no commands."""
    return _PATH.sub(" ", text) if "\\" in text else text


def _last(ends: re.Pattern, text: str) -> int:
    """Where the last closing sign ends; no span that opens behind it is looked for."""
    return max((m.end() for m in ends.finditer(text)), default=0)


def _spans(pattern: re.Pattern, ends: re.Pattern, text: str) -> Iterator[re.Match]:
    return pattern.finditer(text, 0, _last(ends, text))


def _replaced(pattern: re.Pattern, ends: re.Pattern, new, text: str) -> str:
    last = _last(ends, text)
    return pattern.sub(new, text[:last]) + text[last:] if last else text


def _any(pattern: re.Pattern, ends: re.Pattern, text: str) -> bool:
    return next(_spans(pattern, ends, text), None) is not None


def _has_element(text: str) -> bool:
    return "<" in text and next(_marks(text), None) is not None


def has_html(text: str) -> bool:
    if _has_element(text):
        return True
    return "&" in text and any(m.group()[1] == "#" or m.group()[1:] in html5 for m in _ENTITY.finditer(text))


def has_markdown(text: str) -> bool:
    return bool(
        ("#" in text and _MD_HEADING.search(text))
        or ("*" in text and (_any(_MD_STRONG, _MD_STRONG_END, text) or _MD_EMPHASIS.search(text)))
        or ("__" in text and _any(_MD_STRONG, _MD_STRONG_END, text))
        or ("~~" in text and _any(_MD_STRONG, _MD_STRONG_END, text))
        or (("](" in text or "]:" in text) and _MD_LINK.search(text))
        or (">" in text and _MD_QUOTE.search(text))
        or ("`" in text and (_MD_FENCE.search(text) or _MD_CODE.search(text)))
        or ("|" in text and "--" in text and _MD_TABLE.search(text))
    )


def has_wiki(text: str) -> bool:
    return bool(
        ("[[" in text and _WIKI_LINK.search(text))
        or ("{{" in text and _WIKI_TEMPLATE.search(text))
        or ("''" in text and _any(_WIKI_QUOTES, _WIKI_QUOTES_END, text))
        or ("==" in text and _WIKI_HEADING.search(text))
        or ("{|" in text and _WIKI_TABLE.search(text))
    )


def has_latex(text: str) -> bool:
    if "\\" in text:
        bare = _masked(text)
        if "\\" in bare and (_TEX_ENV.search(bare) or _TEX_COMMAND.search(bare) or _TEX_ESCAPE.search(bare) or _any(_TEX_MATH, _TEX_MATH_END, bare)):
            return True
    return text.count("$") > 1 and ("^" in text or "_" in text or "{" in text) and _any(_TEX_MATH, _TEX_MATH_END, text)


# fixed values: the names of the kinds
_KINDS = (("html", has_html), ("markdown", has_markdown), ("wiki", has_wiki), ("latex", has_latex))


def kinds_of(text: str | None) -> list[str]:
    return [kind for kind, found in _KINDS if found(text)] if text else []


# fixed values: elements whose end tag may be left out: what opens them again ends them, up to the element around them
_ENDS_AT = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}
# fixed values: elements that end an open paragraph
_END_P = frozenset("p div ul ol dl li dt dd table h1 h2 h3 h4 h5 h6 pre blockquote section article aside header footer nav main form figure hr".split())
# fixed values: the parts of a table, which are data and no template by themselves
_TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_P_SCOPE = ("table", "td", "th", "caption", "button")


def _marks(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag; comments and doctypes have the name ``!``."""
    at, open_comment = 0, True
    while m := _MARK.search(text, at):
        at = m.end()
        if m.group(2):
            yield m.start(), at, m.group(1), m.group(2).lower(), m.group(3)
        elif m.group() != "<!--":
            yield m.start(), at, "", "!", m.group()
        elif open_comment:
            end = text.find("-->", at)
            if end < 0:
                open_comment = False  # no comment behind this place is closed either
            else:
                yield m.start(), end + 3, "", "!", text[m.start() : end + 3]
                at = end + 3


class _Element:
    __slots__ = ("tag", "attrs", "parts", "start", "end", "digest", "letters")

    def __init__(self, tag: str, attrs: str, start: int, end: int):
        self.tag, self.attrs, self.parts, self.start, self.end, self.digest, self.letters = tag, attrs, [], start, end, 0, 0


class Tree:
    """Elements with their places in the source, in the order of their beginnings.

    End tags that may be left out are supplied; what is no known tag stays text.  The places of
    open elements are kept by name, so building takes one step a tag however deep they stand.
    """

    def __init__(self, text: str):
        self.root = _Element("", "", 0, len(text))
        self.elements: list[_Element] = []
        stack = [self.root]
        open_at: dict[str, list[int]] = {}
        last = 0

        def close(depth: int, end: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                node.end = end
                open_at[node.tag].pop()

        def highest(names: tuple[str, ...]) -> int:
            return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

        def lowest_above(names: tuple[str, ...], scope: int) -> int:
            found = 0
            for n in names:
                # at most one open element of each of these names stands above its scope
                if open_at.get(n) and open_at[n][-1] > scope and (not found or open_at[n][-1] < found):
                    found = open_at[n][-1]
            return found

        for start, end, slash, name, attrs in _marks(text):
            if start > last:
                stack[-1].parts.append(text[last:start])
            last = end
            if slash:
                if open_at.get(name):
                    close(open_at[name][-1], end)
                continue
            if name in _END_P and open_at.get("p") and open_at["p"][-1] > highest(_P_SCOPE):
                close(open_at["p"][-1], start)
            if name in _ENDS_AT:
                ended, scope = _ENDS_AT[name]
                depth = lowest_above(ended, highest(scope))
                if depth:
                    close(depth, start)
            node = _Element(name, attrs.strip(" /"), start, end)
            stack[-1].parts.append(node)
            self.elements.append(node)
            if name != "!" and name not in _VOID and text[end - 2] != "/":
                open_at.setdefault(name, []).append(len(stack))
                stack.append(node)
        if last < len(text):
            stack[-1].parts.append(text[last:])
        close(1, len(text))

    def hash(self) -> None:
        """Digests and letter counts of all subtrees, from the digests of their children.

        Digits are masked outside tables, so years and numbers don't matter.  Elements begin after
        the ones around them, so the reverse order meets children first.
        """
        for node in reversed(self.elements):
            plain = str if node.tag in _TABLE_PARTS else _digitless
            shape = hashlib.blake2b(f"{node.tag}\x00{_digitless(node.attrs)}\x00".encode("utf-8", "replace"), digest_size=8)
            for part in node.parts:
                if isinstance(part, str):
                    shape.update(b"\x01" + plain(part).encode("utf-8", "replace"))
                    node.letters += sum(map(str.isalpha, part))
                else:
                    shape.update(b"\x02" + part.digest.to_bytes(8, "big", signed=True))
                    node.letters += part.letters
            node.digest = int.from_bytes(shape.digest(), "big", signed=True)


def _digitless(text: str) -> str:
    return re.sub(r"\d+", "0", text)


def _plain_ends(text: str) -> str:
    """``text`` with plain line ends and escaped tags opened, as subtrees are hashed and deleted."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "&" in text:
        text = re.sub(r"&(?:amp;)+(?=#?\w+;)", "&", text)
        text = _ESCAPED.sub(r"<\1>", text)
    return text


def _hashed(text: str | None) -> tuple[str, Tree | None]:
    if not text or ("<" not in text and "&" not in text):
        return text or "", None
    text = _plain_ends(text)
    if not _has_element(text):
        return text, None
    tree = Tree(text)
    tree.hash()
    return text, tree


def _can_recur(node: _Element) -> bool:
    return node.letters >= RECURRING_LETTERS and node.tag not in _TABLE_PARTS


def subtree_hashes(text: str | None) -> list[int]:
    """Hashes of the element subtrees of ``text`` that can be a template: letters enough, no part of a table."""
    _, tree = _hashed(text)
    return sorted({e.digest for e in tree.elements if _can_recur(e)}) if tree else []


def without_subtrees(text: str | None, gone: set[int]) -> tuple[str | None, int]:
    """``text`` without the subtrees whose hashes are in ``gone``, and how many different ones it held."""
    if not text or not gone:
        return text, 0
    opened, tree = _hashed(text)
    held = [e for e in tree.elements if e.digest in gone and _can_recur(e)] if tree else []
    if not held:
        return text, 0
    keep, last = [], 0
    for e in held:
        if e.start >= last:  # else inside one that is gone already
            keep.append(opened[last : e.start])
            last = e.end
    return "".join([*keep, opened[last:]]), len({e.digest for e in held})


def _tex(text: str) -> str:
    """LaTeX commands outside formulas as plain structure."""
    text = re.sub(r"\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}[ \t]*\n?", r"\n# \1\n", text)
    text = re.sub(r"\\begin\{(?:itemize|enumerate|description)\}(?:\[[^\]\n]*\])?\s*|\s*\\end\{(?:itemize|enumerate|description)\}", "\n", text)
    text = re.sub(r"\s*\\item(?:\[([^\]\n]*)\])?\s*", lambda m: "\n- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: "\n" + re.sub(r"(?m)^", "    ", m.group(1).rstrip("\n")) + "\n", text, flags=re.S)
    text = _TEX_ENV.sub("", text)
    parts, last, by_command = [], 0, []
    for m in re.finditer(r"(\\[A-Za-z]{2,}\*?)?\{|\}", text):  # commands may be nested
        kept = by_command.pop() if m.group() == "}" and by_command else not m.group(1)
        if m.group() != "}":
            by_command.append(kept)
        if not kept:
            parts.append(text[last : m.start()])
            last = m.end()
    text = "".join([*parts, text[last:]])
    text = re.sub(r"\\[A-Za-z]{2,}\*?(?![A-Za-z])[ \t]?", "", text)
    return _TEX_ESCAPE.sub(r"\1", text)


_SPACES = " \t\n\r\f\v\xa0\u2003"
_ONE_LINE = frozenset("h1 h2 h3 h4 h5 h6 title caption td th".split())
# fixed values: what stands before and after an element's text, and what is stripped from its ends
_FRAMES = {
    **dict.fromkeys(("p", "div", "table", "ul", "ol", "section", "article", "dl", "figure"), ("\n", "\n", "\n")),
    **dict.fromkeys(("li", "dt", "dd"), ("\n- ", "", _SPACES)), "blockquote": ("\n> ", "\n", _SPACES), "tr": ("", "\n", "\t\n "),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "title", "caption"), ("\n# ", "\n", _SPACES)), **dict.fromkeys(("td", "th"), ("", "\t", _SPACES)), "sup": ("", "]", ""),
}


class _Writer:
    """Writes the text of elements from left to right; nothing is copied again, however deep they stand."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.lead = ""  # what is stripped from the text that comes next
        self.solid = 0  # texts written so far
        self.lines = self.code = 0  # open elements whose text is one line, or code
        self.gap = False
        self.open: list[tuple] = []

    def write(self, text: str) -> None:
        if self.lead:
            text = text.lstrip(self.lead)
            if not text:
                return
            self.lead = ""
        if self.lines:
            words = " ".join(text.split())
            gap = self.gap or text[:1].isspace()
            self.gap = text[-1:].isspace() if words else gap
            if not words:
                return
            text = " " + words if gap else words
        elif self.code:
            text = text.replace("\n", "\n    ")
        if text:
            self.out.append(text)
            self.solid += not text.isspace()

    def enter(self, tag: str) -> None:
        before, _, strip = _FRAMES.get(tag, ("", "", ""))
        lead = self.lead
        if tag in ("pre", "textarea"):
            self.write("\n" if self.code else "\n    ")
            before, strip = "", "\n"
            self.code += 1
        self.write(before)
        if tag == "sup":
            self.out.append("")
        self.open.append((tag, len(self.out), self.solid, lead, self.gap))
        if tag in _ONE_LINE:
            self.lines += 1
            self.lead, self.gap = _SPACES, False if self.lines == 1 else self.gap
        elif strip and tag != "tr":
            self.lead = strip

    def leave(self) -> None:
        tag, start, solid, lead, gap = self.open.pop()
        before, after, strip = _FRAMES.get(tag, ("", "", ""))
        if tag in ("pre", "textarea"):
            after, strip = "\n", "\n "
        while strip and len(self.out) > start:
            self.out[-1] = self.out[-1].rstrip(strip)
            if self.out[-1]:
                break
            self.out.pop()
        if tag in _ONE_LINE:
            self.lines -= 1
            self.gap = False
        if tag in ("pre", "textarea"):
            self.code -= 1
        if tag == "sup":
            if self.solid > solid:
                self.out[start - 1] = "["
                self.write(after)
            return
        if tag in _FRAMES or tag in ("pre", "textarea"):
            self.lead = lead if self.solid == solid and not before.strip() else ""
            if after:
                self.write(after)


def _html(tree: Tree) -> str:
    """The text of a tree: headings, list items, quotes, rows and code keep their marks."""
    w = _Writer()
    walks = [iter(tree.root.parts)]
    while walks:
        part = next(walks[-1], None)
        if part is None:
            walks.pop()
            if walks:
                w.leave()
        elif isinstance(part, str):
            w.write(part)
        elif part.tag == "br":
            w.write("\n")
        elif part.tag not in ("!", "script", "style"):
            w.enter(part.tag)
            walks.append(iter(part.parts))
    return "".join(w.out)


def _cells(line: str, mark: str = "|") -> str:
    return "\t".join(c.strip() for c in line.strip().strip("|").split(mark))


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group().split("\n"):
        line = line.strip()
        if line.startswith("{|") or not line:
            continue
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows[-1].append("# " + line[2:].strip())
        elif line[0] in "|!":
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
        elif rows[-1]:
            rows[-1][-1] += " " + line
    return "\n".join("\t".join(r) for r in rows if r) + "\n"


def convert(text: str | None) -> str | None:
    """Clean text of one content."""
    if not text or not kinds_of(text):
        return text
    kept: list[str] = []

    def hold(value: str) -> str:
        kept.append(value)
        return f"\ue000{len(kept) - 1}\ue001"

    text = text.replace("\ue000", "").replace("\ue001", "").replace("\r\n", "\n").replace("\r", "\n")
    text = _PATH.sub(lambda m: hold(m.group()), text)
    text = _MD_FENCE.sub(lambda m: "\n" + hold(re.sub(r"(?m)^", "    ", m.group(3).rstrip("\n"))) + "\n", text)
    text = _replaced(_TEX_MATH, _TEX_MATH_END, lambda m: hold("$" + " ".join(next(g for g in m.groups() if g is not None).split()) + "$"), text)
    # escaped tags and entities inside entities open step by step; every step makes the text shorter
    text = re.sub(r"&(?:amp;)+(?=#?\w+;)", "&", text)
    while True:
        if _has_element(text):
            text = _html(Tree(text))
        opened = html.unescape(text) if "&" in text else text
        if opened == text:
            break
        text = opened
    text = _WIKI_TABLE.sub(_wiki_table, text)
    text = _WIKI_LINK.sub(lambda m: (m.group(2) if m.group(2) is not None else m.group(1)) if not re.match(r"(?i)(?:file|image|category|datei|fichier|archivo):", m.group(1)) else "", text)
    text = _WIKI_TEMPLATE.sub("", text)
    text = _replaced(_WIKI_QUOTES, _WIKI_QUOTES_END, r"\2", text)
    text = _WIKI_HEADING.sub(r"# \2", text)
    text = _MD_TABLE.sub(lambda m: "\n".join(_cells(x) for i, x in enumerate(m.group().split("\n")) if i != 1), text)
    text = _MD_LINK.sub(lambda m: m.group(1) or "", text)
    text = _MD_CODE.sub(lambda m: m.group(2), text)
    text = re.sub(r"^ {0,3}#{1,6}[ \t]+", "# ", text, flags=re.M)
    text = _replaced(_MD_STRONG, _MD_STRONG_END, lambda m: m.group(2) or m.group(3) or m.group(4), text)
    text = _MD_EMPHASIS.sub(lambda m: m.group(1) or m.group(2), text)
    if "\\" in text:
        text = _tex(text)
    text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")


def _contents(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.length("block_content") > 0).select("block_key", "source", "document_id", F.col("block_content").cast("string").alias("block_content"))


def _subtrees(blocks: DataFrame) -> DataFrame:
    """(block_key, source, document_id, subtree): the element subtrees of each content."""
    source = _contents(blocks).where(F.col("block_content").rlike("[<&]"))
    kind = source.schema["block_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtree_hashes(t) for t in batch.column(3).to_pylist()]
            rows = batch.take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array([h for f in found for h in f], pa.int64())], names=["block_key", "source", "document_id", "subtree"])

    return source.mapInArrow(run, f"block_key {kind}, source string, document_id string, subtree bigint")


def site_templates(blocks: DataFrame) -> DataFrame:
    """(source, subtree, documents): subtrees that recur in many filings of one site."""
    each = _subtrees(blocks.where("source IS NOT NULL AND document_id IS NOT NULL"))
    pairs = each.groupBy("source", "subtree", "document_id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("source", "subtree").agg(F.sum("one").alias("documents")).where(F.col("documents") >= RECURRING_DOCUMENTS)


def markup_found(blocks: DataFrame) -> DataFrame:
    """(block_key, markup): one row for each kind of markup in each content.

    The parser stops at the first node of each kind; no subtree is hashed, as deleting a site's
    template changes no row here.
    """
    source = _contents(blocks).select("block_key", "block_content")
    kind = source.schema["block_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [kinds_of(t) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, k in enumerate(kinds) for _ in k], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for k in kinds for x in k], pa.string())], names=["block_key", "markup"])

    return source.mapInArrow(run, f"block_key {kind}, markup string")


def without_markup(blocks: DataFrame) -> DataFrame:
    """(block_key, block_content, removed_subtrees): clean text of every block."""
    rows = blocks.select("block_key", "source", F.col("block_content").cast("string").alias("block_content"))
    found = written(site_templates(blocks), "templates")
    kind = rows.schema["block_key"].dataType.simpleString()
    schema = f"block_key {kind}, block_content string, removed_subtrees int"
    if found.count() <= BROADCAST_ROWS:
        sets: dict[str, set[int]] = {}
        for r in found.collect():
            sets.setdefault(r.source, set()).add(r.subtree)
        shipped = blocks.sparkSession.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, sites = batch.column(2).to_pylist(), batch.column(1).to_pylist()
                cut = [without_subtrees(t, shipped.value.get(s, frozenset())) for t, s in zip(texts, sites)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([convert(t) for t, _ in cut], pa.string()), pa.array([n for _, n in cut], pa.int32())], names=["block_key", "block_content", "removed_subtrees"])

        return rows.mapInArrow(run, schema)
    # many templates: bring to each block only the templates it holds
    held = _subtrees(blocks).select("block_key", "source", "subtree").join(found, ["source", "subtree"]).groupBy("block_key").agg(F.collect_set("subtree").alias("gone"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [without_subtrees(t, set(g or ())) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([convert(t) for t, _ in cut], pa.string()), pa.array([n for _, n in cut], pa.int32())], names=["block_key", "block_content", "removed_subtrees"])

    return rows.join(held, "block_key", "left").select("block_key", "block_content", "gone").mapInArrow(run_joined, schema)
