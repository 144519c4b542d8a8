"""Main text of web pages by tag-path ratios.

A page is read once into blocks: text between block-level tags, with the path of tags
(and class names) from the root. Scripts, styles, forms, comments and blocks below
boilerplate elements (navigation, header, footer, by tag) are never content. Elements whose
class, id or role names say boilerplate (sidebars, notices, adverts, reader comments) are
suspects: their text, weighted by punctuation, counts only for a part (least if a whole name
says so, inside an article only then), and one is content if that part outweighs the text
outside all suspects, or if it holds the page's main or only article. Over the remaining blocks
two ratios are aggregated per tag path: text length per block, and punctuation marks per
block. Both are smoothed over neighbouring blocks in page order, fused by product, and
averaged per path; paths above a share of the page's length-weighted mean are content.
A block of another path is kept when a content path lies in the same section (article,
main, section or a container), so headings and short paragraphs stay with their text.

The tokenizer is one pass over the page with possessive patterns; nothing is dropped or
capped by length. Defined cases: null and empty pages, and pages of boilerplate only,
have an empty text; unclosed and stray tags, missing ``</body>`` and text without tags
are accepted; repeated pages are each extracted; extra columns are passed through; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demandflow.session import ship_package

#: Content paths have a fused ratio of at least this share of the page's mean.
SHARE = 0.1
#: Weights of a block and its neighbours at distance 1 and 2.
KERNEL = (0.5, 0.2, 0.05)
#: What the text of a suspect counts for: by a whole name, and by a part of one or around an article.
WHOLE, PART = 0.1, 0.5
#: Weight (characters, times punctuation) that a suspect's part must have at least.
LEAST = 200

# Elements by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BOILERPLATE = frozenset("head nav header footer aside form button select option menu dialog svg canvas template "
                        "object applet noscript".split())
SECTIONS = frozenset("article main section div td body".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                            "main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of class, id and role names that make an element suspect.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies copyright disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pager "
                  "pagination popup promo promoted recommend recommended related reply replies respond share sharing sidebar "
                  "signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets complementary "
                  "contentinfo search alert modal".split())

# every part is possessive and no name holds "<", so an attempt never looks at a character twice
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/><]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_MARKS = re.compile(r"[.,;:!?…。，！？、]")


def blocks(page: str) -> list[tuple[int, int, str]]:
    """(number of the tag path, section number, text) of each block that may be content, in page order."""
    out: list[tuple[int, int, str]] = []
    paths: dict[tuple[int, str], int] = {}  # path around and last step -> path; 0 is the page
    role = [""]  # per path: "article" or "main" if such an element is on it (or its name begins so)
    inside: list[int] = []  # per block: the innermost suspect around it, or -1
    outer: list[int] = []  # per suspect: the next one around it, or -1
    part: list[float] = []
    holds: list[str] = []
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, -1)]  # tag, path, boilerplate, section, suspect
    held: list[str] = []
    held_at = stack[0]
    sections = 0

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((held_at[1], held_at[3], text))
                inside.append(held_at[4])
            held = []

    def add(text: str) -> None:
        nonlocal held_at
        if text and not stack[-1][2]:
            if not held:
                # a block belongs to the nearest element that is not inline
                held_at = next((x for x in reversed(stack) if x[0] not in INLINE))
            held.append(text)

    opened: dict[str, int] = defaultdict(int)  # open elements by name

    def close(names: frozenset, stop: frozenset) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                for x in stack[k:]:
                    opened[x[0]] -= 1
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at, n = 0, len(page)
    last = page.rfind(">")
    while at < n:
        if at > last:  # no tag ends any more: text up to an open comment
            add(page[at:].partition("<!--")[0])
            break
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            if name not in INLINE:
                flush()
            close(frozenset([name]), frozenset() if name in SECTIONS or name in BOILERPLATE else SECTIONS | BOILERPLATE)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name == "br":
            add(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                tail = page.find(">", at)
                at = tail + 1 if tail >= 0 else n
            continue
        if name not in INLINE:
            flush()
            for open_, closers in CLOSED_BY.items():
                if name in closers:
                    close(frozenset([open_]), SECTIONS | BOILERPLATE | (frozenset(["table"]) if open_ != "p" else frozenset())
                          | (frozenset(["ul", "ol"]) if open_ == "li" else frozenset()))
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        names = [x for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in attributes else []
        parts = [set(_WORD.findall(x)) for x in names]
        words = set().union(*parts)
        parent = stack[-1]
        whole = any(x and x <= MARKS for x in parts)
        junk = parent[2] or (name in BOILERPLATE and not (name == "header" and role[parent[1]] == "article")) or (
            name in INLINE and whole) or (bool(attributes) and bool(_HIDDEN.search(attributes)))
        suspect = parent[4]
        if name in ("article", "main"):
            around = suspect if not junk else -1
            while around >= 0 and holds[around] not in (name, "main"):
                holds[around] = name
                around = outer[around]
        elif name not in INLINE and name not in ("html", "body") and not junk and (
                whole or (words & MARKS and role[parent[1]] != "article")):
            outer.append(suspect)
            part.append(WHOLE if whole else PART)
            holds.append("")
            suspect = len(outer) - 1
        section = parent[3]
        if name in SECTIONS:
            sections += 1
            section = sections
        path = parent[1]
        if name not in INLINE:
            path = paths.setdefault((parent[1], name + "".join(f".{w}" for w in sorted(words)[:3])), len(role))
            if path == len(role):
                role.append("article" if name == "article" else role[parent[1]] or ("main" if name == "main" else ""))
        stack.append((name, path, junk, section, suspect))
        opened[name] += 1
    flush()
    if not outer:
        return out
    kept = _cleared(out, inside, outer, part, holds, role)
    return [x for x, i in zip(out, inside) if i in kept]


def _cleared(found: list[tuple[int, int, str]], inside: list[int], outer: list[int], part: list[float], holds: list[str],
             role: list[str]) -> set[int]:
    """The suspects that are content after all, heaviest first, and -1 for none."""
    own = [0.0] * (len(outer) + 1)  # the last place: outside all suspects
    alone = True
    for (path, _, text), i in zip(found, inside):
        own[i] += len(text) * (1 + len(_MARKS.findall(text)))
        alone = alone and not (i < 0 and role[path])
    free, total = own.pop(), own.copy()
    within = defaultdict(list)
    for i in range(len(outer) - 1, -1, -1):
        within[outer[i]].append(i)
        if outer[i] >= 0:
            total[outer[i]] += total[i]

    def weight(i: int) -> float:
        if total[i] and (holds[i] == "main" or holds[i] == "article" and alone and part[i] == PART):
            return float("inf")
        return total[i] * (PART if holds[i] and alone else part[i])

    kept, heap = {-1}, [(-weight(i), i) for i in within[-1]]
    heapq.heapify(heap)
    # on a page without other text the heaviest part of a name is content, however short
    while heap and -heap[0][0] >= (max(free, LEAST) if free or part[heap[0][1]] == WHOLE else 0):
        i = heapq.heappop(heap)[1]
        kept.add(i)
        free += own[i]
        for j in within[i]:
            heapq.heappush(heap, (-weight(j), j))
    return kept


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    length = np.array([len(t) for _, _, t in found], dtype=np.float64)
    marks = np.array([len(_MARKS.findall(t)) for _, _, t in found], dtype=np.float64)
    total, dots, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for (path, _, _), a, b in zip(found, length, marks):
        total[path] += a
        dots[path] += b
        nodes[path] += 1
    by_text = _smooth(np.array([total[p] / nodes[p] for p, _, _ in found]))
    by_marks = _smooth(np.array([dots[p] / nodes[p] for p, _, _ in found]))
    fused = by_text * (1 + by_marks)
    of_path = defaultdict(float)
    for (path, _, _), f in zip(found, fused):
        of_path[path] += f / nodes[path]
    limit = SHARE * float((fused * length).sum() / length.sum())
    chosen = {p for p, f in of_path.items() if f >= limit}
    near = {s for p, s, _ in found if p in chosen}
    return "\n".join(t for p, s, t in found if p in chosen or s in near)


def _smooth(x: np.ndarray) -> np.ndarray:
    out, weight = KERNEL[0] * x, np.full(len(x), KERNEL[0])
    for d in range(1, min(len(KERNEL), len(x))):
        out[d:] += KERNEL[d] * x[:-d]
        out[:-d] += KERNEL[d] * x[d:]
        weight[d:] += KERNEL[d]
        weight[:-d] += KERNEL[d]
    return out / weight


def with_main_text(df: DataFrame, page: str = "html") -> DataFrame:
    """``df`` with ``_main``: the extracted text of each page."""
    ship_package(df.sparkSession)

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(t) for at in range(0, len(pages), 256) for t in pages.slice(at, 256).to_pylist()], pa.string())

    return df.withColumn("_main", extracted(F.col(page).cast("string")))
