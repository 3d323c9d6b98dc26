"""Main text of web pages by host consensus.

Each page's containers are scored; the best one and those beside it that hold main text too vote with their
paths of tags and generalised classes. In Spark the votes of a host are counted against how often a path occurs,
and the paths that win are used to extract all of the host's pages again. A page on which no winning path fits
keeps its own best containers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import Scratch, small_batches

#: The share of a host's pages, and of the pages that have it, on which a path must have been chosen to win.
SHARE, CHOSEN = 0.1, 0.5
#: A container beside the best one is main text too with this share of its score.
JOIN = 0.25
#: Winners are broadcast up to so many bytes of hosts and paths; more are joined.
MAX_BROADCAST = 16 << 20
#: A path names so many innermost containers; a digest stands for those around them.
SHOWN = 8
#: Letters that make a block prose, and the share of a page's text below which nothing is left outside of what is marked.
PROSE, LITTLE = 80, 0.05
SALTS = 16

#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title iframe xmp".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold a page's main text.
CONTAINERS = frozenset("body main article section div td center".split())
#: Elements whose content isn't main text, unless the main text is nowhere else.
DROPPED = frozenset("noscript template svg math canvas object audio video nav footer aside form button select label fieldset dialog menu".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id or role that mark what isn't main text.
MARKED = frozenset(
    "ad ads adv advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs consent cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo search".split()
)
#: Words that mark what readers wrote.
READERS = frozenset("comment comments replies reply respond discussion".split())
#: The same as MARKED for words that often name parts of an article; they count outside of article and main only.
OUTSIDE = frozenset("header branding".split())
#: Words that may follow a marking word in a name without another meaning.
NEUTRAL = frozenset("area bar bars block body bottom box button buttons column container content entry footer form group head holder icons inner item items left links list main menu panel placeholder posts region right section site slot thread top unit wrap wrapper zone".split())
#: Words before a marking word that say it isn't there, or is somewhere else.
NEGATED = frozenset("has have no non not with without is are hide hides show shows".split())

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTR = re.compile(r"""(?:(?<=[\s"'/])|^)([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_PARTS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_WANTED = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))
#: Elements that end where another block, or another one of them, begins.
_FLOW = frozenset(("p", "li", "dt", "dd"))


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        if (name := m[1].lower()) in _WANTED:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def marks(name: str, words: frozenset[str]) -> bool:
    """A name says what its last words with a meaning say: "site-sidebar-left" is a sidebar, "has-sidebar" and "notice-board" aren't."""
    parts = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    while parts and parts[-1] in NEUTRAL and parts[-1] not in words:
        parts.pop()
    return bool(parts) and parts[-1] in words and not NEGATED.intersection(parts)


def _named(attrs: dict[str, str], words: frozenset[str]) -> bool:
    return any(marks(n, words) for k in ("class", "id", "role") if k in attrs for n in attrs[k].split())


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or attrs.get("aria-hidden", "").lower() == "true"


class Container:
    __slots__ = ("tag", "name", "digest", "start", "end", "outer", "flag", "prose", "score", "plain", "here")

    def __init__(self, tag: str, name: str, digest: bytes, start: int, outer: Container | None, flag: str = ""):
        self.tag, self.name, self.digest, self.start, self.outer, self.flag = tag, name, digest, start, outer, flag
        self.end, self.prose = start, -1  # prose: where the first prose in it begins
        self.score, self.plain, self.here = 0.0, 0, False  # here: in something flagged


class Page:
    """A page's text and its containers, in page order.

    parts holds text and, for the edge of a block, a space; a container spans parts[start:end]. One with a flag
    (dropped, marked or readers) is cut out of what is around it. Reading takes time in proportion to the page.
    """

    def __init__(self, html: str | None):
        self.parts: list[str] = []
        self.containers: list[Container] = []
        self.blocks: list[tuple[int, int, int, Container]] = []  # first part, letters, letters in links, container
        self.root = Container("", "", b"", 0, None)
        self._read(html or "")
        self._settle()
        self._rescue()
        self._rate()

    def _open(self, tag: str, attrs: dict[str, str], outer: Container, flag: str) -> Container:
        kinds = sorted(set(attrs.get("class", "").split()))
        name = tag + "".join("." + _DIGITS.sub("#", k) for k in kinds)
        digest = blake2b(outer.digest + name.encode("utf-8", "replace"), digest_size=8).digest()
        c = Container(tag, name, digest, len(self.parts), outer, flag)
        self.containers.append(c)
        return c

    def _read(self, html: str) -> None:
        parts, blocks, stack = self.parts, self.blocks, [self.root]
        opened: Counter[str] = Counter()
        inside = links = size = linked = begin = 0
        quoted, missing, last = True, set(), html.rfind(">")

        def close_block(edge: bool = True) -> None:
            nonlocal size, linked, begin
            if size:
                c = stack[-1]
                blocks.append((begin, size, linked, c))
                if c.prose < 0 and size - linked >= PROSE and 5 * linked <= size:
                    c.prose = begin
                size = linked = 0
            if edge:
                parts.append(" ")
            begin = len(parts)

        def text(piece: str) -> None:
            nonlocal size, linked
            if "&" in piece:
                piece = unescape(piece)
            parts.append(piece)
            if not piece.isspace():
                n = len(piece) - piece.count(" ")
                size += n
                linked += n if links else 0

        def close(at: int, ended: bool) -> None:
            """Closes stack[at:]. What is flagged but never ended reaches to the first prose in it only."""
            nonlocal inside
            while len(stack) > at:
                c = stack.pop()
                c.end = len(parts)
                opened[c.tag] -= 1
                whole = ended and len(stack) == at
                if c.flag and not whole and c.prose >= 0:
                    c.end = c.prose
                inside -= not c.flag and c.tag in ("article", "main")
                if c.prose >= 0 and stack[-1].prose < 0 and not (c.flag and whole):
                    stack[-1].prose = c.prose if c.flag else c.start

        pos, n = 0, len(html)
        while pos < n:
            at = html.find("<", pos)
            if at < 0 or at > last:
                text(html[pos:])
                break
            m = _NAME.match(html, at + 1)
            if m is None and html[at + 1 : at + 2] not in ("!", "?", "/"):  # a sign, not a tag
                text(html[pos : at + 1])
                pos = at + 1
                continue
            if at > pos:
                text(html[pos:at])
            if m is None:
                start, sign = (4, "-->") if html.startswith("<!--", at) else (9, "]]>") if html.startswith("<![CDATA[", at) else (1, ">")
                end = html.find(sign, at + start)
                end = n if end < 0 else end
                if start == 9:
                    text(html[at + 9 : end])
                pos = end + len(sign)
                continue
            # the tag's end stands outside of quotes, as long as the page's quotes make sense
            stop = m.end()
            while quoted:
                stop = _PLAIN.match(html, stop).end()
                if stop < n and html[stop] == ">":
                    break
                stop = html.find(html[stop], stop + 1) + 1 if stop < n else 0
                quoted = stop > 0
            if not quoted:
                stop = html.find(">", m.end())
            rest, pos = html[m.end() : stop], stop + 1
            tag, closing = m[1].lower(), html[at + 1] == "/"
            if tag == "a":
                links = 0 if closing else 1
                continue
            if tag in RAW:
                if not closing and tag not in missing:
                    end = _ENDS[tag].search(html, pos)
                    if end is not None:
                        pos = end.end()
                    elif tag in ("script", "style"):
                        break
                    missing.update(() if end else (tag,))
                continue
            if closing:
                if tag in BLOCKS:
                    close_block()
                    links = 0
                if opened[tag] and tag != "body":
                    close_block(False)
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    close(i, True)
                continue
            if tag in BLOCKS:
                close_block()
                links = 0
                if (top := stack[-1].tag) in _FLOW and (top == "p" or tag == top or {tag, top} == {"dt", "dd"}):
                    close(len(stack) - 1, True)
            if tag in VOID or tag in ("html", "head") or tag == "body" and opened[tag]:
                continue
            attrs = _attributes(rest) if "=" in rest or "hidden" in rest else {}
            flag = ""
            if tag in DROPPED or tag != "body" and _hidden(attrs):
                flag = "dropped"
            elif tag not in ("body", "main"):
                if _named(attrs, READERS):
                    flag = "readers"
                elif tag != "article" and (_named(attrs, MARKED) or not inside and (tag == "header" or tag in CONTAINERS and _named(attrs, OUTSIDE))):
                    flag = "marked"
            if not (flag or tag in CONTAINERS or opened[tag]) or rest.endswith("/") and tag not in CONTAINERS:
                continue
            close_block(False)
            stack.append(self._open(tag, attrs, stack[-1], flag))
            opened[tag] += 1
            inside += not flag and tag in ("article", "main")
        close_block()
        close(1, False)
        self.root.end = len(parts)

    def _settle(self) -> None:
        """What begins after the end of a container that reaches to its first prose only stands beside it."""
        for c in self.containers:
            while c.outer.outer is not None and c.start >= c.outer.end:
                c.outer = c.outer.outer
        for i, (at, size, linked, c) in enumerate(self.blocks):
            while c.outer is not None and at >= c.end:
                c = c.outer
            self.blocks[i] = at, size, linked, c
            c.plain += size - linked if size >= 2 * linked else 0

    def _rescue(self) -> None:
        """Takes the flags off what holds the main text: all that is around the only article, or nearly all there is."""

        def place() -> None:
            for c in self.containers:
                c.here = bool(c.flag) or c.outer.here

        place()
        if not any(c.flag for c in self.containers):
            return
        free = self.root.plain + sum(c.plain for c in self.containers if not c.here)
        for c in reversed(self.containers):
            c.outer.plain += c.plain
        named = [c for c in self.containers if c.tag in ("article", "main") and not c.flag and c.plain]
        inner = None
        if named:
            if all(c.here for c in named):
                inner = max(named, key=lambda c: c.plain)
                if self._by_readers(inner) and free:
                    inner = None
        else:
            for kinds, share in (("dropped", "marked"), LITTLE), (("readers",), 0.0):
                most = max((c for c in self.containers if c.flag in kinds), key=lambda c: c.plain, default=None)
                if most is not None and most.plain and free <= share * most.plain:
                    inner = most
                    break
        while inner is not None:
            inner.flag, inner = "", inner.outer
        place()

    @staticmethod
    def _by_readers(c: Container | None) -> bool:
        while c is not None and c.flag != "readers":
            c = c.outer
        return c is not None

    def _rate(self) -> None:
        """Scores: a block's letters outside of links for its own container, half of that for the next one around it, a quarter for the third."""
        for _, size, linked, c in self.blocks:
            worth = float(size - linked) if size >= 2 * linked else 0.0
            for _ in range(3):
                if c is None or c.flag:
                    break
                c.score += worth
                c, worth = c.outer, worth / 2

    def path(self, c: Container) -> str:
        names, at = [], c
        while at is not None and at.outer is not None and len(names) < SHOWN:
            names.append(at.name)
            at = at.outer
        return ">".join(names[::-1]) + ("" if at is None or at.outer is None else f"<{c.digest.hex()}")

    def best(self) -> Container:
        """The container with the most text that isn't links, or the outermost article, else main, around it."""
        found = max((c for c in self.containers if not c.here), key=lambda c: c.score, default=self.root)
        if found.score < self.root.score or not found.score:
            found = self.root
        named: dict[str, Container] = {}
        c = found
        while c is not None:
            named[c.tag] = c
            c = c.outer
        return named.get("article") or named.get("main") or found

    def own(self) -> tuple[list[Container], list[Container]]:
        """(the best container and those beside it with a like score, the others beside it); beside an article or main only others of their tag count."""
        top = self.best()
        near = [c for c in self.containers if c.outer is top.outer and not c.here and c.score > 0]
        alike = lambda c: c.score >= JOIN * top.score and (top.tag not in ("article", "main") or c.tag == top.tag)
        return [c for c in near if c is top or alike(c)] or [top], [c for c in near if c is not top and not alike(c)]

    def text(self, found: list[Container]) -> str:
        """The text of containers, in page order, without what is flagged in them."""
        cuts = [(c.start, c.end) for c in self.containers if c.flag]
        out, at, k = [], 0, 0
        for c in sorted(found, key=lambda c: (c.start, -c.end)):
            at = max(c.start, at)
            while at < c.end:
                while k < len(cuts) and cuts[k][1] <= at:
                    k += 1
                stop = min(c.end, max(cuts[k][0], at)) if k < len(cuts) else c.end
                out += self.parts[at:stop]
                at = min(c.end, cuts[k][1]) if stop < c.end else stop
            out.append(" ")
        return " ".join("".join(out).split())


def vote(html: str | None) -> list[tuple[str, int, int]]:
    """(path, 1 if chosen, letters) of the chosen containers and of those beside them; each path once."""
    page = Page(html)
    group, others = page.own()
    out: dict[str, tuple[str, int, int]] = {}
    for c in group:
        if c.score > 0:
            p = page.path(c)
            out[p] = (p, 1, round(c.score) + out.get(p, ("", 0, 0))[2])
    for c in others:
        p = page.path(c)
        out.setdefault(p, (p, 0, 0))
    return list(out.values())


def extract(html: str | None, winners: list[str], losers: list[str] | None = None) -> tuple[str, str]:
    """(text, path used). The first winning path counts whose containers have half of the best one's score.

    With them go the containers of other winning paths, and of the page's own choice, that stand beside them, but
    for those whose paths the host's other pages didn't choose.
    """
    page = Page(html)
    group, _ = page.own()
    top = max(group, key=lambda c: c.score)
    if winners:
        wanted, lost = set(winners), set(losers or [])
        at: dict[str, list[Container]] = {}
        for c in page.containers:
            if c.score > 0 and not c.here and (p := page.path(c)) in wanted:
                at.setdefault(p, []).append(c)
        for p in winners:
            found = at.get(p, [])
            if found and 2 * sum(c.score for c in found) >= top.score:
                around = {id(c.outer) for c in found}
                more = [c for q in winners if q != p for c in at.get(q, []) if id(c.outer) in around]
                more += [c for c in group if id(c.outer) in around and page.path(c) not in lost]
                return page.text(list({id(c): c for c in found + more}.values())), p
    return page.text(group), page.path(top)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, chosen: float = CHOSEN) -> DataFrame:
    """host -> winners, losers: paths chosen on `share` of the host's pages with text and on `chosen` of those that have them, the most frequent first; and paths that stood beside chosen ones, mostly unchosen, on two pages or more.

    Votes are added up a batch at a time before they are shuffled, so a host's pages never meet in one task. A
    host has at most 1 / share winners for each container that its pages choose; what isn't near a winner on
    2 pages isn't kept.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def votes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cast: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(part["host"], part["html"], strict=True):
                given = vote(html)
                for path, yes, score in [*given, ("", 1, 0)] if given else []:  # the empty path counts pages
                    c = cast.setdefault((host, path), [0, 0, 0])
                    c[0] += 1
                    c[1] += yes
                    c[2] += score
            yield pd.DataFrame([(h, p, *v) for (h, p), v in cast.items()], columns=["host", "path", "seen", "n", "score"])

    counted = rows.mapInPandas(votes, "host string, path string, seen long, n long, score long").groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("seen", "n", "score")))
    total = counted.where("path = ''").select("host", F.col("n").alias("all"))
    rated = counted.where("path <> ''").join(total, "host")
    won = (F.col("n") >= F.col("all") * share) & (F.col("n") >= F.col("seen") * chosen)
    lost = (F.col("n") < F.col("seen") * chosen) & (F.col("seen") >= 2) & (F.col("seen") >= F.col("all") * share)
    kept = rated.where(won | lost).groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(won, F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path"))))["path"].alias("winners"),
        F.sort_array(F.collect_list(F.when(lost, F.col("path")))).alias("losers"),
    )
    return kept.where(F.size("winners") > 0)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each input row: id_col, url_col, text (empty if none), n_chars, path.

    A null html has no text; a null url belongs to a host of its own name, the empty one. Repeated rows stay,
    an empty table gives an empty one; other columns, whatever their names, aren't read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "html")
    winners = scratch.write(consensus(pages, url_col, html_col))
    size = winners.select(F.sum(F.octet_length("host") + F.octet_length(F.array_join(F.concat("winners", "losers"), ">")) + 64)).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # a large host's pages go to several tasks
        salted = winners.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = lambda p: list(p) if p is not None else []
            got = [extract(h, told(w), told(x)) for h, w, x in zip(part["html"], part["winners"], part["losers"], strict=True)]
            yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": [t for t, _ in got], "n_chars": [len(t) for t, _ in got], "path": [p for _, p in got]})

    out = joined.select("id", "url", "html", "winners", "losers").mapInPandas(run, "id string, url string, text string, n_chars long, path string")
    return out.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "path")
