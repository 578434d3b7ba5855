"""Main text of web pages by deducing each host's template.

Tokens of a page are its tags, opening and closing, by path, and its text runs, by path and wording. Tokens of a host with
the same occurrence vector (told apart by sums of page hashes, so no vector is ever gathered) form a class. Classes of
enough tokens on enough pages are checked against every page: tokens that leave the order of their class are taken out of it, and
of two classes that cross each other the weaker goes. What remains is the template: classes nested in the gaps of others,
with slots between consecutive tokens. Runs of the template are constant wording; the content node is an element of a class that
stands once on a page and holds most of the slots' text, and the text of its slots is the page's main text. Article and main
elements are evidence for the content node, and decide alone only where a host or page gives no template.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import map_rows, ready
from creditloom.session import cut_lineage

# A class is of the template if it is on this share of the host's pages, on this many, and has this many tokens.
SUPPORT = 0.5
MIN_PAGES = 3
MIN_SIZE = 2
# The content node holds at least this share of the text outside menus and the like.
CONTENT_SHARE = 0.7
# Templates are sent to all tasks up to this many tokens (24 bytes each); beyond, pages and templates are joined by host.
BROADCAST_TOKENS = 1_000_000
# Sums of page hashes are kept modulo this, so that 2^27 partial sums of one token stay exact.
MODULUS = 1 << 36
# Tokens counted per task before their counts are handed on.
HELD_TOKENS = 100_000

# Elements that are not the article, that hold no text to show, that part blocks, that may be content nodes.
BESIDE = frozenset("nav header footer aside form button select option menu dialog label fieldset head title noscript template iframe object svg canvas audio video".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body".split())
# Words of class, id and role that mark what stands beside an article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs button comment comments consent contentinfo cookie cookies disqus "
    "footer form header login menu modal nav navbar navigation newsletter notice pagination popup promo promotion related reply "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
# The rest of a page in which a quote is never closed.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OPENS_TAG = re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)")
_WORDS = re.compile(r"[a-z]+")
_CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

OPEN, CLOSE, TEXT = range(3)
# Flags of an element or text: beside the article, below article or main. Of an element: may be a content node, is article or main.
BESIDE_IT, BELOW_IT, MAY_HOLD, MARKED, ARTICLE = 1, 2, 4, 8, 16


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed) >> 1


def events(page: str) -> list[tuple[int, int, str | None, int, int]]:
    """(kind, token, text, flags, depth) of the elements and text blocks of a page, in order.

    A token is a hash of the path, with the text of a block, or with the end of an element. White space of a text is made single and
    character references are decoded. Every element is closed, at the latest by the end of the page. Time and memory are linear in
    the page: unclosed tags, quotes and elements included.
    """
    out: list[tuple[int, int, str | None, int, int]] = []
    # (tag, path, flags, place of the nearest element that is no inline one, depth in such elements)
    stack: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]
    open_tags: dict[str, int] = {}
    held: list[str] = []
    at, end, pattern = 0, len(page), _TAG

    def flush():
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            _, path, flags, _, depth = stack[-1]
            out.append((TEXT, _hash(text, path), text, flags, depth))

    def close(place: int):
        while len(stack) > place:
            tag, path, flags, _, depth = stack.pop()
            open_tags[tag] -= 1
            if tag not in INLINE:
                out.append((CLOSE, _hash("/", path), None, flags, depth))

    while at < end:
        less = page.find("<", at)
        if less < 0:
            held.append(page[at:])
            break
        if less > at:
            held.append(page[at:less])
        found = _COMMENT.match(page, less)
        if found:
            at = found.end()
            continue
        found = pattern.match(page, less)
        if not found:
            if _OPENS_TAG.match(page, less):
                pattern = _PLAIN_TAG
                found = pattern.match(page, less) if page.find(">", less) >= 0 else None
                if not found and page.find(">", less) < 0:
                    held.append(page[less:])
                    break
            if not found:
                held.append("<")
                at = less + 1
                continue
        at = found.end()
        tag, attributes = found[2].lower(), found[3]
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if found[1]:
            if open_tags.get(tag):
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                if stack[place - 1][2] != stack[-1][2]:
                    flush()
                close(place)
            continue
        if tag not in INLINE and tag not in VOID:
            # A new block ends an open paragraph; a list item, row or cell ends the one before.
            place = stack[-1][3]
            open_tag = stack[place][0]
            if open_tag == "p" or (open_tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(place)
        names = []
        if attributes and tag not in ("html", "body", "article", "main"):
            names = _WORDS.findall(" ".join(m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes)).lower())
        _, above, flags, block, depth = stack[-1]
        before = flags
        if tag in BESIDE or not BESIDE_WORDS.isdisjoint(names) or (attributes and _HIDDEN.search(attributes)):
            flags |= BESIDE_IT
        if tag in ("article", "main"):
            flags |= BELOW_IT
        if tag in RAW and not attributes.endswith("/"):
            ending = _CLOSERS[tag].search(page, at)
            at = ending.end() if ending else end
            continue
        if flags != before:
            flush()
        path = above
        if tag not in INLINE:
            path, depth = _hash(f"{tag}.{names[0]}" if names else tag, above), depth + 1
            kind = (MAY_HOLD if tag in CONTAINERS else 0) | (MARKED if tag in ("article", "main") else 0) | (ARTICLE if tag == "article" else 0)
            out.append((OPEN, path, None, flags | kind, depth))
        if tag in VOID or attributes.endswith("/"):
            if tag not in INLINE:
                out.append((CLOSE, _hash("/", path), None, flags, depth))
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append((tag, path, flags, block if tag in INLINE else len(stack), depth))
    flush()
    close(1)
    return out


def page_marks(page_id, url) -> tuple[int, int]:
    """Two numbers of 32 bits that a page adds to the occurrence vectors' sums."""
    mark = xxhash.xxh64_intdigest(f"{page_id} {url}".encode("utf-8", "surrogatepass"))
    return mark >> 32, mark & 0xFFFFFFFF


def _count_tokens(batches):
    """(host, token, pages, occurrences, two sums that tell occurrence vectors apart, characters and articles below, flags, depth, mark
    and place of the first page); token -1 is the page itself."""
    held: dict[tuple[str, int], list[int]] = {}

    def handed_on():
        keys, values = list(held), list(held.values())
        held.clear()
        return [*map(list, zip(*keys)), *map(list, zip(*values))]

    for ids, urls, pages in batches:
        for page_id, url, page in zip(ids, urls, pages):
            # Per token: occurrences, characters and articles below, flags, depth, place.
            own: dict[int, list[int]] = {-1: [1, 0, 0, 0, 0, -1]}
            chars = articles = 0
            opened: list[tuple[int, int, int]] = []
            for place, (kind, token, text, flags, depth) in enumerate(events(page)):
                row = own.setdefault(token, [0, 0, 0, flags & ~3 if kind == OPEN else 0, depth, place])
                row[0] += 1
                if kind == OPEN:
                    articles += flags & ARTICLE and not flags & BESIDE_IT
                    opened.append((token, chars, articles))
                elif kind == CLOSE:
                    above, chars_then, articles_then = opened.pop()
                    own[above][1] += chars - chars_then
                    own[above][2] += articles - articles_then
                elif not flags & BESIDE_IT:
                    chars += len(text)
            own[-1][1] = chars
            host, (one, two) = host_of(url), page_marks(page_id, url)
            for token, (n, below, inner, flags, depth, place) in own.items():
                row = held.get((host, token))
                if row is None:
                    held[host, token] = [1, n, one * n % MODULUS, two * n % MODULUS, below, inner, flags, depth, one << 31 | two >> 1, place]
                    continue
                for i, more in enumerate((1, n, one * n, two * n, below, inner)):
                    row[i] += more
                row[2:4] = row[2] % MODULUS, row[3] % MODULUS
                row[8:] = min(row[8:], [one << 31 | two >> 1, place])
        if len(held) > HELD_TOKENS:
            yield handed_on()
    if held:
        yield handed_on()


def out_of_order(places: list[int]) -> set[int]:
    """Indexes outside a longest ascending subsequence."""
    tails, ends, before = [], [], []
    for i, place in enumerate(places):
        k = bisect_left(tails, place)
        tails[k:k + 1], ends[k:k + 1] = [place], [i]
        before.append(ends[k - 1] if k else -1)
    kept, i = set(), ends[-1] if ends else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return set(range(len(places))) - kept


def faults(tokens: list[int], classes: dict[int, tuple[int, int]]) -> tuple[set[int], set[int], dict[int, set[tuple[int, int]]]]:
    """What one page says against classes: tokens out of their class's order, classes that are no classes, and where classes lie.

    ``classes`` gives (class, rank in it) of a token; a smaller class number is the stronger one. The last result names, per
    class, the innermost class around its instances and the rank of the token before them, (-1, -1) for none.
    """
    places: dict[int, dict[int, list[int]]] = {}
    for place, token in enumerate(tokens):
        if token in classes:
            places.setdefault(classes[token][0], {}).setdefault(token, []).append(place)
    stray, broken = set(), set()
    for number, found in places.items():
        ordered = sorted(found, key=lambda token: classes[token][1])
        times = {len(p) for p in found.values()}
        if len(times) > 1:
            broken.add(number)
            continue
        outside = set()
        for i in range(times.pop()):
            column = [found[token][i] for token in ordered]
            if any(a > b for a, b in zip(column, column[1:])):
                outside |= {ordered[k] for k in out_of_order(column)}
        stray |= outside
        left = [found[token] for token in ordered if token not in outside]
        if left and any(last > first for last, first in zip(left[-1], left[0][1:])):
            broken.add(number)
    last = {}
    for number, found in places.items():
        left = [token for token in found if token not in stray]
        if left and number not in broken:
            last[number] = max(classes[token][1] for token in left)
    around: dict[int, set[tuple[int, int]]] = {}
    running: list[list[int]] = []
    inside: set[int] = set()
    for token in tokens:
        number, rank = classes.get(token, (-1, 0))
        if number not in last or number in broken or token in stray:
            continue
        while number in inside and running[-1][0] != number:
            # The class on top began inside this one's gap and is not at its end: they cross.
            weaker = max(running[-1][0], number)
            broken.add(weaker)
            if weaker == number:
                break
            inside.discard(running.pop()[0])
        if number in broken:
            inside.discard(number)
            running = [r for r in running if r[0] != number]
            continue
        if number not in inside:
            around.setdefault(number, set()).add(tuple(running[-1]) if running else (-1, -1))
            running.append([number, rank])
            inside.add(number)
        running[-1][1] = rank
        if rank == last[number]:
            inside.discard(running.pop()[0])
    return stray, broken, around


def _check_classes(batches):
    """(host, token or null, class, around, gap): stray tokens, broken classes (no token) and places of classes (around is not null)."""
    for ids, urls, pages, token_lists, class_lists, rank_lists in batches:
        said = set()
        for url, page, tokens, numbers, ranks in zip(urls, pages, token_lists, class_lists, rank_lists):
            known = dict(zip(tokens, zip(numbers, ranks)))
            stray, broken, around = faults([e[1] for e in events(page)], known)
            host = host_of(url)
            said |= {(host, token, known[token][0], None, None) for token in stray}
            said |= {(host, None, number, None, None) for number in broken}
            said |= {(host, None, number, *where) for number, found in around.items() for where in found}
        if said:
            yield [list(c) for c in zip(*said)]


def _rows(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    ready(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias("__id"), F.col(url).alias("__url"), F.coalesce(F.col(source), F.lit("")).alias("__page"))


def _with_hosts(rows: DataFrame, known: DataFrame, tokens: int, how: str) -> DataFrame:
    """Pages with what is known of their host; ``tokens`` is the measured size of what is known."""
    host = F.lower(F.regexp_extract(F.coalesce("__url", F.lit("")), _HOST.pattern, 1))
    known = F.broadcast(known) if tokens <= BROADCAST_TOKENS else known
    return rows.withColumn("__host", host).join(known.withColumnRenamed("host", "__host"), "__host", how)


def classes(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(host, class, rank, token, around, gap, …) of every token of every valid class: the template trees of all hosts.

    ``around`` is the class in whose gap after rank ``gap`` all instances of a class lie; -1 if none, null if it differs.
    Only tokens on at least half of a host's pages are gathered, so a host's template is no longer than two average pages.
    """
    rows = _rows(pages, key, url, source)
    sums, firsts = ("pages", "n", "one", "two", "chars", "inner"), ("flags", "depth")
    schema = ", ".join(f"{c} long" for c in ("token", *sums, *firsts, "mark", "place"))
    counted = map_rows(rows, _count_tokens, f"host string, {schema}").groupBy("host", "token").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in firsts], F.min(F.struct("mark", "place"))["place"].alias("place")
    )
    counted = counted.withColumns({c: F.col(c) % MODULUS for c in ("one", "two")})
    counted = cut_lineage(counted.filter(F.col("pages") >= MIN_PAGES))
    whole = counted.filter("token = -1").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    frequent = counted.filter("token <> -1").join(whole, "host").filter(F.col("pages") >= SUPPORT * F.col("all_pages"))
    # Tokens of equal vectors are on the same pages, so the first of these pages gives the order of them all.
    fields = ("place", "token", "n", "chars", "inner", "flags", "depth")
    found = frequent.groupBy("host", "one", "two", "all_chars").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct(*fields))).alias("tokens"))
    found = found.filter(F.size("tokens") >= MIN_SIZE)
    # Numbered per host by strength; a host has no more classes than an average page has tokens.
    strength = F.struct((-F.col("pages")).alias("p"), (-F.size("tokens")).alias("s"), "one", "two", "all_chars", "pages", "tokens")
    found = found.groupBy("host").agg(F.sort_array(F.collect_list(strength)).alias("found")).select("host", F.posexplode("found").alias("class", "c"))
    found = found.select("host", "class", "c.all_chars", "c.pages", F.posexplode("c.tokens").alias("rank", "t"))
    found = cut_lineage(found.select("host", "class", "rank", "all_chars", "pages", "t.*"))
    per_host = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class", "rank"))).alias("t"))
    per_host = per_host.select("host", F.col("t.token").alias("tokens"), F.col("t.class").alias("classes"), F.col("t.rank").alias("ranks"))
    joined = _with_hosts(rows, per_host, found.count(), "inner").select("__id", "__url", "__page", "tokens", "classes", "ranks")
    said = cut_lineage(map_rows(joined, _check_classes, "host string, token long, class int, around int, gap int").distinct())
    stray = said.filter("token is not null").select("host", "token")
    broken = said.filter("token is null and around is null").select("host", "class")
    one_place = F.when(F.count(F.lit(1)) == 1, F.first("around")).alias("around"), F.when(F.count(F.lit(1)) == 1, F.first("gap")).alias("gap")
    nested = said.filter("around is not null").groupBy("host", "class").agg(*one_place)
    valid = found.join(broken, ["host", "class"], "left_anti").join(stray, ["host", "token"], "left_anti")
    large = valid.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= MIN_SIZE)
    return valid.join(large, ["host", "class"]).join(nested, ["host", "class"], "left")


def templates(found: DataFrame) -> DataFrame:
    """(host, content, marked, tokens) per host with a template, from its ``classes``: the content node and whether it is an article or main element.

    The content node is the deepest article or main element, once on its pages, with most of the host's text and without several
    articles in it; else the deepest such container; of equal depth the one with the largest token.
    """
    may = (F.col("n") == F.col("pages")) & (F.col("chars") >= CONTENT_SHARE * F.col("all_chars"))
    marked = (F.col("flags").bitwiseAND(MARKED) > 0) & (F.col("inner") <= F.col("pages"))
    node = F.when(may & (F.col("flags").bitwiseAND(MAY_HOLD) > 0), F.struct(marked.alias("marked"), "depth", "token"))
    return found.groupBy("host").agg(F.max(node).alias("node"), F.collect_list("token").alias("tokens")).select(
        "host", F.col("node.token").alias("content"), F.col("node.marked").alias("marked"), "tokens"
    )


def slots(page: str, content: int | None, template: frozenset[int]) -> list[tuple[int, str, int, bool, bool]]:
    """(slot, text, flags, in the content node, constant wording) of the texts of a page; a slot is named by the template's token before it."""
    out, slot, inside = [], -1, 0
    ending = None if content is None else _hash("/", content)
    for kind, token, text, flags, _ in events(page):
        if kind == OPEN and token == content:
            inside += 1
        elif kind == CLOSE and token == ending:
            inside -= 1
        if kind == TEXT:
            out.append((slot, text, flags, inside > 0, token in template))
        if token in template:
            slot = token
    return out


def main_text(page: str, content: int | None = None, marked: bool = False, template: frozenset[int] = frozenset()) -> str:
    """The text of the slots in the content node; where the page lacks one, of article or main, else of all slots.

    An article or main element as content node is one slot. In other nodes constant runs are left out, unless they are most of
    the node's text: then the page is a copy of others, and nothing is.
    """
    found = [s for s in slots(page, content, template) if not s[2] & BESIDE_IT]
    below = [s for s in found if s[3]]
    if below and marked:
        return " ".join(s[1] for s in below)
    if not below:
        inside = [s[1] for s in found if s[2] & BELOW_IT]
        if inside:
            return " ".join(inside)
        below = found
    kept = [s[1] for s in below if not s[4]]
    if 2 * sum(map(len, kept)) < sum(len(s[1]) for s in below):
        kept = [s[1] for s in below]
    return " ".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    A null or empty page, and one without article text, gives empty text; a null url is a host of its own
    name; pages of a host with under ``MIN_PAGES`` pages have no template and are read by their tags alone; repeated rows stay
    repeated; an empty table gives no rows; other columns, whatever their names, are not read. Hosts may be of any size: their
    tokens are summed per task first. Pages may be of any length: time and memory are linear in it.
    """
    rows = _rows(pages, key, url, source)
    known = cut_lineage(templates(classes(pages, key, url, source)))
    tokens = known.agg(F.sum(F.size("tokens"))).first()[0] or 0

    def run(batches):
        for ids, urls, bodies, contents, marks, token_lists in batches:
            found = [main_text(b, c, bool(m), frozenset(t or ())) for b, c, m, t in zip(bodies, contents, marks, token_lists)]
            yield [ids, urls, found, [len(t) for t in found]]

    joined = _with_hosts(rows, known, tokens, "left").select("__id", "__url", "__page", "content", "marked", "tokens")
    return map_rows(joined, run, "page_id long, url string, text string, n_chars long")
