"""Main text of web pages by equivalence classes of markup and text over the pages of a host.

Tokens are tags (start and end) and texts (each run of text between tags that break it). A token's role
is its name, class and id below its containers, a text's the words themselves there. Tokens of a host that
occur equally often on the same pages - equal occurrence vectors - form a class. A class is large and
frequent when it has two tokens or more, markup among them, and is on ``SUPPORT`` of the host's different pages and some more; it is ordered
when its tokens stand in the same order wherever it occurs (tokens that change places leave it), and nested when no other
class crosses it and it always stands in the same gap of the class around it. Valid classes nest into the host's template; its
gaps are the slots. Texts that are tokens of the template (banners, boxes, footers, whatever they are called) go, the
texts in the slots are extracted in page order.

What varies from page to page and still is no article - menus, adverts, forms, comments - is no matter of
statistics alone: slots whose text is mostly links go by their host's counts, elements made for such things
by their name or role.

Vectors are never spelled out: pages add hashes to sums, so Spark adds before any shuffle
and a host with a third of all pages is no heavier than others. Pages are parsed once.
"""

from __future__ import annotations

import html as markup
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged

#: A class belongs to the template when it is on this share of a host's different pages and on ``MARGIN`` pages more. What
#: few pages have in common may be their own; it goes for its elements and names alone.
SUPPORT, MARGIN = 0.5, 4
#: A slot with more than this share of its characters inside links is a menu.
LINKED = 0.5
#: Templates are broadcast up to this many tokens (32 bytes each); beyond it both sides are shuffled, with ``SALTS`` parts of a host.
MOST_TOKENS = 2_000_000
SALTS = 32

# Elements by how they take part in a page.
RAW = "script style title noscript iframe template svg math object textarea xmp noembed".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set(
    "html head body nav header footer aside main article section div form ul ol dl table tbody thead tfoot figure fieldset details dialog menu blockquote center address select button search".split()
)
SELF_CLOSING = set("p li dt dd tr td th option".split())
DROPPED_TAGS = set("head nav footer aside form dialog menu select button search".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ADVERTS = set("ad ads adv advert adverts advertisement advertisements adsense adslot adsbygoogle sponsor sponsored sponsors promo promos promotion".split())
DROPPED_WORDS = ADVERTS | set(
    "banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations newsletter subscribe signup login search widget widgets toolbar skip".split()
)
#: Words that tell whatever else is in the name, as in ``reader-comments`` or ``ad-banner-728x90``.
COMMENTS = set("comment comments commentlist disqus".split())
TELLING = ADVERTS | COMMENTS | set("cookie cookies consent gdpr newsletter breadcrumb breadcrumbs pagination".split())
#: Before such a word they speak of the page around.
RELATIONS = set("has no not with without is".split())
#: An aside of an article with such a name is part of its text.
QUOTES = set("pullquote quote blockquote callout".split())
#: Words that say nothing of their own in the name of such an element, as in ``main-menu`` or ``ad-box``.
PLACE_WORDS = set(
    "site page main global top bottom left right primary secondary inner outer box block list area section wrap wrapper container bar item items "
    "link links icons button buttons form post posts article entry recent popular latest follow media mobile desktop sticky slot unit inline title body text".split()
)
#: Names of the elements that hold articles; none of them is left out for its other names.
CONTENT_NAMES = set("content main article post entry story".split())
#: These words mark a page's own head and foot, outside an article.
OUTER_WORDS = set("header masthead footer topbar".split())
OUTER_PLACES = set("site page main global top bottom primary wrap wrapper container bar inner outer".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>|<[!?/](?![a-zA-Z])[^>]*>|(<(?=[a-zA-Z/!?]))", re.S
)
#: After a tag whose quotes never close, tags end at their first ``>``.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>", re.S)
#: One attribute, its value consumed whole; nothing is looked for inside names and values.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_READ = {"class", "id", "role", "hidden", "aria-hidden"}
_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", re.I)

HARD, BY_FORM, ARTICLE = 1, 2, 4
_LISTS = [("places", "int"), ("texts", "string"), ("flags", "int"), ("linked", "int"), ("articles", "int")]
_PARSED = "page_id long, url string, host string, row long, looks long, tokens array<long>, " + ", ".join(f"{k} array<{t}>" for k, t in _LISTS)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


@lru_cache(1 << 16)
def _named(name: str, words: str) -> bool:
    """Whether a class or id name tells of ``words`` (``dropped``, ``adverts``, ``remarks``, ``outer``): by a telling part, or as it speaks of nothing but these and places."""
    parts = [p for p in re.split("[^a-z]+", name) if p]
    telling = {"dropped": TELLING, "adverts": ADVERTS, "remarks": ADVERTS | COMMENTS, "outer": set()}[words]
    if any(p in telling for p in parts) and RELATIONS.isdisjoint(parts):
        return True
    own, places = (OUTER_WORDS, OUTER_PLACES) if words == "outer" else (DROPPED_WORDS if words == "dropped" else telling, PLACE_WORDS)
    return any(p in own for p in parts) and all(p in own or p in places for p in parts)


def _says(names: list[str], words: str) -> bool:
    return any(_named(n, words) for n in names) and CONTENT_NAMES.isdisjoint(names)


def _attributes(text: str) -> tuple[str, list[str], bool]:
    """The part of a role that attributes give, the names of class and id, and whether an attribute drops the element."""
    role, names, out = "", [], False
    for m in _ATTRIBUTE.finditer(text):
        kind = m[1].lower()
        if kind not in _READ:
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if kind in ("class", "id"):
            role += ("." if kind == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split()))
            names += value.split()
        elif kind == "role":
            out = out or value.strip() in DROPPED_ROLES
        elif kind == "hidden" or value == "true":
            out = True
    return role, names, out


def _tokens(source: str):
    """``(start, end, closing, tag, attributes)`` of each piece of markup, in linear time; raw elements are one piece without a tag."""
    at, pattern = 0, _TAG
    while True:
        m = pattern.search(source, at)
        if m is None:
            return
        if pattern is _TAG and m[4]:
            pattern = _PLAIN
            at = m.start()
            if source.find(">", at) < 0:
                # no tag can end any more; only a comment can still open
                at = source.find("<!--", at)
                if at >= 0:
                    yield at, len(source), False, None, ""
                return
            continue
        (start, at), tag = m.span(), m[2]
        if not tag:
            yield start, at, False, None, ""
        elif (tag := tag.lower()) in _END and not m[1]:
            end = _END[tag].search(source, at)
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or len(source)
            yield start, at, False, None, ""
        else:
            yield start, at, bool(m[1]), tag, m[3]
        if pattern is _PLAIN and source.find(">", at) < 0:
            at = source.find("<!--", at)
            if at >= 0:
                yield at, len(source), False, None, ""
            return


def _left_out(tag: str, names: list[str], article: bool) -> int:
    """Whether an element goes for what it is."""
    if tag in ("html", "body", "main"):
        return 0
    if tag == "article":
        return HARD * _says(names, "dropped")
    if tag in CONTAINERS:
        if tag == "form":
            return BY_FORM
        if tag == "aside" and article and any(p in QUOTES for n in names for p in re.split("[^a-z]+", n)):
            return 0
        out = tag in DROPPED_TAGS or _says(names, "dropped") or not article and (tag == "header" or _says(names, "outer"))
        return HARD * out
    return HARD * _says(names, "dropped" if not article else "adverts" if tag in INLINE else "remarks")


class Page:
    """Tokens of one page in order, odd ones texts, and its texts: place among the tokens, words, flags, characters in links, outermost article."""

    def __init__(self, source: str) -> None:
        self.tokens: list[int] = []
        self.places: list[int] = []
        self.texts: list[str] = []
        self.flags: list[int] = []
        self.linked: list[int] = []
        self.articles: list[int] = []
        # tag, path, flags, article
        stack: list[tuple[str, int, int, int]] = [("", 1, 0, 0)]
        opened: dict[str, int] = {}
        pieces: list[str] = []
        in_links: list[str] = []
        links = at = 0

        def close() -> None:
            if not pieces:
                return
            text = " ".join("".join(map(markup.unescape, pieces)).split())
            if text:
                _, path, flags, article = stack[-1]
                self.articles.append(article)
                self.places.append(len(self.tokens))
                self.texts.append(text)
                self.flags.append(flags)
                self.linked.append(len(" ".join("".join(map(markup.unescape, in_links)).split())) if in_links else 0)
                self.tokens.append(xxhash.xxh64_intdigest(text, path) | 1)
            pieces.clear()
            in_links.clear()

        def push(tag: str, path: int, flags: int, article: int) -> None:
            stack.append((tag, path, flags, article))
            opened[tag] = opened.get(tag, 0) + 1

        def pop() -> None:
            opened[stack.pop()[0]] -= 1

        for start, end, closing, tag, attributes in _tokens(source):
            if start > at:
                pieces.append(source[at:start])
                if links:
                    in_links.append(pieces[-1])
            at = end
            if tag is None:
                continue
            top = stack[-1]
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links + (-1 if closing else 1))
                elif closing and top[0] == tag:
                    close()
                    pop()
                elif attributes and not closing and _left_out(tag, _attributes(attributes)[1], bool(top[2] & ARTICLE)):
                    close()
                    push(tag, top[1], top[2] | HARD, top[3])
                continue
            close()
            if closing:
                links = 0
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                self.tokens.append(xxhash.xxh64_intdigest("/" + tag, stack[-1][1]) & ~1)
                continue
            role, names, out = _attributes(attributes) if attributes else ("", [], False)
            while len(stack) > 1 and stack[-1][0] in SELF_CLOSING and (stack[-1][0] in ("p", tag) or tag in ("tr", "li")):
                pop()
            _, path, flags, article = stack[-1]
            own = xxhash.xxh64_intdigest(tag + role, path) & ~1
            self.tokens.append(own)
            if tag in VOID:
                continue
            gone = HARD * out | _left_out(tag, names, bool(flags & ARTICLE))
            if tag in ("main", "article") and not gone:
                # a form around a whole page holds its article all the same
                flags, article = flags & ~BY_FORM | ARTICLE, article or len(self.tokens)
            if tag in CONTAINERS:
                push(tag, own, flags | gone, article)
            elif gone:
                push(tag, path, flags | HARD, article)
        if at < len(source):
            pieces.append(source[at:])
        close()


def _parse(batches):
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        pages = [Page(s or "") for s in batch.column("html").to_pylist()]
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        tokens = [np.array(p.tokens, np.uint64).view(np.int64) for p in pages]
        looks = [xxhash.xxh64_intdigest(t.tobytes()) - (1 << 63) for t in tokens]
        kinds = {"int": pa.int32(), "string": pa.string()}
        lists = [pa.array([getattr(p, k) for p in pages], pa.list_(kinds[t])) for k, t in _LISTS]
        rows = pa.array(np.arange(row, row + len(pages)))
        row += len(pages)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), rows, pa.array(looks, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), *lists],
            names=["page_id", "url", "host", "row", "looks", "tokens", *(k for k, _ in _LISTS)],
        )


def _vectors(batches):
    """For each host and token of a batch: pages, occurrences and the sums that stand for its occurrence vector; token 0 counts pages."""
    for batch in batches:
        lists, hosts = batch.column("tokens"), batch.column("host").dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        page = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.arange(len(sizes))])
        token = np.concatenate([lists.flatten().to_numpy(), np.zeros(len(sizes), np.int64)])
        order = np.lexsort((token, page))
        page, token = page[order], token[order]
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (token[1:] != token[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(page)))
        page, token = page[at], token[at]
        # a page's key: what stands on it
        flat, starts = mix64(token.view(np.uint64)), np.searchsorted(page, np.arange(len(sizes)))
        key = np.add.reduceat(flat, starts) if len(starts) else flat
        mixed = mix64(key[page] + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        host = hosts.indices.to_numpy()[page]
        order = np.lexsort((token, host))
        host, token, times, mixed = host[order], token[order], times[order], mixed[order]
        first = np.ones(len(host), bool)
        first[1:] = (host[1:] != host[:-1]) | (token[1:] != token[:-1])
        at = np.flatnonzero(first)
        add = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else x.astype(np.int64)
        columns = [np.diff(np.append(at, len(host))), add(times), add(mixed & np.uint64(0xFFFFFFFF)), add(mixed >> np.uint64(32))]
        yield pa.RecordBatch.from_arrays(
            [hosts.dictionary.take(pa.array(host[at])), pa.array(token[at]), *map(pa.array, columns)], names=["host", "token", "pages", "times", "low", "high"]
        )


def classes(parsed: DataFrame) -> DataFrame:
    """``host, class, token, size``: the large and frequent equivalence classes of each host."""
    parts = parsed.select("host", "tokens").mapInArrow(_vectors, "host string, token long, pages long, times long, low long, high long")
    found = parts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "low", "high"))).where(f"pages > {MARGIN}")
    found = staged(found, "vectors")
    total = found.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    often = found.where("token <> 0").join(total, "host").where(f"pages >= {SUPPORT} * all_pages + {MARGIN}")
    same = often.groupBy("host", "pages", "times", "low", "high").agg(F.sort_array(F.collect_list("token")).alias("members"))
    large = same.where(F.size("members") > 1).where(F.exists("members", lambda t: t.bitwiseAND(F.lit(1)) == 0))
    return large.select("host", F.col("members")[0].alias("class"), F.explode("members").alias("token"), F.size("members").cast("long").alias("size"))


@lru_cache(4096)
def _decoded(template: bytes) -> dict[int, tuple[int, int, int]]:
    rows = np.frombuffer(template, np.int64).reshape(-1, 4).tolist()
    return {t: (c, i, n) for t, c, i, n in rows}


def _templates_of(batch) -> list[dict]:
    lists = batch.column("template")
    values, offsets = lists.values.to_numpy() if len(lists) else np.zeros(0, np.int64), lists.offsets.to_numpy()
    return [_decoded(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]


def _with_template(parsed: DataFrame, template: DataFrame, small: bool) -> DataFrame:
    """``parsed`` and the tokens of its host's template ``(host, token, class, place, size)`` as one flat list, empty where there is none."""
    row = F.array("token", "class", "place", "size")
    packed = template.groupBy("host").agg(F.flatten(F.sort_array(F.collect_list(row))).alias("template"))
    return _by_host(parsed, packed, small).withColumn("template", F.coalesce("template", F.array().cast("array<long>")))


def _by_host(parsed: DataFrame, hosts: DataFrame, small: bool) -> DataFrame:
    """``parsed`` with what ``hosts`` has for each host: broadcast where it is small, else shuffled with the rows of a host dealt into ``SALTS`` parts."""
    if small:
        return parsed.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parsed.withColumn("_salt", F.pmod(F.hash("url", "tokens"), F.lit(SALTS))).join(salted, ["host", "_salt"], "left").drop("_salt")


def _extremes(found: dict, names: list[str], kinds: list):
    """Rows ``(host, key, least, greatest)`` of a batch."""
    rows = [(h, k, a, b) for (h, k), (a, b) in found.items()]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _note(found: dict, key, value: int) -> None:
    have = found.get(key)
    found[key] = (value, value) if have is None else (min(have[0], value), max(have[1], value))


def _orders(batches):
    """The least and greatest place of each token of a class among the class's tokens; -1 where it does not repeat as a whole."""
    for batch in batches:
        found: dict = {}
        for host, tokens, template in zip(batch.column("host").to_pylist(), batch.column("tokens"), _templates_of(batch)):
            seen: dict[int, list[int]] = {}
            for t in tokens.values.to_pylist() if template else ():
                if t in template:
                    seen.setdefault(template[t][0], []).append(t)
            for c, own in seen.items():
                n = template[own[0]][2]
                whole = len(own) % n == 0 and all(own[k] == own[k - n] for k in range(n, len(own))) and len(set(own[:n])) == n
                for i, t in enumerate(own[:n]):
                    _note(found, (host, t), i if whole else -1)
        yield _extremes(found, ["host", "token", "least", "greatest"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])


def _gap(c: int, place: int) -> int:
    """The name of the gap of class ``c`` after its token ``place``."""
    return int(mix64(np.array([(c + (place + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


_gap = lru_cache(1 << 16)(_gap)
NO_GAP, CROSSED = 0, 1


class Scan:
    """The gap of the innermost open class while the tokens of a page go by."""

    def __init__(self, template: dict) -> None:
        self.template, self.open, self.parents, self.crossed = template, [], [], set()
        self.gap = NO_GAP

    def step(self, token: int) -> bool:
        """Take a token; whether it is one of the template."""
        at = self.template.get(token)
        if at is None:
            return False
        c, place, size = at
        if place == 0:
            self.parents.append((c, self.gap))
            self.open.append([c, 0])
        else:
            if not self.open or self.open[-1] != [c, place - 1]:
                self.crossed.add(c)
                if self.open:
                    self.crossed.add(self.open[-1][0])
                while self.open and self.open[-1][0] != c:
                    self.open.pop()
                if not self.open:
                    self.open.append([c, place])
            self.open[-1][1] = place
            if place == size - 1:
                self.open.pop()
        self.gap = _gap(*self.open[-1]) if self.open else NO_GAP
        return True


def _nesting(batches):
    """The least and greatest gap that each class stands in; both extremes where another class crosses it."""
    for batch in batches:
        found: dict = {}
        for host, tokens, template in zip(batch.column("host").to_pylist(), batch.column("tokens"), _templates_of(batch)):
            if not template:
                continue
            scan = Scan(template)
            for t in tokens.values.to_pylist():
                scan.step(t)
            for c, gap in scan.parents:
                _note(found, (host, c), gap)
            for c in scan.crossed | {c for c, _ in scan.open}:
                _note(found, (host, c), NO_GAP)
                _note(found, (host, c), CROSSED)
        yield _extremes(found, ["host", "class", "least", "greatest"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])


def templates(parsed: DataFrame) -> tuple[DataFrame, bool]:
    """``host, token, class, place, size``: the valid classes of each host, which nest into its template; and whether it can be broadcast."""
    large = staged(classes(parsed), "classes")
    small = large.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
    read = parsed.select("host", "url", "tokens")
    places = _with_template(read, large.withColumn("place", F.lit(0).cast("long")), small).mapInArrow(_orders, "host string, token long, least long, greatest long")
    places = places.groupBy("host", "token").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    fixed = large.join(places, ["host", "token"]).where("least = greatest and least >= 0")
    # tokens that change places leave their class, the others keep their order
    members = fixed.groupBy("host", "class").agg(F.sort_array(F.collect_list(F.struct("least", "token"))).alias("members"))
    left = members.where(F.size("members") > 1).where(F.exists("members", lambda m: m.token.bitwiseAND(F.lit(1)) == 0))
    now = left.select("host", "class", F.size("members").cast("long").alias("size"), F.posexplode("members").alias("place", "m"))
    now = now.select("host", "m.token", "class", F.col("place").cast("long").alias("place"), "size")
    while True:
        now = staged(now, "template")
        gaps = _with_template(read, now, small).mapInArrow(_nesting, "host string, class long, least long, greatest long")
        gaps = gaps.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        unfit = staged(gaps.where("least <> greatest").select("host", "class"), "unfit")
        if unfit.isEmpty():
            return now, small
        # what crosses or moves goes; the others are looked at again without it
        now = now.join(unfit, ["host", "class"], "left_anti")


def _slot_texts(row_tokens, places, template: dict):
    """``(template text?, gap)`` of each text of a page."""
    if not template:
        return [(False, NO_GAP)] * len(places)
    scan, out, k = Scan(template), [], 0
    for i, t in enumerate(row_tokens):
        if k < len(places) and places[k] == i:
            gap = scan.gap
            out.append((scan.step(t), gap))
            k += 1
        else:
            scan.step(t)
    return out


def _slots(batches):
    """For each host and gap of a batch: characters of the texts in it that are not left out, and those inside links."""
    for batch in batches:
        found: dict = {}
        cols = [batch.column(c).to_pylist() for c in ("host", "tokens", "places", "flags", "sizes", "linked")]
        for host, tokens, places, flags, sizes, linked, template in zip(*cols, _templates_of(batch)):
            if template:
                for (own, gap), f, n, li in zip(_slot_texts(tokens, places, template), flags, sizes, linked):
                    if not own and not f:
                        row = found.setdefault((host, gap), [0, 0])
                        row[0] += n
                        row[1] += li
        rows = [(h, g, *v) for (h, g), v in found.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 3)], names=["host", "gap", "chars", "linked"])


def _teasers(texts, flags, linked, articles) -> set[int]:
    """Articles whose first text, their title, is a link elsewhere and that are less than half as long as the longest one."""
    size: dict[int, int] = {}
    titles: dict[int, bool] = {}
    for t, f, n, a in zip(texts, flags, linked, articles):
        if f == ARTICLE:
            titles.setdefault(a, n == len(t))
            size[a] = size.get(a, 0) + len(t)
    return {a for a, n in size.items() if titles[a] and 2 * n < max(size.values())}


def _picked(texts, flags, linked, articles, slots, menus) -> str:
    """The texts of a page's slots in order: those of its article or main elements but teasers where it has some, else all outside menus."""
    if ARTICLE in flags:
        teasers = _teasers(texts, flags, linked, articles)
        return " ".join(t for t, f, a in zip(texts, flags, articles) if f == ARTICLE and a not in teasers)
    return " ".join(t for t, f, (own, gap) in zip(texts, flags, slots) if not f and not own and gap not in menus)


def _extract(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("tokens", "places", "texts", "flags", "linked", "articles", "menus")]
        out = [
            _picked(texts, flags, linked, articles, _slot_texts(tokens, places, template), menus or ())
            for tokens, places, texts, flags, linked, articles, menus, template in zip(*cols, _templates_of(batch))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def main_text(source: str) -> str:
    """The text of one page by its elements alone, as of a host without a template."""
    page = Page(source)
    return _picked(page.texts, page.flags, page.linked, page.articles, [(False, NO_GAP)] * len(page.texts), ())


def _different(parsed: DataFrame) -> DataFrame:
    """One of all pages of a host that look alike to the last token: copies of a page say nothing about what pages have in common."""
    again = staged(parsed.groupBy("host", "looks").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "again")
    rows = parsed.select("host", "url", "looks", "row", "tokens")
    found = rows.join(F.broadcast(again) if again.count() <= MOST_TOKENS else again, ["host", "looks"], "left")
    return found.where("first is null or row = first").select("host", "url", "tokens")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html, ...)``.

    Null and empty html gives the empty text; pages whose url has no host form one group. Text of an
    article or main element is never taken for the template's own. Pages that look alike to the last token
    count once, so a host of one page, however often it comes, has no template and keeps its text. page_id and url are passed on,
    null or repeated; repeated rows each give one; no rows give none; other columns are ignored. Markup that never ends, deep
    nesting and very long pages take linear time; a tag whose quotes never close ends at its first ``>``.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = staged(rows.mapInArrow(_parse, _PARSED), "parsed")
    template, small = templates(_different(parsed))
    sized = parsed.select("host", "url", "tokens", "places", "flags", F.transform("texts", F.length).alias("sizes"), "linked")
    slots = _with_template(sized, template, small).mapInArrow(_slots, "host string, gap long, chars long, linked long")
    menus = slots.groupBy("host", "gap").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).where(f"linked > {LINKED} * chars")
    # at most one for each token of a template
    marked = staged(menus.groupBy("host").agg(F.collect_list("gap").alias("menus")), "menus")
    both = _by_host(_with_template(parsed, template, small), marked, small)
    return both.select("page_id", "url", "tokens", "places", "texts", "flags", "linked", "articles", "menus", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
