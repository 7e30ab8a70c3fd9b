"""Main text of web pages through wrappers inferred from pages of the same host.

Method: every page becomes a stream of block tags and text slots in which runs of equal sibling groups are folded into
one repeated group. The different streams of a host are aligned one after the other with the wrapper so far; a mismatch
becomes an optional group and a run a repeated group. A place of text carries the hashes of its texts and on how many of
the streams each stands: a text that stands on nine of ten streams that have the place, five at least, is template, any
other is content of a slot. The result is a union-free regular expression of the host's pages; its places carry their
path of elements (names and classes). Its slots also choose a region: the deepest element that holds four fifths of
the varying text which stands on nearly all pages; headlines outside of it belong to it, optional groups do not.

Pages are then read again, and each is judged by itself. It gives the texts inside its article (or main) element, or,
if there are none, those in the region and in no boilerplate element, or those in no boilerplate element. Template
texts among them go, unless they are more than half of the texts or two thirds of the characters: then the page is a
near copy of others, and what it shares with them is its article.

Bounds: a group of streams aligned in one task has about 2,000 streams or 16 MB; its wrapper keeps the texts of half of
its streams, and wrappers are aligned 200 at a time. Equal streams of a host (copies of a page) count once.

Defined cases: null html is an empty page with an empty text; a page without a usable url is compared with no other
page; broken markup is read leniently (an unclosed paragraph ends at the next block, an open head at the first element or
text that cannot be in it, a tag without an end is text) and forwards only, in a time that grows with its length; html,
body and main are never boilerplate, an article only as a reader's comment; text inside a block keeps its order, white
space becomes one space, blocks are joined by one space; rows are read one by one; an input column that bears a
result's name is replaced.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import packed, same, stored, unpacked

RESULTS = ("text", "n_chars")
#: Fixed element names. Unknown elements count as blocks.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
                   " strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math canvas object iframe head title textarea select option"
                   " button".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
CLOSED_BY_BLOCK = frozenset(("p",))
#: Words of class and id names. A name is boilerplate if it begins or ends with a word of the first kind, or if it
#: consists of words of either kind and words of place; names with a word of the last line say that something is missing.
NAMES = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|popup|modal|comments?|commenters?"
                   r"|repl(?:y|ies)|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|newsletter|subscribe|login")
NARROW = re.compile(r"notices?|share|social|related|header")
BESIDE = frozenset("site page main top bottom list item area box bar block section widget post posts primary secondary"
                   " links buttons inner outer wrapper container content articles media icons".split())
MISSING = frozenset("has have no not non with without is hide hidden free".split())
NEVER_BOILERPLATE = frozenset("html body main".split())
HEAD_CONTENT = frozenset("script style noscript template title".split())
COMMENT = re.compile(r"comments?|repl(?:y|ies)")
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile("[>\"']")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "textarea", "title")}
#: Elements that a region may be.
REGIONS = frozenset("html body div section center table tbody tr td".split())
HEADLINES = frozenset("h1 h2".split())
SLOT = "#"
DEEPEST = 150
#: Streams and bytes of a group, wrappers aligned at a time.
GROUP, GROUP_BYTES, FAN_IN = 2000, 16 << 20, 200
#: The share of streams, and the least number of them, that make a text template or a place one of nearly all pages;
#: the share of the varying text that a region holds.
TEMPLATE_SHARE, LEAST_STREAMS, REGION_SHARE = 0.9, 5, 0.8


def name_words(token: str) -> list[str]:
    return [w.lower() for w in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token)) if w]


def names_boilerplate(label: str) -> bool:
    """Whether a token of the label is a boilerplate name."""
    for token in label.split():
        words = name_words(token)
        if not words or MISSING & set(words):
            continue
        if NAMES.fullmatch(words[0]) or NAMES.fullmatch(words[-1]):
            return True
        known = [bool(NAMES.fullmatch(w) or NARROW.fullmatch(w)) for w in words]
        if any(known) and all(k or w in BESIDE for k, w in zip(known, words)):
            return True
    return False


def element(name: str, attributes: str) -> str:
    """An element in a path: its name, a dot and its classes (or id) with digits alike; ! marks boilerplate, * the main
    region."""
    said = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)} if attributes.strip() else {}
    label = f"{said.get('class', '')} {said.get('id', '')}"
    plain = re.sub(r"[^a-z0-9 _-]", "", re.sub(r"\d+", "0", (said.get("class") or said.get("id") or "").lower())).split()
    whole = ".".join([name, *plain])[:60].rstrip(".")
    if name == "article":
        said_by_reader = any(words and COMMENT.fullmatch(words[0]) for words in map(name_words, label.split()))
        return f"{whole}!" if said_by_reader else f"{whole}*"
    if name in BOILERPLATE or name == "header" or name not in NEVER_BOILERPLATE and names_boilerplate(label):
        return f"{whole}!"
    return f"{whole}*" if name == "main" or said.get("role", "").lower() == "main" else whole


def base(item: str) -> str:
    """The element's name."""
    return item.partition(".")[0].rstrip("!*")


def read(page: str) -> Iterator[tuple[str, str]]:
    """('open', element), ('close', name) and ('text', characters) of the body's blocks, in order.

    Every character is passed once: a quote is one only if it is closed later on, and where a tag has no end, no later
    one has.
    """
    size, at = len(page), 0
    last = {c: page.rfind(c) for c in "\"'"}
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            yield "text", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        found = TAG_NAME.match(page, start + 1)
        if not found:
            yield "text", "<"
            at = start + 1
            continue
        end = found.end()
        while (stop := TAG_STOP.search(page, end)) and stop[0] != ">":
            closed = last[stop[0]] > stop.start()
            end = page.find(stop[0], stop.end()) + 1 if closed else stop.end()
        if not stop:
            at = start
            break
        attributes, at, name = page[found.end():stop.start()], stop.end(), found[2].lower()
        if name in RAW and not found[1]:
            over = RAW[name].search(page, at)
            end = page.find(">", over.end()) if over else -1
            at = end + 1 if end >= 0 else size
        elif name in ("br", "hr"):
            yield "text", "\n"
        elif name not in INLINE and name not in VOID:
            yield ("close", name) if found[1] else ("open", element(name, attributes))
    if at < size:
        yield "text", page[at:]


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str | None]]:
    """(path, text) of every block of text; (path, None) where an element opens or ends."""
    path: list[str] = []
    held: list[str] = []

    def flush() -> list[tuple[tuple[str, ...], str]]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return [(tuple(path), text)] if text else []

    for kind, what in read(page):
        if path and base(path[-1]) == "head" and (
                what.strip() if kind == "text" else kind == "open" and base(what) not in HEAD_CONTENT):
            yield from flush()
            path.pop()
            yield tuple(path), None
        elif kind == "open" and base(what) == "body":
            heads = [k for k, x in enumerate(path) if base(x) == "head"]
            if heads:
                yield from flush()
                del path[heads[0]:]
                yield tuple(path), None
        if kind == "text":
            held.append(what)
            continue
        yield from flush()
        if kind == "open":
            if path and base(path[-1]) in CLOSED_BY_BLOCK:
                path.pop()
                yield tuple(path), None
            if len(path) < DEEPEST:  # what is nested deeper counts as text of the last level
                path.append(what)
            yield tuple(path), None
        else:
            names = [base(x) for x in path]
            if what in names:
                del path[len(names) - 1 - names[::-1].index(what):]
                yield tuple(path), None
    yield from flush()


def silent(path: tuple[str, ...]) -> bool:
    return any(base(x) in SILENT for x in path)


def text_hash(text: str) -> str:
    """Sixteen digits of a hash, and the number of characters."""
    return f"{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}{len(text):x}"


def hashed_chars(known: str) -> int:
    return int(known[16:], 16)


def tree_stream(page: str, texts: bool = False) -> list:
    """The page as nested items: text slots, elements ["<", name, items] and groups, runs of like siblings folded.

    With texts, a slot is ["#", streams that have it, {hash of a text: streams with this text}, characters].
    """
    root: list = []
    stack: list[tuple[tuple[str, ...], list]] = [((), root)]
    for path, text in blocks(page):
        if silent(path):
            continue
        while stack[-1][0] != path[:len(stack[-1][0])]:
            stack.pop()
        while len(stack[-1][0]) < len(path):
            here = path[:len(stack[-1][0]) + 1]
            inside: list = []
            stack[-1][1].append(["<", here[-1], inside])
            stack.append((here, inside))
        if text is None:  # an element has opened or ended: the next one of this name is another one
            stack[:] = stack[:len(path) + 1]
        else:
            stack[-1][1].append([SLOT, 1, {text_hash(text): 1}, len(text)] if texts else SLOT)
    return fold(root)


def fold(items: list) -> list:
    """Runs of siblings of one name become one repeated group; their insides are aligned."""
    out: list = []
    for item in items:
        made = item if item[0] == SLOT else ["<", item[1], fold(item[2])]
        if not out or key(out[-1]) != key(made):
            out.append(made)
        elif made[0] == SLOT:
            out[-1] = merged(out[-1], made, True)
        else:
            out[-1] = ["+", merged(out[-1], made, True)]
    return out


def key(item) -> str:
    """What an item matches: a slot, or an element's name, whatever group it is in."""
    while item[0] in ("+", "?", "*"):
        item = item[1]
    return SLOT if item[0] == SLOT else item[1]


def bare(item):
    return item[1] if item[0] in ("+", "?", "*") else item


def merged(a, b, one_page: bool = False):
    """One slot or element for two of a key, of one page or of different ones; the counts of a's slots are changed."""
    x, y = bare(a), bare(b)
    if SLOT in (x, y):
        return SLOT
    if x[0] == SLOT:
        x[3] += y[3]
        if one_page:
            x[2].update(y[2])
            return x
        for text, n in y[2].items():
            x[2][text] = x[2].get(text, 0) + n
        x[1] += y[1]
        return x
    return ["<", x[1], align(x[2], y[2], one_page)]


def grouped(a, b, one_page: bool = False):
    """Two matching items as one: optional, repeated or both, as either is."""
    kinds = {a[0], b[0]}
    optional, repeated = bool(kinds & {"?", "*"}), bool(kinds & {"+", "*"})
    inner = merged(a, b, one_page)
    return [{(True, True): "*", (True, False): "?", (False, True): "+"}[optional, repeated], inner] if optional or repeated else inner


def optional(item):
    return item if item[0] in ("?", "*") else ["*", item[1]] if item[0] == "+" else ["?", item]


def align(wrapper: list, sample: list, one_page: bool = False) -> list:
    """The wrapper generalised so that it also covers the sample."""
    out: list = []
    i = j = 0
    while i < len(wrapper) and j < len(sample):
        w, s = key(wrapper[i]), key(sample[j])
        if w == s:
            out.append(grouped(wrapper[i], sample[j], one_page))
            i, j = i + 1, j + 1
            continue
        ahead = next((k for k in range(j + 1, len(sample)) if key(sample[k]) == w), None)
        behind = next((k for k in range(i + 1, len(wrapper)) if key(wrapper[k]) == s), None)
        if behind is not None and (ahead is None or behind - i <= ahead - j):
            out += map(optional, wrapper[i:behind])
            i = behind
        elif ahead is not None:
            out += map(optional, sample[j:ahead])
            j = ahead
        else:
            out += [optional(wrapper[i]), optional(sample[j])]
            i, j = i + 1, j + 1
    return out + [optional(x) for x in (*wrapper[i:], *sample[j:])]


def slots(wrapper: list, path: tuple[str, ...] = ()) -> set[tuple[str, ...]]:
    """Paths of all text slots of a wrapper."""
    found: set[tuple[str, ...]] = set()
    for item in map(bare, wrapper):
        found |= {path} if item[0] == SLOT else slots(item[2], (*path, item[1]))
    return found


def template_texts(wrapper: list, path: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Hashes of the texts that are template, by path."""
    found: dict[str, list[str]] = {}
    for item in map(bare, wrapper):
        if item == SLOT:
            continue
        if item[0] == SLOT:
            more = {"/".join(path): [t for t, n in item[2].items() if n >= max(LEAST_STREAMS, TEMPLATE_SHARE * item[1])]}
        else:
            more = template_texts(item[2], (*path, item[1]))
        for place, texts in more.items():
            if texts:
                found[place] = sorted({*found.get(place, ()), *texts})
    return found


def pruned(wrapper: list) -> list:
    """The wrapper with only those texts that stand on half of the streams that have their slot."""
    for item in map(bare, wrapper):
        if item == SLOT:
            continue
        if item[0] == SLOT:
            item[2] = {t: n for t, n in item[2].items() if 2 * n >= item[1]}
        else:
            pruned(item[2])
    return wrapper


def places(wrapper: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(path, streams that have it, characters that vary) of every slot."""
    for item in map(bare, wrapper):
        if item[0] == SLOT:
            steady = sum(n * hashed_chars(t) for t, n in item[2].items() if n >= TEMPLATE_SHARE * item[1])
            yield path, item[1], item[3] - steady
        else:
            yield from places(item[2], (*path, item[1]))


def region(wrapper: list) -> dict | None:
    """The element that holds most of the varying text of nearly all pages, and the headlines beside it.

    None if the host has too few streams to tell, or if no element below the body holds so much.
    """
    found = [x for x in places(wrapper) if outside(x[0])]
    streams = max((n for _, n, _ in found), default=0)
    if streams < LEAST_STREAMS:
        return None
    steady = [(path, varying) for path, n, varying in found if n >= TEMPLATE_SHARE * streams and varying > 0]
    total = sum(v for _, v in steady)
    held: dict[tuple[str, ...], int] = {}
    for path, varying in steady:
        for depth in range(1, len(path) + 1):
            held[path[:depth]] = held.get(path[:depth], 0) + varying
    chosen: tuple[str, ...] = ()
    while deeper := [p for p, v in held.items() if p[:-1] == chosen and v >= REGION_SHARE * total and base(p[-1]) in REGIONS]:
        chosen = deeper[0]
    if not chosen or base(chosen[-1]) in NEVER_BOILERPLATE:
        return None
    heads = sorted({"/".join(p) for p, _ in steady if p and base(p[-1]) in HEADLINES and p[:len(chosen)] != chosen})
    return {"element": list(chosen), "heads": heads}


def inside(path: tuple[str, ...]) -> bool:
    """Whether a path leads into the main region and into no boilerplate; a header inside the region is part of it."""
    marks = [k for k, x in enumerate(path) if x.endswith("*")]
    return bool(marks) and not any(
        x.endswith("!") and not (base(x) == "header" and k > marks[0]) for k, x in enumerate(path))


def outside(path: tuple[str, ...]) -> bool:
    return not any(x.endswith("!") for x in path)


def main_texts(page: str, known: dict) -> list[str]:
    """Texts of the first region that the page has: its article, the host's region, or all that is no boilerplate.

    Template texts go, unless they are most of the page.
    """
    template, chosen = known.get("template", {}), known.get("region")
    texts = [(p, t) for p, t in blocks(page) if t is not None and not silent(p)]

    def of_host(path: tuple[str, ...]) -> bool:
        element_ = tuple(chosen["element"])
        return outside(path) and (path[:len(element_)] == element_ or "/".join(path) in chosen["heads"])

    for choice in (inside, *([of_host] if chosen else []), outside):
        found = [(p, t) for p, t in texts if choice(p)]
        if not found:
            continue
        own = [t for p, t in found if text_hash(t) not in template.get("/".join(p), ())]
        size = sum(len(t) for _, t in found)
        if 2 * len(own) >= len(found) and 3 * sum(map(len, own)) >= size:
            return own
        return [t for _, t in found]
    return []


def infer(streams: list[str]) -> list:
    wrapper: list | None = None
    for text in sorted(streams):
        stream = json.loads(text)
        wrapper = stream if wrapper is None else align(wrapper, stream)
    return pruned(wrapper or [])


def rules(wrapper: str) -> str:
    """What extract() needs of a wrapper: template texts by place, and the region."""
    inferred = json.loads(wrapper)
    return json.dumps({"template": template_texts(inferred), "region": region(inferred)})


def _column(function, kind: str):
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([function(x or "") for x in values], dtype=object)

    return F.pandas_udf(each, kind)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, rules) from pages (host, html); groups of different streams are aligned, then their wrappers."""
    stream = _column(lambda x: json.dumps(tree_stream(x, True), separators=(",", ":")), "string")
    streams = stored(pages.select("host", stream("html").alias("stream")).distinct(), "streams")
    parts = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum(F.length("stream")) / GROUP_BYTES))
    spread = streams.join(streams.groupBy("host").agg(parts.alias("parts")), "host")
    dealt = spread.select("host", "parts", F.pmod(F.xxhash64("stream"), F.col("parts")).alias("part"), "stream")

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"host": [table["host"][0].as_py()], "parts": [table["parts"][0].as_py()],
                         "part": [table["part"][0].as_py()],
                         "stream": [json.dumps(infer(table["stream"].to_pylist()), separators=(",", ":"))]})

    def aligned(items: DataFrame) -> DataFrame:  # dealt by both keys, else all groups of a host meet in one task
        return items.repartition("host", "part").groupBy("host", "part").applyInArrow(one, "host string, parts bigint, part bigint, stream string")

    first = stored(aligned(dealt), "wrappers_of_groups")
    more = first.where("parts > 1")
    for level in (1, 2, 3):
        width = F.ceil(F.col("parts") / FAN_IN**level) if level < 3 else F.lit(1)
        more = aligned(more.withColumn("part", F.pmod(F.col("part"), width).cast("long")))
    return first.where("parts = 1").union(more).select("host", _column(rules, "string")("stream").alias("rules"))


def extract(pages: pd.Series, hosts: pd.Series) -> pd.Series:
    known: dict[str, dict] = {}
    out = []
    for page, rule in zip(pages, hosts):
        rule = rule or "{}"
        if rule not in known:
            said = json.loads(rule)
            known[rule] = said | {"template": {p: frozenset(t) for p, t in said.get("template", {}).items()}}
        out.append(" ".join(main_texts(page or "", known[rule])))
    return pd.Series(out, dtype=object)


def extract_main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The input's columns without the html, with text and n_chars."""
    left = [c for c in pages.columns if c != page]
    only = pages.select(host_of(pages[f"`{url}`"]).alias("host"), pages[f"`{page}`"].alias("html"))
    wrappers = stored(host_wrappers(only.where("host <> ''")).withColumnRenamed("host", "its_host"), "wrappers")
    rows = pages.select(packed(pages.select([F.col(f"`{c}`") for c in left])), host_of(pages[f"`{url}`"]).alias("host"),
                        pages[f"`{page}`"].alias("html"))
    joined = rows.join(wrappers, same(F.col("host"), F.col("its_host")), "left")
    texts = joined.select("row", F.pandas_udf(extract, "string")("html", "rules").alias("text"))
    return texts.select(*unpacked(left, replaced=set(RESULTS)), "text", F.char_length("text").cast("long").alias("n_chars"))
