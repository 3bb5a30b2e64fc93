"""Main text of web pages by wrappers that are inferred for each host.

Pages of a host share a template. All pages of a host are tokenised into tags and text and aligned in runs of some pages, one
after the other; the runs vote for the container. In a run, repetitions are folded into repeated groups, what only some pages have becomes optional, and text that
differs becomes a slot. The result is a union-free regular expression, the host's *wrapper*. Its slots show the lowest
container of all that varies; that container is then read from every page of the host, without the parts that are
page furniture by element, role or class. Pages that have no such container are read by their own structure.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodlens.llm.common import arrow_schema, map_texts
from floodlens.session import cut

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>|(?P<text>[^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose content is raw, or never shown as text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold others and are tracked until their end.
HOLDERS = frozenset("html head body article main section div nav header footer aside form ul ol dl menu table figure fieldset "
                    "details dialog blockquote button select template object svg math audio video canvas search".split())
#: Elements whose edges end a block of text.
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address center hr tr td th caption thead tbody tfoot figcaption "
                             "legend summary option optgroup hgroup".split())
CLOSES_P = BLOCKS - {"button", "object", "svg", "math", "audio", "video", "canvas"}
FURNITURE = frozenset("head nav footer aside form button select template object svg math audio video canvas dialog menu search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comments "
    "comment commentlist respond disqus widget widgets toolbar pagination pager skip login search".split())
#: Words that go with those in the names of furniture. In a name with any other word, as in slugs of titles, they prove nothing.
COMPANION_WORDS = frozenset(
    "a an article articles bar block body bottom box btn button buttons container content cta entry form group header heading icon icons "
    "image inline inner item items label left line link links list main message meta more on page panel post posts right row section "
    "side site small stories story tag tags text the title to top us with wrap wrapper".split())
#: Elements that are parts of a text and are named after what they say.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote figure figcaption table caption tr td th section".split())
HEADER_WORDS = frozenset({"header", "pageheader", "siteheader"})
MAIN_WORDS = frozenset("article articlebody post entry story content maincontent postcontent entrycontent main".split())

Path = tuple[str, ...]


@dataclass
class Piece:
    """An edge of an element or a text, with the holders around it."""

    kind: str                   # "<", ">" or "#"
    value: str                  # signature of an element, or the text
    path: Path
    furniture: bool
    breaks: bool = False        # whether a block ends here
    name: str = ""


def words_of(value: str) -> list[str]:
    """Words of a class or id, in lower case: at signs between letters and at capitals."""
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def names_furniture(value: str) -> bool:
    """Whether a class or id as a whole is a name of furniture."""
    words = set(words_of(value))
    return not FURNITURE_WORDS.isdisjoint(words) and words <= FURNITURE_WORDS | COMPANION_WORDS


def describe(name: str, rest: str, inside: bool) -> tuple[str, bool]:
    """Signature of an element (name and classes without digits), and whether it is page furniture.

    Headers are furniture outside an article only: inside, they hold its title. Ids of headings, paragraphs and other parts
    of a text are slugs of what they say and count for sections outside an article only, their classes as a whole.
    """
    furniture = name in FURNITURE or (name == "header" and not inside)
    if not rest.strip():
        return name, furniture
    signature, words, whole = name, [], []
    titled = name in TITLED
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "class":
            classes = value.split()
            signature += "".join("." + c.lower() for c in sorted(set(classes)) if not any(map(str.isdigit, c)))
            titled |= "section" in classes
            whole += classes
            words += [w for c in classes for w in words_of(c)]
        elif key == "id":
            words += words_of(value)
            whole += [value] * (name not in TITLED or name == "section" and not inside)
        elif key == "role":
            furniture |= value.lower() in FURNITURE_ROLES
            if value.lower() == "main":
                signature += ".main"
        elif key == "itemprop" and value.lower() == "articlebody":
            signature += ".articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            furniture = True
    if name not in ("html", "body", "article", "main"):
        if titled:
            furniture |= any(map(names_furniture, whole))
        else:
            furniture |= not FURNITURE_WORDS.isdisjoint(words) or (not inside and not HEADER_WORDS.isdisjoint(words))
    return signature, furniture


def pieces(page: str) -> Iterator[Piece]:
    """Elements and text of a page in order. Ends that nobody opened are dropped, missing ends are implied."""
    stack: list[tuple[str, str, bool]] = []   # name, signature, furniture
    path: Path = ()
    at, size = 0, len(page)
    while at < size:
        token = TOKEN.match(page, at)
        at = token.end() if token else at + 1
        if token is None:
            continue
        off = bool(stack) and stack[-1][2]
        if (text := token["text"]) is not None:
            yield Piece("#", html.unescape(text), path, off)
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["end"]:
            if any(s[0] == name for s in stack):
                while True:
                    gone = stack.pop()
                    if gone[0] == name:
                        break
                path = tuple(s[1] for s in stack)
            yield Piece(">", name, path, off, name in BLOCKS, name)
            continue
        if name in CLOSES_P and stack and stack[-1][0] in ("p", "li", "h1", "h2", "h3") and (name != "li" or stack[-1][0] == "li"):
            if stack[-1][0] != "li" or name == "li":
                stack.pop()
                path = tuple(s[1] for s in stack)
                off = bool(stack) and stack[-1][2]
        inside = any(s[0] in ("article", "main") for s in stack)
        signature, furniture = describe(name, token["rest"], inside)
        yield Piece("<", signature, path, off, name in BLOCKS or name == "br", name)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
        elif name not in VOID and not (token["rest"].endswith("/") and name in ("svg", "math")) and (name in HOLDERS or furniture):
            stack.append((name, signature, off or furniture))
            path = path + (signature,)


def blocks(page: str, container: Path) -> tuple[list[str], bool]:
    """Texts of the blocks inside the container (a path of holders), without furniture, and whether it is there."""
    out, now, there = [], [], not container

    def close():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    depth = len(container)
    for piece in pieces(page):
        if piece.kind == "#":
            if not piece.furniture and piece.path[:depth] == container:
                now.append(piece.value)
        elif piece.kind == "<" and not there:
            there = piece.path + (piece.value,) == container
            close()
        elif piece.name == "br":
            now.append(" ")
        elif piece.breaks:
            close()
    close()
    return out, there


# ---------------------------------------------------------------- wrappers

@dataclass
class Item:
    """A token, slot or repeated group of a wrapper."""

    key: str
    path: Path
    furniture: bool
    text: str | int | None = None  # of a slot in the first page; a hash of all texts if it is repeated there
    chars: int = 0               # of text seen in the slot
    varies: bool = False         # from page to page
    optional: bool = False
    group: list["Item"] = field(default_factory=list)   # of a repeated group


def stream(page: str) -> list[Item]:
    """Tags of blocks and holders, and text, of a page as wrapper items."""
    out: list[Item] = []
    for piece in pieces(page):
        if piece.kind == "#":
            text = " ".join(piece.value.split())
            if text:
                if out and out[-1].key == "#":
                    out[-1].text += " " + text
                    out[-1].chars += len(text)
                else:
                    out.append(Item("#", piece.path, piece.furniture, text, len(text)))
        elif piece.breaks and piece.name != "br":
            out.append(Item(piece.kind + piece.value, piece.path, piece.furniture))
    return out


def absorb(into: Item, other: Item) -> None:
    """What one item learns from another one with the same key."""
    into.chars += other.chars
    into.optional |= other.optional
    into.varies |= other.varies or into.text != other.text
    for a, b in zip(into.group, other.group):
        absorb(a, b)


def repeat(into: Item, other: Item) -> None:
    """What one item learns from its next repetition in the same page."""
    into.chars += other.chars
    into.text = hash((into.text, other.text))
    for a, b in zip(into.group, other.group):
        repeat(a, b)


def fold(items: list[Item], known: frozenset[str] = frozenset(), longest: int = 12) -> list[Item]:
    """Adjacent equal groups become one repeated group; so does a single one that other pages repeat."""
    for width in range(1, longest + 1):
        out: list[Item] = []
        at = 0
        while at < len(items):
            group = items[at:at + width]
            keys = [i.key for i in group]
            key = "(" + " ".join(keys) + ")+"
            end = at + width
            # a group must be balanced: it begins with an element and ends with its end, or is one group or slot
            whole = len(group) == width and (width > 1 and keys[0][0] == "<" and keys[-1] == ">" + keys[0][1:].split(".")[0])
            while whole and [i.key for i in items[end:end + width]] == keys:
                for a, b in zip(group, items[end:end + width]):
                    repeat(a, b)
                end += width
            if whole and (end > at + width or key in known):
                out.append(Item(key, group[0].path, group[0].furniture, group=group))
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def align(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """The wrapper after one more page: common items meet, the rest on either side is optional."""
    out: list[Item] = []
    if [i.key for i in wrapper] == [i.key for i in page]:
        for mine, other in zip(wrapper, page):
            absorb(mine, other)
        return wrapper
    matcher = SequenceMatcher(None, [i.key for i in wrapper], [i.key for i in page], autojunk=False)
    for kind, a, b, c, d in matcher.get_opcodes():
        if kind == "equal":
            for mine, other in zip(wrapper[a:b], page[c:d]):
                absorb(mine, other)
                out.append(mine)
        else:
            for item in wrapper[a:b] + page[c:d]:
                item.optional = True
                out.append(item)
    return out


def infer(pages: list[str]) -> list[Item]:
    """Wrapper of some pages of a host."""
    return merged([fold(stream(p)) for p in dict.fromkeys(pages)])


def merged(streams: list[list[Item]]) -> list[Item]:
    """Wrapper of some folded pages."""
    if not streams:
        return []
    known = frozenset(i.key for s in streams for i in s if i.group)
    streams = [fold(s, known) for s in streams]
    wrapper = streams[0]
    for other in streams[1:]:
        wrapper = align(wrapper, other)
    return wrapper


def packed(page: str) -> bytes:
    """The items of a page in short: texts by their digests."""
    items = stream(page)
    paths = list(dict.fromkeys(i.path for i in items))
    number = {path: k for k, path in enumerate(paths)}
    digest = lambda text: int.from_bytes(hashlib.blake2b(text.encode("utf8", "surrogatepass"), digest_size=8).digest(), "big")
    rows = [(i.key, number[i.path], int(i.furniture), None if i.text is None else digest(i.text), i.chars) for i in items]
    return zlib.compress(json.dumps([paths, rows]).encode())


def unpacked(data: bytes) -> list[Item]:
    paths, rows = json.loads(zlib.decompress(data))
    paths = [tuple(p) for p in paths]
    return [Item(key, paths[k], bool(furniture), text, chars) for key, k, furniture, text, chars in rows]


def votes(run: list[bytes], most_items: int = 4000) -> Iterator[tuple[str, str, int]]:
    """Wrapper, container and number of pages behind them, of a run of packed pages; copies in a run serve once.

    Pages with more items than ``most_items`` are too long to be aligned and vote each for itself.
    """
    streams = [fold(unpacked(p)) for p in dict.fromkeys(run)]
    for some in [[s for s in streams if len(s) <= most_items], *([s] for s in streams if len(s) > most_items)]:
        if some:
            wrapper = merged(some)
            yield written(wrapper), json.dumps(container_of(wrapper)), len(some)


def slots(items: list[Item], optional: bool = False) -> Iterator[tuple[Item, bool]]:
    """Slots, and whether their text differs from page to page or is on some pages only."""
    for item in items:
        some = optional or item.optional
        if item.group:
            yield from slots(item.group, some)
        elif item.key == "#":
            yield item, some or item.varies


def written(items: list[Item]) -> str:
    """The wrapper as a pattern: ``#`` a slot, ``(…)+`` a repeated group, ``(…)?`` an optional item."""
    return " ".join(f"({i.key})?" if i.optional else i.key for i in items)


def is_main(signature: str) -> bool:
    name, *classes = signature.split(".")
    return name in ("article", "main") or any(set(words_of(c)) & MAIN_WORDS or c in MAIN_WORDS for c in classes)


def common_holder(paths: list[Path]) -> Path:
    """The lowest holder of all paths."""
    low, high = min(paths), max(paths)
    depth = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:depth]


def container_of(items: list[Item]) -> Path:
    """The lowest holder of all text that differs between pages and is no furniture, with the article around it.

    What all pages share outside of it belongs to the template. If nothing differs, as in a single page, only what is
    outside a main element is taken for the template.
    """
    found = [(slot.path, varies) for slot, varies in slots(items) if not slot.furniture]
    paths = [path for path, varies in found if varies]
    if not paths:
        paths = [path for path, _ in found]
        paths = [p for p in paths if any(s.split(".")[0] == "main" for s in p)] or paths
    if not paths:
        return ()
    holder = common_holder(paths)
    for depth, signature in enumerate(holder, 1):
        if signature.split(".")[0] in ("article", "main"):
            return holder[:depth]
    for depth in range(len(holder), 0, -1):
        if is_main(holder[depth - 1]):
            return holder[:depth]
    # lists, tables and the like are parts of a text
    while holder and holder[-1].split(".")[0] not in ("html", "body", "section", "div"):
        holder = holder[:-1]
    return holder


def main_text(page: str, container: Path | None) -> str:
    """The text of a page in its host's container; by the page's own structure if it has none."""
    found, there = blocks(page, container) if container is not None else ([], False)
    if not there:
        found, _ = blocks(page, container_of(infer([page])))
    return "\n".join(found)


# ---------------------------------------------------------------- Spark

def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(host, F.lit(""))


def light(hosts: DataFrame, *texts: str, most: int = 8 << 20) -> DataFrame:
    """A stored table of hosts, sent to every executor if the joins may: only below ``most`` bytes."""
    size = hosts.agg(F.sum(sum((F.octet_length(t) for t in texts), F.lit(64)))).first()[0] or 0
    return F.broadcast(hosts) if size <= most else hosts


def infer_wrappers(pages: DataFrame, run_pages: int = 12, bucket_pages: int = 240) -> DataFrame:
    """host, wrapper, container for each host, from all of its pages.

    The pages of a host are dealt by a hash of their address and id into buckets of about ``bucket_pages``, and those cut into
    runs of ``run_pages``; each run gives a wrapper, and the container of most pages wins. No task holds more than a run, and
    only the items of the pages travel.
    """
    schema = "host string, wrapper string, container string, pages long"
    target = arrow_schema(schema)
    rows = pages.where(F.col("html").isNotNull()).select(
        host_of(F.col("url")).alias("host"), F.xxhash64("url", "page_id").alias("h"), "page_id", "html")
    sizes = cut(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / bucket_pages).alias("buckets")))
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        return lambda batch: [*batch.columns[:3], [packed(p) for p in batch.column("html").to_pylist()]]
    items = map_texts(rows, ["host", "h", "page_id", "html"], make, f"host string, h long, page_id {kind}, items binary")
    dealt = (items.join(light(sizes, "host"), "host").withColumn("bucket", F.expr("pmod(h, buckets)")).select("host", "bucket", "h", "page_id", "items")
             .repartition("host", "bucket").sortWithinPartitions("host", "bucket", "h", "page_id", "items"))

    def work(batches):
        at, run = None, []

        def done():
            found = list(votes(run)) if run else []
            return pa.RecordBatch.from_pylist([{"host": at[0], "wrapper": w, "container": c, "pages": n} for w, c, n in found], schema=target)
        for batch in batches:
            for host, bucket, page in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "items"))):
                if (host, bucket) != at or len(run) == run_pages:
                    yield done()
                    at, run = (host, bucket), []
                run.append(page)
        if run:
            yield done()

    found = dealt.mapInArrow(work, schema).groupBy("host", "container").agg(F.sum("pages").alias("pages"), F.min("wrapper").alias("wrapper"))
    best = F.struct(-F.col("pages"), "container", "wrapper")
    return (found.groupBy("host").agg(F.min(best).alias("best"))
            .select("host", F.col("best.wrapper").alias("wrapper"), F.col("best.container").alias("container")))


def extract_text(pages: DataFrame, most_broadcast: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars for every page, from its whole html.

    Null html is empty and gives an empty text; a page without an address belongs to the host "". Repeated rows are
    read each for themselves; other columns are ignored; an empty table gives no rows. The containers of all hosts are
    sent to every executor only while they are smaller than ``most_broadcast`` bytes; beyond that they are joined.
    """
    stored = cut(infer_wrappers(pages))
    hosts = light(stored.select("host", "container"), "host", "container", most=most_broadcast)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(hosts, "host", "left")

    def make():
        paths: dict = {None: None}

        def work(batch):
            out = []
            for container, page in zip(batch.column("container").to_pylist(), batch.column("html").to_pylist()):
                if container not in paths:
                    paths[container] = tuple(json.loads(container))
                out.append(main_text(page or "", paths[container]))
            return [batch.column(0), batch.column(1), out, [len(t) for t in out]]

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_texts(joined, ["page_id", "url", "container", "html"], make, f"page_id {kind}, url string, text string, n_chars bigint")
