"""HTML extraction by wrapper induction: same-host DOM trees are aligned, constant nodes are template, varying slots content.

1. Every page is parsed once for its block tree: block elements in order, runs of equal siblings folded, with the
   text length, link text length and text digest of each node.
2. The distinct trees of a host are merged into one template by simple tree matching: roots of equal tag match, their
   children are aligned in order to the largest number of matched nodes, unmatched ones are inserted. Partitions
   merge what they hold, then a host's partial templates merge; both see trees, never texts.
3. Each distinct tree is aligned to its host's template, so every node of every page has a slot. Over all pages of the
   host and slot: a digest found in at least `CONSTANT_SHARE` of the pages, and on `MIN_PAGES` different ones, is
   template text; a slot whose own text is mostly links is a menu. Pages of one main text count as one:
   copies, and near copies that differ in what is around the article or in blocks of a `MINOR_SHARE` of its characters.
4. Every page is parsed again and its nodes are judged by slot: template text, the own text of menus and elements whose
   tag, role, class or id names page furniture go (inside an article only whole names count, of paragraphs, headings and
   cells only those of adverts); the rest is content, within the article or main element if there is
   one. What is nested in a menu is judged by its own slot, so a link beside an article does not take it along.

Defined results: a null html is empty and gives the empty text, 0 characters; so does a page without content. A null url
belongs to the host ''. Hosts with fewer than `MIN_PAGES` different pages have no constant text, only step 4's names.
Text cut off inside a tag or comment is dropped with it; unclosed elements end with their parent. Repeated rows give
repeated results.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .tables import bounded_batches, read

CONSTANT_SHARE, MIN_PAGES = 0.5, 4
LINK_SHARE = 0.7
MINOR_SHARE = 0.1

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

BLOCKS = set("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
blockquote pre address figure figcaption header footer nav aside form fieldset details summary hr dialog menu center search""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea select canvas video audio title button noframes".split())
FURNITURE_TAGS = set("nav footer aside form dialog menu search head".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class and id that name page furniture.
FURNITURE = set("""nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside widget widgets rail
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus
respond reply replies related recommended recommendations pagination pager skip copyright legal disclaimer search toolbar""".split())
ASIDE_ARTICLES = set("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())
# Inside an article names are judged whole: "related-posts" is furniture, "related-work" and "share-price" are not.
WORDS_INSIDE = FURNITURE - set("header masthead banner bottom rail skip copyright legal disclaimer notice notices notification alert search login menu".split())
NEUTRAL = set("box block list section wrapper wrap container area item items bar link links post posts article articles button buttons inner outer top bottom left right site page content main unit slot story stories news form media icons".split())
ADVERTS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
# Elements of an article's own text, of whose names only those of adverts count.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address figcaption".split())
# Deeper elements are laid into the last block of this depth.
MAX_DEPTH = 150
BARRIERS = set("table ul ol div article section body nav main".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# An open element ends where one of these begins inside it.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Node:
    """A block element: its tag, class, whether its names call it furniture, and its blocks and children in order."""
    __slots__ = ("tag", "name", "furniture", "items", "index")

    def __init__(self, tag: str, name: str = "", furniture: bool = False):
        self.tag, self.name, self.furniture, self.items, self.index = tag, name, furniture, [], -1


def named_inside(tag: str, names: str) -> bool:
    """Whether a class or id of an element inside an article is made of furniture words, with none that says otherwise."""
    own = ADVERTS if tag in PROSE else WORDS_INSIDE
    split = ([w.lower() for w in NAME.findall(name)] for name in names.split())
    return any(not own.isdisjoint(words) and all(w in FURNITURE or w in NEUTRAL for w in words) for words in split)


def attributes(tag: str, raw: str, inside: bool = False) -> tuple[str, bool]:
    """(class, furniture) of an element, which an article holds or not."""
    if not raw.strip(" /\n\t"):
        return "", tag in FURNITURE_TAGS
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}
    names = [found.get(k, "") for k in ("class", "id")]
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in FURNITURE_TAGS or hidden or found.get("role", "").lower() in FURNITURE_ROLES:
        return names[0], True
    if tag in ("html", "body", "main", "h1"):  # a page-wide name says nothing of these
        return names[0], False
    if inside and tag != "article":
        return names[0], named_inside(tag, " ".join(names))
    words = {w.lower() for n in names for w in NAME.findall(n)}
    return names[0], bool(words & (ASIDE_ARTICLES if tag == "article" else FURNITURE))


def parse(page: str) -> Node:
    """The block tree of a page; an item of a node is a child or a (text, link characters) block."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]  # the open blocks
    still: Counter[str] = Counter()  # open blocks by tag
    node, text, linked, links = root, [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                node.items.append((block, linked))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                linked += len(piece) if links else 0
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if not closing:
            if tag in RAW:
                if not raw.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else n
                text.append(" " if tag not in ("title",) else "")
                continue
            if tag == "head":  # ends at its own end or at the body
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                if end:
                    at = end.end()
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                text.append(" ")
                continue
            name, furniture = attributes(tag, raw, still["article"] > 0)
            links += tag == "a"
            if tag not in BLOCKS and not furniture:
                continue  # inline: its text belongs to the block
            flush()
            nearby = range(max(1, len(stack) - 32), len(stack))
            inner = max((k for k in nearby if tag in ENDS.get(stack[k][0], ())), default=0)
            if inner > max((k for k in nearby if stack[k][0] in BARRIERS), default=0):  # implied ends
                for closed, _ in stack[inner:]:
                    still[closed] -= 1
                del stack[inner:]
                node = stack[-1][1]
            if len(stack) < MAX_DEPTH:
                child = Node(tag, name, furniture)
                node.items.append(child)
                node = child
            if raw.endswith("/"):
                node = stack[-1][1]
            else:
                stack.append((tag, node))
                still[tag] += 1
        else:
            links = 0 if tag == "a" else links
            if not still[tag]:
                continue
            flush()
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
            for closed, _ in stack[k:]:
                still[closed] -= 1
            del stack[k:]
            node = stack[-1][1]
    flush()
    _pardon(root)
    return root


def _pardon(node: Node) -> bool:
    """Whether a node holds an article or main element that counts; names of what is around it then say nothing."""
    holds = [_pardon(item) for item in node.items if isinstance(item, Node)]
    node.furniture = node.furniture and not any(holds)
    return any(holds) or node.tag in ("article", "main") and not node.furniture


def skeleton(node: Node, counter: list[int], stats: list[list]) -> list:
    """[tag, class, children] with runs of equal siblings folded. Numbers the nodes; stats gets characters, link
    characters and texts of each number."""
    return _fold([node], counter, stats)


def _fold(same: list[Node], counter: list[int], stats: list[list]) -> list:
    index = counter[0]
    counter[0] += 1
    stats.append([0, 0, []])
    groups: list[list[Node]] = []
    for x in same:
        x.index = index
        position = 0
        for item in x.items:
            if isinstance(item, tuple):
                stats[index][0] += len(item[0])
                stats[index][1] += min(item[1], len(item[0]))
                stats[index][2].append(item[0])
            else:  # members of a run share the groups of the first one, in order
                k = next((k for k in range(position, len(groups)) if (groups[k][0].tag, groups[k][0].name) == (item.tag, item.name)), None)
                if k is None:
                    groups.append([item])
                    position = len(groups) - 1
                else:
                    groups[k].append(item)
                    position = k
    return [same[0].tag, same[0].name, [_fold(g, counter, stats) for g in groups]]


def matched(a: list, b: list, memo: dict) -> float:
    """Simple tree matching: nodes of the largest top-down, order-keeping match of two trees; equal classes add a half."""
    if a[0] != b[0]:
        return 0.0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1.0 + 0.5 * (a[1] == b[1]) + _table(a[2], b[2], memo)[-1][-1]
    return memo[key]


def _table(x: list, y: list, memo: dict) -> list[list[float]]:
    m = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(p, q, memo))
    return m


def pairs(x: list, y: list, memo: dict) -> list[tuple[int, int]]:
    """The aligned children of two lists."""
    m, i, j, out = _table(x, y, memo), len(x), len(y), []
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """The template of two trees with equal root tags: matched nodes once, the others inserted in order."""
    memo = {} if memo is None else memo
    children, i, j = [], 0, 0
    for p, q in [*pairs(a[2], b[2], memo), (len(a[2]), len(b[2]))]:
        children += a[2][i:p] + b[2][j:q]
        if p < len(a[2]):
            children.append(merge(a[2][p], b[2][q], memo))
        i, j = p + 1, q + 1
    return [a[0], a[1], children]


def slots(tree: list, template: list) -> list[int]:
    """Slot of each node of a skeleton in the template, both in preorder; -1 where the template has none."""
    memo: dict = {}

    def size(t: list) -> int:
        return 1 + sum(map(size, t[2]))

    out: list[int] = []

    def walk(t: list, s: list | None, number: int) -> None:
        out.append(number if s is not None else -1)
        partner = dict(pairs(t[2], s[2], memo)) if s is not None else {}
        starts, at = [], number + 1
        for c in s[2] if s is not None else ():
            starts.append(at)
            at += size(c)
        for k, c in enumerate(t[2]):
            walk(c, s[2][partner[k]] if k in partner else None, starts[partner[k]] if k in partner else -1)

    walk(tree, template, 0)
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def structures(pages: DataFrame) -> DataFrame:
    """(host, tree, page, chars, links, digests) of every page: the digest of its main text, arrays by the tree's nodes, no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("host", "tree", "page", "chars", "links", "digests")}
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                stats: list[list] = []
                root = parse(page or "")
                tree = skeleton(root, [0], stats)
                rows["host"].append(host)
                rows["tree"].append(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
                rows["page"].append(digest(main_text(root)))
                rows["chars"].append([s[0] for s in stats])
                rows["links"].append([s[1] for s in stats])
                rows["digests"].append([[digest(t) for t in set(s[2])] for s in stats])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("host", pa.string()), ("tree", pa.string()), ("page", pa.int64()), ("chars", pa.list_(pa.int64())),
                ("links", pa.list_(pa.int64())), ("digests", pa.list_(pa.list_(pa.int64())))]))

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        run, "host string, tree string, page long, chars array<long>, links array<long>, digests array<array<long>>")


def templates(trees: DataFrame) -> DataFrame:
    """(host, template) from the distinct (host, tree): merged within partitions, then per host."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, tree in sorted(zip(batch["host"].to_pylist(), batch["tree"].to_pylist())):
                tree = json.loads(tree)
                held[host] = merge(held[host], tree) if host in held else tree
            if len(held) > 10_000:  # bounded memory; a host flushed twice is merged below
                yield pa.RecordBatch.from_pydict({"host": list(held), "template": [json.dumps(t, ensure_ascii=False) for t in held.values()]})
                held = {}
        if held:
            yield pa.RecordBatch.from_pydict({"host": list(held), "template": [json.dumps(t, ensure_ascii=False) for t in held.values()]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for t in sorted(group["template"]):
            t = json.loads(t)
            out = t if out is None else merge(out, t)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [json.dumps(out, ensure_ascii=False)]})

    return trees.mapInArrow(partial, "host string, template string").groupBy("host").applyInPandas(whole, "host string, template string")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, menus, constants): slots that are mostly links, and 'slot:digest' of template texts."""
    found = cut(structures(pages))
    trees = cut(found.select("host", "tree").distinct())
    made = cut(templates(trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [slots(json.loads(t), json.loads(m)) for t, m in zip(batch["tree"].to_pylist(), batch["template"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["tree"], pa.array(got, pa.list_(pa.int32()))], names=["host", "tree", "slots"])

    placed = trees.join(made, "host").mapInArrow(place, "host string, tree string, slots array<int>")
    nodes = (found.groupBy("host", "tree", "page", "chars", "links", "digests").agg(F.lit(1).alias("one"))  # copies of a page once
             .join(placed, ["host", "tree"])
             .select("host", "page", F.explode(F.arrays_zip("slots", "chars", "links", "digests")).alias("n")).select("host", "page", "n.*"))
    nodes = cut(nodes.where("slots >= 0"))
    menus = (nodes.groupBy("host", "slots").agg(F.sum("chars").alias("c"), F.sum("links").alias("l"))
             .where((F.col("c") > 0) & (F.col("l") > LINK_SHARE * F.col("c"))).groupBy("host").agg(F.collect_set("slots").alias("menus")))
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    texts = nodes.select("host", "page", "slots", F.explode("digests").alias("digest")).distinct().groupBy("host", "slots", "digest").agg(F.count("*").alias("n"))
    constants = (texts.where(F.col("n") >= MIN_PAGES).join(sizes, "host").where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
                 .groupBy("host").agg(F.collect_set(F.concat_ws(":", "slots", "digest")).alias("constants")))
    return cut(made.join(menus, "host", "left").join(constants, "host", "left"))


def areas(node: Node, tags: tuple[str, ...]) -> Iterator[Node]:
    """The outermost elements of `tags` that no furniture holds."""
    for item in node.items:
        if isinstance(item, Node) and not item.furniture:
            if item.tag in tags:
                yield item
            else:
                yield from areas(item, tags)


def main_text(root: Node) -> str:
    """What makes a page another page than its near copies: the blocks of its article or main element, else all that are
    not mostly links, without furniture and without its shortest blocks of together `MINOR_SHARE` of the characters, like
    a date."""
    def blocks(node: Node) -> Iterator[tuple[str, int]]:
        for item in node.items:
            if isinstance(item, tuple):
                yield item
            elif not item.furniture:
                yield from blocks(item)

    for tags in (("article",), ("main",), ()):
        found = [b for node in (areas(root, tags) if tags else (root,)) for b in blocks(node)]
        texts = [text for text, linked in found if tags or linked <= LINK_SHARE * len(text)]
        if texts:
            break
    minor, left = set(), MINOR_SHARE * sum(map(len, texts))
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        left -= len(texts[k])
        if left < 0:
            break
        minor.add(k)
    return "\n".join(t for k, t in enumerate(texts) if k not in minor)


def content(root: Node, slot: list[int], menus: set[int], constants: set[str]) -> str:
    """The blocks of a page that are neither furniture nor template."""
    def blocks(node: Node, heading_only: bool, inside: bool) -> Iterator[str]:
        menu = slot[node.index] in menus and node.tag not in ("#root", "article", "main", "body")
        for item in node.items:
            if isinstance(item, tuple):
                if not heading_only and not menu and (not constants or f"{slot[node.index]}:{digest(item[0])}" not in constants):
                    yield item[0]
            elif not item.furniture and (inside or item.tag != "header"):  # an article's own header keeps its headings
                heading = len(item.tag) == 2 and item.tag[0] == "h" and item.tag[1].isdigit()
                yield from blocks(item, (heading_only or item.tag == "header") and not heading, inside or item.tag in ("article", "main"))

    for tags in (("article",), ("main",)):
        if inside := list(areas(root, tags)):
            if text := "\n".join(b for node in inside for b in blocks(node, False, True)):
                return text
    return "\n".join(blocks(root, False, False))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html)."""
    rules = wrappers(bounded_batches(pages))
    # Spark broadcasts the rules where they are small; beyond, pages meet their host's rules by a shuffle with skew splits
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(rules, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            out = []
            for page, host, template, menus, constants in zip(*(batch[c].to_pylist() for c in ("html", "host", "template", "menus", "constants"))):
                root, stats = parse(page or ""), []
                tree = skeleton(root, [0], stats)
                key = (host, json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
                if key not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[key] = slots(tree, json.loads(template)) if template else [-1] * len(stats)
                out.append(content(root, known[key], set(menus or ()), set(constants or ())))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "host", "template", "menus", "constants").mapInArrow(run, pages.select("page_id", "url", F.col("html").alias("text")).schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
