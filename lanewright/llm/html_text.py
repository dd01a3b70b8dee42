"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags.  A block is described by its number of words and its link density, the same two
numbers of the block before and after it, whether it is a heading, and the mark of the nearest container that has one: -1 inside a
menu, header, footer, sidebar, notice, advert, form or comment area, 1 inside an article or main area, 0 elsewhere.  A decision tree
fitted by Spark ML on a small labelled table (the blocks of the pages in ``LABELLED_PAGES``) tells main text from the rest: where no container
decides, by the words and links of the block and of its neighbours.  The tree is turned into one column expression, so that choosing and joining the
blocks stays inside the row: no shuffle, and no page meets another.

Marks.  Class names, ids and roles count as wholes; a compound name decides only if each of its parts says the same or nothing.  An article inside
a form, a header or the like is an article again, but one inside a menu, footer, sidebar, advert or comment area is not.  A form that
holds more than half of the words of a page is a wrapper and has no mark.

Scripts, styles, comments and hidden parts are no text.  Character references are decoded once, a run of white space (no-break spaces
too) inside a block becomes one space, and empty blocks do not count.  A null or empty page has the empty text and no
blocks.  Broken markup is read as it comes: a tag that is never closed ends with the block or container around it, and a ``<`` that starts no tag is
text.  The page is read forwards once: after a quote that never ends, quotes no longer count, so unclosed quotes, tags and long pages cost time in proportion to their
length.  Rows are independent, so repeated pages and ids each get their row; an empty table gives an empty table; only the key columns are kept, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.llm.common import keyed, short_batches, text_of, with_arrow_column

TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
QUOTE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
PART = re.compile(r"[-_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Tags that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never text of the page.
RAW = frozenset("script style template svg math iframe object noscript canvas audio video textarea select button option datalist title head".split())
#: Containers of boilerplate and of main text, by tag and by their class names, ids and roles.
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset label legend".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies "
    "copyright disclaimer discussion disqus footer gdpr header login masthead menu menubar meta modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup privacy promo promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar warning widget".split()
)
GOOD_WORDS = frozenset("article content story entry post main articlebody".split())
#: Parts of a compound name that say nothing.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons col column consent container group inner items item left link links list message outer page panel right row section "
    "site text thread title top unit up us wrap wrapper".split()
)
#: Main text is often wrapped in containers of these names; nothing inside the other ones is main text, an article neither.
OPEN_WORDS = frozenset("banner header masthead meta modal overlay search toolbar topbar widget".split())
CLOSED_TAGS = frozenset("nav footer aside menu dialog".split())
#: Tags that may be a wrapper of the whole page.
WRAPPERS = frozenset("form fieldset".split())
SMALL = frozenset("p li td span a".split())
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table menu dialog fieldset details figure blockquote p li td span a".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("words", T.DoubleType()), T.StructField("links", T.DoubleType()),
    T.StructField("heading", T.DoubleType()), T.StructField("mark", T.DoubleType()),
]))
ARROW_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("words", pa.float64()), ("links", pa.float64()), ("heading", pa.float64()), ("mark", pa.float64())]))
FEATURES = ("words", "links", "heading", "mark", "words_before", "links_before", "words_after", "links_after")

#: The small labelled table: pages whose blocks carry the label in ``data-main`` of the nearest tag (1 main text, 0 not).
LABELLED_PAGES = (
    """<body><div data-main=0><a href=/>Home</a> <a href=/news>News</a> <a href=/sport>Sport</a></div><article data-main=1><h1>River floods three towns</h1>
    <p>Heavy rain pushed the river over its banks on Monday and three towns were cut off for most of the day, officials said.</p><p>Nobody was hurt.</p>
    <p>Roads are open again. More rain is <a href=/w>expected</a> later this week, although less of it.</p></article><div data-main=0>Copyright 2020 All rights reserved</div></body>""",
    """<body><nav data-main=0><ul><li><a href=/a>About us</a></li><li><a href=/b>Contact</a></li><li>Menu</li></ul></nav><div class="ad" data-main=0>Buy now and save on a large range of shoes, coats and hats in
    our new shop, open every day of the week for you and your family.</div><article data-main=1><h2>Notes</h2><p>Short.</p><p>A second paragraph that has rather more words than the first one, as is usual.</p></article>
    <footer data-main=0>&copy; example site &middot; a long line of legal words that nobody reads to the end, whatever they may say here</footer></body>""",
    """<body><header data-main=0><p>The daily page, written for people who like to read long pages every day of the week</p></header><main data-main=1><p>First we mix flour, water and salt, then wait for an hour before the
    dough is folded again.</p><ul><li>Flour</li><li>Water</li><li>Salt</li></ul><p>Bake until brown.</p></main><aside data-main=0><p>You may also like these other recipes that our readers made during the last winter</p><p><a href=/x>Bread rolls
    with seeds</a></p></aside><form data-main=0><p>Sign up for our letter and get a recipe every week in your mail box</p></form></body>""",
    """<body><div data-main=1><p>This page has no marks at all, but it holds a long paragraph of plain words without a single link in it, so it must be the text.</p><p>It goes on with another
    paragraph that is long enough to be told from a menu entry by its words alone.</p></div><div data-main=0><a href=/1>One</a> | <a href=/2>Two</a> | <a href=/3>Three</a></div><div data-main=0><a href=/p>Privacy policy and terms of use of this site</a></div></body>""",
    """<body><div class="comments" data-main=0><p>I read this twice and still do not agree with the writer, who has never lived there.</p><p>Nice!</p></div><div data-main=1><p>The old bridge was built by hand in four years and carried
    carts, then trains, and now only people on foot and their dogs.</p></div><div data-main=0>Share this</div><div data-main=0><a href=/n>Next</a></div><div class="cookie notice" data-main=0>We use cookies to make this site work better for you and to count our visitors</div></body>""",
    """<body><article data-main=1><h1>Tables</h1><table><tr><td>Speed</td><td>Twelve</td></tr><tr><td>Weight</td><td>Nine</td></tr></table><p>See <a href=/t>the full table of all measured values</a></p><pre>x = 1</pre><blockquote>Say little.</blockquote></article>
    <div class="related" data-main=0><p><a href=/r>Related story about tables and chairs in old houses</a></p><p>Some words on it, quite a number of them in fact, to make it look like the text</p></div></body>""",
    """<body><div data-main=0>Menu</div><div data-main=0>Log in</div><div data-main=1><p>Each morning the baker walks down the hill with two baskets of fresh bread for the school and the old people's home by the lake.</p><p>Nobody knows who pays her.</p>
    <p>When it snows she takes the long way round, and the children wait at the gate until she comes.</p></div><div data-main=0>Tags: <a href=/q>bread</a> <a href=/s>snow</a></div></body>""",
    """<body><div data-main=0><a href=/top>Ten places by the sea that you should see once before the summer ends, chosen by our readers over many years</a></div><div data-main=0><a href=/ship>The captain who
    sailed his small ship around the cape in a storm and came home with a crew of cats and one old parrot</a></div><div data-main=1><h1>Late harvest</h1><p>The grapes hung on the vines for three weeks longer than usual because the nights stayed
    warm until the end of the month.</p><p>It was worth it.</p><p>Growers in the valley say that the wine will be sweet, strong and rather expensive, and that most of it has been sold before it was made.</p><p>We asked why.</p><p>The answer is
    that a single dry year took half of the plants, so the cellars stand empty and every buyer wants to be the first at the door.</p></div><div data-main=0><a href=/m1>Older</a></div><div data-main=0><a href=/m2>Newer</a></div><div data-main=0>All dates</div></body>""",
    """<body><div data-main=0><a href=/a>Start</a></div><div data-main=0>Your account</div><div data-main=0><a href=/b>Basket</a></div><div data-main=1><h2>How to mend a tyre</h2><p>Turn the bicycle over, take out the wheel and press the tyre off its rim with two spoons or with your
    bare thumbs.</p><p>Find the hole.</p><p>Hold the tube under water and look for a row of bubbles, then dry it, rub it with fine paper and put a thin coat of <a href=/g>glue</a> on it.</p><p>Wait five minutes.</p><p>Press the patch
    on, put the tube back without a twist and pump slowly while you check that the rim holds the tyre on both sides all the way round.</p></div><div data-main=0><a href=/c>Pumps, patches, spoons and everything else that you need for long tours through the hills, with free delivery for
    orders of more than fifty crowns</a></div><div data-main=0>Follow us</div><div data-main=0><a href=/d>Jobs</a></div><div data-main=0>Terms apply</div></body>""",
    """<body><div data-main=0><a href=/1>Weather</a></div><div data-main=0><a href=/2>Traffic</a></div><div data-main=0>Sunday edition</div><div data-main=0><a href=/3>Letters</a></div><div data-main=1><p>Nobody had opened the door of the old mill for sixty years when the children found the key under a stone by
    the stream.</p><p>They went in.</p><p>Inside stood a table with five plates, five cups and a loaf of bread that had turned to something like wood, and on the wall hung a clock that still showed the right time.</p><p>Then it struck nine.</p><p>The youngest
    of them ran all the way home without his shoes, and to this day he will not say what else he saw there.</p></div><div data-main=0><a href=/r1>What happened to the mill after the great flood and why the town council wants to turn it into a hotel with forty rooms</a></div><div data-main=0>Read on</div><div data-main=0><a href=/r2>The
    stream that runs uphill, or so it seems to everyone who has walked along it from the bridge to the dam</a></div></body>""",
    """<body><main data-main=1><h1>News in brief</h1><p>Yes.</p><p>The bridge opens on Friday, two months late.</p><p><a href=/full>Read the plan of the new bridge</a></p><p>No toll is asked.</p></main><div data-main=0><a href=/z>Back</a></div><div data-main=0>Print</div></body>""",
    """<body><header data-main=0><p>Since 1911 the paper of the whole coast, printed every day but Sunday, and read from the lighthouse in the north to the salt gardens in the south</p></header><article data-main=1><p>Two whales were seen.</p></article><div id="comments" data-main=0>
    <p>My father saw three of them in the same bay forty years ago, and the paper did not believe him then, so I am glad that somebody finally took a picture of one.</p><p>They come every year when the herring does, you only have to get up early and look past the second buoy, as all of us here have always done.</p>
    <p>Agreed.</p><p>It is a pity that so many boats went out to look at them, because the noise drives them off and the next day there was nothing left to see from the shore at all.</p></div><footer data-main=0><p>All texts and pictures belong to the paper or to the people who made them and may not be used
    elsewhere without a written word from the office.</p></footer></body>""",
    """<body><div class="cookie-notice" data-main=0><p>We and our partners store small files on your machine so that we can count visits, remember what you like and show you things that you may want to buy from us or from them.</p></div><div data-main=1><p>The ferry will not sail before noon because a rope got into its screw during the
    night and the diver lives on the other side.</p></div><aside data-main=0><p>The shop on the pier sells boots, coats, ropes and lamps of the best make, and whoever brings this page along gets a tenth off every price until the end of the season.</p><p>Our letter comes once a week with the tides, the moon, the weather and all the
    dates of the village, and you can leave the list at any time by a single word.</p></aside><div class="ad" data-main=0>A house by the sea need not be dear when you share it with five other families, each of which has it for two months of the year and pays for no more than these.</div><footer data-main=0>The village office is open on
    Tuesday and on Thursday from nine until noon, in the hall behind the church, and by telephone on every other working day of the week.</footer></body>""",
    """<body><article data-main=1><p>Closed today.</p></article><footer data-main=0>This page is kept by the friends of the old library, who meet on the first Monday of the month in the reading room to talk about books, roofs and money.</footer></body>""",
    """<body><nav data-main=0><p>Here you find the way to all rooms of the house, to the garden, to the tower and to the small shop beside the gate where the tickets are sold.</p></nav><main data-main=1><p>Sold out.</p></main><div class="related" data-main=0>More on the same matter can be read in the
    yearly book of the house, in the guide for children and in the letters of its first owner.</div></body>""",
    """<body><article data-main=1><h1>Lost</h1><p>One grey cat.</p></article><div class="newsletter" data-main=0>Leave your address here and we write to you whenever a cat, a dog, a bird or anything else that has a name is lost or found within ten miles of your door.</div></body>""",
    """<body><main data-main=1><p>It rained.</p></main><footer data-main=0><p>Made by hand in the old school, with the help of everyone who brought a chair, a lamp or a cake, and paid for by the lottery, the bank and the baker of the next village.</p></footer></body>""",
    """<body><div class="notice" data-main=0>From the first of the month on, all orders are sent by the new carrier, who comes on three days of the week and does not ring the bell of houses without a name on the door.</div><article data-main=1><p>Plum jam.</p></article><div class="promo" data-main=0>Whoever buys three jars of
    anything before the fair gets a fourth of the same kind for the price of the empty jar.</div></body>""",
)


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in ATTRIBUTE.findall(text)}


class Area:
    """A container with a mark, and the words of the blocks whose nearest marked container it is."""

    __slots__ = ("mark", "closed", "wrapper", "around", "words")

    def __init__(self, mark: int, closed: bool, wrapper: bool, around: Area | None):
        self.mark, self.closed, self.wrapper, self.around, self.words = mark, closed, wrapper, around, 0


def name_words(name: str) -> set[str]:
    """The words of a compound name (``share-buttons``, ``siteHeader``) that say something."""
    return {w for w in PART.split(CAMEL.sub("-", name).lower()) if w and not w.isdigit()} - PLAIN_WORDS


def name_mark(name: str) -> int:
    """-1, 0 or 1 for one class name, id or role; a compound name decides if none of its parts disagrees or is unknown."""
    words = name_words(name)
    if words and words <= BAD_WORDS:
        return -1
    if words and words <= GOOD_WORDS:
        return 1
    # "post-comments" and "article-footer" are parts of a post, but "content-sidebar" is a layout.
    parts = [w for w in PART.split(name.lower()) if w]
    return -1 if len(parts) == 2 and parts[0] in GOOD_WORDS - {"content", "main"} and parts[1] in BAD_WORDS else 0


def _area(tag: str, attributes: dict[str, str], around: Area | None) -> Area | None:
    """The nearest marked container of what lies inside a new container; a heading area inside an article belongs to the article."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split() if tag not in ("html", "body") else ()
    marks = {name_mark(name) for name in names}
    if tag in BAD_TAGS and not (tag == "header" and around is not None and around.mark > 0) or -1 in marks:
        closed = tag in CLOSED_TAGS or any(name_words(name) & BAD_WORDS - OPEN_WORDS for name in names if name_mark(name) < 0)
        return Area(-1, closed or around is not None and around.closed, tag in WRAPPERS and -1 not in marks, around)
    if (tag in GOOD_TAGS or 1 in marks) and not (around is not None and around.closed):
        return Area(1, False, False, around)
    return around


def _settle(areas: list[Area], words: int) -> None:
    """Forms that hold more than half of the words take the mark of what is around them."""
    inside = {id(area): area.words for area in areas}
    for area in reversed(areas):
        if area.around is not None:
            inside[id(area.around)] += inside[id(area)]
    for area in areas:
        if area.wrapper and 2 * inside[id(area)] > words:
            area.mark = area.around.mark if area.around is not None else 0


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


class Tags:
    """The end of each tag of a page, by one pass over it."""

    def __init__(self, html: str):
        self.html, self.quotes, self.open = html, True, True

    def end(self, at: int) -> int:
        """The place of the ``>`` of a tag whose name ends at ``at``, or -1; a quote counts where a value may start."""
        here = at
        while self.quotes:
            mark = QUOTE.search(self.html, here)
            if mark is None:
                self.quotes = False
            elif mark[0] == ">":
                return mark.start()
            elif not self.html[max(at, mark.start() - 16) : mark.start()].rstrip().endswith("="):
                here = mark.end()
            else:
                here = self.html.find(mark[0], mark.end()) + 1
                self.quotes = here > 0
        found = self.html.find(">", at) if self.open else -1
        self.open = found >= 0
        return found


def blocks(html: str) -> list[dict]:
    """The text blocks of a page in order: text, words, links (share of words inside links), heading, mark and label (``data-main`` or None)."""
    found: list[dict] = []
    areas: list[Area] = []
    stack: list[tuple[str, Area | None, bool, str | None]] = [("", None, False, None)]  # tag, nearest marked area, hidden, label: of all containers around
    large: Counter = Counter()  # open large containers by tag
    small = [Counter()]  # open small containers inside the innermost large one
    buffer: list[tuple[str, bool]] = []
    never_closed: set[str] = set()
    tags = Tags(html)
    heading, links, at, total = 0, 0, 0, 0

    def flush():
        nonlocal total
        text = SPACE.sub(" ", unescape("".join(part for part, _ in buffer))).strip()
        if text:
            words = len(text.split())
            linked = len(unescape("".join(part for part, link in buffer if link)).split())
            _, area, _, label = stack[-1]
            total += words
            if area is not None:
                area.words += words
            found.append({"text": text, "words": float(words), "links": min(1.0, linked / words), "heading": float(heading), "mark": area, "label": label})
        buffer.clear()

    def add(text: str):
        if text and not stack[-1][2]:
            buffer.append((text, links > 0))

    def pop():
        tag = stack.pop()[0]
        if tag in SMALL:
            small[-1][tag] -= 1
        else:
            small.pop()
            large[tag] -= 1

    def close(tag: str):
        """End the innermost open ``tag``; a small element does not reach out of a larger one."""
        if (small[-1] if tag in SMALL else large)[tag]:
            while stack[-1][0] != tag:
                pop()
            pop()

    while True:
        match = TAG.search(html, at)
        add(html[at : match.start()] if match else html[at:])
        if match is None:
            break
        start, closing, tag = match.start(), match[1], match[2]
        if not tag:
            close_by = {"<!--": "-->", "<![CDATA[": "]]>"}.get(match[0], ">")
            end = html.find(close_by, match.end())
            if close_by == "]]>":
                add(html[match.end() : end if end >= 0 else len(html)].replace("&", "&amp;"))
            at = end + len(close_by) if end >= 0 else len(html)
            continue
        end = tags.end(match.end())
        if end < 0:
            add(html[start : match.end()])
            at = match.end()
            continue
        rest, at, tag = html[match.end() : end], end + 1, tag.lower()
        if tag in RAW:
            if not closing and not rest.endswith("/") and tag not in never_closed:
                ended = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                if ended:
                    at = ended.end()
                elif tag in ("script", "style", "title", "textarea"):
                    at = len(html)
                else:
                    never_closed.add(tag)
            if tag in ("button", "select", "textarea"):
                buffer.append((" ", links > 0))
            elif tag in ("title", "head", "iframe", "video", "noscript"):
                flush()
            continue
        if tag == "br":
            buffer.append((" ", links > 0))
            continue
        if tag not in INLINE:
            flush()
        if tag == "a":
            links = 0 if closing else 1
        if tag in HEADINGS:
            heading = 0 if closing else 1
            continue
        if tag not in CONTAINERS:
            continue
        if tag not in INLINE:
            links = 0
        if closing:
            close(tag)
        elif not rest.rstrip().endswith("/"):
            if tag in ("p", "li", "td"):
                close(tag)
            attributes = _attributes(rest) if "=" in rest or "hidden" in rest else {}
            _, around, hidden, label = stack[-1]
            area = _area(tag, attributes, around)
            if area is not around:
                areas.append(area)
            stack.append((tag, area, hidden or _hidden(attributes), attributes.get("data-main", label)))
            if tag in SMALL:
                small[-1][tag] += 1
            else:
                small.append(Counter())
                large[tag] += 1
    flush()
    _settle(areas, total)
    for block in found:
        block["mark"] = float(block["mark"].mark) if block["mark"] is not None else 0.0
    return found


def _described(found: list[dict]) -> list[dict]:
    """Blocks with the numbers of their neighbours; beyond the ends of a page there are no words and no links."""
    none = {"words": 0.0, "links": 0.0}
    out = []
    for i, block in enumerate(found):
        before = found[i - 1] if i else none
        after = found[i + 1] if i + 1 < len(found) else none
        out.append(block | {"words_before": before["words"], "links_before": before["links"], "words_after": after["words"], "links_after": after["links"]})
    return out


def labelled_blocks(spark: SparkSession) -> DataFrame:
    rows = [
        (*[b[name] for name in FEATURES], float(b["label"])) for page in LABELLED_PAGES for b in _described(blocks(page)) if b["label"] is not None
    ]
    return spark.createDataFrame(rows, ", ".join(f"{name} double" for name in (*FEATURES, "label")))


def fit_tree(labelled: DataFrame, depth: int = 5):
    """The root node of a decision tree over ``FEATURES``; it says 1 for main text."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, seed=7).fit(assembled)._java_obj.rootNode()


def tree_expression(node, value: dict[str, Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(node.prediction() == 1.0)
    split = node.split()
    return F.when(value[FEATURES[split.featureIndex()]] <= split.threshold(), tree_expression(node.leftChild(), value)).otherwise(
        tree_expression(node.rightChild(), value)
    )


def extract(pages: DataFrame, keys: list[str], html: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """``keys``, ``text`` (main blocks joined by an empty line) and ``blocks`` (text, words, links, heading, mark, main) of each whole page."""
    short_batches(pages.sparkSession)
    tree = fit_tree(labelled if labelled is not None else labelled_blocks(pages.sparkSession))
    rows, names = keyed(pages, keys, _html=text_of(html))
    columns = [name for name in BLOCK.elementType.names]

    def convert():
        return lambda htmls: [[{c: b[c] for c in columns} for b in blocks(x)] for x in htmls]

    made = with_arrow_column(rows, "_html", "_blocks", BLOCK, ARROW_BLOCK, convert)

    def judged(block: Column, i: Column) -> Column:
        whole = F.col("_blocks")
        before, after = F.get(whole, i - 1), F.get(whole, i + 1)
        value = {name: block[name] for name in FEATURES[:4]}
        value |= {f"{name}_before": F.coalesce(before[name], F.lit(0.0)) for name in ("words", "links")}
        value |= {f"{name}_after": F.coalesce(after[name], F.lit(0.0)) for name in ("words", "links")}
        return block.withField("main", tree_expression(tree, value))

    made = made.withColumn("blocks", F.transform("_blocks", judged))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["text"]), "\n\n")
    return made.select(*names, text.alias("text"), "blocks").withColumnsRenamed(names)
