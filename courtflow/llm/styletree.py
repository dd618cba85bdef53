"""Main text of pages by site style trees.

The DOMs of a host are merged: a node of the style tree is a path of tags with their classes and ids. Its
presentation importance is the entropy of the child sequences that pages show under it, its content
importance the entropy of what pages have in it, both to the base of the number of pages that show the node. A branch
that looks and reads the same on page after page has little of either and is removed from each page, whatever it is called. What differs from page to page and is no main text all the same (adverts, comments) no entropy tells, and on hosts with few
pages there is none to go by; there tags, roles and class names decide. A name does not count against the
body, the main part or the article of a page, nor against an element that is called or holds its main part and has most of its
text. Where a page marks its article and that is most of what is left, only that is kept.

Pages are scanned once from left to right, whatever quotes and tags are left open, and walked without recursion.
"""

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

#: fixed values: elements by their part in HTML
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "svg", "math"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
_BREAK = {"br", "hr", "wbr", "img"}
_CLOSES_P = set(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
_SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "aside", "nav", "body", "html"}
_NEVER = set(
    "head nav footer aside form button select input option dialog menu script style object canvas audio video".split()
) | _RAW
_NEVER_ROLES = set(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
_NEVER_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond toolbar pagination pager search skip "
    "teaser teasers widget widgets".split()
)
#: words in a class name that say what an element has, not what it is
_MODIFIERS = set("has have no not non with without to for is in on under near".split())
_MAIN_NAMES = set("main content article post story entry text body".split())
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "body", "html", "blockquote", "pre"}
_SPACES = re.compile(r"[\W_]+")


class _Node:
    """``path`` is a running hash of the keys from the root on, so that its length does not grow with the depth."""

    __slots__ = ("tag", "path", "above", "ruled", "never", "named", "called", "main", "inside", "parts", "shape")

    def __init__(self, tag, path, above, never, named, called, main, inside):
        self.tag, self.path, self.above, self.ruled, self.named, self.called = tag, path, above, never, named, called
        self.never = never  # by tag, role or style as ``ruled`` says, or later by name
        self.main, self.inside, self.parts, self.shape = main, inside, [], []


def _tag_end(page, at):
    """Where the tag whose name ends at ``at`` closes, past quoted values; -1 where a quote is left open."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        if page[at : m.start()].rstrip().endswith("="):
            at = page.find(m[0], m.end()) + 1
            if not at:
                return -1
        else:
            at = m.end()
    return -1


def _tokens(page):
    """Texts (str) and tags (place behind it, whether it closes, name, attributes) of a page; comments are left out.

    A generator: a place sent to it is where it goes on. Once a quote is left open, tags end at the first >.
    """
    at, end, quotes = 0, len(page), True
    while at < end:
        low = page.find("<", at)
        if low < 0:
            yield page[at:]
            return
        if low > at:
            yield page[at:low]
        at = low
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = close + 3 if close >= 0 else end
            continue
        m = _TAG.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            yield "<"
            at += 1
            continue
        close = _tag_end(page, m.end()) if m and quotes else -1
        if close < 0:
            close = page.find(">", at)
            quotes = quotes and m is None
        if close < 0:  # nothing behind here is a tag
            yield page[at:]
            return
        at = close + 1
        if m:
            at = (yield at, bool(m[1]), m[2].lower(), page[m.end() : close]) or at


def _attributes(text):
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip() else {}


def _said_of(tag, attrs, inside):
    """Key of an element; whether it is no main text by tag, role or style, or by a name; whether a name or a mark calls it main."""
    names = " ".join((attrs.get("class", ""), attrs.get("id", ""))).lower().split()
    key = tag + "".join("." + x for x in sorted(set(attrs.get("class", "").lower().split())))
    role = attrs.get("role", "").lower()
    never = tag not in ("html", "body") and (
        tag in _NEVER
        or role in _NEVER_ROLES
        or (not inside and tag == "header")
        or "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    )
    named = False
    for name in names if tag not in ("html", "body", "main") and role != "main" else ():
        words = set(_SPACES.split(name))
        if words & _MODIFIERS:
            continue
        against = _NEVER_NAMES if inside else _NEVER_NAMES | {"header"}
        named = named or (name in against if tag == "article" else bool(words & against))
    main = tag in ("article", "main") or role in ("article", "main") or attrs.get("itemprop", "") == "articleBody"
    return key, never, named, not _MAIN_NAMES.isdisjoint(names), main and not never and not named


def parse(page):
    """The nodes of a page in order, the root first. ``parts`` holds text (str) and child nodes."""
    root = _Node("", "", None, False, False, False, False, False)
    nodes, stack = [root], [root]
    opened = Counter()

    def leave():
        gone = stack.pop().tag
        opened[gone] -= 1
        return gone

    tokens, goto = _tokens(page), None
    while True:
        try:
            token, goto = tokens.send(goto), None
        except StopIteration:
            break
        if isinstance(token, str):
            stack[-1].parts.append(token)
            continue
        at, closes, tag, said = token
        if closes:
            if opened[tag]:
                while leave() != tag:
                    pass
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            goto = close.end() if close else len(page)
            continue
        if tag in _BREAK:
            stack[-1].parts.append(" ")
        # inline elements are part of the text around them, but for those that hold none of the main text
        nested = stack[-1].never or (stack[-1].named and stack[-1].tag in _INLINE)
        if tag in _VOID or tag in _INLINE and not nested and not said.strip():
            continue
        attrs = _attributes(said)
        key, never, named, called, main = _said_of(tag, attrs, stack[-1].inside)
        if tag in _INLINE and not never and not named and not nested:
            continue
        if tag in _CLOSES_P and stack[-1].tag == "p":
            leave()
        ends = _SIBLINGS.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    while len(stack) > i:
                        leave()
                    break
                if stack[i].tag in _SCOPES:
                    break
        above = stack[-1]
        node = _Node(tag, _path(above.path, key), above, never or above.never, named, called, main, above.inside or main)
        above.parts.append(node)
        above.shape.append(key)
        nodes.append(node)
        if not said.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _judge_names(nodes)
    return nodes


def _judge_names(nodes):
    """Let names count: a named element is no main text, unless it is called or holds the main part and has most of the text."""
    if not any(node.named for node in nodes):
        return
    size, marked = {}, set()
    for node in reversed(nodes):  # children come after their parents
        own = sum(len(p.strip()) if isinstance(p, str) else size[id(p)] for p in node.parts)
        size[id(node)] = 0 if node.never else own
        if node.main and not node.never:
            marked.add(id(node))
        if id(node) in marked and node.above is not None:
            marked.add(id(node.above))
    half = size[id(nodes[0])] / 2
    for node in nodes[1:]:
        spared = size[id(node)] > half and (node.called or id(node) in marked)
        node.never = node.never or node.above.never or (node.named and not spared)


def _path(above, key):
    return hashlib.blake2b(f"{above}/{key}".encode("utf-8", "replace"), digest_size=16).hexdigest()


def _said(pieces):
    """The text of a block's pieces, which are taken away."""
    text = " ".join(html.unescape("".join(pieces)).split())
    pieces.clear()
    return text


def _blocks(root, keep):
    """The blocks of text under a node, as (text, in the main part); depth is bounded by memory only."""
    out, pieces = [], []

    def flush(main):
        text = _said(pieces)
        if text:
            out.append((text, main))

    stack = [(iter(root.parts), False)]
    while stack:
        parts, main = stack[-1]
        for part in parts:
            if isinstance(part, str):
                pieces.append(part)
            elif part.tag in _INLINE and part.never:
                pieces.append(" ")
            else:
                flush(main)
                if keep(part):
                    stack.append((iter(part.parts), main or part.main))
                    break
        else:
            flush(main)
            stack.pop()
    return out


def extract(page, low=frozenset()):
    """Main text of one page; ``low`` holds the paths of its host's unimportant branches."""
    if not page:
        return ""
    nodes = parse(page)

    def text(keep):
        out = _blocks(nodes[0], keep)
        marked = [t for t, main in out if main]
        if 2 * sum(map(len, marked)) >= sum(len(t) for t, _ in out):
            return "\n".join(marked)
        return "\n".join(t for t, _ in out)

    said = text(lambda n: not n.never and n.path not in low)
    return said if said or not low else text(lambda n: not n.never)


def _digest(text):
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: fixed values: prime and base of the hash of a sequence of blocks
_PRIME, _BASE = (1 << 127) - 1, 0x2D358DCCAA6C78A58BB84B93962EACC9
_NOTHING = (0, 1)


def _then(one, two):
    """Hash of one sequence of blocks after another, with the power of the base that its length stands for."""
    return (one[0] * two[1] + two[0]) % _PRIME, one[1] * two[1] % _PRIME


def _content_hashes(nodes):
    """Hash of the blocks under each node; each piece of text is read once, however deep it lies."""
    out = {}
    for node in reversed(nodes):  # children come after their parents
        if node.ruled:
            continue
        whole, pieces = _NOTHING, []

        def flush(whole, pieces=pieces):
            text = _said(pieces)
            return _then(whole, (_digest(text) % _PRIME + 1, _BASE)) if text else whole

        for part in node.parts:
            if isinstance(part, str):
                pieces.append(part)
            elif part.tag in _INLINE and part.ruled:
                pieces.append(" ")
            else:
                whole = flush(whole)
                if not part.ruled:
                    whole = _then(whole, out[id(part)])
        out[id(node)] = flush(whole)
    return out


def branches(page):
    """(path, digest of its shapes, digest of its content) for each path of a page that tags, roles and styles don't rule out."""
    nodes = parse(page)
    hashes = _content_hashes(nodes)
    shapes, contents = {}, {}
    for node in nodes:
        if node.ruled or not node.path or node.tag in _TEXTUAL:
            continue
        shapes.setdefault(node.path, []).append(",".join(node.shape))
        contents[node.path] = _then(contents.get(node.path, _NOTHING), hashes[id(node)])
    return [(p, _digest(";".join(shapes[p])), _digest(f"{contents[p][0]:x}")) for p in shapes]


def _branch_page_rows(batches):
    for batch in batches:
        host, number, path, shape, content = [], [], [], [], []
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            whole = _digest(page)
            for p, s, c in branches(page):
                host.append(name)
                number.append(whole)
                path.append(p)
                shape.append(s)
                content.append(c)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(host, pa.string()),
                pa.array(number, pa.int64()),
                pa.array(path, pa.string()),
                pa.array(shape, pa.int64()),
                pa.array(content, pa.int64()),
            ],
            ["host", "page", "path", "shape", "content"],
        )


def importance(rows, damping=0.9):
    """host, path, pages and importance of the merged nodes; ``rows`` has host, path, shape, content, one per page and path.

    With l different shapes, the importance is (1 - damping^l) of presentation and damping^l of content importance.
    """
    kinds = rows.unpivot(["host", "path"], ["shape", "content"], "kind", "value")
    values = kinds.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    sums = values.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("pages"), F.sum(F.expr("n * ln(n)")).alias("weight"), F.count("*").alias("different")
    )
    entropy = F.when(F.col("pages") > 1, 1 - F.col("weight") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    each = sums.withColumn("entropy", entropy).groupBy("host", "path").agg(
        F.max("pages").alias("pages"),
        F.max(F.expr("if(kind = 'shape', entropy, null)")).alias("presentation"),
        F.max(F.expr("if(kind = 'content', entropy, null)")).alias("substance"),
        F.max(F.expr("if(kind = 'shape', different, null)")).alias("shapes"),
    )
    part = F.pow(F.lit(damping), F.col("shapes"))
    return each.withColumn("importance", (1 - part) * F.col("presentation") + part * F.col("substance"))


def _text_rows(batches):
    for batch in batches:
        low = [frozenset(x or ()) for x in batch.column("low").to_pylist()]
        found = [extract(h, x) for h, x in zip(batch.column("html").to_pylist(), low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"]
        )


def _large_hosts(rows, share=0.001):
    """Hosts with more than ``share`` of all pages, so 1 / share at most; their pages are dealt over all partitions."""
    counts = rows.where("host is not null").groupBy("host").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r.host for r in counts.where(F.col("count") > share * total).collect()]


def main_text(pages, least_importance=0.3, least_pages=8):
    """page_id, url and main text of each row of ``pages`` (page_id, url, html).

    Equal pages of a host count once in its style tree. A branch is removed where at least ``least_pages`` pages show it
    with an importance below ``least_importance``; text elements and the article itself are not up for removal, and a
    page that would lose everything keeps what tags and names allow. Rows without a host have no
    style tree. A null html is empty. Repeated rows are extracted each. Other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = rows.withColumn("host", F.when(F.length(host) > 0, host))
    shown = rows.where("host is not null").select("host", "html").mapInArrow(
        _branch_page_rows, "host string, page long, path string, shape long, content long"
    )
    shown = shown.distinct().drop("page")
    low = importance(shown).where((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
    low = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = F.col("host").isin(_large_hosts(rows))
    low = low.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int")).otherwise(0)
    return (
        rows.withColumn("salt", salt)
        .join(low, ["host", "salt"], "left")
        .select("page_id", "url", "html", "low")
        .mapInArrow(_text_rows, "page_id long, url string, text string")
    )
