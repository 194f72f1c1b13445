"""Main text of pages by equivalence-class templates (operator 7).

Each page is parsed once, into a stored table of token digests, containers
and blocks of text; everything after that reads the columns it needs of that
table, and html is never shuffled.

Tokens of a page are its structural tags, told apart by the chain of open
containers, and its whole text blocks.  Over the different pages of one host, tokens
with the same occurrence vector (how often on which page) form an equivalence
class; the vector is carried as an order-free digest, so classes come from two
plain aggregations, however many pages a host has.  A class is valid when
it is large (``MIN_TOKENS``), frequent (``MIN_SHARE`` of the host's pages, three
at least), its tokens that occur once stand in one order on every page, and it
nests: on every page all of it lies in the same gap of the same enclosing class,
and no other class straddles it.  The valid classes are the host's template; its
tokens cut each page into slots, named by the template token before them.

What is main text is decided by what the slots hold on the host as a whole.
The deepest container of the template in which at least ``REGION_SHARE`` of
the host's varying text lies (text that is no template token, no link and not
marked off) is the host's region: blocks outside it go, whatever they are
called (but an article beside a region without one stays).  Inside it go blocks that are template tokens, blocks of mostly
link text in slots that are mostly links on their host, and parts marked off. Tags
and whole class names (navigation, footer, advert, comments ...) are evidence
only: they keep text from counting towards a region, mark reader comments and the
like inside it, and decide alone on pages that have no template or lack its region.

A host's template is one row of at most the tokens that half its pages share;
pages and templates are joined by host, by shuffle or, if Spark finds the
templates small enough, broadcast; AQE splits a host that holds most pages.

Defined cases: null html is empty, its text empty; a null or odd url belongs to
the empty host; pages repeated with one page_id are extracted each; unclosed or
broken markup is read leniently, never dropped; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowrank.llm.common import by_value, read_table, save_table, text_blocks

by_value(__name__)

MIN_TOKENS, MIN_SHARE, MIN_PAGES = 3, 0.5, 3
SLOT_LINKS = 0.3
REGION_SHARE = 0.5
REMEMBERED = 100_000               # digests of structural tokens a task remembers

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)/?>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_BLANK = re.compile(r"\s+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "template"}
CONTAINERS = set("html head body div section article main nav header footer aside form ul ol dl table details figure dialog fieldset menu svg select button".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre hr address figcaption summary thead tbody tfoot legend option".split())
BOILER = set("head nav footer aside form menu svg select button dialog fieldset".split())
MAIN = {"article", "main"}
# Class and id words that mark a part off, and words that may stand
# beside them in one name ("comment-list"); a name with any other word says nothing.
WORDS = set("""nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
banner cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist reply replies respond disqus share sharing social related
breadcrumb breadcrumbs newsletter subscribe subscription signup login search pagination pager widget toolbar complementary contentinfo""".split())
BESIDE = set("""site page post global main top bottom left right primary secondary list box bar block area wrap wrapper container section inner outer panel
form button buttons links items item slot unit text message thread""".split())
_VOID = set("br img input meta link hr wbr source col area base embed param track".split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTR.findall(text)}


def _marked(names: str, words: set[str]) -> bool:
    """Some whole name of ``names`` is made of ``words``, at least one, and words that may stand beside them."""
    for name in names.lower().split():
        parts = {x for x in re.split(r"[^a-z]+", name) if x}
        if parts & words and parts <= words | BESIDE:
            return True
    return False


class Parsed(NamedTuple):
    tokens: list[str]              # names in page order
    containers: list[tuple[int, int]]            # (token, enclosing container or -1)
    blocks: list[tuple[int, int, str, bool, bool, int]]
    # (token, container or -1, text, in a marked-off part, in an article, link characters)


def parse(page: str) -> Parsed:
    tokens, containers, blocks = [], [], []
    stack: list[tuple[str, bool, bool, int]] = []  # (tag, marked off, article, container)
    path: list[str] = []
    parts, link_chars, in_link = [], 0, False

    def flush():
        nonlocal link_chars
        if not parts:
            return
        text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            _, boiler, main, inside = stack[-1] if stack else ("", False, False, -1)
            blocks.append((len(tokens), inside, text, boiler, main, min(link_chars, len(text))))
            tokens.append("/".join(path) + "=" + text)
        link_chars = 0

    def add(s: str):
        nonlocal link_chars
        if s:
            parts.append(s)
            if in_link:
                link_chars += len(s)

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:-3]))
            continue
        if not m[1] and tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            # An unclosed raw element hides the rest of the page, as in a browser.
            at = close.end() if close else n
            continue
        if tag == "a":
            in_link = not m[1]
        if tag in ("br", "img"):
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag in CONTAINERS:
            if m[1]:
                depth = max((i for i, x in enumerate(stack) if x[0] == tag), default=-1)
                if depth >= 0:
                    del stack[depth:], path[depth:]
                tokens.append("/".join(path) + "</" + tag)
            else:
                own = _attributes(m[3]) if m[3] else {}
                names = " ".join(own[k] for k in ("class", "id", "role", "itemprop", "aria-label") if own.get(k))
                main = bool(stack and stack[-1][2]) or tag in MAIN
                hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(own.get("style", "")))
                boiler = bool(stack and stack[-1][1]) or tag in BOILER or hidden or (tag == "header" and not main)
                # A page's outermost elements are not marked off by their name alone.
                boiler = boiler or (tag not in ("html", "body", "main") and _marked(" ".join(own.get(k, "") for k in ("class", "id", "role")), WORDS - {"header"} if main else WORDS))
                containers.append((len(tokens), stack[-1][3] if stack else -1))
                stack.append((tag, boiler, main, len(containers) - 1))
                path.append(tag + ("." + names if names else ""))
                tokens.append("/".join(path))
        elif tag not in _VOID:
            tokens.append("/".join(path) + "<" + m[1] + tag)
    flush()
    return Parsed(tokens, containers, blocks)


def token_key(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


PAGE = ("page_id long, url string, host string, digest string, tokens array<long>, containers array<long>, parents array<int>, "
        "block_tokens array<int>, block_containers array<int>, texts array<string>, marked array<boolean>, main array<boolean>, links array<int>")


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: dict[str, int] = {}
    for rows, pages in text_blocks(batches, "html"):
        out = [[] for _ in range(13)]
        for page_id, url, page in zip(rows.column("page_id").to_pylist(), rows.column("url").to_pylist(), pages.to_pylist()):
            p = parse(page)
            texts = {b[0] for b in p.blocks}
            if len(keys) > REMEMBERED:
                keys.clear()
            found = []
            for i, name in enumerate(p.tokens):
                key = None if i in texts else keys.get(name)
                if key is None:
                    key = token_key(name)
                    if i not in texts:
                        keys[name] = key
                found.append(key)
            cols = list(zip(*p.blocks)) if p.blocks else [()] * 6
            digest = blake2b(page.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            row = (page_id, url, host_of(url), digest, found, [found[t] for t, _ in p.containers], [c for _, c in p.containers], *cols)
            for col, x in zip(out, row):
                col.append(x)
        longs, ints, flags = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), longs, longs, ints, ints, ints, pa.list_(pa.string()), flags, flags, ints]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in PAGE.split(", ")])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a block of different pages: pages, and the order-free
    digest of the occurrence vector, a sum modulo 2^64 in two halves."""
    for b in batches:
        found: dict[tuple[str, int], list] = {}
        hosts: dict[str, int] = {}
        for host, digest, tokens in zip(*(b.column(c).to_pylist() for c in ("host", "digest", "tokens"))):
            hosts[host] = hosts.get(host, 0) + 1
            seen = Counter(tokens)
            entry = {c: token_key(f"{digest}:{c}") for c in set(seen.values())}
            for key, count in seen.items():
                x = found.setdefault((host, key), [0, 0, 0])
                x[0] += 1
                x[1] = (x[1] + entry[count]) % (1 << 64)
                x[2] = max(x[2], count)
        for host, n in hosts.items():
            found[host, None] = [n, 0, 0]
        keys = list(found)
        cols = list(zip(*found.values())) if found else [[]] * 3
        low, high = [v & 0xFFFFFFFF for v in cols[1]], [v >> 32 for v in cols[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int64()), pa.array(cols[0], pa.int64()),
             pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(cols[2], pa.int64())],
            names=["host", "token", "pages", "low", "high", "most"])


def classes(pages: DataFrame) -> DataFrame:
    """(host, tokens, vectors, most): large and frequent classes of each host, of different ``pages``."""
    low, half = F.sum("low"), F.lit(0xFFFFFFFF)
    vector = F.shiftleft((F.sum("high") + F.shiftright(low, 32)).bitwiseAND(half), 32).bitwiseOR(low.bitwiseAND(half))
    found = save_table(pages.select("host", "digest", "tokens")
                       .mapInArrow(_vectors, "host string, token long, pages long, low long, high long, most long")
                       .groupBy("host", "token").agg(F.sum("pages").alias("pages"), vector.alias("vector"), F.max("most").alias("most")), "tokens")
    size = found.where("token is null").select("host", F.col("pages").alias("all_pages"))
    frequent = (found.where("token is not null").join(size, "host")
                .where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages"))))
    large = frequent.groupBy("host", "vector").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TOKENS).select("host", "vector")
    return (frequent.join(large, ["host", "vector"]).groupBy("host")
            .agg(F.sort_array(F.collect_list(F.struct("token", "vector", "most"))).alias("t"))
            .select("host", F.col("t.token").alias("tokens"), F.col("t.vector").alias("vectors"), F.col("t.most").alias("most")))


def nesting(order: list[tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """({class: (enclosing class or 0, its gap)}, classes that straddle another)
    of one page, from its (class, token) in page order."""
    left = Counter(v for v, _ in order)
    passed: Counter = Counter()
    stack, place, straddling = [], {}, set()
    for v, _ in order:
        if v not in place:
            place[v] = (stack[-1], passed[stack[-1]]) if stack else (0, 0)
            stack.append(v)
        elif v in stack:
            # Classes opened inside v that have tokens to come lie in two of its gaps.
            inner = stack[stack.index(v) + 1:]
            straddling.update(inner)
            del stack[stack.index(v) + 1:]
        passed[v] += 1
        left[v] -= 1
        while stack and not left[stack[-1]]:
            stack.pop()
    return place, straddling


def _slots(tokens: list[int], template, texts: set[int]) -> list[int]:
    """The last template token, no text, before each token."""
    out, last = [], 0
    for i, key in enumerate(tokens):
        out.append(last)
        if i not in texts and key in template:
            last = key
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host: order and nesting of each class, and what slots and containers hold, page by page."""
    for b in batches:
        rules, sums = set(), {}
        names = ("host", "tokens", "containers", "parents", "block_tokens", "block_containers", "lengths", "marked", "main", "links", "keys", "vectors", "most")
        for host, tokens, containers, parents, *blocks, keys, vectors, most in zip(*(b.column(c).to_pylist() for c in names)):
            template = {k: (v, m) for k, v, m in zip(keys, vectors, most)}
            once = [(template[t][0], t) for t in tokens if template.get(t, (0, 0))[1] == 1]
            by: dict[int, list] = {}
            for v, t in once:
                by.setdefault(v, []).append(t)
            place, straddling = nesting(once)
            rules.update((host, "class", v, token_key(",".join(map(str, x)))) for v, x in by.items())
            rules.update((host, "nest", v, token_key(f"{a}:{g}")) for v, (a, g) in place.items())
            rules.update((host, "straddle", v, 0) for v in straddling)
            slot = _slots(tokens, template, set(blocks[0]))
            first = Counter(containers)
            for token, inside, chars, marked, main, links in zip(*blocks):
                if marked or tokens[token] in template:
                    continue
                for key, x in (((host, "slot", slot[token]), (chars if main else 0, chars, links)), ((host, "all", 0), (0, chars, links))):
                    held = sums.setdefault(key, [0, 0, 0])
                    for i in range(3):
                        held[i] += x[i]
                depth = []
                while inside >= 0:
                    depth.append(inside)
                    inside = parents[inside]
                for level, c in enumerate(reversed(depth)):
                    if containers[c] in template and first[containers[c]] == 1:
                        held = sums.setdefault((host, "inside", containers[c]), [0, 0, 0])
                        held[0] = max(held[0], level)
                        held[1] += chars
                        held[2] += links
        out = [(*r, 0, 0) for r in rules] + [(*k, *x) for k, x in sums.items()]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "kind", "name", "a", "b", "c"])


def templates(parsed: DataFrame) -> DataFrame:
    """(host, template, link_slots, region): tokens of the valid classes, slots that
    are mostly links, and the container of the main text (null: none)."""
    # Copies of a page say nothing about what its host repeats.
    chosen = parsed.groupBy("host", "digest").agg(F.min("row").alias("row")).select("row")
    facts = parsed.withColumn("lengths", F.transform("texts", lambda x: F.length(x))).drop("texts", "url", "page_id")
    pages = save_table(facts.join(chosen, "row", "left_semi").drop("row"), "different")
    found = save_table(classes(pages), "classes")
    joined = pages.join(found.withColumnRenamed("tokens", "keys"), "host")
    seen = save_table(joined.mapInArrow(_observe, "host string, kind string, name long, a long, b long, c long")
                      .groupBy("host", "kind", "name").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.sum(F.when(F.col("kind") == "slot", F.col("a"))).alias("main"),
                                                            F.sum("b").alias("chars"), F.sum("c").alias("links")), "observed")
    broken = (seen.where("kind = 'straddle' or kind in ('class', 'nest') and lo <> hi")
              .groupBy("host").agg(F.collect_set("name").alias("broken")))
    links = (seen.where("kind = 'slot'").where((F.col("links") > SLOT_LINKS * F.col("chars")) & (2 * F.col("main") <= F.col("chars")))
             .groupBy("host").agg(F.collect_set("name").alias("link_slots")))
    varying = F.col("chars") - F.col("links")
    total = seen.where("kind = 'all'").select("host", varying.alias("total"))
    region = (seen.where("kind = 'inside'").join(total, "host").where(varying >= REGION_SHARE * F.col("total"))
              .groupBy("host").agg(F.max_by("name", F.struct("hi", varying, "name")).alias("region")))
    none = F.array().cast("array<bigint>")
    pairs = F.filter(F.arrays_zip("tokens", "vectors"), lambda x: ~F.array_contains(F.coalesce("broken", none), x["vectors"]))
    template = F.transform(pairs, lambda x: x["tokens"])
    return (found.join(broken, "host", "left").join(links, "host", "left").join(region, "host", "left")
            .select("host", template.alias("template"), F.coalesce("link_slots", none).alias("link_slots"),
                    F.when(F.array_contains(template, F.col("region")), F.col("region")).alias("region")))


def page_text(tokens, containers, parents, blocks, template: set[int], link_slots: set[int], region: int | None) -> str:
    """Main text of one page; ``blocks`` are (token, container, text, marked, main, links)."""
    within = None
    if region is not None and region in containers:
        within = []
        for key, up in zip(containers, parents):
            within.append(key == region or (up >= 0 and within[up]))

    def held(inside: int) -> bool:
        return within is None or (inside >= 0 and within[inside])

    # An article beside a region that is in no article itself is no boilerplate.
    beside = not any(main and held(inside) for _, inside, _, _, main, _ in blocks)
    slot = _slots(tokens, template, {b[0] for b in blocks}) if template else []
    out = []
    for token, inside, text, marked, main, links in blocks:
        if marked or not (held(inside) or (main and beside)):
            continue
        if template and (tokens[token] in template or (links > SLOT_LINKS * len(text) and slot[token] in link_slots)):
            continue
        out.append(text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("host", "tokens", "containers", "parents", "block_tokens", "block_containers", "texts", "marked", "main", "links")
    for b in batches:
        last, sets, out = None, None, []
        for i, (host, tokens, containers, parents, *blocks) in enumerate(zip(*(b.column(c).to_pylist() for c in names))):
            if host != last:
                last = host
                sets = [set(b.column(c)[i].as_py() or ()) for c in ("template", "link_slots")]
            out.append(page_text(tokens, containers, parents, list(zip(*blocks)), *sets, b.column("region")[i].as_py()))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The stored parse of every row, with ``row``, its place in that table."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return save_table(rows.mapInArrow(_parse_pages, PAGE).withColumn("row", F.monotonically_increasing_id()), "parsed")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    # Stored first, so that Spark knows the templates' size when it picks the join.
    found = save_table(templates(parsed), "templates")
    return parsed.join(found, "host", "left").mapInArrow(_extract, "page_id long, url string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
