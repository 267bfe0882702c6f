"""Main text of web pages by wrappers that are inferred for each host.

A page is a stream of tokens: start tags (with class, id and role), end tags and
texts.  Equal neighbouring groups of tokens fold into one repeated group.  The
folded streams of a host's pages are aligned one after another into a wrapper, a
regular expression without unions: what matches stays, a text against a text is
a text slot, and what only one side has becomes an optional group.  Equal
streams count once; of a host with more than ``FAN`` different streams, groups
of about so many are aligned first and their wrappers then with each other,
level by level, so a host of any size is spread over tasks.

A template is the pages of a host that declare main text at the same article or
main elements or, of those without one, have text in the same set of boxes.  Each
template has its own wrapper.  Every page's stream is matched against it, which
gives each text its place in the wrapper.

Texts under menus, headers, footers, sidebars, notices, adverts, forms and
comments (by element, role, class or id) are not main text; inside an article or
main element, a header's headings are, and class words of paragraphs, headings
and list items do not count.  Of the others, those inside the article or main
elements are main text, if the template has them; else those inside the element
that holds most text outside links.  There the wrapper decides: a place whose
strings mismatch between pages is a text slot, one where three or more pages of
different texts have the same is template text.  Template text before the first
and after the last slot goes, and outside article and main elements also that
between slots whose element never varies.  A page that would lose all its text
keeps what is inside the element.

Null and empty html give the empty text; null urls are one host.  Repeated ids
are extracted row by row; extra columns are ignored.  Character references are
decoded, white space in a block becomes one space, blocks are joined by one
space.  Pages are parsed whole, in time and memory in proportion to their length;
elements nested deeper than ``DEPTH`` count as part of the one at that depth.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.storage import durable

#: Streams that one task aligns, on average.
FAN = 256
#: Longest group of tokens that is looked for as a repetition.
FOLD = 24
#: Deepest nesting of elements that paths tell apart.
DEPTH = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msub msup mfrac msqrt".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
BAD_TAGS = frozenset("nav header footer aside form button menu dialog head".split()) | RAW
#: Words of boilerplate anywhere in a class, id or role, and those that must be all of one.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter outbrain pagination pager popup "
    "promo promoted sharing sidebar signup sponsor sponsored subscribe taboola toolbar topbar".split()
)
BAD_WHOLE = frozenset("copyright disclaimer header login notice notices notification promotion related reply replies respond search share skip social subscription widget widgets related-posts related-articles social-share share-buttons search-form skip-link site-header page-header cookie-notice site-notice legal-notice".split())
#: Elements of running text, whose class words do not count inside an article.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN_WORDS = frozenset("main articlebody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_LINK = re.compile(r"(^|/)a(\.|/|$)")


def _signature(tag: str, attributes: str) -> str:
    """Element name with its class, id and role words, digits dropped."""
    if "=" not in attributes:
        return tag
    words = sorted({re.sub(r"\d+", "", w.lower()) for _, *v in _ATTRIBUTE.findall(attributes) for w in "".join(v).split()} - {""})
    return ".".join([tag, *(re.sub(r"[./\s]", "-", w) for w in words)])


def parse(page: str) -> Iterator[tuple[str, str, str]]:
    """("<sig", "", ""), (">sig", "", "") and ("#", path, text) in page order.

    Elements that HTML closes by itself are closed; raw elements are skipped.
    """
    stack: list[tuple[str, str, str]] = []  # tag, signature, path
    opened: dict[str, int] = {}
    inline = 0  # inline elements at the end of the stack

    def push(tag: str, sig: str) -> None:
        nonlocal inline
        before = stack[-1][2] if stack else ""
        if len(stack) < DEPTH or tag in BAD_TAGS and not is_bad(before):
            before = f"{before}/{sig}" if before else sig
        stack.append((tag, sig, before))
        opened[tag] = opened.get(tag, 0) + 1
        inline = inline + 1 if tag in INLINE else 0

    def pop() -> str:
        nonlocal inline
        tag, sig, _ = stack.pop()
        opened[tag] -= 1
        if inline:
            inline -= 1
        else:
            while inline < len(stack) and stack[-1 - inline][0] in INLINE:
                inline += 1
        return ">" + sig

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if m[7] is not None:
            yield "#", stack[-1][2] if stack else "", m[7]
            continue
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    yield pop(), "", ""
                yield pop(), "", ""
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            yield pop(), "", ""
        # a paragraph also ends where only inline elements are open inside it
        if inline and tag in CLOSED_BY["p"] and len(stack) > inline and stack[-1 - inline][0] == "p":
            for _ in range(inline + 1):
                yield pop(), "", ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if not rest.rstrip().endswith("/"):
                at = end.end() if end else n
            continue
        sig = _signature(tag, rest)
        if not (tag in VOID or rest.rstrip().endswith("/") and tag not in INLINE | {"p", "div"}):
            push(tag, sig)
        yield "<" + sig, "", ""


# A wrapper is a list of nodes: a token, ["+", nodes] (repeated) or ["?", nodes] (optional).



def fold(tokens: list) -> list:
    """Fold equal neighbouring groups, short ones first, until nothing changes."""
    changed = True
    while changed:
        changed = False
        for width in range(1, FOLD + 1):
            out: list = []
            i = 0
            while i < len(tokens):
                group = tokens[i : i + width]
                j = i + width
                if len(group) == width and (width > 1 or group[0] == "#"):
                    while tokens[j : j + width] == group:
                        j += width
                if j > i + width:
                    body = group
                    if width == 1 and isinstance(group[0], list) and group[0][0] == "+":
                        body = group[0][1]
                    out.append("#" if body == ["#"] else ["+", body])
                    changed = True
                    i = j
                elif width > 1 and out and isinstance(out[-1], list) and out[-1][0] == "+" and out[-1][1] == group:
                    changed = True  # one more round of the repetition before
                    i = j
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
    return tokens


def _bodies(nodes: list) -> list[list]:
    return [x[1] for x in nodes if isinstance(x, list) and x[0] == "+"]


def _lift(nodes: list, bodies: list[list]) -> list:
    """Write single occurrences of the other side's repeated groups as repeated groups."""
    for body in sorted(bodies, key=len, reverse=True):
        out, i = [], 0
        while i < len(nodes):
            if nodes[i : i + len(body)] == body:
                out.append(["+", body])
                i += len(body)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """The wrapper of everything that either wrapper matches."""
    if a == b:
        return a
    a, b = _lift(a, _bodies(b)), _lift(b, _bodies(a))

    def flat(nodes: list) -> list[tuple[str, object, bool]]:
        out = []
        for x in nodes:
            if isinstance(x, list) and x[0] == "?":
                out += [(k, y, True) for k, y, _ in flat(x[1])]
            elif isinstance(x, list):
                out.append(("+" + str(x[1][0]), x, False))
            else:
                out.append((x, x, False))
        return out

    x, y = flat(a), flat(b)
    out: list[tuple[object, bool]] = []
    for how, i, j, k, m in SequenceMatcher(None, [t[0] for t in x], [t[0] for t in y], autojunk=False).get_opcodes():
        if how == "equal":
            for (key, p, may), (_, q, might) in zip(x[i:j], y[k:m], strict=True):
                out.append((["+", align(p[1], q[1])] if key[0] == "+" else p, may or might))
        else:
            out += [(p, True) for _, p, _ in x[i:j]] + [(q, True) for _, q, _ in y[k:m]]
    nodes: list = []
    for node, optional in out:
        if not optional:
            nodes.append(node)
        elif nodes and isinstance(nodes[-1], list) and nodes[-1][0] == "?":
            nodes[-1][1].append(node)
        else:
            nodes.append(["?", [node]])
    return nodes


def pattern(nodes: list) -> str:
    """The wrapper as a readable regular expression."""
    return " ".join(x if isinstance(x, str) else f"({pattern(x[1])}){x[0]}" for x in nodes)


def slots(nodes: list) -> set[str]:
    """The paths of the wrapper's text slots."""
    found: set[str] = set()

    def walk(items: list, stack: list[str]) -> None:
        for x in items:
            if isinstance(x, list):
                walk(x[1], stack)
            elif x == "#":
                found.add("/".join(stack))
            elif x[0] == "<" and x[1:].split(".")[0] not in VOID:
                stack.append(x[1:])
            elif x[0] == ">" and x[1:] in stack:
                while stack.pop() != x[1:]:
                    pass

    walk(nodes, [])
    return found


def program(nodes: list) -> list[tuple[str, object]]:
    """The wrapper as steps: a token, "skip" (or go to a step) around each optional token, "loop" back to a step."""
    steps: list = []

    def emit(items: list) -> None:
        for x in items:
            if isinstance(x, str):
                steps.append(("token", x))
            elif x[0] == "+":
                start = len(steps)
                emit(x[1])
                steps.append(("loop", start))
            else:
                for y in x[1]:
                    at = len(steps)
                    steps.append(None)
                    emit([y])
                    steps[at] = ("skip", len(steps))

    emit(nodes)
    return steps


def match(steps: list[tuple[str, object]], tokens: list[str]) -> list[int] | None:
    """The step that each token matches; repetitions and optional tokens are taken where they fit."""
    n, m = len(steps), len(tokens)
    came: dict[tuple[int, int], tuple[int, int] | None] = {}
    stack: list[tuple] = [(0, 0, None)]
    while stack:
        step, at, before = stack.pop()
        if (step, at) in came:
            continue
        came[step, at] = before
        if step == n:
            if at < m:
                continue
            out, now = [0] * m, (step, at)
            while (before := came[now]) is not None:
                if before[1] < now[1]:
                    out[before[1]] = before[0]
                now = before
            return out
        kind, value = steps[step]
        if kind == "token":
            if at < m and tokens[at] == value:
                stack.append((step + 1, at + 1, (step, at)))
        elif kind == "skip":
            stack += [(value, at, (step, at)), (step + 1, at, (step, at))]
        else:
            stack += [(step + 1, at, (step, at)), (value, at, (step, at))]
    return None


def places(steps: list[tuple[str, object]]) -> list[int]:
    """The block of each step: steps with only inline elements between them are one block."""
    out, block = [], 0
    for kind, value in steps:
        if kind == "token" and value != "#" and value[1:].split(".")[0] not in INLINE:
            block += 1
        out.append(block)
    return out


def _words(sig: str) -> set[str]:
    _, *words = sig.split(".")
    return {p for w in words for p in re.split(r"[-_:]+", w)} | set(words)


def _bad_words(sig: str) -> bool:
    whole = set(sig.split(".")[1:])
    return bool(whole & BAD_WHOLE or _words(sig) & BAD_WORDS)


@lru_cache(1 << 14)
def is_bad(path: str) -> bool:
    parts = path.split("/")
    inside = False
    for k, sig in enumerate(parts):
        tag = sig.split(".")[0]
        heading = inside and tag == "header" and any(x.split(".")[0] in HEADINGS for x in parts[k + 1 :])
        if not heading and (tag in BAD_TAGS or not (inside and tag in TEXT_TAGS) and _bad_words(sig)):
            return True
        inside = inside or _is_main(sig)
    return False


def _is_main(sig: str) -> bool:
    return sig.split(".")[0] in ("article", "main") or bool(_words(sig) & MAIN_WORDS)


def _box(path: str) -> str:
    parts = path.split("/")
    while parts and parts[-1].split(".")[0] in INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "td", "tr", "pre"}:
        parts.pop()
    return "/".join(parts)


def _element(path: str) -> str:
    parts = path.split("/")
    while len(parts) > 1 and parts[-1].split(".")[0] in INLINE:
        parts.pop()
    return "/".join(parts)


def _good(paths: set[str]) -> tuple[set[str], bool]:
    """The paths that can be main text, and whether they are inside article or main elements."""
    good = {p for p in paths if p and not is_bad(p)}
    main = {p for p in good if any(_is_main(s) for s in p.split("/"))}
    return (main, True) if main else (good, False)


def template(paths: set[str]) -> str:
    """What pages of one template share: their outermost main elements, or the boxes of their texts."""
    good, declared = _good(paths)
    if not declared:
        return json.dumps(sorted({_box(p) for p in good}))
    tops = set()
    for p in good:
        parts = p.split("/")
        tops.add("/".join(parts[: 1 + next(i for i, s in enumerate(parts) if _is_main(s))]))
    return json.dumps(["main", *sorted(tops)])


def choose(stats: list[dict]) -> tuple[set[tuple[int, str]], set[tuple[int, str]]]:
    """Main-text slots of a wrapper (block and path), and those inside its main element.

    ``stats`` of each slot: characters, characters in links, different pages (3 for
    more) and whether its block has the same text on all.
    """
    good, declared = _good({r["path"] for r in stats})
    if declared:
        inside = [r for r in stats if r["path"] in good]
    else:
        weight: dict[str, int] = {}
        for r in stats:
            if r["path"] in good:
                weight[_box(r["path"])] = weight.get(_box(r["path"]), 0) + r["chars"] - 2 * r["linked"]
        if not weight:
            return set(), set()
        box = max(sorted(weight), key=lambda k: weight[k])
        inside = [r for r in stats if r["path"] in good and (r["path"] == box or not box or r["path"].startswith(box + "/"))]
    texts: dict[int, set] = {}
    pages: dict[int, set] = {}
    for r in inside:
        texts.setdefault(r["block"], set()).update((r["least"], r["most"]))
        pages.setdefault(r["block"], set()).update(r["pages"])
    varying = {b for b in texts if len(texts[b]) > 1 or len(pages[b]) < 3}
    elements = {_element(r["path"]) for r in inside if r["block"] in varying}
    all_inside = {(r["block"], r["path"]) for r in inside}
    kept = {(b, p) for b, p in all_inside if b in varying or varying and min(varying) < b < max(varying) and (declared or _element(p) in elements)}
    return kept or all_inside, all_inside


SEEN = "page_id long, url string, host string, template string, stream string, tokens string, paths array<string>, texts array<string>"


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's template, folded stream, tokens (blank texts as a space) and texts with their paths."""
    folded: dict[str, str] = {}
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("template", "stream", "tokens", "paths", "texts")}
        for page in batch["html"].to_pylist():
            tokens, paths, texts = [], [], []
            for kind, path, value in parse(page or ""):
                if kind == "#":
                    paths.append(path)
                    texts.append(value)
                    kind = "#" if value.strip() else " "
                tokens.append(kind)
            key = json.dumps(tokens)
            if key not in folded:
                if len(folded) > 5000:
                    folded.clear()
                folded[key] = json.dumps(fold(_joined(tokens)))
            out["template"].append(template({p for p, t in zip(paths, texts, strict=True) if t.strip()}))
            out["stream"].append(folded[key])
            out["tokens"].append(key)
            out["paths"].append(paths)
            out["texts"].append(texts)
        text, texts = pa.string(), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], *(pa.array(v, texts if c in ("paths", "texts") else text) for c, v in out.items())], ["page_id", "url", "host", *out])


def _joined(tokens: list[str]) -> list[str]:
    """Tokens without blank texts, neighbouring texts as one."""
    out: list[str] = []
    for t in tokens:
        if t != " " and not (t == "#" and out and out[-1] == "#"):
            out.append(t)
    return out


class _Matcher:
    """The place in the wrapper of each text of a page: its block, three numbers a block (-1: blank, or no match)."""

    def __init__(self) -> None:
        self.wrappers: dict[str, tuple[list, list[int]]] = {}
        self.known: dict[tuple[str, str], list[int]] = {}

    def __call__(self, nodes: str, tokens: str) -> list[int]:
        if (found := self.known.get((nodes, tokens))) is not None:
            return found
        if len(self.known) > 5000:
            self.known.clear()
            self.wrappers.clear()
        if nodes not in self.wrappers:
            steps = program(json.loads(nodes))
            self.wrappers[nodes] = steps, places(steps)
        steps, blocks = self.wrappers[nodes]
        items = json.loads(tokens)
        at = match(steps, _joined(items))
        out, k, last = [], -1, ""
        entered: dict[int, int] = {}  # rounds of each block
        now = -1
        for t in items:
            if t == " ":
                out.append((-1, 0))
                continue
            k += not (t == "#" and last == "#")
            last = t
            block = -1 if at is None else blocks[at[k]]
            if block != now:
                entered[block] = entered.get(block, -1) + 1
                now = block
            if t == "#":
                out.append((block, entered[block]))
        # in a repetition, the first and the last round are places of their own
        out = [b if b < 0 else 3 * b + (0 if r == 0 else 2 if r == entered[b] else 1) for b, r in out]
        self.known[nodes, tokens] = out
        return out


SLOTS = "host string, template string, block int, path string, chars long, linked long, least long, most long, pages array<long>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and slot: characters, characters in links, least and most hash of its block's text, up to three different pages."""
    matcher = _Matcher()
    for batch in batches:
        found: dict[tuple, list] = {}
        for row in batch.to_pylist():
            blocks = matcher(row["nodes"], row["tokens"])
            texts = [(b, p, t) for b, p, t in zip(blocks, row["paths"], row["texts"], strict=True) if t.strip()]
            good, _ = _good({p for _, p, _ in texts})
            page = _hash("\0".join(t for _, p, t in texts if p in good))
            whole: dict[int, str] = {}
            for b, p, t in texts:
                if p in good:
                    whole[b] = whole.get(b, "") + " ".join(t.split()) + " "
            hashes = {b: _hash(t) for b, t in whole.items()}
            for b, p, t in texts:
                if p in good:
                    h = hashes[b]
                    r = found.setdefault((row["host"], row["template"], b, p), [0, 0, h, h, set()])
                    r[0] += len(t)
                    r[1] += len(t) if _LINK.search(p) else 0
                    r[2], r[3] = min(r[2], h), max(r[3], h)
                    if len(r[4]) < 3:
                        r[4].add(page)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        rows = [(*k, *v[:4], sorted(v[4])) for k, v in found.items()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SLOTS.split(", ")])


def _infer(key: tuple, table: pa.Table) -> pa.Table:
    nodes: list | None = None
    for stream in sorted(table["stream"].to_pylist(), key=lambda s: (len(s), s)):
        own = json.loads(stream)
        nodes = own if nodes is None else align(nodes, own)
    return pa.table({"host": table["host"][:1], "template": table["template"][:1], "stream": pa.array([json.dumps(nodes)], pa.string())})


WRAPPERS = "host string, template string, nodes string, wrapper string, main array<string>, kept array<string>, inside array<string>"


def _roles(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    texts = pa.list_(pa.string())
    if not left.num_rows:
        return pa.table([pa.array([], texts if "array" in c else pa.string()) for c in WRAPPERS.split(", ")], [c.split()[0] for c in WRAPPERS.split(", ")])
    kept, inside = choose(right.to_pylist())
    nodes = left["nodes"][0].as_py()
    lists = [sorted({p for _, p in kept}), sorted(f"{b} {p}" for b, p in kept), sorted(f"{b} {p}" for b, p in inside)]
    return pa.table({"host": left["host"], "template": left["template"], "nodes": left["nodes"], "wrapper": pa.array([pattern(json.loads(nodes))], pa.string())} | {c: pa.array([v], texts) for c, v in zip(("main", "kept", "inside"), lists, strict=True)})


def _seen(pages: DataFrame) -> DataFrame:
    return durable(pages.select("page_id", "url", "host", "html").mapInArrow(_skeletons, SEEN), "pages-seen")


def _wrappers(seen: DataFrame) -> DataFrame:
    merged = seen.select("host", "template", "stream").distinct()
    while True:
        most = merged.groupBy("host", "template").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // FAN)
        salt = F.pmod(F.xxhash64("stream"), F.lit(max(1, groups)))
        merged = durable(merged.groupBy("host", "template", salt.alias("salt")).applyInArrow(_infer, "host string, template string, stream string"), "pages-wrapped")
        if groups <= 1:
            break
    nodes = merged.withColumnRenamed("stream", "nodes")
    rows = seen.join(nodes, ["host", "template"]).select("host", "template", "nodes", "tokens", "paths", "texts").mapInArrow(_slots, SLOTS)
    stats = rows.groupBy("host", "template", "block", "path").agg(
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))), 1, 3).alias("pages"),
    )
    return durable(nodes.groupBy("host", "template").cogroup(stats.groupBy("host", "template")).applyInArrow(_roles, WRAPPERS), "wrappers")


def wrappers(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``host, template, wrapper, main`` of a table with ``host``: the inferred expression and its main-text paths."""
    empty = F.lit(None)
    return _wrappers(_seen(pages.select(empty.cast("long").alias("page_id"), empty.cast("string").alias("url"), "host", F.col(html_col).alias("html")))).select("host", "template", "wrapper", "main")


def main_text(tokens: list[str], slots: list[tuple[int, str]], texts: list[str], kept: set[str]) -> str:
    """The texts at kept slots, block by block."""
    paths = {k.split(" ", 1)[1] for k in kept}
    blocks: list[str] = []
    now: list[str] = []
    k = 0
    for t in tokens:
        if t in ("#", " "):
            block, path = slots[k]
            if f"{block} {path}" in kept or t == " " and path in paths:
                now.append(html.unescape(texts[k]))
            k += 1
        elif now and t[1:].split(".")[0] not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = _Matcher()
    for batch in batches:
        sets: dict[tuple, set[str]] = {}
        out = []
        for row in batch.drop_columns(["page_id", "url"]).to_pylist():
            slots = list(zip(matcher(row["nodes"], row["tokens"]), row["paths"], strict=True))
            tokens, text = json.loads(row["tokens"]), ""
            for column in ("kept", "inside"):
                key = tuple(row[column])
                text = text or main_text(tokens, slots, row["texts"], sets.setdefault(key, set(key)))
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    seen = _seen(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")))
    known = _wrappers(seen).select("host", "template", "nodes", "kept", "inside")
    # the wrappers are a written table, so Spark knows their size: it broadcasts them below its threshold only
    joined = seen.join(known, ["host", "template"]).select("page_id", "url", "tokens", "paths", "texts", "nodes", "kept", "inside")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
