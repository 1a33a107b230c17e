"""Blocks of a web page with their place in it, and token streams of pages (numpy and regular expressions, inside tasks)."""

from __future__ import annotations

import html as html_lib
import re
from urllib.parse import urlsplit

import numpy as np
import xxhash

from .textkit import mix, windows

MAIN, OPEN, SIDE = 0, 1, 2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template title textarea iframe object svg canvas audio video select head".split())
RAW = frozenset("script style title textarea iframe noscript template svg canvas audio video".split())
SIDE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Parts of class and id names of what stands around an article.
SIDE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup social sharing share related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager comment comments disqus replies reply respond login widget toolbar copyright skip".split()
)
NOT_NAMED = frozenset("no has with without".split())
#: Parts that such a name may have beside it within an article, where a part alone says little (share-price, related-work).
BESIDE_NAMES = frozenset(
    "box boxes list lists block blocks bar bars area areas section wrapper wrap container inner outer group row col column panel pane item items link links button buttons icon icons "
    "tool tools post posts article articles story stories entry page site content text body main top bottom left right center inline slot unit form field input message messages card cards "
    "more also news topics tags tag by line media video image label title heading head mobile desktop sticky fixed floating js wp el section sections thread count policy banner".split()
)
#: Names of a layout rather than of what it holds.
LAYOUT_NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar aside widget toolbar".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset "
    "figure figcaption address hr body html details summary center menu dialog option head".split()
)
VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
#: Start tags that end an open element of the same kind, up to the container that holds both.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_P_ENDS = BLOCKS - {"body", "html", "option", "head"}
_P_HOLDS = frozenset("td th li div section article main blockquote body form figure aside nav header footer".split())


def _named_side(attributes: str, in_main: bool, but: frozenset[str] = frozenset()) -> bool:
    """Whether attributes hide an element or name it as standing beside the article; names in ``but`` do not count.

    Within the article a name counts with nothing but parts of such names around it.
    """
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in SIDE_ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = _PARTS.findall(word)
                if in_main and not all(p in SIDE_NAMES or p in BESIDE_NAMES or p.isdigit() for p in parts):
                    continue
                for i, part in enumerate(parts):
                    if part in SIDE_NAMES and part not in but and not (i and parts[i - 1] in NOT_NAMED) and not (in_main and part == "header"):
                        return True
    return False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block with text: inside an article or main element, beside it, or in neither.

    Comments, scripts and markup are gone, character references decoded, white space is one space.  On a page without
    text in an article or main element those inside a form or a container with the name of a layout count too.
    """
    if not page:
        return []
    out = _read(page, False)
    if any(zone == MAIN for zone, _ in out):
        return out
    lenient = _read(page, True)
    return lenient if any(zone == MAIN for zone, _ in lenient) else out


def _read(page: str, lenient: bool) -> list[tuple[int, str]]:
    """The blocks, read strictly; or with articles and main elements inside forms and layouts found as such."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = [("", OPEN, False)]  # tag, zone, within an article

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            if said:
                out.append((stack[-1][1] if not stack[-1][2] or stack[-1][1] != MAIN else MAIN - 1, said))
            text.clear()

    def pop(kinds: tuple[str, ...], until: tuple[str, ...] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in kinds:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text.append(html_lib.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[1]:
            if tag in BLOCKS or tag not in VOID:
                pop((tag,), ("",))
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _P_ENDS:
            pop(("p",), _P_HOLDS)
        if tag in CLOSES:
            pop(*CLOSES[tag])
        _, zone, article = stack[-1]
        role = tag == "main" or "main" in m[3].lower() and re.search(r"\brole\s*=\s*[\"']?main\b", m[3], re.I) is not None
        if zone != SIDE:
            passed = lenient and zone == OPEN
            if tag in HIDDEN or tag in SIDE_TAGS and not (tag == "header" and zone == MAIN) and not (passed and tag == "form"):
                zone = SIDE
            elif m[3] and tag not in ("html", "body") and _named_side(m[3], zone == MAIN, LAYOUT_NAMES if passed else frozenset()):
                zone = SIDE
            elif tag == "article" or role:
                zone, article = MAIN, article or tag == "article"
        stack.append((tag, zone, article))
    flush()
    # Where there are articles, the rest of a main element is not the article.
    if any(zone < MAIN for zone, _ in out):
        return [(MAIN if zone < MAIN else OPEN if zone == MAIN else zone, said) for zone, said in out]
    return out


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


_BREAK = np.uint64(0xA0761D6478BD642F)


def stream(found: list[tuple[int, str]], host: str) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
    """Token keys of the blocks outside the article, tied to the host, a break after each block; and the blocks' words."""
    outside = [(i, said.split()) for i, (zone, said) in enumerate(found) if zone != MAIN]
    return _tokens([words for _, words in outside], host, {}), outside


#: Words whose keys a task remembers.
KNOWN_WORDS = 1 << 16


def _key(said: str) -> int:
    return xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"))


def _tokens(said: list[list[str]], host: str, known: dict[str, int]) -> np.ndarray:
    """Token keys of blocks, tied to the host, a break after each block; ``known`` remembers the keys of words."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    flat: list[int] = []
    for words in said:
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = _key(w)
            flat.append(k)
        flat.append(int(_BREAK))
    return mix(np.array(flat, np.uint64) ^ np.uint64(_key(host)))


def article_key(found: list[tuple[int, str]]) -> int:
    """Key of the article's text, 0 on a page without one."""
    inside = [said for zone, said in found if zone == MAIN]
    return _key("\n".join(inside)) if inside else 0


def covered_blocks(found: list[tuple[int, str]], host: str, repeated: np.ndarray, depth: int, known: dict[str, int]) -> list[tuple[int, int, int, int, int]]:
    """(place, words, block, before, after) of the article's blocks that repeats (sorted fingerprints) cover whole.

    The last three are keys of texts: of the block, and of the nearest blocks of the article that are not covered (0: none).
    """
    inside = [(i, said, said.split()) for i, (zone, said) in enumerate(found) if zone == MAIN]
    hit = covered(_tokens([words for _, _, words in inside], host, known), repeated, depth)
    if not hit.any():
        return []
    starts = np.cumsum([0, *(len(words) + 1 for _, _, words in inside)])
    whole = [bool(hit[a : a + len(words)].all()) for a, (_, _, words) in zip(starts.tolist(), inside)]
    around = [0 if w else _key(said) for w, (_, said, _) in zip(whole, inside, strict=True)]
    return [
        (i, len(words), _key(said), next((k for k in reversed(around[:at]) if k), 0), next((k for k in around[at + 1 :] if k), 0))
        for at, (i, said, words) in enumerate(inside) if whole[at]
    ]


def prefix_ranks(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the concatenated streams in the order of their first ``depth`` tokens (a power of two).

    Returns the suffix array, the ranks (equal for equal prefixes), and the stream of each position.  Ranks are doubled
    from one token to two, four and so on; every stream ends in a token of its own, so prefixes never cross pages.
    """
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    rank = np.zeros(len(owner), np.int64)
    body = np.ones(len(owner), bool)
    body[ends] = False
    _, inside = np.unique(np.concatenate(streams), return_inverse=True)
    rank[body] = inside + len(streams)
    rank[ends] = np.arange(len(streams))
    step = 1
    while step < depth:
        ahead = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[: len(rank)]
        pair = rank * (rank.max() + 2) + ahead + 1
        _, rank = np.unique(pair, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable"), rank, owner


def repeated_prefixes(streams: list[np.ndarray], depth: int, pages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the distinct prefixes of ``depth`` tokens, the streams that have each (or the pages that these
    streams stand for), and one such stream."""
    streams_long = [i for i, s in enumerate(streams) if len(s) >= depth]
    if not streams_long:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    order, rank, owner = prefix_ranks(streams, depth)
    starts = np.cumsum([0, *(len(s) + 1 for s in streams)])
    whole = np.zeros(len(rank), bool)
    for i in streams_long:
        whole[starts[i] : starts[i + 1] - depth] = True
    order = order[whole[order]]
    # Neighbours in the suffix array with equal ranks share the prefix.
    pairs = np.unique(np.column_stack([rank[order], owner[order]]), axis=0)
    ranks, first = np.unique(pairs[:, 0], return_index=True)
    held = np.add.reduceat(np.ones(len(streams), np.int64)[pairs[:, 1]] if pages is None else pages[pairs[:, 1]], first) if len(first) else np.empty(0, np.int64)
    lead = order[np.searchsorted(rank[order], ranks)]
    spot = owner[lead]
    prints = np.array([windows(streams[o][p - starts[o] : p - starts[o] + depth], depth)[0] for o, p in zip(spot.tolist(), lead.tolist(), strict=True)], np.uint64)
    return prints, held, pairs[first, 1]


def covered(tokens: np.ndarray, repeated: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie in a repeated prefix (sorted fingerprints)."""
    prints = windows(tokens, depth)
    edge = np.zeros(len(tokens) + 1, np.int64)
    if len(prints) and len(repeated):
        at = np.minimum(np.searchsorted(repeated, prints), len(repeated) - 1)
        hit = np.flatnonzero(repeated[at] == prints)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + depth, -1)
    return np.cumsum(edge)[:-1] > 0


def unique_words(words: list[str], gone: np.ndarray, depth: int) -> list[str]:
    """Words of a block outside its covered runs; a run shorter than ``depth`` only goes if it is the whole block, since
    it may be the fringe of a repeat in the next block."""
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    keep = np.ones(len(words), bool)
    for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if z - a >= min(depth, len(words)):
            keep[a:z] = False
    return [w for w, k in zip(words, keep, strict=True) if k]


def main_text(
    found: list[tuple[int, str]], marked: np.ndarray | None, outside: list[tuple[int, list[str]]], depth: int, gone: frozenset[int] = frozenset()
) -> str:
    """The article's blocks but for those at the places ``gone``; on a page without article or main element, the unmarked
    blocks without covered runs."""
    if any(zone == MAIN for zone, _ in found):
        return "\n".join(said for i, (zone, said) in enumerate(found) if zone == MAIN and i not in gone)
    kept, at = [], 0
    for i, words in outside:
        if found[i][0] == OPEN:
            left = unique_words(words, marked[at : at + len(words)], depth) if marked is not None else words
            if left:
                kept.append(" ".join(left))
        at += len(words) + 1
    return "\n".join(kept)
