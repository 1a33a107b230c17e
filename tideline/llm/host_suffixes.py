"""Main text of web pages from their structure and a suffix array per host.

1. Every page is cut into blocks; articles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments
   are told by elements, roles and names.  What stands outside the article is the page's token stream.
2. Distinct streams of a host are sorted as suffixes.  A prefix of ``depth`` tokens that enough pages share is
   boilerplate; longer repeats are chains of such prefixes.  A host of any size is dealt into parts of bounded size by the
   hash of the stream; parts send the page counts of their prefixes and the sums decide, so no host meets in one task.
3. Boilerplate structure goes; of pages without an article the covered words go too and unique runs stay.
4. The tokens of every article are matched with what most of its host's pages repeat outside of articles.  A block that
   this covers whole, and that stands between different blocks on enough pages, is a notice within the articles and goes.

Enough is a least number and a share of the host's distinct pages, so a few pages that repeat a passage of an article do
not cut it out on a large host.  Pages are distinct if their streams or their articles differ.  On a host of few pages near copies of a page still count as pages of their own.

What articles alone repeat is their text and stays, however many do, and so does what fewer pages than most have beside
their article: adverts and reader comments repeat passages of articles.  So does a title or a passage of one article that
menus or teasers of other pages repeat: it stands between the same blocks wherever that article does.  Articles are not
in the suffix arrays, since a repeat among them decides nothing.

Defined cases: null and empty html give an empty text; a null or malformed url is the host ""; pages with equal streams
and articles count once, so copies of a page do not turn each other into boilerplate; repeated rows get equal results; broken markup
is read as far as it goes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_blocks as B
from .common import SMALL_BYTES, small, stage

#: Tokens of a repeat (a power of two), distinct pages that must share it, share of the host's distinct pages that they
#: must be too, the same share where a repeat is to leave an article, tokens of a part.
DEPTH, MIN_PAGES, MIN_SHARE, MOST, PART_TOKENS = 8, 3, 0.1, 0.5, 1_000_000


def streams(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(row, host, tokens, article, page): stream of each row, ``page`` is its key, ``article`` that of the article's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, u, page in batch.itertuples(index=False):
                host = B.host_of(u)
                blocks = B.blocks(page)
                tokens, _ = B.stream(blocks, host)
                rows.append((row, host, tokens.view(np.int64), int(np.uint64(B.article_key(blocks)).astype(np.int64))))
            yield pd.DataFrame(rows, columns=["row", "host", "tokens", "article"])

    cols = pages.select(F.xxhash64(url, html).alias("row"), F.col(url).alias("u"), F.col(html).alias("h"))
    return cols.mapInPandas(run, "row long, host string, tokens array<long>, article long").withColumn("page", F.xxhash64("host", "tokens"))


def parts(found: DataFrame, part_tokens: int) -> DataFrame:
    """Distinct streams of each host with their bin; hosts above the bound are dealt into several parts.

    A stream stands for as many pages as there are different articles with it around them.
    """
    told = found.where((F.size("tokens") > 0) | (F.col("article") != 0)).select("host", "page", "article").distinct()
    told = stage(told.groupBy("host", "page").agg(F.count("*").alias("pages")))
    distinct = found.where(F.size("tokens") > 0).dropDuplicates(["page"]).select("page", "host", "tokens")
    sizes = distinct.groupBy("host").agg(F.sum(F.size("tokens")).alias("n")).join(told.groupBy("host").agg(F.sum("pages").alias("host_pages")), "host")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // part_tokens) * 2)
    own = sizes.select("host", "host_pages", F.ceil(F.col("n") / part_tokens).cast("long").alias("parts"))
    placed = distinct.join(told.select("page", "pages"), "page").join(own, "host")
    return placed.select("page", "host", "tokens", "pages", "parts", "host_pages", F.pmod(F.xxhash64("host", F.pmod("page", "parts")), F.lit(bins)).alias("bin"))


def repeats(placed: DataFrame, depth: int, min_pages: int, min_share: float) -> DataFrame:
    """(bin, host, print, share): prefixes that enough distinct pages of their host share, for each bin that has them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        prints, pages, one = B.repeated_prefixes([np.asarray(t, np.int64).view(np.uint64) for t in group["tokens"]], depth, group["pages"].to_numpy())
        # A lone prefix of a host that lies in one part has no other page.
        sent = (pages > 1) | (group["parts"].to_numpy()[one] > 1) if len(one) else np.empty(0, bool)
        # Prefixes are tied to their host, so one page tells which it is and how many pages it has.
        size = group["host_pages"].to_numpy()[one][sent] if len(one) else np.empty(0, np.int64)
        host = group["host"].to_numpy()[one][sent] if len(one) else np.empty(0, object)
        return pd.DataFrame({"bin": group["bin"].iloc[0], "host": host, "print": prints[sent].view(np.int64), "pages": pages[sent], "host_pages": size})

    seen = stage(placed.groupBy("bin").applyInPandas(run, "bin long, host string, print long, pages long, host_pages long"))
    often = seen.groupBy("print").agg(F.sum("pages").alias("pages"), F.max("host_pages").alias("host_pages"))
    often = often.where((F.col("pages") >= min_pages) & (F.col("pages") >= min_share * F.col("host_pages")))
    return seen.select("bin", "host", "print").join(often.select("print", (F.col("pages") / F.col("host_pages")).alias("share")), "print")


def marks(placed: DataFrame, prints: DataFrame, depth: int) -> DataFrame:
    """(page, marked): 1 for the tokens of a distinct stream that repeats cover."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(right["print"].to_numpy(np.int64).view(np.uint64))
        found = [B.covered(np.asarray(t, np.int64).view(np.uint64), known, depth) for t in left["tokens"]]
        return pd.DataFrame({"page": left["page"], "marked": [np.packbits(m).tobytes() for m in found], "n": [int(m.sum()) for m in found]})

    return placed.groupBy("bin").cogroup(prints.groupBy("bin")).applyInPandas(run, "page long, marked binary, n long").where("n > 0")


def leaked(pages: DataFrame, url: str, html: str, prints: DataFrame, depth: int, min_pages: int) -> DataFrame:
    """(row, places, words): blocks of articles that are boilerplate of their host, by their places on the page.

    ``prints`` are on most pages of their host, so a host has at most two pages' worth of them, however large it is.
    """
    often = stage(prints.select("host", "print").distinct())
    by_host = often.groupBy("host").agg(F.collect_list("print").alias("prints"))
    by_host = F.broadcast(by_host) if often.count() * 40 <= SMALL_BYTES else by_host

    @F.pandas_udf("string")
    def hosts(u: pd.Series) -> pd.Series:
        return u.map(B.host_of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for row, host, page, prefixes in batch.itertuples(index=False):
                repeated = np.sort(np.asarray(prefixes, np.int64).view(np.uint64))
                for place, words, *keys in B.covered_blocks(B.blocks(page), host, repeated, depth, known):
                    rows.append((row, host, place, words, *np.array(keys, np.uint64).view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["row", "host", "place", "words", "block", "before", "after"])

    cols = pages.select(F.xxhash64(url, html).alias("row"), hosts(F.col(url)).alias("host"), F.col(html).alias("h")).join(by_host, "host")
    cols = cols.select("row", "host", "h", "prints")
    found = stage(cols.mapInPandas(run, "row long, host string, place int, words long, block long, before long, after long").dropDuplicates(["row", "place"]))
    between = found.select("host", "block", "before", "after").distinct().groupBy("host", "block").count()
    gone = stage(between.where(F.col("count") >= min_pages).select("host", "block"))
    return found.join(small(gone, 64), ["host", "block"]).groupBy("row").agg(F.collect_list("place").alias("places"), F.sum("words").alias("words"))


def main_texts(
    pages: DataFrame, url: str = "url", html: str = "html", depth: int = DEPTH, min_pages: int = MIN_PAGES, part_tokens: int = PART_TOKENS,
    min_share: float = MIN_SHARE, most: float = MOST,
) -> DataFrame:
    """Adds ``text``, ``n_chars`` and ``n_repeated`` to ``pages``: words outside the article that the host repeats, and those of blocks that
    leave the article."""
    found = stage(streams(pages, url, html))
    placed = stage(parts(found, part_tokens))
    prints = stage(repeats(placed, depth, min_pages, min_share))
    marked = marks(placed, prints.select("bin", "print"), depth)
    marked = found.select("row", "page").distinct().join(marked, "page").select("row", "marked", "n")
    rows = stage(
        marked.join(leaked(pages, url, html, prints.where(F.col("share") >= most), depth, min_pages), "row", "full").select(
            F.col("row").alias("_tideline_row"), F.col("marked").alias("_tideline_marked"), F.col("places").alias("_tideline_places"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("words", F.lit(0))).alias("_tideline_n"),
        )
    )

    @F.pandas_udf("string")
    def read(u: pd.Series, h: pd.Series, m: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for where, page, bits, places in zip(u, h, m, gone, strict=True):
            blocks = B.blocks(page)
            tokens, outside = B.stream(blocks, B.host_of(where)) if bits is not None else (None, [(i, s.split()) for i, (z, s) in enumerate(blocks) if z != B.MAIN])
            hit = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(tokens)].astype(bool) if bits is not None else None
            out.append(B.main_text(blocks, hit, outside, depth, frozenset(places) if places is not None else frozenset()))
        return pd.Series(out, dtype=object)

    pages = pages.drop(*[c for c in ("text", "n_chars", "n_repeated") if c in pages.columns and c not in (url, html)])
    out = pages.withColumn("_tideline_row", F.xxhash64(url, html)).join(small(rows, 96), "_tideline_row", "left")
    out = out.withColumn("text", read(F.col(url), F.col(html), F.col("_tideline_marked"), F.col("_tideline_places")))
    return out.select(*pages.columns, "text", F.length("text").cast("long").alias("n_chars"), F.coalesce("_tideline_n", F.lit(0)).cast("long").alias("n_repeated"))
