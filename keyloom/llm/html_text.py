"""HTML extraction with a sparse suffix array for each host.

Pages are cut into blocks of text; what the markup says outright is no article (menus, adverts, forms and the like) is left
out, and what it only hints at is marked. The token streams of a host's pages are then concatenated and looked at in two
steps. Sorted first is a sparse array of anchors: of the ANCHOR_TOKENS tokens from each place of a run on, those with the least
hash, so that every run has one, equal runs have equal ones, and neighbours mostly share theirs. A run can be on RUN_PAGES
distinct pages of the host only if its anchor is; all runs of such anchors, from every place, are then sorted and counted
themselves. A block that repeated runs cover is boilerplate if it is marked, if it stands outside an article, or if its runs
stand outside an article on some page of the host; repeated text that has no such mark and that only articles have is
quotation or syndication, and stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, table
from keyloom.llm.hashing import MULTIPLIERS, hashed_texts, mixed

#: A run has so many tokens (all of a shorter block) and counts on so many distinct pages; a block goes from this cover on.
RUN_TOKENS, RUN_PAGES, COVER = 16, 3, 0.9
#: Anchors have so many tokens: about one place in six begins one. This changes the work, not the result.
ANCHOR_TOKENS = 6
#: Hosts with more html are dealt into parts of about this size, whose runs are counted over the whole host by a shuffle.
PART_BYTES = 4_000_000
#: Up to so many such hosts, their numbers of parts are broadcast (some 10 MB); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in "script style textarea title xmp iframe noembed noframes noscript".split()}
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never article text. A header counts only outside an article.
CHROME = frozenset("aside audio canvas dialog embed footer form head iframe input menu meter nav noscript object progress script select style svg template textarea title video".split())
#: Words of class, id and role that mark the same.
CHROME_WORDS = frozenset(
    "ad ads adsense alert announcement advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo search".split()
)
#: The same, but only outside an article, which may have a header of its own.
OUTER_WORDS = frozenset(["header"])
#: Words that say nothing of their own. A name of these and of the words above marks outright; one with other words in it, as
#: share-price or legal-analysis, only hints.
PLAIN_WORDS = frozenset(
    "area article articles author avatar bar block body bottom box button buttons col column container content count date desktop entry field first fixed foot form global group head header heading icon icons id inner item items label last left link links list main message meta mobile module name outer page panel post posts primary reader readers right row secondary section site slot sticky text time title top unit user users wrap wrapper".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
ARTICLE = frozenset(["article", "main"])
#: Elements whose class, id and role say nothing of their content, but for articles in an article: readers' comments may be some.
WHOLE = ARTICLE | {"html", "body"}

_part = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([a-zA-Z][^\s/><]*+)|[^<]++|<", re.S)
#: What may stand before a tag's end: quotes count after an equals sign.
_inside = re.compile(r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+""")
_inside_unquoted = re.compile(r"[^<>]*+")
_attribute = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hump = re.compile(r"(?<=[a-z])(?=[A-Z])")
_split_words = re.compile(r"[^a-z0-9]+")
_hidden = re.compile(r"""(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_long_reference = re.compile(r"&#0*(?:[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,});?")
NOTHING, HINT, OUT = 0, 1, 2


def _marks(name: str, attributes: str, in_article: bool) -> int:
    """What an element's name, class, id and role say of its content: NOTHING, HINT at something beside the article, or OUT."""
    if name in CHROME or (name == "header" and not in_article):
        return OUT
    if not attributes or (name in WHOLE and not (in_article and name == "article")):
        return NOTHING
    found = NOTHING
    for _, a, b, c in _attribute.findall(attributes):
        for token in (a or b or c).split():
            words = {w for w in _split_words.split(_hump.sub("-", token).lower()) if w and not w.isdigit()}
            if not CHROME_WORDS.isdisjoint(words) or not (in_article or OUTER_WORDS.isdisjoint(words)):
                if words <= CHROME_WORDS | PLAIN_WORDS:
                    return OUT
                found = HINT
    return OUT if _hidden.search(attributes) else found


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """The blocks of a page in order, each with whether it is in an article and whether markup hints that it is none of it.

    Without what the markup rules out, hinted blocks that are mostly links, and blocks that are buttons. Tags may be missing
    or badly nested: a closing tag without an open element is ignored, paragraphs and list items end where the next begins,
    and an article that begins ends whatever menu or advert was never closed before it. A tag that the page's end cuts off
    goes. Takes time in proportion to the page, whatever is in it.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # name, what it says of its content
    opened: dict[str, int] = {}
    inner: list[dict[str, int]] = [{}]  # the same from each open article on
    marked = [0, 0, 0]  # open elements by what they say
    size = hinted = linked = pressed = 0  # characters of the block: all, hinted at, in links, in buttons
    articles = wasted = at = 0
    seen_article = False
    inside = _inside

    def end_block() -> None:
        nonlocal size, hinted, linked, pressed
        if text:
            words = unescape(_long_reference.sub("�", "".join(text))).split()
            hint = 2 * hinted > size
            if words and pressed < size and not (hint and 2 * linked >= size):
                out.append((" ".join(words), articles > 0, hint))
            text.clear()
            size = hinted = linked = pressed = 0

    def pop() -> str:
        nonlocal articles
        name, says = stack.pop()
        marked[says] -= 1
        opened[name] -= 1
        inner[-1][name] -= 1
        if name in ARTICLE:
            articles -= 1
            inner.pop()
        return name

    while m := _part.match(html, at):
        begin, at = at, m.end()
        name = m.group(2)
        if name is not None:
            end = inside.match(html, at).end()
            if end == len(html):
                break
            if html[end] != ">":  # no tag after all
                wasted += end - at
                if wasted > 8 * len(html):  # quotes that lead astray again and again
                    inside = _inside_unquoted
                name = None
            else:
                attributes, at = html[at:end], end + 1
        if name is None:
            t = html[begin:at]
            if not marked[OUT] and not t.startswith(("<!", "<?")):
                n = len(t.strip())
                text.append(t)
                size += n
                hinted += n if marked[HINT] else 0
                linked += n if opened.get("a") else 0
                pressed += n if opened.get("button") else 0
            continue
        name = name.lower()
        if name in BLOCK:
            end_block()
        if m.group(1):
            if (opened if name in ("body", "html") else inner[-1]).get(name):
                while pop() != name:
                    pass
            continue
        if name in ARTICLE and not seen_article:
            seen_article = True
            while marked[OUT]:
                pop()
        while stack and name in ENDS.get(stack[-1][0], ()):
            pop()
        if name in VOID:
            continue
        if name in RAW:
            end = RAW[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if attributes.endswith("/") and name not in BLOCK:
            continue
        says = _marks(name, attributes, articles > 0)
        if name in ARTICLE:
            articles += 1
            inner.append({})
        stack.append((name, says))
        marked[says] += 1
        opened[name] = opened.get(name, 0) + 1
        inner[-1][name] = inner[-1].get(name, 0) + 1
    end_block()
    return out


PAGE, OUTSIDE = np.uint32(0x7FFFFFFF), np.uint32(0x80000000)


def _hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of so many tokens from each place on."""
    n = max(len(words) - length + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h += words[k : k + n] * MULTIPLIERS[k]
    return mixed(h + np.uint64(length))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


def _among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the sorted known ones, and where it is, or would be."""
    at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
    return known[at] == x if len(known) else np.zeros(len(x), bool), at


class Suffixes:
    """The suffixes of the blocks of some pages: each one's run (64 bits of its first tokens), its anchor, block and place in it.

    Of a block's suffixes, all that have a whole run; the whole of a shorter block is its run and anchor.
    """

    def __init__(self, pages: list[tuple[list[str], bytes]]) -> None:
        """pages: the blocks of each, and a byte for each block: 1 in an article, 2 hinted at."""
        blocks_ = [b for texts, _ in pages for b in texts]
        self.page = np.repeat(np.arange(len(pages)), [len(texts) for texts, _ in pages])
        self.flags = np.frombuffer(b"".join(f for _, f in pages), np.uint8)
        # pages of equal text count as one
        self.digest = np.array([int.from_bytes(blake2b("\n".join(t).encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") for t, _ in pages], np.uint32) & PAGE
        words, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for hashes, bounds in hashed_texts(pa.array([b.encode("utf-8", "surrogatepass") for b in blocks_], pa.binary()), lower=False):
            words.append(hashes)
            lengths.append(np.diff(bounds))
        words, lengths = np.concatenate(words), np.concatenate(lengths)
        begins = np.cumsum(lengths) - lengths
        runs, anchors, block, place = [], [], [], []
        if (lengths >= RUN_TOKENS).any():
            h = _hashes(words, RUN_TOKENS)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[: len(h)]
            at = (np.arange(len(h)) - begins[owner]).astype(np.int32)
            inside = at <= (lengths - RUN_TOKENS)[owner]  # runs end in their block
            runs.append(h[inside])
            anchors.append(_least(_hashes(words, ANCHOR_TOKENS), RUN_TOKENS - ANCHOR_TOKENS + 1)[inside])
            block.append(owner[inside])
            place.append(at[inside])
        for length in range(1, RUN_TOKENS):
            some = np.flatnonzero(lengths == length)
            if len(some):
                h = np.zeros(len(some), np.uint64)
                for k in range(length):
                    h += words[begins[some] + k] * MULTIPLIERS[k]
                runs.append(mixed(h + np.uint64(length)))
                anchors.append(runs[-1])
                block.append(some.astype(np.int32))
                place.append(np.zeros(len(some), np.int32))
        self.run = np.concatenate([np.zeros(0, np.uint64), *runs])
        self.anchor = np.concatenate([np.zeros(0, np.uint64), *anchors])
        self.block = np.concatenate([np.zeros(0, np.int32), *block])
        self.place = np.concatenate([np.zeros(0, np.int32), *place])

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted anchors: each with up to RUN_PAGES of its pages."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.block[1:] != self.block[:-1])
        return _least_pages(self.anchor[new], self.digest[self.page[self.block[new]]])

    def repeats(self, anchors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted suffixes whose anchors (sorted) repeat on the host, by default on these pages: each run with up to
        RUN_PAGES of its pages, OUTSIDE if it stands outside an article."""
        some, _ = _among(self.anchor, _repeated(*self.sparse())[0] if anchors is None else anchors)
        block = self.block[some]
        return _least_pages(self.run[some], self.digest[self.page[block]] | np.where(self.flags[block] & 1, np.uint32(0), OUTSIDE))

    def kept(self, runs: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """For each block whether it stays. runs (sorted) repeat on the host, those of outside also outside an article."""
        told, at = _among(self.run, runs)
        count = lambda which: np.bincount(self.block[which], minlength=len(self.flags))
        least = COVER * count(np.ones(len(self.run), bool))
        covered = count(told) >= least
        loose = count(told & outside[at]) >= least if len(runs) else covered
        inside, hint = (self.flags & 1) > 0, (self.flags & 2) > 0
        in_article = np.zeros(len(self.digest), bool)
        np.logical_or.at(in_article, self.page, inside)
        stays = ~(covered & (hint | ~inside | loose))
        left = np.zeros(len(self.digest), bool)
        np.logical_or.at(left, self.page, stays)
        return np.where(in_article[self.page], inside & stays, stays | ~left[self.page])


def _least_pages(run: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run with up to RUN_PAGES of its distinct pages, the least ones; all are OUTSIDE if any of its pages is."""
    if not len(run):
        return run, page
    by = np.lexsort((page & PAGE, run))
    run, page = run[by], page[by]
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lengths = np.diff(np.r_[begin, len(run)])
    outside = np.repeat(np.bitwise_or.reduceat(page, begin) & OUTSIDE, lengths)
    page = page & PAGE
    new = np.r_[True, (run[1:] != run[:-1]) | (page[1:] != page[:-1])]
    run, page = run[new], (page | outside)[new]
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    place = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
    return run[place < RUN_PAGES], page[place < RUN_PAGES]


def _repeated(run: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of _least_pages: the runs on RUN_PAGES pages, sorted, and whether each is OUTSIDE."""
    if not len(run):
        return run, np.zeros(0, bool)
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    often = np.diff(np.r_[begin, len(run)]) >= RUN_PAGES
    return run[begin][often], (page[begin][often] & OUTSIDE) > 0


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The html as blocks, one to a line, and a byte of flags for each."""
    for batch in batches:
        found = [blocks(h.as_py() or "") for h in batch.column(batch.num_columns - 1)]
        arrays = [pa.array(["\n".join(t for t, _, _ in p) for p in found], pa.string()), pa.array([bytes(i + 2 * h for _, i, h in p) for p in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], ["page_id", "url", "host", "part", "parts", "body", "flags"])


def _suffixes(group: pd.DataFrame) -> Suffixes:
    return Suffixes([(b.split("\n") if f else [], f) for b, f in zip(group["body"], group["flags"], strict=True)])


def _written(group: pd.DataFrame, suffixes: Suffixes, runs: np.ndarray, outside: np.ndarray) -> pd.DataFrame:
    stays = iter(suffixes.kept(runs, outside).tolist())
    texts, gone = [], []
    for body, flags in zip(group["body"], group["flags"], strict=True):
        found = [(b, next(stays)) for b in (body.split("\n") if flags else [])]
        texts.append("\n".join(b for b, s in found if s))
        article = any(f & 1 for f in flags)
        gone.append(sum(not s and (f & 1 > 0 or not article) for (_, s), f in zip(found, flags, strict=True)))
    return pd.DataFrame({"page_id": group["page_id"].astype("Int64"), "url": group["url"], "text": texts, "repeated_blocks": gone})


def _whole_host(group: pd.DataFrame) -> pd.DataFrame:
    suffixes = _suffixes(group)
    return _written(group, suffixes, *_repeated(*suffixes.repeats()))


def _dealt(group: pd.DataFrame, run: np.ndarray, page: np.ndarray) -> pd.DataFrame:
    """A part's runs or anchors and their pages, by bucket: a few parts' worth each."""
    if not len(group):
        return pd.DataFrame({"host": [], "bucket": [], "part": [], "runs": [], "pages": []})
    bucket = (run % np.uint64(max(int(group["parts"].iloc[0]) // 4, 1))).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    pack = lambda x: [p.tobytes() for p in np.split(x[by], first[1:])][: len(first)]
    return pd.DataFrame({"host": group["host"].iloc[0], "bucket": bucket[by][first], "part": group["part"].iloc[0], "runs": pack(run), "pages": pack(page)})


def _anchors(group: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a part with up to RUN_PAGES of its pages that have them."""
    return _dealt(group, *_suffixes(group).sparse())


def _seen(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The runs of a part whose anchors repeat on the host, with up to RUN_PAGES of its pages that have them."""
    return _dealt(group, *_suffixes(group).repeats(_joined(told)[0]))


def _told(group: pd.DataFrame) -> pd.DataFrame:
    """The runs, or anchors, of a bucket that RUN_PAGES pages of the host have, for each part that has them."""
    seen = [np.frombuffer(x, "<u8") for x in group["runs"]]
    runs, outside = _repeated(*_least_pages(np.concatenate(seen), np.concatenate([np.frombuffer(x, "<u4") for x in group["pages"]])))
    out = []
    for part, x in zip(group["part"], seen, strict=True):
        own = np.isin(runs, x)
        if own.any():
            out.append((group["host"].iloc[0], part, runs[own].tobytes(), outside[own].tobytes()))
    return pd.DataFrame(out, columns=["host", "part", "runs", "outside"])


def _joined(told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What the buckets tell a part, sorted by run."""
    runs = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8") for x in told["runs"])])
    outside = np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool) for x in told["outside"])])
    by = np.argsort(runs)
    return runs[by], outside[by]


def _part_of_host(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if not len(group):
        return pd.DataFrame({"page_id": pd.array([], "Int64"), "url": [], "text": [], "repeated_blocks": []})
    return _written(group, _suffixes(group), *_joined(told))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_bytes: int = PART_BYTES, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per row of pages: page_id, url, text, repeated_blocks.

    text are the blocks of the article in page order, one to a line, character references decoded, white space inside a
    block as one space. Null and empty html give the empty text. Pages without article or main element keep all blocks
    that neither markup nor repetition across the host's pages rules out, or all that markup leaves if that is none.
    repeated_blocks counts the blocks that went because they repeat on RUN_PAGES distinct pages of the host or more; pages of
    equal text are one page there. A null url is a host of its own; repeated rows give the same text each. Other columns are
    ignored; an empty table gives an empty result. part_bytes and broadcast_hosts change how the work is dealt out, not
    the result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    large = rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")).filter(F.col("bytes") > part_bytes)
    large = cut(large.select("host", F.ceil(F.col("bytes") / part_bytes).alias("parts")))
    dealt = rows.join(F.broadcast(large) if large.count() <= broadcast_hosts else large, "host", "left")
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0))
    parsed = lambda of: of.select("page_id", "url", "host", part.alias("part"), "parts", "html").mapInArrow(_parsed, "page_id long, url string, host string, part long, parts long, body string, flags binary")
    kind = "page_id long, url string, text string, repeated_blocks long"
    whole, parts = parsed(dealt.filter("parts is null")), parsed(dealt.filter("parts is not null"))
    dealt_kind = "host string, bucket long, part long, runs binary, pages binary"
    told = lambda of: of.groupBy("host", "bucket").applyInPandas(_told, "host string, part long, runs binary, outside binary").groupBy("host", "part")
    of_host = parts.groupBy("host", "part")
    anchors = told(of_host.applyInPandas(_anchors, dealt_kind))
    runs = told(of_host.cogroup(anchors).applyInPandas(_seen, dealt_kind))
    from_parts = of_host.cogroup(runs).applyInPandas(_part_of_host, kind)
    return whole.groupBy("host").applyInPandas(_whole_host, kind).unionByName(from_parts)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "repeated_blocks")
