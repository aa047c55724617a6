"""Main text of web pages: a host suffix array over the pages' token streams, with page structure as its guard.

A page is cut into blocks, each in a zone: inside an article or main element, in a known kind of boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, comments), or elsewhere. Its stream is the tokens of all its blocks,
with a token for each block's end.

A host's streams are concatenated, and their suffix array, sorted to the RUN tokens that matter, puts equal runs next to
each other. A run is repeated if two distinct pages of the host hold it, and frequent if at least OFTEN_PAGES and OFTEN_SHARE
of them do. Pages of equal streams count as one page, or copies would delete each other.

* On a page with neither article nor main element the array alone decides: tokens in repeated runs go, unique runs stay,
  and the known kinds of boilerplate go as well.
* On a page with an article (or else a main element) its blocks are the text, but for those that frequent runs cover from
  end to end: boilerplate without a name, such as an appeal that stands in each article of a host. Structure guards the rest: text
  that a few pages share is a copy or a quotation and stays, and so does all of an article of which frequent runs cover
  more than half, as that is a copy of other pages.

Hosts of up to SHARD_CHARS of html are done in one task each. Larger ones are dealt out in shards by hash of the stream, and
what the shards' arrays hold is joined by run hash, with the same decisions. A shard tells the runs that two of its pages hold,
and of the others those that pages without an article hold as well, which is all that the array decides there. So a run's sum
lacks at most one page for each shard that doesn't tell it; runs that those might make frequent are counted once more, in every
page. Where a run could be frequent with one page in each shard, the shards tell all runs.

Defined results: null html is empty and gives empty text; null url is a host of its own; repeated rows are pages of
their own; other columns are ignored; markup cut off by the end of the page is dropped, text is kept; a quote that isn't
closed is taken for a part of its tag only. Pages are read in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm import common

#: Tokens in the shortest run that counts as repeated.
RUN = 8
#: Pages of a host, and share of its pages, that hold a frequent run.
OFTEN_PAGES, OFTEN_SHARE = 5, 0.5
#: Characters of html of a host, or of a shard of it, that one task takes.
SHARD_CHARS = 12 << 20
#: Most repeated runs, of large hosts or of pages, that are broadcast.
BROADCAST_ROWS = 200_000

MARKUP = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP, ANGLE = re.compile(r"""[<>"']"""), re.compile(r"[<>]")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

ZONES = ("boilerplate", "other", "main", "article")
# Elements by kind, and words of class, id and role that name boilerplate.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
INLINE = {"button", "select", "object", "audio", "video", "canvas"}
NAMES = set(
    "ad ads advert adverts advertisement advertisements alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: First words of names that say what a thing has or lacks, not what it is.
SAYING = {"has", "have", "no", "with", "without", "is", "not", "hide", "show", "js"}
#: Elements that can hold such a name: inline ones are part of their block, whatever they are called.
HOLDERS = {"div", "section", "article", "ul", "ol", "dl", "table", "p", "main", "details", "figure", "blockquote", "center", "h1", "h2", "h3", "h4", "h5", "h6", "li"}


def named_boilerplate(attributes: str) -> bool:
    if "=" not in attributes:
        return bool(attributes) and bool(HIDDEN.search(attributes))
    if HIDDEN.search(attributes):
        return True
    for value in ATTRIBUTE.findall(attributes):
        for item in value.strip("\"'").split():
            words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", item).lower())
            if words and words[0] not in SAYING and not NAMES.isdisjoint(words):
                return True
    return False


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the > of a tag is whose name ends at at; -1 if another < comes first. > and < in quotes don't count if the quote
    is closed and the tag ends after it. dead: opening quotes already found to lead to no end, so none is followed twice."""
    i, seen = at, []
    while m := STOP.search(page, i):
        if m[0] == ">":
            return m.start()
        q = m.start()
        if m[0] == "<" or q in dead:
            break
        seen.append(q)
        i = page.find(m[0], q + 1) + 1
        if not i:
            break
    dead.update(seen)
    m = ANGLE.search(page, at)
    return m.start() if m and m[0] == ">" else -1


def markup(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before it, "/" or "", name, attributes, end) of each tag, and the text at the end with an empty name. Lower-case names.

    The reader may send the place to go on from.
    """
    at, since, last, dead = 0, 0, page.rfind(">"), set()
    while m := MARKUP.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            end = page.find("-->", start)
            end = end + 3 if end >= 0 else len(page)
            closing = name = attributes = ""
        elif start > last:  # cut off
            yield page[since:start], "", "", "", len(page)
            return
        elif m[0] in ("<!", "<?"):
            end = page.find(">", start) + 1
            closing = name = attributes = ""
        else:
            head = NAME.match(page, start)
            close = tag_end(page, head.end(), dead)
            if close < 0:
                at = start + 1
                continue
            closing, name, attributes, end = head[1], head[2].lower(), page[head.end() : close], close + 1
        go_on = yield page[since:start], closing, name, attributes, end
        at = since = end if go_on is None else go_on
    yield page[since:], "", "", "", len(page)


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block that isn't empty, in page order."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that matter, and the zone within
    opened: Counter[str] = Counter()
    zone = "other"

    def flush() -> None:
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            held.clear()
            if text:
                out.append((zone, text))

    def close(name: str) -> None:
        """Closes the innermost element of that name and all in it."""
        while stack:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    reader, go_on = markup(page), None
    while True:
        try:
            before, closing, name, attributes, end = reader.send(go_on)
        except StopIteration:
            break
        go_on = None
        if before and zone != "inline":
            held.append(before)
        if not name:
            continue
        if name == "br" or name in ("td", "th"):
            held.append(" ")
        elif name in RAW and not closing:
            tail = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, end)
            go_on = tail.end() if tail else len(page)
            if name in ("title", "textarea"):
                held.append(" ")
            continue
        if name in BLOCKS and zone != "inline":
            flush()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                if zone != "inline":
                    flush()
                close(name)
                zone = stack[-1][1] if stack else "other"
            continue
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        inside = zone
        if zone == "inline":
            pass
        elif name in INLINE:
            inside = "inline"
        elif zone != "boilerplate":
            if name in BOILERPLATE and not (name == "header" and zone in ("article", "main")):
                inside = "boilerplate"
            elif name in HOLDERS and attributes and named_boilerplate(attributes):
                inside = "boilerplate"
            elif name == "article":
                inside = "article"
            elif name == "main" and zone != "article":
                inside = "main"
        if inside != zone or name in ("div", "section", "article", "main") or name in BOILERPLATE or opened[name]:
            if inside not in (zone, "inline"):
                flush()
            if name == "p" and opened["p"]:  # closes the open paragraph, if it stands for a zone
                close("p")
                outer = stack[-1][1] if stack else "other"
                inside = inside if inside == "boilerplate" and attributes and named_boilerplate(attributes) else outer
            stack.append((name, inside))
            opened[name] += 1
            zone = inside
    zone = "other" if zone == "inline" else zone
    flush()
    return out


def best_zone(zones: Iterable[int]) -> int:
    """The zone of a page's text: article, else main, else other."""
    return max([1, *zones])


def stream_of(blocks: list[str]) -> list[str]:
    return [w for b in blocks for w in [*b.split(), "\n"]]


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first depth tokens (doubling), and each position's class: equal within that depth."""
    rank, k = tokens.astype(np.int64), 1
    while k < depth:
        step = min(k, depth - k)
        after = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)]
        _, rank = np.unique(rank * (len(rank) + int(rank.max(initial=0)) + 2) + after, return_inverse=True)
        k += step
    return np.argsort(rank, kind="stable"), rank


class Arrays:
    """The distinct runs of some pages' streams, each of RUN tokens: their hashes, and which pages hold them."""

    def __init__(self, streams: list[list[str]]):
        import xxhash

        coded: dict[str, int] = {}
        flat = [coded.setdefault(t, len(coded)) for s in streams for t in [*s, ""]]
        sizes = np.array([len(s) + 1 for s in streams], np.int64)
        codes = np.array(flat, np.int64) + len(streams)
        self.ends = np.cumsum(sizes) - 1
        codes[self.ends] = np.arange(len(streams))  # each stream ends in a token of its own
        self.owner = np.repeat(np.arange(len(streams)), sizes)
        order, rank = suffix_order(codes, RUN)
        order = order[self.ends[self.owner[order]] - order >= RUN]
        self.order, self.starts = order, np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]]) if len(order) else order
        self.sizes = np.diff(np.r_[self.starts, len(order)])
        words = np.fromiter(map(xxhash.xxh64_intdigest, coded), np.uint64, len(coded))
        self.words, self.codes = words, np.array(flat, np.int64)

    def pages(self) -> np.ndarray:
        """How many streams hold each run; positions of a run are in order, so those of a stream are next to each other."""
        if not len(self.order):
            return self.starts
        of = self.owner[self.order]
        new = np.r_[True, of[1:] != of[:-1]]
        new[self.starts] = True
        return np.add.reduceat(new.astype(np.int64), self.starts)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.words[self.codes], self.order[self.starts])

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """Which tokens lie in a chosen run; the streams one after another, each with its end."""
        at = self.order[np.repeat(chosen, self.sizes)]
        ends = np.zeros(len(self.codes) + RUN + 1, np.int64)
        np.add.at(ends, at, 1)
        np.add.at(ends, at + RUN, -1)
        return np.cumsum(ends)[: len(self.codes)] > 0


def run_hashes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the RUN tokens, given by their hashes, from each place on."""
    h = np.full(len(at), RUN, np.uint64)
    for i in range(RUN):
        h = (h ^ tokens[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def frequent(pages: np.ndarray, of: int) -> np.ndarray:
    return pages >= max(OFTEN_PAGES, OFTEN_SHARE * of)


def main_text(blocks: list[str], zones: list[int], repeated: np.ndarray, often: np.ndarray) -> str:
    """The text of a page whose stream has tokens in repeated and in frequent runs."""
    best, at, out = best_zone(zones), 0, []
    mine = []
    for text, zone in zip(blocks, zones, strict=True):
        words = text.split()
        if zone == best:
            mine.append((text, words, repeated[at : at + len(words)], often[at : at + len(words)]))
        at += len(words) + 1
    if best == 1:
        kept = (" ".join(w for w, gone in zip(words, r.tolist(), strict=True) if not gone) for _, words, r, _ in mine)
        return "\n".join(t for t in kept if t)
    boilerplate = [bool(o.all()) for *_, o in mine]
    hidden = sum(len(w) for (_, w, *_), gone in zip(mine, boilerplate, strict=True) if gone)
    if 2 * hidden > sum(len(w) for _, w, *_ in mine):
        boilerplate = [False] * len(mine)
    out = [t for (t, *_), gone in zip(mine, boilerplate, strict=True) if not gone]
    return "\n".join(out)


def host_texts(pages: list[tuple[list[str], list[int]]]) -> list[str]:
    """The texts of all pages, (blocks, zones), of one host."""
    streams = [stream_of(b) for b, _ in pages]
    first: dict[tuple[str, ...], int] = {}
    which = [first.setdefault(tuple(s), len(first)) for s in streams]
    distinct = list(map(list, first))
    arrays = Arrays(distinct)
    n = arrays.pages()
    repeated, often = arrays.covered(n > 1), arrays.covered(frequent(n, len(distinct)))
    begins = np.r_[0, arrays.ends + 1].tolist()
    return [main_text(b, z, repeated[begins[k] : begins[k + 1]], often[begins[k] : begins[k + 1]]) for (b, z), k in zip(pages, which, strict=True)]


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PAGE = "page_id long, url string, host string, sid long, blocks array<string>, zones array<int>, guarded boolean"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("sid", pa.int64()), ("blocks", pa.list_(pa.string())), ("zones", pa.list_(pa.int32())), ("guarded", pa.bool_())])
TEXT = "page_id long, url string, text string"
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, sid (the stream's hash), blocks, zones, and whether it has an article or main element, of each page."""
    import xxhash

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [blocks_of(p or "") for p in batch.column("html").to_pylist()]
        zones = [[ZONES.index(z) for z, _ in g] for g in got]
        sids = [xxhash.xxh64_intdigest("\n".join(t for _, t in g)) >> 1 for g in got]
        return common.batch_of(_PAGE, [batch.column("page_id"), batch.column("url"), batch.column("host"), sids, [[t for _, t in g] for g in got], zones, [best_zone(z) > 1 for z in zones]])

    return common.map_batches(pages, parse, PAGE)


def groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of equal keys, which come one after another."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (mine := tuple(r[k] for k in keys)) != key:
                if held:
                    yield held
                key, held = mine, []
            held.append(r)
    if held:
        yield held


def by_host(pages: DataFrame) -> DataFrame:
    """The texts of hosts that fit in one task each."""

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("host",)):
            found = host_texts([(r["blocks"], r["zones"]) for r in rows])
            yield common.batch_of(_TEXT, [[r["page_id"] for r in rows], [r["url"] for r in rows], found])

    return parsed(pages).repartition("host").sortWithinPartitions("host").mapInArrow(texts, TEXT)


def small(df: DataFrame, weight: str = "1") -> DataFrame:
    """df, which is written, to be broadcast if its rows weigh little."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(weight))).first()[0] or 0) <= BROADCAST_ROWS else df


def wanted_runs(of_host: DataFrame, runs_of: Callable[[DataFrame], DataFrame]) -> dict[str, np.ndarray]:
    """The runs of pages without an article, by host; only of the hosts with the fewest such tokens, BROADCAST_ROWS in all."""
    hosts, room = [], BROADCAST_ROWS
    for r in of_host.filter("loose > 0").select("loose", "host").orderBy("loose", "host").limit(BROADCAST_ROWS).collect():
        room -= r.loose
        if room < 0:
            break
        hosts.append((r.host,))
    if not hosts:
        return {}
    out: dict[str, list[int]] = {h: [] for h, in hosts}
    for r in runs_of(of_host.sparkSession.createDataFrame(hosts, "host string")).select("host", "run").distinct().collect():
        out[r.host].append(r.run)
    return {h: np.array(x, np.int64) for h, x in out.items()}


def by_shards(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """The texts of hosts that are dealt out in shards."""
    rows = common.materialize(parsed(pages), "parsed")
    mine = pa.schema([("host", pa.string()), ("sid", pa.int64()), ("run", pa.int64())])

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(hashes_of(b)) for b in batch.column("blocks").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        return common.batch_of(mine, [batch.column("host").take(at), batch.column("sid").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *found]))])

    def hashes_of(blocks: list[str]) -> np.ndarray:
        import xxhash

        words = np.fromiter(map(xxhash.xxh64_intdigest, stream_of(blocks)), np.uint64)
        return run_hashes(words, np.arange(max(0, len(words) - RUN + 1)))

    def runs_of(pages: DataFrame) -> DataFrame:
        return common.map_batches(pages.select("host", "sid", "blocks"), own, "host string, sid long, run long")

    tokens = F.expr("if(guarded, 0L, aggregate(blocks, 0L, (n, b) -> n + size(split(b, ' ')) + 1))")
    of_host = common.materialize(rows.groupBy("host").agg(F.count_distinct("sid").alias("of"), F.sum(tokens).alias("loose")).join(shards, "host"), "of_host")
    least = F.greatest(F.lit(float(OFTEN_PAGES)), F.col("of") * OFTEN_SHARE)
    loose = wanted_runs(of_host, lambda hosts: runs_of(rows.filter("NOT guarded").join(F.broadcast(hosts), "host", "left_semi")))
    share_loose = rows.sparkSession.sparkContext.broadcast(loose)
    streams = rows.select("host", "sid", "blocks").dropDuplicates(["host", "sid"]).join(of_host.withColumn("dense", F.col("shards") >= least).drop("of"), "host")
    dealt = streams.withColumn("shard", F.pmod("sid", "shards")).repartition("host", "shard").sortWithinPartitions("host", "shard", "sid")
    run = pa.schema([("host", pa.string()), ("run", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_())])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, ("host", "shard")):
            host, wanted = held[0]["host"], share_loose.value.get(held[0]["host"])
            whole = held[0]["dense"] or (held[0]["loose"] > 0 and wanted is None)
            arrays = Arrays([stream_of(r["blocks"]) for r in held])
            n, hashes = arrays.pages(), arrays.hashes()
            kept = (n > 1) | whole
            if wanted is not None:
                kept |= np.isin(hashes, wanted)
            k = int(kept.sum())
            yield common.batch_of(run, [[host] * k, pa.array(hashes[kept]), pa.array(n[kept]), [whole] * k])

    told = dealt.mapInArrow(runs, "host string, run long, n long, whole boolean").groupBy("host", "run").agg(F.sum("n").alias("n"), F.count("*").alias("told"), F.max("whole").alias("whole"))
    unsure = (F.col("n") < least) & (F.col("n") + F.col("shards") - F.col("told") >= least) & ~F.col("whole")
    needed = (F.col("n") >= least) | unsure | ((F.col("n") > 1) & (F.col("loose") > 0))
    found = common.materialize(told.join(of_host, "host").filter(needed).select("host", "run", "n", "of", "loose", unsure.alias("unsure")), "found")
    again = found.filter("unsure").select("host", "run")
    if not again.isEmpty():
        counted = runs_of(rows.join(small(again.select("host").distinct()), "host", "left_semi")).join(small(again), ["host", "run"]).distinct()
        found = found.join(counted.groupBy("host", "run").agg(F.count("*").alias("counted")), ["host", "run"], "left").withColumn("n", F.coalesce("counted", "n"))
    often = F.col("n") >= least
    repeated = common.materialize(found.filter(often | ((F.col("n") > 1) & (F.col("loose") > 0))).select("host", "run", often.alias("often")), "runs")

    def held(guarded: bool) -> DataFrame:
        """The runs that matter for such pages: frequent ones where there is an article, else all that are repeated."""
        return runs_of(rows.filter(F.col("guarded") == guarded)).join(small(repeated.filter("often") if guarded else repeated), ["host", "run"]).distinct()

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(r["blocks"], r["zones"], r["runs"] or [], [x for x, o in zip(r["runs"] or [], r["often"] or [], strict=True) if o]) for r in batch.to_pylist()]
        return common.batch_of(_TEXT, [batch.column("page_id"), batch.column("url"), texts])

    def text_of(blocks: list[str], zones: list[int], runs: list[int], often: list[int]) -> str:
        h, covered = hashes_of(blocks) if len(runs) or len(often) else np.empty(0, np.int64), []
        size = sum(len(b.split()) + 1 for b in blocks)
        for chosen in (runs, often):
            at = np.flatnonzero(np.isin(h, np.asarray(chosen, np.int64)))
            mask = np.zeros(size + RUN, bool)
            for i in range(RUN):
                mask[at + i] = True
            covered.append(mask)
        return main_text(blocks, zones, *covered)

    def joined(pages: DataFrame, held: DataFrame) -> DataFrame:
        hit = held.groupBy("host", "sid").agg(F.collect_list(F.struct("run", "often")).alias("hits"))
        hit = common.materialize(hit.select("host", "sid", F.col("hits.run").alias("runs"), F.col("hits.often").alias("often")), "hit")
        return common.map_batches(pages.join(small(hit, "1 + size(runs)"), ["host", "sid"], "left").select("page_id", "url", "blocks", "zones", "runs", "often"), finish, TEXT)

    told = joined(rows.filter("NOT guarded"), held(False))
    frequent_runs = repeated.filter("often").select("host", "run")
    if frequent_runs.count() > BROADCAST_ROWS:
        return told.unionByName(joined(rows.filter("guarded"), held(True)))
    often: dict[str, list[int]] = {}
    for r in frequent_runs.collect():  # BROADCAST_ROWS at most
        often.setdefault(r.host, []).append(r.run)
    share = rows.sparkSession.sparkContext.broadcast({h: np.array(x, np.int64) for h, x in often.items()})

    def guarded(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(r["blocks"], r["zones"], (), share.value.get(r["host"], ())) for r in batch.to_pylist()]
        return common.batch_of(_TEXT, [batch.column("page_id"), batch.column("url"), texts])

    return told.unionByName(common.map_batches(rows.filter("guarded").select("page_id", "url", "host", "blocks", "zones"), guarded, TEXT))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    table = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    chars = table.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).filter(F.col("chars") > SHARD_CHARS)
    large = common.materialize(chars.select("host", F.ceil(F.col("chars") / SHARD_CHARS).alias("shards")), "hosts")  # one row for each SHARD_CHARS of input at most
    done = by_host(table.join(large, "host", "left_anti"))
    if not large.isEmpty():
        done = done.unionByName(by_shards(table.join(large.select("host"), "host", "left_semi"), large))
    return done.withColumn("n_chars", F.length("text").cast("long"))
