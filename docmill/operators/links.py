"""Links of Markdown documents: extraction, targets, resolution, rewriting, transclusion, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import bound, strip
from docmill.operators.lines import scan, text_lines
from docmill.operators.markdown import extract_block, extract_section, is_table_rule
from docmill.storage import materialise, sorted_side

def _some(but: str, opener: str, least: int = 1) -> str:
    """A run of characters other than ``but``, with at most eight of the ``opener``: unclosed links are given up soon, so that many of them cost linear time."""
    return (rf"(?=[^{but}])" if least else "") + rf"[^{but}{opener}]*(?:{opener}[^{but}{opener}]*){{0,8}}"


# What links and embeds look like.
_TARGET, _SHOWN, _LABEL = _some(r"|\]\\", r"\["), _some(r"\]", r"\[", 0), _some(r"\]", r"\[")
WIKI_EMBED = rf"!\[\[({_TARGET})(?:\\?\|({_SHOWN}))?\]\]"
MD_EMBED = rf"!\[({_SHOWN})\]\(({_some(r')\s', r'\(')})(?:\s*=\s*(\d*)x(\d*))?\s*\)"
WIKI_LINK = rf"(?<!!)\[\[({_TARGET})(?:\\?\|({_SHOWN}))?\]\]"
MD_LINK = rf"(?<!!)\[({_LABEL})\]\(({_some(r')', r'\(')})\)"
ANY = "|".join((WIKI_EMBED, MD_EMBED, WIKI_LINK, MD_LINK))


def _size(x: Column, part: int) -> Column:
    found = F.regexp_extract(x, r"\|(\d+)(?:x(\d*))?$", part)
    return F.when(found != "", found.cast("int"))


def extract_links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every link and embed in order: ``pos, end_pos`` (0-based), ``kind, raw, link, display, width, height``."""
    others = [c for c in docs.columns if c != text_col]
    raws = F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))
    gaps = F.split(F.col(text_col), ANY, -1)
    both = bound(gaps, lambda g: F.zip_with(raws, F.slice(g, F.lit(1), F.size(g) - 1), lambda r, gap: F.struct(r.alias("raw"), F.char_length(gap).alias("gap"))))
    start = F.struct(F.lit("").alias("raw"), F.lit(0).alias("pos"))
    placed = scan(both, start, lambda a, x: F.struct(x["raw"].alias("raw"), (a["pos"] + F.char_length(a["raw"]) + x["gap"]).alias("pos")), "struct<raw:string,pos:int>")
    rows = docs.filter(F.contains(text_col, F.lit("]"))).select(*others, F.explode(placed).alias("l")).select(*others, "l.pos", "l.raw")
    raw = F.col("raw")
    kind = F.when(raw.startswith("![["), "wiki_embed").when(raw.startswith("!["), "md_embed").when(raw.startswith("[["), "wiki_link").otherwise("md_link")
    inner = F.when(raw.startswith("![["), F.regexp_extract(raw, WIKI_EMBED, 1)).when(raw.startswith("!["), F.regexp_extract(raw, MD_EMBED, 2)).when(raw.startswith("[["), F.regexp_extract(raw, r"\[\[([^|\]\\]+)", 1)).otherwise(F.regexp_extract(raw, r"\]\(([^)]+)\)$", 1))
    shown = F.when(raw.startswith("![["), F.regexp_extract(raw, WIKI_EMBED, 2)).when(raw.startswith("!["), F.regexp_extract(raw, MD_EMBED, 1)).when(raw.startswith("[["), F.regexp_extract(raw, r"\|([^\]]*)\]\]$", 1)).otherwise(F.regexp_extract(raw, r"^\[([^\]]+)\]", 1))
    sized = F.concat(F.lit("|"), shown)
    by_alt = F.when(raw.startswith("![["), _size(sized, 1)).when(raw.startswith("!["), _size(shown, 1))
    by_alt_h = F.when(raw.startswith("![["), _size(sized, 2)).when(raw.startswith("!["), _size(shown, 2))
    equals = lambda k: F.when(F.regexp_extract(raw, MD_EMBED, k) != "", F.regexp_extract(raw, MD_EMBED, k).cast("int"))
    return rows.select(
        *others, "pos", (F.col("pos") + F.char_length("raw")).alias("end_pos"), kind.alias("kind"), "raw", strip(inner).alias("link"),
        F.regexp_replace(shown, r"(?:^|\|)\d+(?:x\d*)?$", "").alias("display"), F.coalesce(equals(3), by_alt).alias("width"), F.coalesce(equals(4), by_alt_h).alias("height"),
    )


def parse_target(link: Column) -> Column:
    """``path, heading, block_id`` of a decoded link without its query."""
    guarded = F.replace(link, F.lit("+"), F.lit("%2B"))
    decoded = F.substring_index(F.coalesce(F.try_url_decode(guarded), link), "?", 1)

    def split(d: Column) -> Column:
        anchor = F.when(F.contains(d, F.lit("#")), strip(F.regexp_extract(d, r"(?s)^[^#]*#(.*)$", 1)))
        return F.struct(
            strip(F.substring_index(d, "#", 1)).alias("path"),
            F.when((anchor != "") & ~anchor.startswith("^"), anchor).alias("heading"),
            F.when(anchor.startswith("^"), F.substring(anchor, 2, 1 << 30)).alias("block_id"),
        )

    return bound(decoded, split)


IMAGES, MARKDOWN = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".ico"), (".md", ".markdown")


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*MARKDOWN), "markdown").otherwise("unknown")


def folded_path(path: Column) -> Column:
    """A path without ``.`` and empty segments, where ``..`` takes the segment before it; above the start of a relative path ``..`` stays, above a root it goes."""
    none = F.array().cast("array<string>")
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        up, top = part == "..", F.get(kept, F.size(kept) - 1)
        return (
            F.when(part.isin("", "."), kept)
            .when(up & (F.size(kept) > 0) & (top != ".."), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(up & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    whole = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/", -1), none, step), "/"))
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), whole).otherwise(path)


def resolve_links(links: DataFrame, files: DataFrame, keys: list[str], search_dirs: tuple[str, ...] = ("",), source: str = "source_path", target: str = "target") -> DataFrame:
    """``keys, resolved, file_type``: the first of a link's candidate paths that exists among ``files(path)``; null where none does.

    Candidates: the path as it is when absolute; beside the source; for bare names the folder named like the source and the search folders; each with ``.md`` where no extension is given. ``.`` and ``..`` are folded.
    """
    t = F.col(target)
    folder = F.regexp_extract(F.col(source), r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(F.col(source), r"\.[^./]*$", "")
    relative = F.concat(folder, F.regexp_replace(t, r"^\./", ""))
    places = [F.when(t.startswith("/"), t), F.when(~t.startswith("/"), relative), F.when(~F.contains(t, F.lit("/")), F.concat(stem, F.lit("/"), t))]
    places += [F.when(~F.contains(t, F.lit("/")), F.concat(F.lit(d + "/" if d else ""), t)) for d in search_dirs]
    named = F.transform(F.filter(F.array(*places), lambda p: p.isNotNull()), folded_path)
    both = F.when(t.rlike(r"\.[^./]+$"), named).otherwise(F.flatten(F.transform(named, lambda p: F.array(F.concat(p, F.lit(".md")), p))))
    tries = links.select(*keys, F.posexplode(both).alias("_n", "path"))
    found = tries.join(sorted_side(files.select("path").distinct()), "path").groupBy(*keys).agg(F.min_by("path", "_n").alias("resolved"))
    return links.select(*keys).join(sorted_side(found), keys, "left").select(*keys, "resolved", F.when(F.col("resolved").isNotNull(), file_kind(F.col("resolved"))).alias("file_type"))


def rewrite_links(text: Column, wiki: str = "extract_text", markdown: str = "extract_text", embeds: str = "keep") -> Column:
    """Links by mode (``keep``, ``extract_text``, ``remove``), image embeds by mode (those and ``placeholder``)."""
    if embeds == "placeholder":
        text = F.regexp_replace(F.regexp_replace(text, WIKI_EMBED, "{{IMAGE:$1}}"), MD_EMBED, "{{IMAGE:$2}}")
    elif embeds == "extract_text":
        text = F.regexp_replace(F.regexp_replace(text, WIKI_EMBED, "$1"), MD_EMBED, "$1")
    elif embeds == "remove":
        text = F.regexp_replace(F.regexp_replace(text, WIKI_EMBED, ""), MD_EMBED, "")
    if wiki == "extract_text":
        text = F.regexp_replace(F.regexp_replace(text, r"(?<!!)\[\[[^|\]\\]+\\?\|([^\]]*)\]\]", "$1"), r"(?<!!)\[\[([^|\]\\]+)\]\]", "$1")
    elif wiki == "remove":
        text = F.regexp_replace(text, WIKI_LINK, "")
    if markdown == "extract_text":
        text = F.regexp_replace(text, MD_LINK, "$1")
    elif markdown == "remove":
        text = F.regexp_replace(text, MD_LINK, "")
    return text


MESSAGES = {"cycle": "[cycle: {}]", "depth": "[too deep: {}]", "missing": "[not found: {}]", "section": "[no such section: {}]"}


# Embeds that don't go over a line's end.
EMBED = rf"!\[\[({_some(r'|\]\\\n', r'\[')})(?:\\?\|({_some(r'\]\n', r'\[', 0)}))?\]\]|!\[({_some(r'\]\n', r'\[', 0)})\]\(({_some(r')\s', r'\(')})(?:[ \t]*=[ \t]*\d*x\d*)?[ \t]*\)"
TABLE_ROW = r"^[> \t]*\|.*\|\s*$"


def _in_cell(x: Column) -> Column:
    """A text that may stand in a table's cell."""
    return F.regexp_replace(F.regexp_replace(strip(x), r"(?:\r?\n)+", "<br>"), r"(?<!\\)\|", r"\\|")


def expand_embeds(
    docs: DataFrame,
    max_depth: int = 3,
    path_col: str = "path",
    text_col: str = "text",
    messages: dict[str, str] = MESSAGES,
    search_dirs: tuple[str, ...] = ("",),
    assets: DataFrame | None = None,
    images: str = "keep",
) -> DataFrame:
    """``path, text``: embeds of Markdown files (whole, section or block) in their place, ``max_depth`` levels deep.

    Targets are found as :func:`resolve_links` does, among the documents and ``assets(path)``. Embeds of images stay or become a ``placeholder``;
    those of other files and of addresses stay. In a table's row the embedded text is one line with escaped pipes.

    Level by level: the embeds of all pieces of a level meet the documents in one join, then the pieces are put together from
    the deepest level up. An ancestor embedded again is a cycle, even where the depth would end too; siblings may repeat a document.
    """

    def message(kind: str) -> Column:
        before, _, after = messages[kind].partition("{}")
        return F.concat(F.lit(before), F.col("link"), F.lit(after))

    files = docs.select(F.col(path_col).alias("file"), F.col(text_col).alias("whole"))
    known = files.select(F.col("file").alias("path"))
    known = known if assets is None else known.unionByName(assets.select("path"))
    level = docs.select(F.col(path_col).alias("node"), F.array(path_col).alias("up"), F.col(text_col).alias("text"))
    levels, places = [], []
    in_line = lambda x: F.transform(F.regexp_extract_all(x, F.lit(EMBED), F.lit(0)), lambda r: F.struct(r.alias("raw"), (x.rlike(TABLE_ROW) & ~is_table_rule(x)).alias("in_table")))
    for depth in range(max_depth + 1):
        level = materialise(level)
        levels.append(level)
        found = level.filter(F.contains("text", F.lit("!["))).select("node", "up", F.posexplode(F.flatten(F.transform(text_lines(F.col("text")), in_line))).alias("n", "e"))
        raw = F.col("e.raw")
        link = strip(F.when(raw.startswith("![["), F.regexp_extract(raw, EMBED, 1)).otherwise(F.regexp_extract(raw, EMBED, 4)))
        found = found.select("node", "up", "n", raw.alias("raw"), F.col("e.in_table").alias("in_table"), link.alias("link")).withColumn("t", parse_target(F.col("link")))
        found = materialise(found.withColumn("target", F.when(~F.col("link").rlike(r"^(?:data:|\w+://)"), F.col("t.path"))).withColumn("source_path", F.element_at("up", -1)))
        places_of = resolve_links(found.filter("target <> ''"), known, ["node", "n"], search_dirs).withColumnRenamed("resolved", "file")
        joined = found.join(sorted_side(places_of), ["node", "n"], "left").join(sorted_side(files), "file", "left")
        body = F.regexp_replace("whole", r"\A(?s)---\s*\n.*?\n---[ \t]*(?:\n|\z)", "")
        part = F.when(F.col("t.heading").isNotNull(), extract_section(body, F.col("t.heading"))).when(F.col("t.block_id").isNotNull(), extract_block(body, F.col("t.block_id"))).otherwise(strip(body))
        stays = F.col("target").isNull() | (F.col("file_type") != "markdown")
        state = F.when(stays, "stays").when(F.col("whole").isNull(), "missing").when(F.array_contains("up", F.col("file")), "cycle").when(F.lit(depth >= max_depth), "depth")
        joined = joined.withColumn("state", state).withColumn("part", F.when(F.col("state").isNull(), part))
        joined = joined.withColumn("state", F.when(F.col("state").isNull() & F.col("part").isNull(), "section").otherwise(F.col("state")))
        shown = F.when((F.col("file_type") == "image") & F.lit(images == "placeholder"), F.concat(F.lit("{{IMAGE:"), F.col("file"), F.lit("}}"))).otherwise(F.col("raw"))
        said = F.coalesce(F.when(F.col("state") == "stays", shown), *(F.when(F.col("state") == k, message(k)) for k in messages), F.lit(""))
        child = F.concat_ws("/", "node", F.col("n").cast("string"))
        joined = materialise(joined.select("node", "n", child.alias("child"), F.concat("up", F.array("file")).alias("up"), "part", "in_table", said.alias("said")))
        places.append(joined)
        level = joined.filter("part IS NOT NULL").select(F.col("child").alias("node"), "up", F.col("part").alias("text"))
    done = None
    for level, place in zip(reversed(levels), reversed(places), strict=True):
        filled = place.select("node", "n", "child", "said", "in_table")
        if done is not None:
            inner = done.select(F.col("node").alias("child"), F.col("text").alias("_t"))
            filled = filled.join(sorted_side(inner), "child", "left").withColumn("said", F.coalesce(F.when(F.col("in_table"), _in_cell(F.col("_t"))).otherwise(F.col("_t")), "said"))
        piled = filled.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "said"))), lambda v: v["said"]).alias("_in"))
        rows = level.join(sorted_side(piled), "node", "left").withColumn("_gap", F.split("text", EMBED, -1))
        text = F.array_join(F.transform("_gap", lambda g, i: F.concat(F.when(i == 0, "").otherwise(F.coalesce(F.get("_in", i - 1), F.lit(""))), g)), "")
        done = materialise(rows.select("node", text.alias("text")))
    return done.select(F.col("node").alias(path_col), F.col("text").alias(text_col))


def link_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree, broken`` from ``edges(source, target)`` with null targets where a link leads nowhere."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("target").alias("out_degree"), F.count_if(F.col("target").isNull()).alias("broken"))
    into = edges.filter("target IS NOT NULL").groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    rows = nodes.select("node").join(sorted_side(out), "node", "left").join(sorted_side(into), "node", "left")
    return rows.select("node", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("out_degree", "in_degree", "broken")))


def link_cycles(edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """``node, length``: the shortest cycle of at most ``max_depth`` edges through each node; nodes on none have no row. A link to itself has length 1.

    Cycles of three and four links are met in the middle, seen from their node of most links: half walks of two links go from
    it over a node of fewer links to another such node, and those back meet them in semi joins. So a half walk counts at its end of
    fewer links, and all of them are at most the sum over links of the lesser number of links at either end: around a note that
    links to all and is linked by all they are as many as the links. Longer cycles are sought by distinct (start, end) pairs of walks,
    only from nodes that have no shorter one.
    """
    some = edges.filter("target IS NOT NULL").select("source", "target").distinct()
    ins, outs = some.select(F.col("target").alias("source")).distinct(), some.select(F.col("source").alias("target")).distinct()
    some = materialise(some.join(sorted_side(ins), "source", "left_semi").join(sorted_side(outs), "target", "left_semi").select("source", "target"))
    loops, some = some.filter("source = target"), some.filter("source <> target")
    found = loops.select(F.col("source").alias("node"), F.lit(1).alias("length"))
    back = some.select(F.col("target").alias("source"), F.col("source").alias("target"))
    if max_depth >= 2:
        found = found.unionByName(some.join(sorted_side(back), ["source", "target"], "left_semi").select(F.col("source").alias("node"), F.lit(2).alias("length")))
    if max_depth >= 3:
        links = some.unionByName(back).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        ranks = [links.select(F.col("source").alias(side), F.struct("n", F.col("source").alias("node")).alias(f"{side}_rank")) for side in ("source", "target")]
        ranked = materialise(some.join(sorted_side(ranks[0]), "source").join(sorted_side(ranks[1]), "target"))
        below, above = F.col("target_rank") < F.col("source_rank"), F.col("target_rank") > F.col("source_rank")
        top = lambda top, mid, when: ranked.filter(when).select(F.col(top).alias("top"), F.col(f"{top}_rank").alias("top_rank"), F.col(mid).alias("mid"))
        on = lambda mid, end: ranked.select(F.col(mid).alias("mid"), F.col(end).alias("end"), F.col(f"{end}_rank").alias("end_rank"))
        away = top("source", "target", below).join(sorted_side(on("source", "target")), "mid").filter("end_rank < top_rank").select("top", "mid", "end")
        home = top("target", "source", above).join(sorted_side(on("target", "source")), "mid").filter("end_rank < top_rank").select("top", "mid", "end")
        each = lambda walks, length: walks.select(F.explode(F.array("top", "mid", "end")).alias("node"), F.lit(length).alias("length"))
        closing = some.select(F.col("source").alias("end"), F.col("target").alias("top"))
        found = found.unionByName(each(away.join(sorted_side(closing), ["top", "end"], "left_semi"), 3))
        if max_depth >= 4:
            for one, other in ((away, home), (home, away)):
                found = found.unionByName(each(one.join(sorted_side(other.select("top", "end")), ["top", "end"], "left_semi"), 4))
    found = materialise(found.groupBy("node").agg(F.min("length").alias("length")))
    if max_depth <= 4:
        return found
    step = some.select(F.col("source").alias("end"), F.col("target").alias("next"))
    walks = some.withColumnsRenamed({"source": "node", "target": "end"}).join(sorted_side(found), "node", "left_anti")
    for length in range(2, max_depth + 1):
        walks = walks.filter("node <> end").join(sorted_side(step), "end").select("node", F.col("next").alias("end")).distinct()
        if length > 4:
            found = found.unionByName(walks.filter("node = end").select("node", F.lit(length).alias("length")))
    return found.groupBy("node").agg(F.min("length").alias("length"))
