"""URL admission rules and the crawl plan over an already fetched pages table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..constants import CRAWL_MAX_PAGES, MIME_SOURCE
from ..functions import html, urls
from ..functions.text import lookup, url_id
from ..session import scratch_path, stored


def clean(values, strip_slash: bool = False) -> list[str]:
    """Option values trimmed and lower-cased, empty ones dropped; optionally without slashes at the ends."""
    out = {v.strip().lower() for v in values if v.strip()}
    return sorted({v.strip("/").strip() for v in out} if strip_slash else out)


def clean_column(values: Column, strip_slash: bool = False) -> Column:
    """The same for a table of options with an array column."""
    out = F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    if strip_slash:
        out = F.transform(out, lambda v: F.trim(F.regexp_replace(v, r"^/+|/+$", "")))
    return F.array_sort(F.array_distinct(out))


@dataclass
class CrawlOptions:
    max_pages: int = CRAWL_MAX_PAGES
    max_depth: int | None = None
    same_host_only: bool = True
    exclude_mimetypes: list[str] = field(default_factory=list)
    exclude_query_params: list[str] = field(default_factory=list)
    exclude_substrings: list[str] = field(default_factory=list)
    exclude_suffixes: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.exclude_mimetypes = clean(self.exclude_mimetypes, True)
        self.exclude_query_params = clean(self.exclude_query_params, True)
        self.exclude_substrings = clean(self.exclude_substrings)
        self.exclude_suffixes = clean(self.exclude_suffixes, True)

    def supported_extensions(self) -> list[str]:
        return [e for e in urls.SUPPORTED_EXTENSIONS if urls.EXTENSION_MIME[e] not in self.exclude_mimetypes]

    def supported_mimetypes(self) -> list[str]:
        return sorted({urls.EXTENSION_MIME[e] for e in urls.SUPPORTED_EXTENSIONS} - set(self.exclude_mimetypes))


def same_host(a: Column, b: Column) -> Column:
    return urls.netloc(a) == urls.netloc(b)


def banned_extension(url: Column, supported: list[str]) -> Column:
    ext = urls.extension_of(url)
    return F.coalesce(~ext.isin(*supported) & ext.isin(*urls.BANNED_EXTENSIONS), F.lit(False)) if supported else F.coalesce(
        ext.isin(*urls.BANNED_EXTENSIONS), F.lit(False)
    )


def excluded_parameter(url: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(False)
    query = urls.url_query(url)
    name = lambda p: F.substring_index(p, "=", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.lower(F.coalesce(F.try_url_decode(name(p)), name(p))))
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))


def excluded_substring(url: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(p)) for p in parts], F.lit(False))


def excluded_suffix(url: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(False)
    return F.substring_index(F.rtrim(F.lower(urls.url_path(url)), F.lit("/")), "/", -1).isin(*names)


def admitted(url: Column, start_url: Column, opts: CrawlOptions) -> Column:
    """A URL may be fetched when no rule excludes it."""
    ok = ~banned_extension(url, opts.supported_extensions()) & ~excluded_parameter(url, opts.exclude_query_params)
    ok = ok & ~excluded_substring(url, opts.exclude_substrings) & ~excluded_suffix(url, opts.exclude_suffixes)
    return ok & same_host(start_url, url) if opts.same_host_only else ok


def robots_allowed(rows: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Flag ``allowed``: the longest matching rule of the host decides, allow wins a tie, no rule allows.

    An agent with a group of its own does not heed the rules for all agents. Rules are matched with the path and the query. The rules of a
    host are one small array, so a host with most of the URLs only repeats a lookup.
    """
    rule = F.struct("agent", "path_prefix", "allow")
    mine = rules.where(F.col("agent").isin("*", agent)).groupBy(F.col("host").alias("_host")).agg(F.collect_list(rule).alias("_all"))
    own = F.filter("_all", lambda r: r["agent"] == agent)
    mine = mine.select("_host", F.when(F.size(own) > 0, own).otherwise(F.col("_all")).alias("_rules"))
    joined = rows.withColumn("_host", urls.netloc(F.col(url))).join(mine, "_host", "left")
    query = urls.url_query(F.col(url))
    path = F.concat(urls.url_path(F.col(url)), F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))
    matching = F.filter("_rules", lambda r: path.startswith(r["path_prefix"]))
    best = F.array_max(F.transform(matching, lambda r: F.struct(F.length(r["path_prefix"]).alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_rules")


def page_links(pages: DataFrame, keep: list[str], link: Column | None = None) -> DataFrame:
    """Normalised links of pages with their ``hrefs``, in document order; ``link`` is the expression for them if the caller has it."""
    link = urls.normalise_url(F.col("final_url"), F.col("href")) if link is None else link
    rows = pages.select(*keep, "final_url", F.posexplode("hrefs").alias("pos", "href"))
    return rows.withColumn("link", link).where(F.col("link").isNotNull())


def crawl_plan(
    spark: SparkSession, seeds: DataFrame, pages: DataFrame, redirects: DataFrame, opts: CrawlOptions, rules: DataFrame | None = None, agent: str = "*"
) -> DataFrame:
    """Breadth-first visit of a fetched pages table from seed URLs, one crawl per seed.

    ``seeds``: crawl_id, url. ``pages``: url, html, content_type. ``redirects``: url, final_url (final URLs do not redirect
    again). Returns crawl_id, url, final_url, depth, visit_key (the places of the links that led there), mimetype, title;
    ordering by depth and visit_key is the order of the visit. A round is a few joins over the whole frontier; what it claims and fetches is written to the
    shared folder, so lineage never grows and a lost executor costs one round. The HTML is parsed in one pass before the
    first round; rounds meet only titles and links, and a small frontier is broadcast by its stored size, so the pages are
    not shuffled for it. The driver only learns whether a level is empty. Only HTML pages count to ``max_pages``.
    """
    base = scratch_path(spark, "crawl")
    parsed = pages.select(F.col("url").alias("final_url"), "content_type", html.parsed("html").alias("_p"))
    found = stored(parsed.select("final_url", "content_type", "_p.title", F.col("_p.links").alias("hrefs")), f"{base}/pages")
    moved = redirects.select("url", F.col("final_url").alias("_to"))
    start = F.col("start_url")
    is_html = F.col("mimetype") == "text/html"
    frontier = seeds.select(
        "crawl_id", F.col("url").alias("start_url"), urls.normalise_url(F.col("url"), F.lit("")).alias("url"), F.array().cast("array<int>").alias("visit_key")
    )
    # the rules are the same expressions in every round, so they are built once
    url_ok, target_ok = admitted(F.col("url"), start, opts), admitted(F.col("final_url"), start, opts)
    mimetype = urls.mime_type(F.col("final_url"), F.col("url"), F.col("content_type"))
    supported, link = F.col("mimetype").isin(*opts.supported_mimetypes()), urls.normalise_url(F.col("final_url"), F.col("href"))
    known = None
    visits = None
    places: list[str] = []  # of what each round keeps
    pages_seen = 0
    depth = 0
    while opts.max_depth is None or depth <= opts.max_depth:
        first = Window.partitionBy("crawl_id", "url").orderBy("visit_key")
        fresh = frontier.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
        if known is not None:
            fresh = fresh.join(known, ["crawl_id", "url"], "left_anti")
        checked = fresh.withColumn("ok", url_ok)
        if rules is not None:
            checked = robots_allowed(checked, rules, agent).withColumn("ok", F.col("ok") & F.col("allowed")).drop("allowed")
        resolved = checked.join(moved, "url", "left").withColumn("final_url", F.coalesce("_to", "url")).drop("_to")
        level, counts = _counted(resolved.withColumn("final_ok", F.col("ok") & target_ok), f"{base}/level/round={depth}", rows=F.lit(True))
        if not counts["rows"]:
            break
        # a URL goes to the first that claims it: as its own address or as the target of an admitted redirect
        claims = level.where((F.col("final_url") == F.col("url")) | F.col("ok"))
        turn = Window.partitionBy("crawl_id", "final_url").orderBy("visit_key")
        claims = claims.withColumn("_n", F.row_number().over(turn)).where((F.col("_n") == 1) & F.col("final_ok")).drop("_n")
        if known is not None:
            redirected = claims.where(F.col("final_url") != F.col("url"))
            old = known.withColumnRenamed("url", "final_url")
            claims = claims.where(F.col("final_url") == F.col("url")).unionByName(redirected.join(old, ["crawl_id", "final_url"], "left_anti"))
        fetched = claims.join(found, "final_url").withColumn("mimetype", mimetype).where(supported)
        fetched, counts = _counted(fetched.withColumn("depth", F.lit(depth).cast("long")), f"{base}/fetched/round={depth}", pages=is_html)
        kept, ended = fetched, None
        pages_seen += counts["pages"]
        if pages_seen >= opts.max_pages:
            # some crawl may have reached its budget: cut each behind the last HTML page that still counts; the rank is bounded below the shuffle
            left = F.lit(opts.max_pages).cast("long")
            here = fetched.where(is_html).select("crawl_id", "visit_key")
            if places:
                earlier = spark.read.schema(fetched.schema).parquet(*places).where(is_html).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("_before"))
                here, left = here.join(earlier, "crawl_id", "left"), left - F.coalesce("_before", F.lit(0))
            place = Window.partitionBy("crawl_id").orderBy("visit_key")
            counted = here.withColumns({"_left": left, "_n": F.row_number().over(place)}).where(F.col("_n") <= opts.max_pages)
            ended = counted.where(F.col("_n") == F.col("_left")).select("crawl_id", F.col("visit_key").alias("_last"))
            kept = fetched.join(ended, "crawl_id", "left").where(F.col("_last").isNull() | (F.col("visit_key") <= F.col("_last"))).drop("_last")
            kept = stored(kept, f"{base}/kept/round={depth}")
        places.append(f"{base}/{'fetched' if ended is None else 'kept'}/round={depth}")
        # every address of the level and every target of an admitted redirect is known from now on
        levels = spark.read.schema(level.schema).parquet(f"{base}/level")
        addresses = F.array_distinct(F.array("url", F.when(F.col("ok"), F.col("final_url")).otherwise(F.col("url"))))
        known = levels.select("crawl_id", F.explode(addresses).alias("url"))
        visits = spark.read.schema(kept.schema).parquet(*places).drop("hrefs", "content_type")
        parents = kept.where(is_html)
        if ended is not None:
            parents = parents.join(ended.select("crawl_id"), "crawl_id", "left_anti")
        links = page_links(parents, ["crawl_id", "start_url", "visit_key"], link)
        frontier = links.select(
            "crawl_id", "start_url", F.col("link").alias("url"), F.concat("visit_key", F.array(F.col("pos"))).alias("visit_key")
        )
        depth += 1
    return visits.select("crawl_id", "url", "final_url", "depth", "visit_key", "mimetype", "title")


def _counted(df: DataFrame, path: str, **what: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` stored at ``path``, and how many of its rows each condition holds for, counted while they are written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, *[F.count_if(c).alias(name) for name, c in what.items()]), path)
    found = seen.get
    return out, {name: found.get(name) or 0 for name in what}


def rejected_pages(pages: DataFrame, opts: CrawlOptions) -> DataFrame:
    """Fetched pages (url, content_type) that a crawl leaves out for their type, with the type and the reason."""
    mimetype = urls.mime_type(F.col("url"), F.col("url"), F.col("content_type")).alias("mimetype")
    m = F.col("mimetype")
    reason = F.when(m.isNull(), "unknown type").when(m.isin(*opts.exclude_mimetypes), "excluded type").when(~m.isin(*opts.supported_mimetypes()), "unsupported type")
    return pages.select("url", mimetype).withColumn("reason", reason).where(F.col("reason").isNotNull())


def crawl_records(visited: DataFrame, project_id: str, language: str) -> DataFrame:
    """Catalog entries of a crawl without uploading anything."""
    return visited.select(
        url_id(F.lit(project_id), F.col("final_url")).alias("_id"), F.lit(project_id).alias("project_id"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), urls.base_name(F.col("final_url"))).alias("name"), F.lit(language).alias("language"),
        F.col("final_url").alias("source_file"), lookup(MIME_SOURCE, F.col("mimetype")).alias("source_type"),
    )
