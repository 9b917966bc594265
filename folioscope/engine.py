"""The library as an object: list, search, read articles and sections, convert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as fx
from folioscope.operators import conversion, ranking, redirects, sections

MAX_BYTES = 16 << 20


class NotFound(LookupError):
    """No such archive or entry."""


class SectionNotFound(LookupError):
    """The article has no such section."""


class InvalidArgument(ValueError):
    """A request that can't be answered."""


class Library:
    """Archives as rows of directory entries (see ``folioscope.sources.container.SCHEMA``).

    Point lookups filter the entries table and bring single rows to the driver; searches stay DataFrames.
    """

    def __init__(self, entries: DataFrame):
        self.entries = entries
        self.spark: SparkSession = entries.sparkSession

    def archives(self) -> list[str]:
        return [r["archive"] for r in self.entries.select("archive").distinct().orderBy("archive").collect()]

    def archive(self, name: str) -> str:
        """The archive of that name, relative to the library; names never lead outside."""
        plain = name.removeprefix("./")
        known = self.archives()
        if not plain or plain.startswith("/") or ".." in plain.split("/") or plain not in known:
            raise NotFound(f"no archive {name!r}; there are {', '.join(known) or 'none'}")
        return plain

    def candidates(self, path: str) -> list[tuple[str, str]]:
        """(namespace, url) to try in order: as typed, then below the content namespaces."""
        path = path.strip()
        while path.startswith("./"):
            path = path[2:]
        path = path.lstrip("/")
        out = []
        if len(path) > 2 and path[1] == "/":
            out += [(path[0], path[2:]), (path[0], path)]
        return out + [(ns, url) for ns in ("C", "A") for url in (path, f"{ns}/{path}")]

    def resolve(self, archive: str, paths: list[str]) -> dict | None:
        """The entry that the first existing candidate of the paths leads to, without content."""
        tried = [(k, ns, url) for k, (ns, url) in enumerate(c for p in paths for c in self.candidates(p))]
        wanted = F.broadcast(self.spark.createDataFrame(tried, "k int, namespace string, url string"))
        own = self.entries.where(F.col("archive") == archive)
        found = own.drop("content").join(wanted, ["namespace", "url"]).orderBy("k").limit(1).collect()
        if not found:
            return None
        entry = found[0].asDict()
        hops = 0
        while entry["kind"] == "redirect":  # a walk of one request: at most as many point lookups as hops are allowed
            hops += 1
            ahead = own.where(F.col("entry_idx") == entry["redirect_idx"]).drop("content").limit(1).collect() if hops < redirects.MOST_ENTRIES else []
            if not ahead:
                raise NotFound(f"{paths[0]!r} redirects to nothing")
            entry = ahead[0].asDict()
        return entry

    def get(self, archive: str, path: str, raw: bool = False) -> dict:
        """title, path, mime_type, content_encoding and content of an article; HTML becomes Markdown unless raw."""
        name = self.archive(archive)
        entry = self.resolve(name, [path, path.replace(" ", "_")])
        if entry is None or entry["kind"] != "item":
            raise NotFound(f"no entry {path!r} in {archive}")
        if entry["full_path"].startswith("X/"):
            raise InvalidArgument(f"{entry['full_path']} is an internal entry")
        rows = self.entries.where((F.col("archive") == name) & (F.col("entry_idx") == entry["entry_idx"]))
        size = rows.select(F.octet_length("content")).first()[0] or 0
        if size > MAX_BYTES:
            raise InvalidArgument(f"{entry['full_path']} has {size} bytes; the most is {MAX_BYTES}")
        title = fx.path_title(F.col("full_path"))
        title = F.when(F.col("title") == F.col("full_path"), title).otherwise(F.col("title")).alias("title")
        encoding, content = fx.content(F.col("content"))
        mime = entry["mime_type"] or ""
        if mime.startswith("text/html") and not raw:
            content, mime = sections.html_to_md(F.col("content").cast("string"), title, F.lit(None).cast("string")), "text/markdown"
        out = rows.select(title, F.col("full_path").alias("path"), F.lit(mime).alias("mime_type"), encoding.alias("content_encoding"), content.alias("content"))
        return out.first().asDict()

    def get_section(self, archive: str, path: str, section: str) -> dict:
        found = self.get(archive, path)
        text = sections.markup.md_section_content(found["content"], section)
        if text is None:
            raise SectionNotFound(f"{found['path']} has no section {section!r}")
        return {"title": found["title"], "section": section, "content": text}

    def convert(self, **flags) -> dict[str, DataFrame]:
        return conversion.convert(self.entries, **flags)

    def search(self, query: str, archive: str | None = None, limit: int = 10, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """zim, path, title, preview and sections of the best hits: exact titles and paths, then titles with all words, then full text.

        ``tables`` are those of ``convert``, kept as Parquet by whoever searches often. Text is read for the
        winners alone. Ranks of archives' titles are interleaved; full-text weights use pooled statistics.
        """
        if not query.strip():
            raise InvalidArgument("the query is empty")
        tables = tables or self.convert()
        only = (lambda d: d.where(F.col("archive") == self.archive(archive))) if archive else (lambda d: d)
        full, titles = only(tables["full_text"]), only(tables["titles"])
        typed = query.strip()
        folded = self.spark.range(1).select(fx.tokens(fx.fold(F.lit(typed.replace('"', " ")))).alias("w")).first()["w"]
        forms = list(dict.fromkeys(f.replace(" ", "_") for f in (typed, typed[:1].upper() + typed[1:], typed.capitalize(), "_".join(w[:1].upper() + w[1:] for w in typed.lower().split()), typed.upper())))
        names = [k for f in forms for k in (f, f"C/{f}")]
        link = only(tables["redirects"]).select("archive", "path", F.col("target_path").alias("target"))
        places = titles.select("archive", "path", F.col("target_path").alias("target")).unionByName(link)
        order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
        exact = places.where(order > 0).select("archive", F.col("target").alias("path"), F.lit(1).alias("tier"), order.cast("double").alias("rank"))
        hits = exact
        if folded:
            named = ranking.all_terms(titles, folded, "title").join(titles, ["archive", "doc_id"])
            scored = ranking.search(titles, folded, text="title").join(named.select("archive", "doc_id", "target_path"), ["archive", "doc_id"])
            best = ranking.top(scored, limit, ["archive"]).select("archive", F.col("target_path").alias("path"), F.lit(2).alias("tier"), F.col("rank").cast("double").alias("rank"))
            local = ranking.top(ranking.search(full, folded), ranking.LOCAL_TOP, ["archive"]).select("archive", "doc_id")
            pooled = ranking.search(full, folded, pooled=True).join(local, ["archive", "doc_id"], "left_semi")
            texts = pooled.join(full.select("archive", "doc_id", "path"), ["archive", "doc_id"]).select("archive", "path", F.lit(3).alias("tier"), (-F.col("score")).alias("rank"))
            hits = hits.unionByName(best).unionByName(texts)
        kept = ranking.first_wins(hits, ["archive", "path"], ["tier", "rank"]).orderBy("tier", "rank", "archive", "path").limit(limit)
        shown = self.entries.select("archive", F.col("full_path").alias("path"), "title", "content", "mime_type")
        joined = shown.join(F.broadcast(kept), ["archive", "path"])
        html = F.startswith("mime_type", F.lit("text/html"))
        body = F.make_valid_utf8(F.col("content").cast("string"))
        regions = F.when(html, sections.html_sections(body)).otherwise(sections.md_sections(body))
        title = F.when(F.col("title") == F.col("path"), fx.path_title(F.col("path"))).otherwise(F.col("title"))
        out = joined.select(F.col("archive").alias("zim"), "path", title.alias("title"), regions.alias("regions"), "tier", "rank")
        out = out.withColumn("preview", sections.intro_preview(F.col("regions")))
        if folded:  # at most ``limit`` articles, so their regions are few
            key = ["zim", "path"]
            parts = out.where("tier = 3").select(*key, F.explode("regions").alias("r")).select(*key, "r.pos", "r.name", F.concat_ws(" ", "r.name", F.array_join("r.paragraphs", " ")).alias("_text"))
            found = sections.scored(parts, key, folded, fx.tokens(fx.fold(F.col("_text"))))
            out = out.join(sections.relevant(found, key, F.col("name")).withColumnRenamed("shown", "sections"), key, "left")
        else:
            out = out.withColumn("sections", F.lit(None).cast("array<string>"))
        return out.select("zim", "path", "title", "preview", "sections", "tier", "rank").orderBy("tier", "rank", "zim", "path")
