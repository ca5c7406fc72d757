"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

A line seen on at least ``sites`` distinct sites is boilerplate. Lines with fewer occurrences than that drop out by a plain count;
the rest get HyperLogLog sketches of their sites, merged by aggregation. Where a sketch comes near the threshold the sites are
counted exactly. Lines are known by two independent 64-bit hashes; their text is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

SITES = 10
LG_K = 12  # sketch size; relative standard error 1.04 / sqrt(2 ** LG_K)
#: Lines with more than 1 / HOT_SHARE of all rows are hot: at most HOT_SHARE of them exist, so they may be broadcast.
HOT_SHARE = 20_000
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> list[Column]:
    """Two 64-bit hashes of a line without the blanks, tabs and carriage returns around it."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2")]


def keyed_lines(docs: DataFrame, doc_id: str, site: str, text: str) -> DataFrame:
    """A row (doc_id, mark, site, n, h1, h2) per line that isn't blank: ``mark`` is a hash of the whole text, ``n`` the line's number from 0."""
    base = docs.select(docs[doc_id].alias("doc_id"), docs[site].alias("site"), docs[text].alias("text"))
    lines = base.select("doc_id", "site", F.xxhash64("text").alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("n", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\r")) != "").select("doc_id", "mark", "site", "n", *line_key(F.col("line")))


def _by_key(lines: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """``lines`` whose key is in ``keys`` (h1, h2, hot), as two parts: hot keys by broadcast, others, which are small groups, by shuffle."""
    hot, cold = keys.where("hot").select(*KEY), keys.where("not hot").select(*KEY)
    return [lines.join(F.broadcast(hot), KEY, "left_semi"), lines.join(cold, KEY, "left_semi")]


def site_sketches(lines: DataFrame) -> DataFrame:
    """A mergeable sketch of sites per line key; ``merged`` adds sketches of other batches."""
    return lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))


def merged(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy(*KEY).agg(F.hll_union_agg("sketch").alias("sketch"))


def boilerplate(lines: DataFrame, sites: int, scratch: Scratch) -> DataFrame:
    """The keys (h1, h2, hot) of lines on at least ``sites`` distinct sites. A null site is none. ``lines`` should be a stored table."""
    total = lines.count()
    hot = F.col("n") > max(1000, total // HOT_SHARE)
    counted = lines.where("site is not null").groupBy(*KEY).agg(F.count("*").alias("n"))
    often = scratch.save(counted.where(F.col("n") >= sites).select(*KEY, hot.alias("hot")), "often")
    parts = [site_sketches(part.where("site is not null")) for part in _by_key(lines, often)]
    estimate = F.hll_sketch_estimate("sketch").alias("about")
    judged = parts[0].unionByName(parts[1]).select(*KEY, estimate).join(often, KEY)
    margin = max(1.0, 6 * 1.04 / 2 ** (LG_K / 2) * sites)
    judged = scratch.save(judged.select(*KEY, "hot", F.when(F.col("about") < sites - margin, 0).when(F.col("about") > sites + margin, 2).otherwise(1).alias("verdict")), "judged")
    near = judged.where("verdict = 1").select(*KEY, "hot")
    exact = [part.where("site is not null").groupBy(*KEY, "site").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("n")) for part in _by_key(lines, near)]
    sure = exact[0].unionByName(exact[1]).where(F.col("n") >= sites).select(*KEY)
    return judged.where("verdict = 2").select(*KEY, "hot").unionByName(near.join(sure, KEY, "left_semi"))


def remove_boilerplate(docs: DataFrame, sites: int = SITES, doc_id: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the boilerplate lines cut from ``text``, and n_lines and n_removed (int).

    Lines end at a line feed; blank lines always stay. A null text stays null with 0 lines, an empty one has 1. A null site counts for no
    line. Rows that share a doc_id, null included, are each cleaned. If every line goes, the text is empty. No row is dropped; columns
    named n_lines or n_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(keyed_lines(docs, doc_id, site, text), "lines")
    found = scratch.save(boilerplate(lines, sites, scratch), "boilerplate")
    # Rows with one id and text are cleaned alike, and rows without id are told apart by their texts. The numbers of a text's bad lines
    # are taken off as a set, so a text of many lines, many of them bad, costs no more than its length.
    hit = _by_key(lines.select("doc_id", "mark", "n", *KEY), found)
    affected = hit[0].unionByName(hit[1]).groupBy("doc_id", "mark").agg(F.collect_set("n").alias("__bad"))
    affected = scratch.save(affected.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__text"), "__bad"), "affected")
    scratch.drop("often", "judged", "lines", "boilerplate")
    base = docs.drop(*[c for c in ("n_lines", "n_removed") if c in docs.columns])
    # one join strategy at every size: affected documents grow with the corpus
    same = base[doc_id].eqNullSafe(affected["__id"]) & (F.xxhash64(base[text]) == affected["__text"])
    joined = base.join(affected.hint("merge"), same, "left").withColumn("__lines", split_lines(F.col(text)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__bad")
    kept = F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda n: F.get("__lines", n)))
    size = lambda a: F.coalesce(F.when(F.col(a).isNotNull(), F.size(a)), F.lit(0)).cast("int")
    out = joined.withColumn("__kept", kept)
    out = out.withColumns({"n_lines": size("__lines"), "n_removed": size("__lines") - size("__kept"), text: F.array_join("__kept", "\n")})
    return out.select(*base.columns, "n_lines", "n_removed")


def oracle(sites: int = SITES) -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_removed of ``remove_boilerplate`` over documents."""
    bare = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""
with d as (select row_number() over () r, doc_id, source, text from documents),
l as (select r, doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from d where text is not null),
b as (select {bare} k from l where {bare} <> '' group by 1 having count(distinct source) >= {sites}),
j as (select l.*, b.k is not null bad from l left join b on b.k = {bare}),
a as (select r, count(*) n_lines, count(*) filter (bad) n_removed, coalesce(string_agg(line, chr(10) order by n) filter (not bad), '') kept from j group by r)
select doc_id, case when text is null then null else kept end text, cast(coalesce(n_lines, 0) as int) n_lines, cast(coalesce(n_removed, 0) as int) n_removed
from d left join a using (r)"""
