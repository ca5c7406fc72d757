"""Reads, regions and a dictionary derived from the star-schema tables, by SQL that Spark and DuckDB both run, but for one product of the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genospark import scratch

READS = """b0 as (select l_orderkey*1009 + l_partkey*31 + l_suppkey*7 + l_linenumber as h, l_orderkey, l_partkey, l_suppkey from {lineitem}),
b as (select h, (h * 2654435761) & 4294967295 as g, cast(l_suppkey % 24 as int) as tid,
  cast((l_partkey*997 + l_orderkey*131) % 1000000 as int) as pos, l_suppkey from b0),
reads as (select concat('RG', cast(l_suppkey % 4 as string), ':', cast(h as string)) as qname, cast(g >> 20 as int) as flag, tid, pos,
  cast((g >> 11) % 61 as int) as mapq,
  case (g >> 7) % 6 when 0 then '32M' when 1 then '5S27M' when 2 then '10M2I20M' when 3 then '16M3D16M' when 4 then '20M12S' else '4H28M4S' end as cigar,
  cast(case when h % 10 = 0 then (tid + 1) % 24 else tid end as int) as mtid, cast(greatest(0, pos + (g >> 3) % 600 - 200) as int) as mpos, 32 as l_qseq,
  translate(md5(cast(h as string)), '0123456789abcdef', 'ACGTACGTACGTACGN') as seq,
  translate(md5(concat('q', cast(h as string))), '0123456789abcdef', '#$&,0369<?BEFGHI') as qual,
  case when h % 3 = 0 then null else concat('RG', cast(l_suppkey % 4 as string)) end as rg,
  case when h % 7 = 0 then null else cast((g >> 5) % 5 as int) end as nm from b)"""
#: The same text for Spark: the low 32 bits of the product come from halves of h, so that no step leaves 64 bits where keys are large.
_PRODUCT = "(h * 2654435761) & 4294967295"
_HALVES = "((h & 65535) * 2654435761 + ((((h >> 16) & 65535) * 2654435761) & 65535) * 65536) & 4294967295"
SPARK_READS = READS.replace(_PRODUCT, _HALVES)
REGIONS = """regions as (select cast(event_id as bigint) id, cast(user_id % 24 as int) chr, cast((event_id*97) % 1000000 as int) pos1,
  cast((event_id*97) % 1000000 + (event_id % 13)*100 as int) pos2,
  case event_type when 'view' then '+' when 'click' then '-' else '*' end strand from {events})"""
DICTIONARY = """dict as (select cast(n_nationkey as int) id,
  case when n_nationkey=22 then 'X' when n_nationkey=23 then 'Y' else cast(n_nationkey+1 as string) end name,
  cast(1000000 + n_nationkey*1000 as bigint) length from {nation} where n_nationkey < 24)"""


class Fixtures:
    """The derived tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def folder(self, name: str) -> str:
        """A new path for files that a query writes and reads again."""
        return scratch.folder(self.spark, name)

    def spread(self, name: str, *columns: str) -> DataFrame:
        """The named columns of a table. A table of few splits, which would leave cores idle, is dealt out first; large ones never are."""
        found, cores = self.table(name).select(*columns), self.spark.sparkContext.defaultParallelism
        return found.repartition(cores, *columns) if found.rdd.getNumPartitions() < cores else found

    def _derived(self, text: str, view: str, source: str, *columns: str) -> DataFrame:
        return self.spark.sql(f"with {text} select * from {view}", **{source: self.spread(source, *columns) if columns else self.table(source)})

    @property
    def reads(self) -> DataFrame:
        return self._derived(SPARK_READS, "reads", "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

    @property
    def regions(self) -> DataFrame:
        return self._derived(REGIONS, "regions", "events")

    @property
    def dictionary(self) -> DataFrame:
        return self._derived(DICTIONARY, "dict", "nation")

    @property
    def sequences(self) -> DataFrame:
        return self.reads.selectExpr("qname as name", "cast(null as string) as comment", "seq", "qual")


def oracle(select: str, *more: str) -> str:
    """DuckDB SQL over the derived tables; ``more``: further common tables."""
    parts = [READS.format(lineitem="lineitem"), REGIONS.format(events="events"), DICTIONARY.format(nation="nation"), *more]
    return f"with {', '.join(parts)} {select}"
