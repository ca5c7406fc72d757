"""The queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.functions import cigar as C
from genospark.functions import flags as A
from genospark.functions import hashing as H
from genospark.functions import motif as M
from genospark.functions import region as R
from genospark.functions import sequence as S
from genospark.operators import align, assemble, correct, intervals, kmers, plot, stats
from genospark.operators import dictionary as D
from genospark.plans import rules
from genospark.plans.fixtures import Fixtures, oracle
from genospark.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *more: str):
    """Registers a function of Fixtures as a query, with the DuckDB select of its rows."""

    def add(f: Callable[[Fixtures], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *more)
        return f

    return add


# --- pieces of DuckDB text ---


def _sum(kinds: str, column: str = "cigar") -> str:
    return f"cast(coalesce(list_sum(list_transform(regexp_extract_all({column}, '([0-9]+)[{kinds}]', 1), lambda x: cast(x as int))), 0) as int)"


def _max(kind: str) -> str:
    return f"cast(coalesce(list_max(list_transform(regexp_extract_all(cigar, '([0-9]+){kind}', 1), lambda x: cast(x as int))), 0) as int)"


END = f"(case when flag & 4 = 0 then pos + greatest({_sum('MDN=X')}, 1) else pos + 1 end)"
PAIR = "(flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0)"
FULL = f"cast(case when {PAIR} and tid = mtid then abs(pos - mpos) + {_sum('MIS=X')} else 0 end as int)"
LEFT = "(tid < mtid or (tid = mtid and pos <= mpos))"
ORIENT = f"""cast(case when flag & 4 <> 0 or flag & 8 <> 0 then 4 else case when {LEFT} then
  case when flag & 16 = 0 and flag & 32 <> 0 then 0 when flag & 16 = 0 and flag & 32 = 0 then 1 when flag & 16 <> 0 and flag & 32 = 0 then 2 else 3 end
  else case when flag & 32 = 0 and flag & 16 <> 0 then 0 when flag & 32 = 0 and flag & 16 = 0 then 1 when flag & 32 <> 0 and flag & 16 = 0 then 2 else 3 end end end as int)"""
GROUP = "coalesce(rg, case when instr(qname, ':') > 0 then split_part(qname, ':', 1) end, 'NA')"
NBASES = "cast(length(seq) - length(replace(seq, 'N', '')) as int)"
COMPLEMENT = "reverse(translate({}, 'ACGTacgt', 'TGCAtgca'))"
COMMAS = "format('{{:,}}', {})"


# --- records ---


@query("""select qname, pos, flag & 16 <> 0 rev, flag & 32 <> 0 mate_rev, flag & 1024 <> 0 dup, flag & 256 <> 0 sec, flag & 1 <> 0 paired, flag & 512 <> 0 qcfail,
  flag & 2048 <> 0 supp, flag & 4 = 0 mapped, flag & 8 = 0 mate_mapped, flag & 2 <> 0 proper, flag & 64 <> 0 first_read, flag & 128 <> 0 last_read,
  (flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0) pair_mapped, (tid <> mtid and flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0) interchrom from reads""")  # fmt: skip
def flag_projection(t: Fixtures) -> DataFrame:
    named = {"rev": A.reverse(), "mate_rev": A.mate_reverse(), "dup": A.duplicate(), "sec": A.secondary(), "paired": A.paired(), "qcfail": A.qc_fail(), "supp": A.supplementary(), "mapped": A.mapped(), "mate_mapped": A.mate_mapped(), "proper": A.proper_pair(), "first_read": A.first_in_pair(), "last_read": A.last_in_pair(), "pair_mapped": A.pair_mapped(), "interchrom": A.interchromosomal()}
    return t.reads.select("qname", "pos", *[c.alias(n) for n, c in named.items()])


@query("select count(*) n, count(*) filter (flag & 1024 <> 0) dup, count(*) filter (flag & 4 = 0) mapped, count(*) filter (flag & 512 <> 0) qcfail from reads")
def named_flag_counts(t: Fixtures) -> DataFrame:
    return t.reads.agg(F.count("*").alias("n"), F.count_if(A.duplicate()).alias("dup"), F.count_if(A.mapped()).alias("mapped"), F.count_if(A.qc_fail()).alias("qcfail"))


@query(f"select qname, pos, {ORIENT} orientation from reads")
def pair_orientation(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "pos", A.pair_orientation().alias("orientation"))


@query("select qname, pos, (tid = mtid and case when pos < mpos then flag & 16 = 0 and flag & 32 <> 0 else flag & 16 <> 0 and flag & 32 = 0 end) proper from reads")
def proper_orientation(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "pos", A.proper_orientation().alias("proper"))


@query(f"select qname, pos, {FULL} full_insert from reads")
def full_insert_size(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "pos", A.full_insert_size().alias("full_insert"))


@query(f"select qname, pos, cast({END} as int) pos_end, cast(mpos + l_qseq as int) mate_end from reads")
def position_end(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "pos", A.position_end().alias("pos_end"), A.mate_position_end().alias("mate_end"))


@query(f"select qname, tid chr, pos pos1, cast({END} as int) pos2, case when flag & 4 <> 0 then '*' when flag & 16 <> 0 then '-' else '+' end strand, mtid mchr, mpos mpos1, cast(mpos + l_qseq as int) mpos2, case when flag & 8 <> 0 then '*' when flag & 32 <> 0 then '-' else '+' end mstrand from reads")
def read_regions(t: Fixtures) -> DataFrame:
    both = t.reads.select("qname", A.region().alias("r"), A.mate_region().alias("m"))
    return both.select("qname", "r.*", F.col("m.chr").alias("mchr"), F.col("m.pos1").alias("mpos1"), F.col("m.pos2").alias("mpos2"), F.col("m.strand").alias("mstrand"))


@query(f"select qname, {GROUP} read_group from reads")
def read_group_parse(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", A.read_group().alias("read_group"))


@query(f"select qname, concat(cast(tid + 1 as varchar), ':', {COMMAS.format('pos')}, '(', case when flag & 16 <> 0 then '-' else '+' end, ')') brief, concat(cast(mtid + 1 as varchar), ':', {COMMAS.format('mpos')}, '(', case when flag & 32 <> 0 then '-' else '+' end, ')') mate_brief from reads")
def read_brief(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", A.brief().alias("brief"), A.mate_brief().alias("mate_brief"))


@query("select qname, pos, cast(flag | 512 as int) failed, cast(flag & ~1 as int) unpaired, cast(case when mapq > 30 then flag | 32 else flag & ~32 end as int) mate_set from reads")
def set_flags(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "pos", A.with_flag(A.QC_FAIL).alias("failed"), A.with_flag(A.PAIRED, False).alias("unpaired"), A.with_flag(A.MATE_REVERSE, F.col("mapq") > 30).alias("mate_set"))


@query("select tid, cast(count(*) filter (mapq > 30) * 100 // count(*) as int) percent from reads group by tid")
def percent_kept(t: Fixtures) -> DataFrame:
    return t.reads.groupBy("tid").agg(F.count_if(F.col("mapq") > 30).alias("k"), F.count("*").alias("n")).select("tid", A.percent_kept(F.col("k"), F.col("n")).alias("percent"))


@query("select qname, name, mate_name from (select r.qname, coalesce(d.name, cast(r.tid as varchar)) name, coalesce(m.name, cast(r.mtid as varchar)) mate_name from reads r left join dict d on r.tid = d.id left join dict m on r.mtid = m.id)")
def chromosome_names(t: Fixtures) -> DataFrame:
    named = D.with_name(t.reads, t.dictionary, "tid", "name")
    return D.with_name(named, t.dictionary, "mtid", "mate_name").select("qname", "name", "mate_name")


@query("select qname, concat_ws(chr(9), qname, cast(flag as varchar), cast(tid + 1 as varchar), cast(pos as varchar), cast(mapq as varchar), cigar, cast(mtid + 1 as varchar), cast(mpos as varchar), '0', seq, '*') line from reads")
def sam_text(t: Fixtures) -> DataFrame:
    return t.reads.withColumn("isize", F.lit(0)).select("qname", A.sam_lite().alias("line"))


@query("select concat('M', cast(item_id as varchar)) qname, cast(case when item_id % 2 = 0 then 16 else 0 end as int) flag, cast(0 as int) tid, cast(item_id as int) pos, cast(60 as int) mapq, concat(cast(length(text) as varchar), 'M') cigar, cast(length(text) as int) l_qseq from benchmark")
def built_records(t: Fixtures) -> DataFrame:
    """Records made by hand over passages as sequences."""
    rows = t.table("benchmark").select(F.concat(F.lit("M"), F.col("item_id").cast("string")).alias("n"), "text", F.concat(F.length("text").cast("string"), F.lit("M")).alias("c"), F.col("item_id").cast("int").alias("p"), F.when(F.col("item_id") % 2 == 0, "-").otherwise("+").alias("s"))
    made = A.built(F.col("n"), F.col("text"), F.col("c"), F.lit(0), F.col("p"), F.col("p") + F.length("text") - 1, F.col("s"))
    return rows.select(made.alias("r")).select("r.*").drop("seq")


@query("select qname, cast(null as varchar) seq, cast(null as varchar) qual, tid from reads")
def cleared_records(t: Fixtures) -> DataFrame:
    return t.reads.withColumns(A.cleared()).where(~A.is_missing()).select("qname", "seq", "qual", "tid")


# --- bases, qualities, tags ---


@query(f"select qname, {NBASES} n_bases from reads")
def n_base_count(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", S.n_bases().alias("n_bases"))


@query(f"select qname, {COMPLEMENT.format('seq')} rc from reads")
def reverse_complement(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", S.reverse_complement("seq").alias("rc"))


_LOW = "[" + "".join("\\x%02x" % c for c in range(33, 53)) + "]"


@query(f"""select qname, cast(case when l = 0 then l_qseq else length(qual) - l end as int) trim_start, cast(case when l = 0 then -1 else r end as int) trim_end
  from (select qname, l_qseq, qual, length(regexp_replace(qual, '^{_LOW}+', '')) l, length(regexp_replace(qual, '{_LOW}+$', '')) r from reads)""")
def quality_trim_bounds(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", S.quality_trim(20).alias("b")).select("qname", F.col("b.start").alias("trim_start"), F.col("b.end").alias("trim_end"))


@query("select qname, cast(list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) as double) / length(qual) mean_phred from reads")
def mean_phred(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", S.mean_phred().alias("mean_phred"))


@query("select qname, list_aggregate(list_transform(string_split(qual, ''), lambda x: chr(ascii(x) - 2)), 'string_agg', '') qual from reads")
def quality_offset(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", S.qualities("qual", 31).alias("qual"))


@query("select qname, nm, coalesce(rg, 'none') rg_tag, 'x' note from reads where nm is not null")
def tag_access(t: Fixtures) -> DataFrame:
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    tagged = t.reads.withColumn("tags", S.with_tag("NM", "i", F.col("nm"), tags=S.with_tag("RG", "Z", F.coalesce("rg", F.lit("none")), tags=empty)))
    tagged = tagged.withColumn("tags", S.without_tag("ZZ", tags=S.with_tag("CO", "Z", F.lit("x"), tags=S.with_tag("ZZ", "Z", F.lit("gone")))))
    return tagged.where(F.col("tags")["ZZ"].isNull()).select("qname", S.int_tag("NM").alias("nm"), S.z_tag("RG").alias("rg_tag"), S.tag("CO").alias("note")).where("nm is not null")


@query("select qname, concat('@', qname, chr(10), seq, chr(10), '+', chr(10), qual) record from reads")
def fastq_text(t: Fixtures) -> DataFrame:
    return t.sequences.select(F.col("name").alias("qname"), S.fastq().alias("record"))


# --- CIGAR ---


@query(f"select qname, cigar, {_sum('MIS=X')} query_bases, {_sum('MDN=X')} reference_bases, {_sum('MID=X')} aligned, {_sum('M')} matched from reads")
def cigar_consumed(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", "cigar", C.query_consumed().alias("query_bases"), C.reference_consumed().alias("reference_bases"), C.aligned_bases().alias("aligned"), C.match_bases().alias("matched"))


@query(f"select qname, {_sum('S')} soft, {_sum('H')} hard, {_sum('SH')} clip from reads")
def cigar_clips(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", C.soft_clip().alias("soft"), C.hard_clip().alias("hard"), C.clip().alias("clip"))


@query(f"select qname, {_max('I')} max_ins, {_max('D')} max_del from reads")
def cigar_max_indel(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", C.longest("I").alias("max_ins"), C.longest("D").alias("max_del"))


_TAIL = "regexp_extract(cigar, '(([0-9]+[SH])*)$', 1)"
_LEAD = "coalesce(try_cast(regexp_extract(cigar, '^([0-9]+H)*([0-9]+)S', 2) as int), 0)"


@query(f"select qname, {_LEAD} align_start, cast(l_qseq - {_sum('SH', _TAIL)} as int) align_end, {_sum('SH', _TAIL)} rev_start, cast(l_qseq - {_LEAD} as int) rev_end from reads")
def cigar_align_pos(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", C.alignment_start().alias("align_start"), C.alignment_end().alias("align_end"), C.alignment_start_reverse().alias("rev_start"), C.alignment_end_reverse().alias("rev_end"))


@query("select qname, cast(len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as int) operations, array_to_string(list_reverse(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')), '') reversed from reads")
def cigar_reversed(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", C.operations().alias("operations"), C.reversed_string().alias("reversed"))


_SHARED = {"32M": 22, "5S27M": 22, "10M2I20M": 20, "16M3D16M": 22, "20M12S": 10, "4H28M4S": 18}


@query("select qname, cast(case cigar " + " ".join(f"when '{c}' then {n}" for c, n in _SHARED.items()) + " end as int) shared from reads")
def cigar_overlapping_coverage(t: Fixtures) -> DataFrame:
    """Offsets that are M in the read and in 5S10M5I12M, whose M offsets are 5-14 and 20-31."""
    return t.reads.select("qname", C.overlapping_coverage(F.col("cigar"), F.lit("5S10M5I12M")).alias("shared"))


# --- regions ---


@query("select id, cast(pos2 - pos1 + 1 as bigint) width, cast(pos1 - 7 as int) padded1, cast(pos2 + 7 as int) padded2 from regions")
def region_width_pad(t: Fixtures) -> DataFrame:
    start, end = R.padded(7)
    return t.regions.select("id", R.width().alias("width"), start.alias("padded1"), end.alias("padded2"))


_NEXT = "select a.id, a.chr, a.pos1, a.pos2, b.chr chr_b, b.pos1 pos1_b, b.pos2 pos2_b from regions a join regions b on b.id = a.id + 24"


def _next(t: Fixtures) -> DataFrame:
    other = t.regions.select((F.col("id") - 24).alias("id"), *[F.col(c).alias(f"{c}_b") for c in ("chr", "pos1", "pos2")])
    return t.regions.join(other, "id")


@query(f"select id, cast(case when chr <> chr_b or pos2 < pos1_b or pos2_b < pos1 then 0 when pos1 >= pos1_b and pos2 <= pos2_b then 3 when pos1_b >= pos1 and pos2_b <= pos2 then 2 else 1 end as int) class from ({_NEXT})")
def region_overlap_class(t: Fixtures) -> DataFrame:
    return _next(t).select("id", R.overlap_class().alias("class"))


@query(f"select id, cast(case when chr = chr_b then abs(pos1 - pos1_b) else -1 end as int) starts, cast(case when chr = chr_b then abs(pos2 - pos2_b) else -1 end as int) ends, chr = chr_b and pos1 = pos1_b and pos2 = pos2_b same, (chr, pos1, pos2) < (chr_b, pos1_b, pos2_b) less from ({_NEXT})")
def region_distance(t: Fixtures) -> DataFrame:
    return _next(t).select("id", R.distance_starts().alias("starts"), R.distance_ends().alias("ends"), (R.key() == R.key("_b")).alias("same"), (R.key() < R.key("_b")).alias("less"))


_NAME = "(case when chr = 22 then 'X' when chr = 23 then 'Y' when chr = 24 then 'M' else cast(chr + 1 as varchar) end)"


@query(f"select id, concat({_NAME}, ':', {COMMAS.format('pos1')}, '-', {COMMAS.format('pos2')}, '(', strand, ')') text, concat({_NAME}, ':', {COMMAS.format('pos1')}, '(', strand, ')') point from regions")
def region_format(t: Fixtures) -> DataFrame:
    return t.regions.select("id", R.to_string(R.default_name()).alias("text"), R.point_string(R.default_name()).alias("point"))


@query("select id, concat_ws(chr(9), d.name, cast(pos1 as varchar), cast(pos2 as varchar), strand) line from (select r.id, r.chr, r.pos1, r.pos2, r.strand, d.name from regions r join dict d on r.chr = d.id) d")
def bed_text(t: Fixtures) -> DataFrame:
    named = D.with_region_name(t.regions, t.dictionary, "name")
    return named.select("id", R.bed_line(F.col("name")).alias("line"))


@query("select id, name, coalesce(cast(case when name in ('X') then 22 when name in ('Y') then 23 else cast(name as int) - 1 end as int), -1) plain_id, id looked_up, length from dict")
def dictionary_lookup(t: Fixtures) -> DataFrame:
    named = t.dictionary.select("id", "name", "length", R.chromosome_id(F.col("name")).alias("plain_id"))
    return D.with_id(named, t.dictionary, "name", "looked_up", True).select("id", "name", "plain_id", "looked_up", "length")


@query("select id, concat('@SQ', chr(9), 'SN:', name, chr(9), 'LN:', cast(length as varchar)) line from dict")
def header_lines(t: Fixtures) -> DataFrame:
    return D.header_lines(t.dictionary)


@query("select count(*) size, count(distinct chr) chromosomes from regions")
def region_summary(t: Fixtures) -> DataFrame:
    return intervals.summary(t.regions)


@query("select * from ((select id, chr, pos1, pos2, strand from regions order by chr, pos1, pos2, id limit 3) union all (select id, chr, pos1, pos2, strand from regions order by chr desc, pos1 desc, pos2 desc, id desc limit 3))")
def region_head_tail(t: Fixtures) -> DataFrame:
    return intervals.sample_rows(t.regions)


# --- rules ---


def _kept(t: Fixtures, script: dict, where=None) -> DataFrame:
    return rules.apply(t.reads, rules.parse(script, where)).select("qname", "flag", "tid", "pos", "mapq", "cigar")


def _rule_query(name: str, script: dict, condition: str, where=None) -> None:
    def run(t: Fixtures) -> DataFrame:
        return _kept(t, script, where)

    run.__name__ = name
    query(f"select qname, flag, tid, pos, mapq, cigar from reads where {condition}")(run)


def _literal(text: str) -> list[tuple[int, int, int]]:
    return [readers.parse_region(text, [(i, str(i + 1), 1_000_000) for i in range(24)])]


_NM = "coalesce(nm, 0)"
_rule_query("filter_range", {"": {"rules": [{"mapq": [10, 50], "nm": [1, 4], "length": 30}]}}, f"mapq between 10 and 50 and {_NM} between 1 and 4 and l_qseq >= 30")
_rule_query("filter_inverted_range", {"": {"rules": [{"mapq": [50, 10], "ins": False}]}}, f"not (mapq between 10 and 50) and not ({_max('I')} >= 1)")
_rule_query("filter_masks", {"": {"rules": [{"allflag": 3, "!anyflag": 1536}, {"anyflag": 48, "!allflag": 192}]}}, "(flag & 3 = 3 and flag & 1536 = 0) or (flag & 48 <> 0 and flag & 192 <> 192)")
_rule_query("filter_named_flags", {"": {"rules": [{"duplicate": False, "supplementary": False, "qcfail": False, "mapped": True, "mate_mapped": True, "fwd_strand": True, "mate_rev": True}]}}, "flag & 1024 = 0 and flag & 256 = 0 and flag & 512 = 0 and flag & 4 = 0 and flag & 8 = 0 and flag & 16 = 0 and flag & 32 <> 0")
_rule_query("filter_hardclip", {"": {"rules": [{"hardclip": True, "mapped": True}]}}, f"(case when len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) > 1 then {_sum('H')} > 0 else true end) and flag & 4 = 0")
_rule_query("filter_orientation", {"": {"rules": [{"fr": False}, {"ic": True}]}}, f"({PAIR} and (tid <> mtid or {ORIENT} <> 0)) or ({PAIR} and tid <> mtid)")
_rule_query("filter_or_rules", {"global": {"!anyflag": 1536}, "": {"rules": [{"ic": True}, {"clip": 5}, {"ins": True}, {"del": True}, {"mapped": True, "mate_mapped": False}, {"mate_mapped": True, "mapped": False}]}}, f"flag & 1536 = 0 and (({PAIR} and tid <> mtid) or {_sum('SH')} >= 5 or {_max('I')} >= 1 or {_max('D')} >= 1 or (flag & 4 = 0 and flag & 8 <> 0) or (flag & 8 = 0 and flag & 4 <> 0))")
_rule_query("filter_global", {"global": {"!anyflag": 1536, "mapq": 20}, "": {}}, "flag & 1536 = 0 and mapq >= 20")
_rule_query("filter_insert_size", {"": {"rules": [{"isize": [100, 300]}]}}, f"{FULL} between 100 and 300")
_rule_query("filter_read_group", {"": {"rules": [{"rg": "RG1"}]}}, f"{GROUP} = 'RG1'")
_rule_query("filter_n_bases", {"": {"rules": [{"nbases": [0, 1], "phred": [15, 25]}]}}, f"{NBASES} between 0 and 1 and list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) / cast(length(qual) as double) between 15 and 25")
_IN_A = f"(tid = 2 and pos <= 200010 and {END} >= 99991)"
_rule_query("filter_region", {"A": {"region": "3:100,001-200,000", "pad": 10, "rules": [{"mapq": [10, 50]}, {"clip": 5, "mapped": True}]}}, f"{_IN_A} and (mapq between 10 and 50 or ({_sum('SH')} >= 5 and flag & 4 = 0))", _literal)
_rule_query("filter_matelink", {"A": {"region": "3:100,001-200,000", "matelink": True, "rules": [{"mapq": 5}]}}, f"((tid = 2 and pos <= 200000 and {END} >= 100001) or (mtid = 2 and mpos <= 200000 and mpos + l_qseq >= 100001)) and mapq >= 5", _literal)
_rule_query("filter_excluder", {"global": {"!anyflag": 1536}, "A": {"region": "3:100,001-200,000", "pad": 10, "rules": [{"mapq": [10, 50]}]}, "B": {"exclude": True, "rules": [{"nbases": [3, 100]}]}}, f"{_IN_A} and flag & 1536 = 0 and mapq between 10 and 50 and not (flag & 1536 = 0 and {NBASES} between 3 and 100)", _literal)
_rule_query("filter_auto_includer", {"global": {"mapq": 30}, "B": {"exclude": True, "rules": [{"clip": 5}]}}, f"mapq >= 30 and not (mapq >= 30 and {_sum('SH')} >= 5)")
_rule_query("motif_filter", {"": {"rules": [{"motif": ["ACGTA", "GGGCC", "TTTTA"]}]}}, "contains(seq, 'ACGTA') or contains(seq, 'GGGCC') or contains(seq, 'TTTTA')")
_rule_query("motif_inverted", {"": {"rules": [{"!motif": ["ACG", "GGG"], "mapq": 10}]}}, "not (contains(seq, 'ACG') or contains(seq, 'GGG')) and mapq >= 10")

_MANY = tuple(a + b + c + d + "AC" for a in "ACG" for b in "ACGT" for c in "ACGT" for d in "AT")


@query(f"select qname, pos from reads where regexp_matches(seq, '{'|'.join(_MANY)}')")
def motif_large_dictionary(t: Fixtures) -> DataFrame:
    return t.reads.where(M.contains_motif(F.col("seq"), _MANY)).select("qname", "pos")


@query("select doc_id from documents d where exists (select 1 from benchmark b where contains(d.text, b.text))")
def motif_documents_whole(t: Fixtures) -> DataFrame:
    words = [r[0] for r in t.table("benchmark").select("text").collect()]  # the benchmark is a dictionary by definition
    return t.table("documents").where(M.contains_motif(F.col("text"), words)).select("doc_id")


_XOR = "(({0} | {1}) - ({0} & {1}))"
_HASH = ", ".join([
    "x31 as (select qname, pos, list_reduce(list_prepend(0::bigint, list_transform(string_split(qname, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 31 + c) & 4294967295) h from reads)",
    f"w0 as (select qname, pos, {_XOR.format('h', '999')} k from x31)", "w1 as (select qname, pos, (k + 4294967295 - ((k * 32768) & 4294967295)) & 4294967295 k from w0)",
    f"w2 as (select qname, pos, {_XOR.format('k', '(k >> 10)')} k from w1)", "w3 as (select qname, pos, (k + 8 * k) & 4294967295 k from w2)", f"w4 as (select qname, pos, {_XOR.format('k', '(k >> 6)')} k from w3)",
    "w5 as (select qname, pos, (k + 4294967295 - ((k * 2048) & 4294967295)) & 4294967295 k from w4)", f"w6 as (select qname, pos, {_XOR.format('k', '(k >> 16)')} k from w5)",
])


@query("select qname, pos from w6 where (k & 16777215) / 16777216.0 < 0.25", _HASH)
def subsample_hash(t: Fixtures) -> DataFrame:
    return rules.apply(t.reads, rules.parse({"": {"rules": [{"subsample": 0.25}]}})).select("qname", "pos")


@query("select r.qname, r.pos from (select distinct qname, pos, k from w6) w join (select distinct * from reads) r on r.qname = w.qname and r.pos = w.pos where (k & 16777215) / 16777216.0 < (r.tid % 4) / 4.0", _HASH)
def subsample_by_region(t: Fixtures) -> DataFrame:
    return t.reads.distinct().where(H.keep_fraction(F.col("qname"), F.pmod(F.col("tid"), F.lit(4)) / 4.0, rules.SEED)).select("qname", "pos")



@query(f"select r.qname, r.pos, r.flag from (select *, {END} e from reads) r join (select distinct qname, k from w6) w on r.qname = w.qname where (w.k & 16777215) / 16777216.0 < (select max((g.id % 4) / 4.0) from regions g where g.chr = r.tid and r.pos <= g.pos2 and r.e >= g.pos1)", _HASH)
def sample_by_regions(t: Fixtures) -> DataFrame:
    fractions = t.regions.withColumn("frac", F.pmod("id", F.lit(4)) / 4.0)
    return intervals.sampled_by_regions(t.reads, fractions).select("qname", "pos", "flag")


@query(f"""select cast(-1 as int) "filter", cast(-1 as int) rule, count(*) filter (flag & 1536 = 0 and (mapq >= 30 or {_sum('SH')} >= 5)) passed from reads
  union all select 0, -1, count(*) filter (flag & 1536 = 0 and (mapq >= 30 or {_sum('SH')} >= 5)) from reads
  union all select 0, 0, count(*) filter (flag & 1536 = 0 and mapq >= 30) from reads union all select 0, 1, count(*) filter (flag & 1536 = 0 and {_sum('SH')} >= 5) from reads""")
def filter_rule_counts(t: Fixtures) -> DataFrame:
    return rules.parse({"global": {"!anyflag": 1536}, "": {"rules": [{"mapq": 30}, {"clip": 5}]}}).counts(t.reads)


@query(f"select {GROUP} read_group, count(*) reads from reads where flag & 1536 = 0 and ((mapq between 10 and 50 and {_NM} between 1 and 4) or {_sum('SH')} >= 5) group by 1")
def filtered_read_groups(t: Fixtures) -> DataFrame:
    script = {"global": {"!anyflag": 1536}, "": {"rules": [{"mapq": [10, 50], "nm": [1, 4]}, {"clip": 5}]}}
    return rules.apply(t.reads, rules.parse(script)).groupBy(A.read_group().alias("read_group")).agg(F.count("*").alias("reads"))


@query("select qname, flag, tid, pos, mapq, cigar, mtid, mpos, l_qseq, seq, qual, rg, nm from reads")
def sam_round_trip(t: Fixtures) -> DataFrame:
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    tagged = t.reads.withColumn("tags", S.with_tag("RG", "Z", F.col("rg"), tags=S.with_tag("NM", "i", F.col("nm"), tags=empty))).withColumn("isize", F.lit(0))
    lines = writers.sam_lines(tagged, t.dictionary).withColumnRenamed("line", "value")
    return readers.sam_reads(lines, t.dictionary).drop("isize", "tags")


@query("select item_id id, cast(item_id as varchar) name, cast(item_id % 30 as int) pos1, cast(item_id % 30 + 40 as int) pos2, substr(text, cast(item_id % 30 + 1 as int), 41) bases from benchmark")
def reference_query(t: Fixtures) -> DataFrame:
    """Passages as reference sequences, cut from chunks of 16 letters."""
    genome = t.table("benchmark").select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("seq"))
    low = F.pmod("item_id", F.lit(30)).cast("int")
    asked = t.table("benchmark").select(F.col("item_id").alias("id"), F.col("item_id").cast("string").alias("name"), low.alias("pos1"), (low + 40).cast("int").alias("pos2"))
    return readers.reference_query(readers.reference_chunks(genome, 16), asked, 16)


@query("select id, chr, pos1, pos2 from regions")
def region_from_text(t: Fixtures) -> DataFrame:
    text = t.regions.select("id", R.to_string(R.default_name()).alias("t"))
    parts = text.select("id", F.regexp_extract("t", r"^(.*):", 1).alias("n"), *[F.replace(F.regexp_extract("t", r":([0-9,]+)-([0-9,]+)", k), F.lit(",")).cast("int").alias(f"pos{k}") for k in (1, 2)])
    return parts.select("id", R.chromosome_id(F.col("n")).alias("chr"), "pos1", "pos2")


# --- interval joins ---

_SPANS = f"spans as (select row_number() over () id, tid chr, pos pos1, cast({END} as int) pos2 from reads)"
_HIT = "q.chr = s.chr and s.pos2 >= q.pos1 and s.pos1 <= q.pos2"
_TRIM = "greatest(q.pos1, s.pos1) pos1, least(q.pos2, s.pos2) pos2"


def _spans(t: Fixtures) -> DataFrame:
    return t.reads.select(F.monotonically_increasing_id().alias("id"), F.col("tid").alias("chr"), F.col("pos").alias("pos1"), A.position_end().alias("pos2"), F.lit("*").alias("strand"), "qname")


@query(f"select q.id query_id, r.qname, q.chr, greatest(q.pos1, r.pos) pos1, cast(least(q.pos2, {END}) as int) pos2 from regions q join reads r on q.chr = r.tid and {END} >= q.pos1 and r.pos <= q.pos2")
def overlap_join(t: Fixtures) -> DataFrame:
    found = intervals.pairs(t.regions, _spans(t))
    return found.select(F.col("q.id").alias("query_id"), F.col("s.qname").alias("qname"), "chr", "pos1", "pos2")


@query(f"select q.id query_id, s.id subject_id, q.chr, {_TRIM} from regions q join regions s on {_HIT} and q.strand = s.strand")
def strand_overlap(t: Fixtures) -> DataFrame:
    return intervals.overlap_join(t.regions, t.regions, True).drop("strand")


@query(f"select q.id query_id, count(s.id) n from regions q left join spans s on {_HIT} group by q.id", _SPANS)
def overlap_count(t: Fixtures) -> DataFrame:
    return intervals.count_overlaps(t.regions, _spans(t))


@query("select id subject_id, chr, greatest(pos1, 100000) pos1, least(pos2, 500000) pos2 from regions where chr = 3 and pos1 <= 500000 and pos2 >= 100000")
def overlap_one_region(t: Fixtures) -> DataFrame:
    return intervals.overlaps_of(t.regions, 3, 100_000, 500_000).drop("strand")


@query(f"select distinct a.id id_a, b.id id_b from regions a join (select q.id, s.id sid from regions q join regions s on {_HIT}) x on x.id = a.id join (select q.id, s.id sid from regions q join regions s on {_HIT}) y on x.sid = y.sid join regions b on y.id = b.id")
def overlap_same_interval_all(t: Fixtures) -> DataFrame:
    return intervals.share_subject(t.regions, t.regions, t.regions)


_MERGED = "select chr, min(pos1) pos1, max(pos2) pos2 from (select *, sum(fresh) over (partition by {k} order by pos1, pos2 rows unbounded preceding) island from (select *, case when pm is null or pos1 > pm then 1 else 0 end fresh from (select *, max(pos2) over (partition by {k} order by pos1, pos2 rows between unbounded preceding and 1 preceding) pm from {t}))) group by {k}, island"


@query("select q.id query_id, cast(coalesce(w, 0) as bigint) width from regions q left join (select query_id, sum(pos2 - pos1 + 1) w from (" + _MERGED.format(k="query_id, chr", t="hits").replace("select chr,", "select query_id, chr,", 1) + ") group by query_id) m on q.id = m.query_id", _SPANS, f"hits as (select q.id query_id, q.chr, {_TRIM} from regions q join spans s on {_HIT})")
def overlap_width(t: Fixtures) -> DataFrame:
    return intervals.overlap_width(t.regions, _spans(t))


@query(f"select q.chr, {_TRIM} from regions q join regions s on {_HIT}")
def intersection_all(t: Fixtures) -> DataFrame:
    return intervals.intersection(t.regions, t.regions)


@query("select q.id query_id, count(s.id) n from regions q left join spans s on q.chr = s.chr and s.pos1 >= q.pos1 and s.pos2 <= q.pos2 group by q.id", _SPANS)
def count_contained(t: Fixtures) -> DataFrame:
    return intervals.count_contained(t.regions, _spans(t))


@query(f"select qname, flag, pos from reads r where exists (select 1 from regions g where g.chr = r.tid and r.pos <= g.pos2 and {END} >= g.pos1)")
def region_semi(t: Fixtures) -> DataFrame:
    return intervals.overlapping_reads(t.reads, t.regions).select("qname", "flag", "pos")


@query(f"select qname, flag, pos from reads r where not exists (select 1 from regions g where g.chr = r.tid and r.pos <= g.pos2 and {END} >= g.pos1)")
def region_anti(t: Fixtures) -> DataFrame:
    return intervals.overlapping_reads(t.reads, t.regions, anti=True).select("qname", "flag", "pos")


@query(f"select qname, flag, pos from reads r where exists (select 1 from regions g where g.chr = r.tid and r.pos <= g.pos2 and {END} >= g.pos1) or exists (select 1 from regions g where g.chr = r.mtid and r.mpos <= g.pos2 and r.mpos + r.l_qseq >= g.pos1)")
def region_semi_matelink_all(t: Fixtures) -> DataFrame:
    return intervals.overlapping_reads(t.reads, t.regions, mate_linked=True).select("qname", "flag", "pos")


@query(f"select g.id region_id, qname, flag, pos from reads r join regions g on g.chr = r.tid and r.pos <= g.pos2 and {END} >= g.pos1")
def multi_region_scan_all(t: Fixtures) -> DataFrame:
    return intervals.scan_regions(t.reads, t.regions).select("region_id", "qname", "flag", "pos")


# --- merge, depth, tiles ---


@query(_MERGED.format(k="chr", t="regions"))
def merge_intervals(t: Fixtures) -> DataFrame:
    return intervals.merged_at_scale(t.regions)


@query("select cast(sum(pos2 - pos1 + 1) as bigint) total_width from regions")
def total_width(t: Fixtures) -> DataFrame:
    return intervals.total_width(t.regions)


@query("select id, chr, pos1, pos2 from regions union all select null, chr, pos1, pos2 from spans", _SPANS)
def concat_regions_all(t: Fixtures) -> DataFrame:
    """The regions, and the reads' spans without an id."""
    return intervals.concatenated(t.regions.drop("strand"), _spans(t).select("chr", "pos1", "pos2"))


@query(_MERGED.format(k="chr", t="(select chr, pos1, pos2 from regions union all select chr, pos1, pos2 from spans)"), _SPANS)
def interval_union(t: Fixtures) -> DataFrame:
    return intervals.union(t.regions, _spans(t))


_EVENTS = "ev as (select chr, p, sum(a) a, sum(b) b from (select chr, pos1 p, 1 a, 0 b from regions where id % 2 = 0 union all select chr, pos2 + 1, -1, 0 from regions where id % 2 = 0 union all select chr, pos1, 0, 1 from regions where id % 2 = 1 union all select chr, pos2 + 1, 0, -1 from regions where id % 2 = 1) group by 1, 2)"


@query(_MERGED.format(k="chr", t="(select chr, p pos1, q - 1 pos2 from (select chr, p, lead(p) over w q, sum(a) over w a, sum(b) over w b from ev window w as (partition by chr order by p)) where a > 0 and b = 0)").replace("pos1 > pm then", "pos1 > pm + 1 then"), _EVENTS)
def interval_difference(t: Fixtures) -> DataFrame:
    return intervals.difference(t.regions.where("id % 2 = 0"), t.regions.where("id % 2 = 1"))


def _depth(end: str) -> str:
    return f"dev as (select chr, p, sum(v) v from (select tid chr, pos p, 1 v from reads where {END} > pos union all select tid, {end}, -1 from reads where {END} > pos) group by 1, 2), runs as (select * from (select chr, p \"start\", lead(p) over (partition by chr order by p) \"end\", sum(v) over (partition by chr order by p) depth from dev) where depth > 0)"


@query('select chr, "start", cast("end" as int) "end", cast(depth as bigint) depth from runs', _depth(END))
def depth_runs(t: Fixtures) -> DataFrame:
    return intervals.depth_runs(intervals.read_spans(t.reads))


@query('select chr, "start", cast("end" as int) "end", cast(depth as bigint) depth from runs', _depth(f"{END} + 1"))
def depth_runs_inclusive(t: Fixtures) -> DataFrame:
    return intervals.depth_runs(intervals.read_spans(t.reads), inclusive_end=True)


@query("select cast(max(depth) as bigint) max_depth from runs", _depth(END))
def depth_max(t: Fixtures) -> DataFrame:
    return intervals.max_depth(intervals.depth_runs(intervals.read_spans(t.reads)))


@query('select g.id, g.chr, g.pos1 pos, cast(coalesce(r.depth, 0) as bigint) depth from regions g left join runs r on g.chr = r.chr and g.pos1 >= r."start" and g.pos1 < r."end"', _depth(END))
def depth_at(t: Fixtures) -> DataFrame:
    return intervals.depth_at(intervals.depth_runs(intervals.read_spans(t.reads)), t.regions.select("id", "chr", F.col("pos1").alias("pos")))


@query("""select concat_ws(chr(9), d.name, cast("start" as varchar), cast(e as varchar), cast(depth as varchar)) line from (select chr, min("start") "start", max("end") e, depth from
  (select *, sum(f) over (partition by chr order by "start") g from (select *, case when lag("end") over w = "start" and lag(depth) over w = depth then 0 else 1 end f from runs window w as (partition by chr order by "start"))) group by chr, g, depth) r join dict d on r.chr = d.id""", _depth(END))
def bedgraph(t: Fixtures) -> DataFrame:
    return intervals.bedgraph(intervals.depth_runs(intervals.read_spans(t.reads), coalesce=True), t.dictionary)


@query("""select id, chr, cast(s as int) pos1, cast(least(s + 300, pos2) as int) pos2 from (select id, chr, pos1, pos2, unnest(case when pos2 - pos1 > 300 then generate_series(pos1, pos2 - 300, 250) else [cast(pos1 as bigint)] end) s from regions)
  union all select id, chr, cast(l + 300 - 50 as int), pos2 from (select *, pos1 + ((pos2 - 300 - pos1) // 250) * 250 l from regions where pos2 - pos1 > 300) where l + 300 < pos2""")
def tile_region(t: Fixtures) -> DataFrame:
    return intervals.tiles(t.regions, 300, 50)


@query("select id chr, cast(s as int) pos1, cast(s + 50000 as int) pos2 from (select id, unnest(generate_series(0, length - 50000, 40000)) s from dict)")
def tile_genome(t: Fixtures) -> DataFrame:
    return intervals.genome_tiles(t.dictionary, 50_000, 10_000)


@query("select id, chr, pos1, cast(coalesce(lead(pos1) over (order by chr, pos1, pos2, id) - 1, 2000000) as int) pos2, strand from regions")
def stretch_right(t: Fixtures) -> DataFrame:
    return intervals.stretched_right(t.regions, 2_000_000)


@query("select id, chr, cast(coalesce(lag(pos2) over (order by chr, pos1, pos2, id) + 1, 0) as int) pos1, pos2, strand from regions")
def stretch_left(t: Fixtures) -> DataFrame:
    return intervals.stretched_left(t.regions, 0)


@query("select id, chr, pos1, cast(coalesce(lead(pos1) over (partition by chr order by pos1, pos2, id) - 1, pos2) as int) pos2, strand from regions")
def stretch_right_per_chromosome(t: Fixtures) -> DataFrame:
    return intervals.stretched_right(t.regions, per_chr=True)


# --- statistics ---

_KEY = f"coalesce(rg, concat('QNAMED_', {GROUP}))"


@query(f"select {_KEY} read_group, count(*) reads, count(*) filter (flag & 256 <> 0) supplementary, count(*) filter (flag & 256 <> 0) secondary, count(*) filter (flag & 512 <> 0) qc_fail, count(*) filter (flag & 1024 <> 0) duplicate, count(*) filter (flag & 4 <> 0) unmapped, count(*) filter (flag & 8 <> 0) mate_unmapped from reads group by 1")
def rg_stats(t: Fixtures) -> DataFrame:
    return stats.read_group_stats(t.reads)


def _histogram(kind: str, value: str) -> None:
    low, high, width, _ = stats.HISTOGRAMS[kind]
    _VALUES[kind] = value

    def run(t: Fixtures) -> DataFrame:
        return stats.read_group_histogram(t.reads, kind)

    run.__name__ = f"hist_{kind}"
    lo = f"cast({low} + ((greatest({low}, least({high}, {value})) - {low}) // {width}) * {width} as int)"
    query(f"select read_group, lo, cast(least(lo + {width - 1}, {high}) as int) hi, count(*) n from (select {_KEY} read_group, {lo} lo from reads) group by 1, 2")(run)


#: DuckDB's form of the histogrammed values.
_VALUES: dict[str, str] = {}
_histogram("mapq", "mapq")
_histogram("nm", _NM)
_histogram("isize", f"case when not {PAIR} then -2 when tid <> mtid then -1 else abs(pos - mpos) end")
_histogram("clip", _sum("SH"))
_histogram("length", "l_qseq")
_histogram("phred", "cast(floor(list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) / cast(length(qual) as double)) as int)")


@query("select string_agg(concat(lo, '_', hi, '_', n), ',' order by lo) histogram from (select cast(mapq // 10 * 10 as int) lo, cast(least(mapq // 10 * 10 + 9, 60) as int) hi, count(*) n from reads group by 1, 2)")
def histogram_compact(t: Fixtures) -> DataFrame:
    return stats.histogram_compact(stats.histogram(t.reads, F.col("mapq"), 0, 60, 10)).select("histogram")


def _report() -> str:
    counts = {"reads": "true", "supplementary": "flag & 256 <> 0", "qc_fail": "flag & 512 <> 0", "duplicate": "flag & 1024 <> 0", "unmapped": "flag & 4 <> 0", "mate_unmapped": "flag & 8 <> 0"}
    columns = [f"count(*) filter ({c}) {n}" for n, c in counts.items()]
    packed = []
    for kind, value in _VALUES.items():
        low, high, width, _ = stats.HISTOGRAMS[kind]
        lo = f"cast({low} + ((greatest({low}, least({high}, {value})) - {low}) // {width}) * {width} as int)"
        packed.append(f"(select read_group, string_agg(concat(lo, '_', least(lo + {width - 1}, {high}), '_', n), ',' order by lo) {kind} from (select {_KEY} read_group, {lo} lo, count(*) n from reads group by 1, 2) group by 1)")
    return f"select * from (select {_KEY} read_group, {', '.join(columns)} from reads group by 1) " + " ".join(f"join {x} using (read_group)" for x in packed)


@query(_report())
def rg_table(t: Fixtures) -> DataFrame:
    return stats.read_group_table(t.reads)


_CUTS = f"""vs as (select case when tid <> mtid then {stats.INTERCHROMOSOMAL} else abs(pos - mpos) end v from reads where {PAIR}),
  dv as (select v, c, n, lead(v) over (order by v) q from (select cast(v as bigint) v, count(*) c, sum(count(*)) over (order by v) n from vs where v <> {stats.INTERCHROMOSOMAL} group by v)),
  goal as (select greatest(1, ceil(max(n) / 10.0)) g from dv),
  cuts as (select min(v) lo, cast(0 as hugeint) before from dv union all
    select arg_min(d.q, d.n), min(d.n) from cuts c join dv d on d.q - c.lo >= 5 and d.n - c.before >= (select g from goal) group by c.lo having min(d.n) is not null)"""


@query(f"""select cast(lo as bigint) lo, cast(coalesce(lead(lo) over (order by lo) - 1, (select max(v) from dv)) as bigint) hi, cast(coalesce(lead(before) over (order by lo), (select max(n) from dv)) - before as bigint) n from cuts where lo is not null
  union all select v, v, count(*) from vs where v = {stats.INTERCHROMOSOMAL} group by v""", _CUTS)
def hist_equal_frequency(t: Fixtures) -> DataFrame:
    return stats.equal_frequency_bins(t.reads.where(A.pair_mapped()).select(F.when(A.interchromosomal(), stats.INTERCHROMOSOMAL).otherwise(F.abs(F.col("pos") - F.col("mpos"))).cast("long").alias("value")), 10, 5)


@query("select kmer, count(*) n from (select substr(seq, cast(i as int), 8) kmer from reads, range(1, 26) r(i)) where instr(kmer, 'N') = 0 group by 1")
def kmer_counts(t: Fixtures) -> DataFrame:
    return kmers.kmer_counts(t.sequences, 8)


_CANONICAL = f"km as (select least(kmer, {COMPLEMENT.format('kmer')}) kmer, count(*) n from (select substr(seq, cast(i as int), 8) kmer from reads, range(1, 26) r(i)) where instr(kmer, 'N') = 0 group by 1), sp as (select cast(least(n, 255) as int) n, count(*) kmers from km group by 1)"


@query("select * from sp", _CANONICAL)
def kmer_spectrum(t: Fixtures) -> DataFrame:
    return kmers.kmer_spectrum(kmers.kmer_counts(t.sequences, 8, canonical=True))


@query("select kcov, cast(greatest(3, least(255, floor(kcov * 0.1 + 0.499))) as int) min_cov from (select cast(sum(n * kmers) as double) / cast(sum(kmers) as double) kcov from sp where n >= 3)", _CANONICAL)
def kmer_coverage(t: Fixtures) -> DataFrame:
    return kmers.kmer_coverage(kmers.kmer_spectrum(kmers.kmer_counts(t.sequences, 8, canonical=True)))


@query("select qname, tid, pos from reads order by tid, pos, qname, cigar, flag")
def sorted_by_position(t: Fixtures) -> DataFrame:
    """The whole table in order."""
    return t.reads.orderBy("tid", "pos", "qname", "cigar", "flag").select("qname", "tid", "pos")


@query("select qname, mtid, mpos from reads order by mtid, mpos, qname, cigar, flag")
def sorted_by_mate(t: Fixtures) -> DataFrame:
    """The whole table in order."""
    return t.reads.orderBy("mtid", "mpos", "qname", "cigar", "flag").select("qname", "mtid", "mpos")


@query("select qname, tid, pos, mapq, cast(k as int) rank from (select *, row_number() over w - 1 k, first_value(mapq) over w f from (select concat('Q', cast(pos % 1000 as varchar)) qname, tid, pos, mapq, flag, cigar, seq from reads) window w as (partition by qname order by mapq desc, tid, pos, flag, cigar, seq)) where k <= 5 and (k = 0 or mapq >= 0.8 * f)")
def primary_secondary_rank(t: Fixtures) -> DataFrame:
    hits = t.reads.select(F.concat(F.lit("Q"), F.pmod("pos", F.lit(1000)).cast("string")).alias("qname"), "tid", "pos", "mapq", "flag", "cigar", "seq")
    return stats.alignment_order(hits, 0.8, 5).select("qname", "tid", "pos", "mapq", F.col("rank").cast("int").alias("rank"))


# --- sequence engines: rows only ---


def _laid(rows: DataFrame, key: str, order: str) -> DataFrame:
    """name and seq of each ``key``: its sequences end to end, N read as A."""
    sequences = F.transform(F.sort_array(F.collect_list(F.struct(order, "seq"))), lambda x: F.translate(x["seq"], "N", "A"))
    return rows.groupBy(F.col(key).alias("name")).agg(F.array_join(sequences, "").alias("seq"))


def _regional(t: Fixtures) -> DataFrame:
    """All reads' sequences by region of 2 ** 12 positions."""
    return _laid(t.reads.select(F.concat_ws(":", "tid", F.shiftright("pos", 12)).alias("region"), "qname", "seq"), "region", "qname")


def _references(t: Fixtures) -> DataFrame:
    """Four references: the read of least name in each 1,000 positions of chromosomes 0 to 3, so 128,000 bases at most at any scale."""
    rows = t.reads.where("tid < 4").groupBy("tid", F.floor(F.col("pos") / 1000).alias("bin")).agg(F.min(F.struct("qname", "seq")).alias("r"))
    return _laid(rows.select(F.concat(F.lit("ref"), F.col("tid").cast("string")).alias("ref"), "bin", "r.seq"), "ref", "bin").orderBy("name")


ORACLES["hist_equal_frequency"] = ORACLES["hist_equal_frequency"].replace("with ", "with recursive ", 1)


@query()
def align_reads(t: Fixtures) -> DataFrame:
    """All reads against the references, N read as A as there."""
    queries = t.sequences.select("name", F.translate("seq", "N", "A").alias("seq"))
    return align.align_sequences(queries, _references(t)).select("qname", "flag", "tid", "pos", "mapq", "cigar", "score", "nm", "na")


@query()
def smith_waterman(t: Fixtures) -> DataFrame:
    both = t.reads.select("qname", "seq", F.concat(F.lit("ACGTT"), F.substring("seq", 4, 24), F.lit("GGATC")).alias("target"))
    return both.select("qname", align.smith_waterman(F.col("seq"), F.col("target")).alias("a")).select("qname", "a.*")


_REGIONAL = "rg as (select concat_ws(':', tid, pos >> 12) name, string_agg(replace(seq, 'N', 'A'), '' order by qname, seq) seq from reads group by 1)"


@query('select substr(seq, cast(i + 1 as int), 15) kmer, name, cast(i as int) "at" from (select name, seq, unnest(range(0, length(seq) - 14)) i from rg where length(seq) >= 15)', _REGIONAL)
def seed_index(t: Fixtures) -> DataFrame:
    return align.seed_index(_regional(t))


def _shotgun(t: Fixtures) -> DataFrame:
    """Fragments of 50 bases at every seventh base and at the end of each region's sequence, the region as their group."""
    last = F.greatest(F.length("seq") - 50, F.lit(0))
    ends = F.array_union(F.sequence(F.lit(0), last, F.lit(7)), F.array(last))
    cut = align.pieces(_regional(t), ends, 50, "name")
    return cut.select(F.concat_ws(":", "name", (F.col("at") + 1).cast("string")).alias("name"), F.col("piece").alias("seq"), F.lit(None).cast("string").alias("qual"), F.col("name").alias("group"))


@query()
def correct_reads(t: Fixtures) -> DataFrame:
    """All reads; those of one name are copies, so each gets the changes of its name."""
    reads = t.sequences
    return correct.correct(reads, correct.train(correct.checked(reads), 21, 2), 1).select("name", "seq")


@query()
def assemble_contigs(t: Fixtures) -> DataFrame:
    return assemble.assemble(_shotgun(t), assemble.Options(k=25)).select("group", "id", "name", "seq", "reads", "depth")


@query()
def gfa_export(t: Fixtures) -> DataFrame:
    """One graph of all groups."""
    return writers.assembled_gfa_lines(assemble.assemble(_shotgun(t), assemble.Options(k=25)), 24)


@query()
def plot_lines(t: Fixtures) -> DataFrame:
    return plot.plot_reads(t.reads, 3, 100_000, 110_000)


# --- files written and read again ---


@query("select chr, pos1, pos2 from regions")
def bed_round_trip(t: Fixtures) -> DataFrame:
    path = t.folder("regions.bed")
    writers.write_lines(writers.bed_lines(t.regions, t.dictionary), path)
    return readers.read_bed(t.spark, path, t.dictionary).select("chr", "pos1", "pos2")


@query("select chr, pos1, pos1 pos2 from regions")
def vcf_sites(t: Fixtures) -> DataFrame:
    path = t.folder("sites.vcf")
    named = D.with_name(t.regions, t.dictionary).select(F.concat_ws("\t", "name", F.col("pos1").cast("string"), F.lit("."), F.lit("A"), F.lit("C")).alias("line"))
    head = t.spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT",)], "line string")
    writers.write_lines(head.unionByName(named), path)
    return readers.read_vcf(t.spark, path, t.dictionary).select("chr", "pos1", "pos2")


@query("select 'bed' kind, chr, pos1, pos2 from regions union all select 'vcf', chr, pos1, pos1 from regions union all select 'text', 2, 1000, 2000 union all select 'text', 22, 5, (select cast(length as int) from dict where name = 'X')")
def region_sources(t: Fixtures) -> DataFrame:
    """Regions from files told apart by their names, and from strings."""
    bed, vcf = t.folder("some.bed"), t.folder("some.vcf")
    writers.write_lines(writers.bed_lines(t.regions, t.dictionary), bed)
    named = D.with_name(t.regions, t.dictionary).select(F.concat_ws("\t", "name", F.col("pos1").cast("string")).alias("line"))
    writers.write_lines(named, vcf)
    parts = {"bed": [bed], "vcf": [vcf], "text": ["3:1,000-2,000", "X:5"]}
    found = [readers.regions(t.spark, source, t.dictionary).select(F.lit(kind).alias("kind"), "chr", "pos1", "pos2") for kind, sources in parts.items() for source in sources]
    return intervals.concatenated(*found)


@query("select chr, pos1, pos2, cast((id % 4) / 4.0 as double) frac from regions")
def bed_fractions(t: Fixtures) -> DataFrame:
    path = t.folder("fractions.bed")
    named = D.with_name(t.regions, t.dictionary)
    writers.write_lines(named.select(F.concat_ws("\t", "name", F.col("pos1").cast("string"), F.col("pos2").cast("string"), (F.pmod("id", F.lit(4)) / 4.0).cast("string")).alias("line")), path)
    return readers.read_bed(t.spark, path, t.dictionary, fraction=True).select("chr", "pos1", "pos2", "frac")


@query("select chr, pos1, pos2, '*' strand from spans", _SPANS)
def regions_of_reads(t: Fixtures) -> DataFrame:
    return readers.regions_of_reads(t.reads).drop("id")


@query("select * from (values (0, 1, 10, 20, '+'), (1, 1, 20, 20, '*'), (2, -1, 0, 0, '-')) v(id, chr, pos1, pos2, strand)")
def region_literals(t: Fixtures) -> DataFrame:
    return readers.region_table(t.spark, [(1, 10, 20, "+"), (1, 20, 20, "*"), (-1, 0, 0, "-")]).withColumn("id", F.col("id").cast("int"))


@query("select id, (chr = -1 and pos1 = 0 and pos2 = 0) empty, true valid from (select id, chr, pos1, pos2 from regions union all select -1, -1, 0, 0)")
def region_validity(t: Fixtures) -> DataFrame:
    none = t.spark.createDataFrame([(-1, -1, 0, 0, "*")], t.regions.schema)
    return t.regions.unionByName(none).select("id", R.is_empty().alias("empty"), R.checked().alias("valid"))


@query("select qname name, seq from reads")
def fasta_round_trip(t: Fixtures) -> DataFrame:
    path = t.folder("reads.fa")
    writers.write_lines(writers.fasta_lines(t.sequences), path)
    return readers.read_fasta(t.spark, path).select("name", "seq")


@query("select qname name, seq, qual from reads")
def fastq_round_trip(t: Fixtures) -> DataFrame:
    path = t.folder("reads.fq")
    writers.write_lines(t.sequences.select(S.fastq().alias("line")), path)
    return readers.read_fastq(t.spark, path).select("name", "seq", "qual")


def _records(t: Fixtures) -> DataFrame:
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    return t.reads.withColumn("tags", S.with_tag("RG", "Z", F.col("rg"), tags=S.with_tag("NM", "i", F.col("nm"), tags=empty))).withColumn("isize", F.lit(0))


_FIELDS = ["qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "l_qseq", "seq", "qual", "rg", "nm"]


@query(f"select {', '.join(_FIELDS)} from reads")
def merged_sam_files(t: Fixtures) -> DataFrame:
    """Two SAM files, with headers, as one table in coordinate order."""
    paths = [t.folder(f"{k}.sam") for k in (0, 1)]
    for k, path in enumerate(paths):
        writers.write_sam(_records(t).where(F.pmod("pos", F.lit(2)) == k), t.dictionary, path)
    return readers.read_merged(t.spark, paths, t.dictionary).select(*_FIELDS)


@query("select id, name, length from dict")
def sam_header_dictionary(t: Fixtures) -> DataFrame:
    path = t.folder("header.sam")
    writers.write_sam(_records(t).where("tid = 0"), t.dictionary, path)
    return D.from_text(t.spark, readers.sam_header(t.spark, path))


@query(f"select {', '.join(_FIELDS)} from reads")
def bam_round_trip(t: Fixtures) -> DataFrame:
    path = t.folder("bam")
    writers.write_bam(_records(t), t.dictionary, path.removeprefix("file:"))
    return readers.read_bam(t.spark, path).select(*_FIELDS)


@query("select id, name, length from dict")
def bam_header_dictionary(t: Fixtures) -> DataFrame:
    path = t.folder("bam")
    writers.write_bam(_records(t).where("tid = 0"), t.dictionary, path.removeprefix("file:"))
    return readers.read_bam_dictionary(t.spark, path)


@query("select qname, tid, pos from reads where tid = 3 and pos between 100000 and 400000")
def indexed_layout(t: Fixtures) -> DataFrame:
    path = t.folder("reads.parquet")
    writers.write_indexed(t.reads, path, 8)
    return t.spark.read.parquet(path).where("tid = 3 and pos between 100000 and 400000").select("qname", "tid", "pos")


@query("select qname, pos from reads where contains(seq, 'ACGTA') or contains(seq, 'GGGCC')")
def motif_file(t: Fixtures) -> DataFrame:
    path = t.folder("motifs.txt")
    writers.write_lines(t.spark.createDataFrame([("ACGTA",), ("",), (" GGGCC ",)], "line string"), path)
    return t.reads.where(M.contains_motif(F.col("seq"), readers.read_motifs(t.spark, path))).select("qname", "pos")


_GAPPED = "case cigar when '32M' then seq when '5S27M' then substr(seq, 6, 27) when '10M2I20M' then substr(seq, 1, 10) || substr(seq, 13, 20) when '16M3D16M' then substr(seq, 1, 16) || '---' || substr(seq, 17, 16) when '20M12S' then substr(seq, 1, 20) else substr(seq, 1, 28) end"


@query(f"select qname, {_GAPPED} gapped from reads")
def gapped_sequences(t: Fixtures) -> DataFrame:
    return t.reads.select("qname", plot.gapped_sequence("seq", "cigar").alias("gapped"))


@query("select doc_id, cast(len(regexp_extract_all(lower(text), '(^|[^\\p{L}])(and|the|of)($|[^\\p{L}])')) > 0 as boolean) found from documents where text is not null")
def motif_whole_words(t: Fixtures) -> DataFrame:
    """Whether a document holds one of three words, any case, as a word of its own."""
    held = M.holds_motif(F.col("text"), ("and", "the", "of"), ignore_case=True, whole_words=True)
    return t.table("documents").where("text is not null").select("doc_id", held.alias("found"))


@query("select qname, length(seq) - length(replace(seq, 'ACG', '')) letters, replace(replace(seq, 'A', ''), 'C', '') bare, upper(lower(seq)) big from reads")
def sequence_text(t: Fixtures) -> DataFrame:
    hits = M.motif_hits(F.col("seq"), ("ACG",), without_overlaps=True)
    letters = F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    bare = S.scrub(S.scrub("seq", "A"), "C")
    return t.reads.select("qname", letters.alias("letters"), bare.alias("bare"), F.upper(F.lower("seq")).alias("big"))


@query("select a.qname, a.pos, (a.tid, a.pos) < (a.mtid, a.mpos) before_mate, (a.tid, a.pos) = (a.mtid, a.mpos) at_mate, a.qname is null missing from reads a")
def record_order(t: Fixtures) -> DataFrame:
    mate = F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
    return t.reads.select("qname", "pos", (A.position_key() < mate).alias("before_mate"), (A.position_key() == mate).alias("at_mate"), A.is_missing().alias("missing"))


@query("select id, chr, pos1, pos2, strand from regions")
def shuffled_regions(t: Fixtures) -> DataFrame:
    return intervals.shuffled(t.regions, 7)


@query("select id, chr, pos1, pos2, strand from regions where id = 17")
def region_at(t: Fixtures) -> DataFrame:
    return t.regions.where("id = 17")


@query("select * from (values (0, 90, 205), (1, 10, 20)) v(chr, pos1, pos2)")
def filter_regions(t: Fixtures) -> DataFrame:
    """Regions added to a filter, overlapping ones merged, and listed again."""
    made = rules.ReadFilter("A", (), None, False, False).with_regions([(0, 100, 200), (1, 10, 20)]).with_regions([(0, 90, 100), (0, 150, 205)])
    return t.spark.createDataFrame(rules.FilterCollection().add(made).regions(), "chr int, pos1 int, pos2 int")


@query(f"select qname, flag, pos from reads r where exists (select 1 from regions g where g.chr = r.tid and r.pos <= g.pos2 and {END} >= g.pos1)")
def distinct_region_scan(t: Fixtures) -> DataFrame:
    return intervals.scan_regions(t.reads, t.regions, distinct=True).select("qname", "flag", "pos")
